"""Dense frames and their files: against pixel rows and plain versions, of several videos, at two sizes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.operators import dense, detection, layers, pixels
from flightloom.sources import config, readers, video_files

DET = config.DEFAULTS["detection"] | {"threshold_mode": "fixed", "diff_threshold": 25}


def frames_of(spark, videos):
    rows = [(v, f, *image.shape, bytearray(image.astype(np.uint8).tobytes())) for v, images in videos.items() for f, image in images]
    return spark.createDataFrame(rows, dense.FRAME)


def noisy(n, h, w, seed=1, level=60, size=8):
    """A bright block that moves over noise."""
    rng = np.random.default_rng(seed)
    out = []
    for f in range(n):
        image = level + rng.integers(-3, 4, (h, w))
        y, x = 4 + 2 * f % (h - size - 4), 5 + 3 * f % (w - size - 5)
        image[y : y + size, x : x + size] = 200
        out.append((f, image))
    return out


def images_by_video(df, column="pixels", kind=np.uint8):
    return {r.video_id: np.frombuffer(r[column], kind).reshape(r.h, r.w) for r in df.collect()}


@pytest.fixture(scope="module")
def two(spark):
    return {"a": noisy(12, 40, 52), "long": noisy(45, 30, 44, 2, 90)}


@pytest.fixture(scope="module")
def frames(spark, two):
    return frames_of(spark, two).repartition(5).cache()


def test_pixels_and_back(spark, frames, two):
    px = dense.to_pixels(frames)
    assert px.count() == 12 * 40 * 52 + 45 * 30 * 44
    assert frames.exceptAll(dense.from_pixels(px)).count() == 0
    only = dense.to_pixels(frames, above=150).collect()
    assert {(r.video_id, r.frame, r.y, r.x) for r in only} == {(v, f, y, x) for v, images in two.items() for f, i in images for y, x in np.argwhere(i > 150)}


def test_pixel_rows_are_linear_in_the_pixels(spark):
    """Four times the pixels take about four times as long, not sixteen; a frame of 1024 x 576 is read in seconds."""
    took = []
    for side in (256, 512, 1024):
        one = frames_of(spark, {"v": [(0, np.arange(side * side).reshape(side, side) % 256)]})
        began = time.time()
        assert readers.pixels_of(one).agg(F.count("*"), F.sum("v")).first()[0] == side * side
        took.append(time.time() - began)
    assert took[2] < 6 * took[1] + 2 and took[2] < 20


def test_background_of_each_video_from_its_own_frames(spark):
    """A short video beside one a hundred times as long: its samples lie in its own frames (a level of 10 but in frame 0)."""
    flat = lambda v: np.full((6, 7), v)
    videos = {"short": [(f, flat(200 if f == 0 else 10)) for f in range(100)], "long": [(f, flat(30)) for f in range(0, 10_000, 50)]}
    f = frames_of(spark, videos)
    numbers = dense.sample_numbers(dense.context(dense.frame_counts(f), 25.0, 0.0, -1), 20)
    assert numbers.where("video_id = 'short'").count() == 20 and numbers.agg(F.max("frame")).first()[0] == 9950
    got = images_by_video(dense.background(dense.at(f, numbers), tile=10))
    assert (got["short"] == 10).all() and (got["long"] == 30).all()


def test_sample_numbers_and_context(spark):
    counts = spark.createDataFrame([("a", 40), ("b", 3), ("c", 1), ("d", 1000)], "video_id string, frame_count long")
    for n, uniform, start, length in ((7, True, 0.5, 1.0), (5, False, 0.1, -1.0), (1, True, 0.0, 0.0), (300, True, 2.0, 30.0)):
        cx = {r.video_id: (r.first, r.end) for r in dense.context(counts, 25.0, start, length).collect()}
        got = dense.sample_numbers(dense.context(counts, 25.0, start, length), n, uniform).collect()
        for v, total in (("a", 40), ("b", 3), ("c", 1), ("d", 1000)):
            first = min(max(0, round(start * 25)), max(0, total - 1))
            end = total if length <= 0 else min(total, first + max(1, round(length * 25)))
            assert cx[v] == (first, end)
            assert sorted(r.frame for r in got if r.video_id == v) == pixels.sample_frames(total, n, uniform, first, end)


def test_background_and_kernels_equal_those_of_pixel_rows(spark, frames, two):
    got = images_by_video(dense.background(frames, tile=100))
    for v, images in two.items():
        assert (got[v] == np.floor(np.median([i for _, i in images], axis=0))).all()
    blurred = {(r.video_id, r.frame): np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w) for r in dense.blurred(frames, 5).collect()}
    assert all((blurred[v, f] == np.rint(pixels.gaussian(i, 5))).all() for v, images in two.items() for f, i in images)
    thresholds = {(r.video_id, r.frame): r.threshold for r in dense.otsu(frames, 3).collect()}
    assert all(thresholds[v, f] == min(255, max(1, detection.otsu_level(i) + 3)) for v, images in two.items() for f, i in images)


def plain_heat(images, threshold, blur, size, chunk_free=None):
    heat, last = 0.0, None
    for _, image in images:
        image = np.rint(pixels.gaussian(image, blur))
        if last is not None:
            change = np.abs(image - last)
            mask = change > threshold
            if size > 1:
                mask = pixels.moved(pixels.moved(mask, pixels.ellipse(size), False), pixels.ellipse(size), True)
            heat = heat + np.where(mask, change, 0.0)
        last = image
    return heat


@pytest.mark.parametrize("chunk,blur,size", [(1, 0, 0), (7, 5, 3), (64, 3, 3)])
def test_heat_over_chunks(spark, frames, two, chunk, blur, size):
    got = images_by_video(dense.motion_energy(frames, 14, blur, size, chunk=chunk, tile=64), "energy", np.float64)
    for v, images in two.items():
        assert np.allclose(got[v], plain_heat(images, 14, blur, size))


def test_heat_over_gaps_and_in_a_region(spark):
    images = [(f, i) for f, i in noisy(30, 20, 24) if f not in (3, 8, 9, 10, 11, 12, 13, 14, 15, 16)]
    half = np.zeros((20, 24), int)
    half[:, 12:] = 255
    region = spark.createDataFrame([("v", 20, 24, bytearray(half.astype(np.uint8).tobytes()))], "video_id string, h int, w int, pixels binary")
    got = images_by_video(dense.motion_energy(frames_of(spark, {"v": images}), 14, region=region, chunk=4), "energy", np.float64)["v"]
    assert np.allclose(got, np.where(half > 0, plain_heat(images, 14, 0, 0), 0))
    one = images_by_video(dense.motion_energy(frames_of(spark, {"v": images[:1]}), 14), "energy", np.float64)["v"]
    assert not one.any()


@pytest.mark.parametrize("mode", ["fixed", "otsu", "adaptive"])
def test_detections_equal_those_of_pixel_rows(spark, frames, mode):
    cfg = DET | {"threshold_mode": mode, "max_global_intensity_shift": 20.0, "adaptive_block_size": 31, "roi_x_min": 22.0, "roi_x_max": 40.0, "centroid_mode": "moments"}
    images = dense.background(frames).cache()
    found = dense.detect(frames, images, cfg)
    back = dense.to_pixels(images)
    for video, size in (("a", (52, 40)), ("long", (44, 30))):
        own = F.col("video_id") == video
        plain = detection.detect(dense.to_pixels(frames.where(own)), back.where(own), cfg, size)
        assert found.where(own).exceptAll(plain).count() == 0 == plain.exceptAll(found.where(own)).count()
    assert found.select("video_id").distinct().count() == 2


def test_detection_at_full_size_in_seconds(spark):
    """48 frames of 1024 x 576 with a noisy one: a broadcast image, no row a pixel."""
    images = noisy(48, 576, 1024, size=20)
    rng = np.random.default_rng(0)
    images[5] = (5, np.where(rng.random((576, 1024)) < 0.02, 250, images[5][1]))
    f = frames_of(spark, {"v": images}).repartition(8).cache()
    f.count()
    began = time.time()
    background = dense.background(f).cache()
    found = dense.detect(f, background, DET | {"min_area": 50}).collect()
    assert time.time() - began < 90
    assert {r.frame for r in found} >= set(range(48)) - {5}
    explained = dense.detect(f, background, DET)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in explained


def test_an_image_of_another_size_is_an_error(spark, frames):
    wrong = spark.createDataFrame([("a", 3, 3, bytearray(9)), ("long", 30, 44, bytearray(30 * 44))], "video_id string, h int, w int, pixels binary")
    with pytest.raises(Exception, match="size"):
        dense.frame_stats(frames, wrong, 1.0).collect()
    with pytest.raises(Exception, match="bytes"):
        dense.to_pixels(spark.createDataFrame([("a", 0, 3, 3, bytearray(5))], dense.FRAME)).collect()
    mixed = frames_of(spark, {"v": [(0, np.zeros((3, 4))), (1, np.zeros((4, 3)))]})
    with pytest.raises(Exception, match="several sizes"):
        dense.background(mixed).collect()


def test_nothing_gives_nothing(spark, frames):
    none = frames.where("false")
    back = dense.background(none)
    for df in (back, dense.motion_energy(none), dense.detect(none, back, DET), dense.to_pixels(none), dense.otsu(none), dense.vegetation_mask(dense.vegetation_samples(none, dense.frame_counts(none)))):
        assert df.count() == 0


def test_valid_regions_by_three_methods(spark):
    """A dark hole left of the middle of a lit band: the band, the hole, the hole within the band."""
    from functools import partial

    image = np.full((60, 90), 20)
    image[:, 15:75] = 180
    image[20:45, 30:50] = 40
    images = spark.createDataFrame([("v", 60, 90, bytearray(image.astype(np.uint8).tobytes()))], "video_id string, h int, w int, pixels binary")
    band = pixels.valid_band(dense.column_profile(images, 3), 5, 0.45, 2, 0.3)
    x0, x1 = band.select("x_start", "x_end").first()
    assert 14 <= x0 <= 19 and 71 <= x1 <= 76
    area = {}
    for method in ("horizontal_illumination_profile", "central_deep_layer", "hybrid_deep_layer_profile"):
        kernel = partial(layers.region_mask, method=method, cfg=layers.Layers(3, 60.0, 5))
        px = dense.region_masks(images, band, kernel)
        area[method] = {(r.x, r.y) for r in px.collect()}
    assert len(area["horizontal_illumination_profile"]) == 60 * (x1 - x0 + 1)
    hole = area["hybrid_deep_layer_profile"]
    assert (40, 30) in hole and all(29 <= x <= 51 and 19 <= y <= 46 for x, y in hole) and len(hole) > 400


def test_run_from_dense_frames_of_two_videos(spark):
    """Tracks of both videos with every region method; the short video has its own background."""
    from flightloom.plans import run

    videos = {}
    for v, n in (("short", 14), ("long", 40)):
        back = np.full((48, 64), 60)
        back[:, 6:58] = 90
        images = []
        for f in range(n):
            image = back.copy()
            image[10 + f // 2 : 18 + f // 2, 8 + f : 16 + f] = 200
            images.append((f, image))
        videos[v] = images
    f = frames_of(spark, videos)
    for method in ("horizontal_illumination_profile", "central_deep_layer", "hybrid_deep_layer_profile"):
        cfg = {
            "detection": {"threshold_mode": "fixed"}, "tracking": {"tracker": "greedy"}, "cave_zones": {"method": "motion", "motion_percentile": 50.0, "dilate_px": 0},
            "valid_region": {"method": method, "apply_to_detection": False, "blur_kernel_size": 3, "profile_smooth_window": 3, "safety_margin": 1, "depth_morph_kernel": 3, "depth_percentile": 60.0},
            "vegetation_noise": {"enabled": True, "auto_scale_with_resolution": False, "exclude_entry_exit_dilate_px": 1, "mask_dilate_px": 1},
        }
        r = run.run(cfg, (64, 48), frames=f)
        lengths = {(k.video_id): k.n for k in r.raw_points.groupBy("video_id").agg(F.count("*").alias("n")).collect()}
        assert lengths["short"] >= 10 and lengths["long"] >= 30
        assert r.background.where("x = 30 and y = 2").select("v").distinct().collect()[0].v == 90
        assert {s.kind for s in r.source_scores.collect()} >= {"valid_region"} and r.region.count() > 0
        if method != "horizontal_illumination_profile":
            continue
        inside = run.run(cfg | {"valid_region": cfg["valid_region"] | {"apply_to_detection": True}}, (64, 48), frames=f)
        assert inside.raw_points.agg(F.min("x")).first()[0] >= 6


# ---- files

@pytest.fixture(scope="module")
def files(spark, frames, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("videos"))
    done = video_files.write_y4m(frames.where("video_id <> 'long' or frame not in (20, 21)"), path, segment=16).collect()
    assert sum(r.frames for r in done) == 12 + 43 and len({r.path for r in done}) == 5
    return path


@pytest.mark.parametrize("part_bytes", [500, 5000, 1 << 20])
def test_y4m_round_trip(spark, frames, files, part_bytes):
    got = video_files.frames(spark, files, part_bytes)
    want = frames.where("video_id <> 'long' or frame not in (20, 21)")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert {tuple(r) for r in video_files.videos(spark, files).collect()} == {("a", 25.0, 12, 52, 40), ("long", 25.0, 45, 44, 30)}


def test_conditions_reach_the_files(spark, files):
    reader = video_files.FrameReader({"path": files, "partbytes": "100000"})
    left = list(reader.pushFilters([video_files.GreaterThanOrEqual(("frame",), 17), video_files.LessThan(("frame",), 20), video_files.EqualTo(("video_id",), "long"), video_files.EqualTo(("h",), 30)]))
    assert [f.attribute for f in left] == [("h",)]
    pieces = reader.partitions()
    assert {r[1] for p in pieces for r in p.ranges} == {"long"} and len([r for p in pieces for r in p.ranges]) == 2
    assert [f[1] for p in pieces for f in reader._frames(p)] == [17, 18, 19]
    df = video_files.frames(spark, files).where("frame >= 17 and frame < 20 and video_id = 'long' and h = 30")
    assert sorted(r.frame for r in df.collect()) == [17, 18, 19]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "frame_files" in plan and "< 20" not in plan and "= 30" in plan  # what the reader takes is not checked again
    assert video_files.frames(spark, files).where("video_id in ('a', 'x')").count() == 12
    assert video_files.frames(spark, files).where("frame > 100").count() == 0


def test_images_and_chroma(spark, tmp_path):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rgb = np.arange(36, dtype=np.uint8).reshape(3, 4, 3) * 7
    (tmp_path / "s@0003.pgm").write_bytes(b"P5\n# a note\n4 3\n255\n" + grey.tobytes())
    (tmp_path / "s@0004.ppm").write_bytes(b"P6 4 3 255\n" + rgb.tobytes())
    (tmp_path / "c.y4m").write_bytes(b"YUV4MPEG2 W4 H3 F30000:1001 C420jpeg\n" + b"".join(b"FRAME\n" + (grey + i).tobytes() + bytes(8) for i in range(3)))
    (tmp_path / "notes.txt").write_text("no frames")
    got = {(r.video_id, r.frame): np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w) for r in video_files.frames(spark, str(tmp_path), 30).collect()}
    assert set(got) == {("s", 3), ("s", 4), ("c", 0), ("c", 1), ("c", 2)}
    assert (got["s", 3] == grey).all() and (got["c", 2] == grey + 2).all()
    assert (got["s", 4] == np.rint(rgb @ np.array([0.299, 0.587, 0.114]))).all()
    fps = {r.video_id: (round(r.fps, 2), r.frame_count) for r in video_files.videos(spark, str(tmp_path)).collect()}
    assert fps == {"s": (25.0, 5), "c": (29.97, 3)}


@pytest.mark.parametrize("name,data,match", [
    ("x.y4m", b"RIFF....", "YUV4MPEG2"), ("x.y4m", b"YUV4MPEG2 W4 H3 F25:1 C420p10\n", "colour space"), ("x.y4m", b"YUV4MPEG2 W4 H3 F25:1 Cmono\nFRAME\n123", "cut short"),
    ("x.y4m", b"YUV4MPEG2 W2 H2 F25:1 Cmono\nFRAME Ip\n1234", "parameters"), ("x.pgm", b"P2 1 1 255\n3", "binary PGM"), ("x.pgm", b"P5 2 2 255\n123", "cut short"),
])
def test_broken_files_are_errors(spark, tmp_path, name, data, match):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(Exception, match=match):
        video_files.frames(spark, str(tmp_path)).collect()


def test_a_folder_without_videos(spark, tmp_path):
    assert video_files.frames(spark, str(tmp_path)).count() == 0 and video_files.videos(spark, str(tmp_path)).count() == 0


def test_heat_of_tiles_on_a_stream(spark, tmp_path):
    """Frames of 256 x 256 in three batches, one of them late: the sums of a batch, a row a tile."""
    from flightloom.streaming import stateful

    images = noisy(9, 256, 256, 6, size=30)
    for part in (images[:4], images[4:7], [*images[7:], (2, images[5][1])]):
        frames_of(spark, {"v": part}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(dense.FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.motion_heat_tile_stream(stream, 14.0).writeStream.format("memory").queryName("tile_heat").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    rows = spark.table("tile_heat")
    assert rows.select("tile").distinct().count() == 16 and rows.count() <= 3 * 16
    got = images_by_video(stateful.whole_heat(rows), "energy", np.float64)["v"]
    assert np.allclose(got, plain_heat(images, 14, 0, 0)) and got.any()
