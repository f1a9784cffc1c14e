"""The detection chain, contours, gates and streams against plain versions."""

import math
import random

import numpy as np
import pytest

from flightloom.operators import detection, pixels, tracking, windows
from flightloom.sources import config
from flightloom.streaming import stateful

DET = config.DEFAULTS["detection"]


def flood(image):
    """Components by flood fill, in scan order."""
    labels, n = np.zeros(image.shape, int), 0
    for y, x in zip(*np.nonzero(image)):
        if labels[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        labels[y, x] = n
        while todo:
            a, b = todo.pop()
            for i in range(max(0, a - 1), min(image.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(image.shape[1], b + 2)):
                    if image[i, j] and not labels[i, j]:
                        labels[i, j] = n
                        todo.append((i, j))
    return labels


def test_labels_by_flood_fill():
    rng = np.random.default_rng(3)
    for density in (0.2, 0.5, 0.8):
        image = rng.random((40, 33)) < density
        assert (pixels.label_image(image) == flood(image)).all()
    line = np.zeros((61, 61), bool)  # a winding line is one component
    line[::4] = True
    line[1:4, -1] = line[5:8, 0] = line[9:12, -1] = True
    assert (pixels.label_image(line) == flood(line)).all() and not pixels.label_image(np.zeros((3, 3), bool)).any()


def test_images_are_labelled_together(spark, monkeypatch):
    """Numbers of each image's own, however images fall into batches and canvases; many images are one call."""
    rng, calls, label = np.random.default_rng(6), [], pixels.label_image
    images = [rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.5 for _ in range(60)]
    rows = [(f"v{i % 3}", i // 3, int(x) + 5, int(y) + 7) for i, image in enumerate(images) for y, x in zip(*np.nonzero(image))]
    want = {(f"v{i % 3}", i // 3, x + 5, y + 7): int(n) for i, image in enumerate(images) for (y, x), n in np.ndenumerate(label(image)) if n}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = pixels.components(spark.createDataFrame(rows, "video_id string, frame long, x int, y int"), ["video_id", "frame"]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r)[:4]: r.component for r in got} == want and len(got) == len(rows)
    order = sorted(rows, key=lambda r: r[:2])
    first = np.array([i for i, r in enumerate(order) if not i or r[:2] != order[i - 1][:2]])
    x, y = (np.array([r[k] for r in order]) for k in (2, 3))
    monkeypatch.setattr(pixels, "label_image", lambda image: calls.append(1) or label(image))
    for canvas, most in ((1, len(first)), (200, 40), (1 << 22, 1)):
        monkeypatch.setattr(pixels, "CANVAS", canvas)
        calls.clear()
        assert pixels.component_numbers(x, y, first).tolist() == [want[r] for r in order] and len(calls) <= most


def test_outline_and_area():
    box = np.zeros((9, 9), bool)
    box[2:6, 3:8] = True
    path = pixels.outline(box)
    assert len(path) == 14 and path[0] == (3, 2) and pixels.polygon_area(path) == 4 * 3
    assert pixels.outline(np.eye(1, dtype=bool)) == [(0, 0)] and pixels.polygon_area([(0, 0)]) == 0
    line = np.zeros((3, 6), bool)
    line[1, 1:5] = True
    assert pixels.polygon_area(pixels.outline(line)) == 0 and set(pixels.outline(line)) == {(x, 1) for x in range(1, 5)}
    triangle = np.tri(12, dtype=bool)
    x, y = detection.centre_of_mass(pixels.outline(triangle))
    assert y - 5.5 > 1 and 5.5 - x > 1  # below and left of the box's centre


def px(spark, images):
    rows = [("v", f, x, y, float(image[y, x])) for f, image in enumerate(images) for y in range(image.shape[0]) for x in range(image.shape[1])]
    return spark.createDataFrame(rows, "video_id string, frame long, x int, y int, v double")


def test_detection_of_a_moving_block(spark):
    back = np.full((48, 64), 60.0)
    images = []
    for f in range(6):
        image = back.copy()
        image[10 + 3 * f : 18 + 3 * f, 5 + 6 * f : 13 + 6 * f] = 180
        images.append(image)
    images.append(back + 40)  # a flash: the whole frame moved
    background = px(spark, [back]).drop("frame")
    found = {}
    for mode in ("fixed", "otsu", "adaptive"):
        cfg = DET | {"threshold_mode": mode, "max_global_intensity_shift": 20.0, "adaptive_block_size": 31}
        found[mode] = detection.detect(px(spark, images), background, cfg, (64, 48)).orderBy("frame").collect()
        assert [r.frame for r in found[mode]] == list(range(6))
        for r in found[mode]:
            assert abs(r.x - (9 + 6 * r.frame)) <= 1 and abs(r.y - (14 + 3 * r.frame)) <= 1 and 30 <= r.area <= 120
    roi = DET | {"threshold_mode": "fixed", "roi_x_min": 20.0, "max_foreground_ratio": 0.5}
    assert {r.frame for r in detection.detect(px(spark, images), background, roi, (64, 48)).collect()} == {2, 3, 4, 5}
    assert detection.process_window((64, 48), roi) == (4, 64, 0, 48) and detection.process_window((640, 480), roi | {"roi_x_min": 100.0, "roi_x_max": 200.5})[:2] == (84, 218)


def test_otsu_level_by_search():
    rng = np.random.default_rng(4)
    v = np.clip(np.concatenate([rng.normal(60, 9, 300), rng.normal(170, 20, 80)]), 0, 255).astype(int)
    between = lambda t: (v <= t).mean() * (v > t).mean() * (v[v <= t].mean() - v[v > t].mean()) ** 2
    assert detection.otsu_level(v) == max(range(v.min(), v.max()), key=lambda t: (between(t), -t))


def test_gated_assignment_by_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.random((4, 2)) * 60, rng.random((5, 2)) * 60
        pairs = tracking.gated(a, b, 25.0)
        far = 25.0 * 1e6
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        cost = np.where(d <= 25.0, d, far)
        best = min(sum(cost[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert math.isclose(sum(d[i, j] for i, j in pairs) + far * (4 - len(pairs)), best, rel_tol=1e-9)


def test_gate_by_a_plain_walk(spark):
    rnd = random.Random(7)
    rows = [("v", f, rnd.choice([0, 1, 1, 4, 9])) for f in range(0, 900) if rnd.random() < 0.4 or f % 200 < 30]
    hits, until, want = [], -1, {}
    for _, f, n in rows:
        hits = [h for h in hits + ([f] if n >= 4 else []) if h > f - 6]
        cooling, fires = f <= until, len(hits) >= 3
        until = f + 4 if fires and not cooling else until
        want[f] = not cooling and not fires
    got = windows.burst_gate(spark.createDataFrame(rows, "video_id string, frame long, n long"), 4, 6, 3, 5).collect()
    assert {r.frame: r.keep for r in got} == want and 0 < sum(want.values()) < len(want)


def streamed(spark, tmp_path, rows, schema, make, mode):
    for k in range(3):
        part = [r for i, r in enumerate(rows) if i * 3 // len(rows) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"t{abs(hash(str(tmp_path)))}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return spark.table(name).collect()


def test_trail_energy_stream(spark, tmp_path):
    rows = [("v", 1, f, float(f % 3), 0.0) for f in (0, 1, 2, 3, 5, 6, 8, 9)]
    got = streamed(spark, tmp_path, rows, "video_id string, track_id long, frame long, x double, y double", lambda s: stateful.trail_energy_stream(s, 0.5, None), "update")
    last = {}
    for r in got:
        last[r.x] = max(last.get(r.x, (-1, 0.0)), (r.frame, r.energy))
    want = {}
    for _, _, f, x, _ in rows:
        want.setdefault(int(x), []).append(f)
    assert last == {x: (max(fs), sum(0.5 ** (max(fs) - f) for f in fs)) for x, fs in want.items()}


def test_gate_stream_drops_late_frames(spark, tmp_path):
    rows = [("v", 0, 9), ("v", 1, 9), ("v", 2, 9), ("v", 1, 9), ("v", 3, 0), ("v", 9, 0)]
    listener = stateful.Progress()
    spark.streams.addListener(listener)
    try:
        got = streamed(spark, tmp_path, rows, "video_id string, frame long, n long", lambda s: stateful.gate_stream(s, 5, 4, 3, 3), "append")
    finally:
        spark.streams.removeListener(listener)
    assert sorted((r.frame, r.keep) for r in got) == [(0, True), (1, True), (2, False), (3, False), (9, True)]
    assert listener.batches and all(b["rows"] <= len(rows) for b in listener.batches)  # told some time after


def test_coherent_needs_flight():
    from collections import deque

    assert stateful.coherent(deque([(0, 0), (10, 0), (20, 1)])) and not stateful.coherent(deque([(0, 0), (1, 0), (0, 1)])) and not stateful.coherent(deque([(0, 0)]))


def test_scratch_needs_a_shared_folder():
    from flightloom.sources.scratch import shared_folder

    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "local-cluster[2,1,1024]"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_run_from_frames(spark):
    """Frames alone give background, detections and a track; with the region drivers on also a region and zones."""
    from flightloom.plans import run

    back = np.full((48, 64), 60.0)
    back[:, 40:] = 90
    images = []
    for f in range(8):
        image = back.copy()
        image[10 + 3 * f : 18 + 3 * f, 5 + 6 * f : 13 + 6 * f] = 180
        images.append(image)
    frames = px(spark, images)
    off = {"valid_region": {"enabled": False}, "cave_zones": {"enabled": False}}
    base = {"detection": {"threshold_mode": "fixed"}, "tracking": {"tracker": "greedy"}}
    r = run.run(base | off, (64, 48), frames=frames)
    assert r.points.groupBy("track_id").count().collect()[0]["count"] == 8 and r.background.where("x = 60 and y = 2").first().v == 90
    assert r.region is None and r.metrics.first().tracks_total == 1
    on = {"cave_zones": {"method": "motion", "motion_percentile": 50.0, "dilate_px": 0}, "valid_region": {"profile_smooth_window": 3, "safety_margin": 1}}
    r = run.run(base | on, (64, 48), raw_points=r.raw_points, frames=frames)
    assert {s.kind for s in r.source_scores.collect()} == {"cave_zones", "valid_region"} and r.region.count() > 0 and r.zones.count() >= 1


def test_cleaning_at_once_equals_its_steps(spark):
    rng = np.random.default_rng(9)
    rows = [(v, int(x), int(y)) for v in ("a", "b") for y, x in np.argwhere(rng.random((30, 41)) < 0.2)]
    mask = spark.createDataFrame(rows, "video_id string, x int, y int")
    for k in (1, 5, 7):
        steps = pixels.opened(pixels.closed(mask, pixels.ellipse(k), (41, 30), 2), pixels.ellipse(k), (41, 30))
        assert {tuple(r) for r in pixels.cleaned(mask, pixels.ellipse(k), (41, 30)).collect()} == {tuple(r) for r in steps.select("video_id", "x", "y").collect()}
