"""Images kept dense. A frame is a row (video_id, frame, h, w, pixels) with one byte a
pixel, row by row; an image of a video is (video_id, h, w, pixels). Kernels run over the
frames of an Arrow batch; nothing is ever a row a pixel but what a mask leaves. What looks
along time works on tiles: a task holds one tile of a video in all its sampled frames. What
looks at neighbouring frames works on chunks of a video that share one frame with the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.operators import detection, filters, pixels, regions

FRAME = "video_id string, frame long, h int, w int, pixels binary"
#: Pixels of a tile, frames of a chunk.
TILE, CHUNK = 4096, 64
#: Bytes of an Arrow batch between Spark and Python (a longer row is a batch of its own).
BATCH_BYTES = 16 << 20
#: Images of all videos up to so many bytes are broadcast; beyond that they are joined by video.
BROADCAST_BYTES = 32 << 20
_KINDS = {"u1": np.uint8, "f8": np.float64}


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes. Plans are run after they are built, so this stays set on the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[t]) for c, t in (f.split() for f in ddl.split(", "))])


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def images_in(batch: pa.RecordBatch | pa.Table, column: str = "pixels", kind: str = "u1") -> Iterator[np.ndarray]:
    """The images of a batch, without a copy; one whose bytes are not h x w is an error."""
    size = np.dtype(_KINDS[kind]).itemsize
    for data, h, w in zip(batch.column(column), batch.column("h").to_pylist(), batch.column("w").to_pylist()):
        raw = data.as_buffer()
        if raw is None or raw.size != h * w * size:
            raise ValueError(f"an image of {w} x {h} has {raw and raw.size} bytes")
        yield np.frombuffer(raw, _KINDS[kind]).reshape(h, w)


def per_frame(frames: DataFrame, kernel: Callable[..., dict], ddl: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a kernel over each frame: it gets the image and the images in the columns ``beside``, and
    gives columns (lists or arrays of one length, all of ``ddl`` but video_id and frame)."""
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [images_in(batch, c) for c in beside]
            for video, frame, image, *more in zip(batch.column("video_id").to_pylist(), batch.column("frame").to_pylist(), images_in(batch), *others):
                out = kernel(image, *more)
                n = len(next(iter(out.values())))
                if n:
                    key = {"video_id": [video] * n, "frame": [frame] * n}
                    yield pa.RecordBatch.from_arrays([pa.array((key | out)[f.name], f.type) for f in schema], schema=schema)

    return mapped(frames.select("video_id", "frame", "h", "w", "pixels", *beside), run, ddl)


def levels(image: np.ndarray) -> np.ndarray:
    """Whole levels 0..255."""
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def changed(frames: DataFrame, kernel: Callable[..., np.ndarray], beside: tuple[str, ...] = ()) -> DataFrame:
    """The frames with new pixels: a kernel's image, cut to whole levels (a mask is 0 and 255)."""

    def run(image: np.ndarray, *more: np.ndarray) -> dict:
        new = kernel(image, *more)
        new = levels(new * 255 if new.dtype == bool else new)
        return {"h": [new.shape[0]], "w": [new.shape[1]], "pixels": [new.tobytes()]}

    return per_frame(frames, run, FRAME, beside)


def from_pixels(px: DataFrame) -> DataFrame:
    """Dense frames of pixel rows (video_id, frame, x, y, v); pixels not given are 0."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, y, v = (rows[c].to_numpy() for c in ("x", "y", "v"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        image[y, x] = levels(v)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [image.shape[0]], [image.shape[1]], [image.tobytes()]], schema=_schema(FRAME))

    return px.select("video_id", F.col("frame").cast("long").alias("frame"), "x", "y", F.col("v").cast("double").alias("v")).groupBy("video_id", "frame").applyInArrow(run, FRAME)


def to_pixels(images: DataFrame, column: str = "pixels", kind: str = "u1", name: str = "v", above: float | None = None) -> DataFrame:
    """Pixel rows (video_id, frame if there is one, x, y, value) of dense images, those above a value only if one is given."""
    key = [c for c in ("video_id", "frame") if c in images.columns]
    ddl = ", ".join(f"{c} {'string' if c == 'video_id' else 'long'}" for c in key) + f", x int, y int, {name} double"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            for k, image in zip(keys, images_in(batch, column, kind)):
                y, x = np.nonzero(image > above) if above is not None else (i.ravel() for i in np.indices(image.shape))
                for a in range(0, len(x), 1 << 20):
                    part = slice(a, a + (1 << 20))
                    data = [pa.array([v] * len(x[part]), schema.field(c).type) for c, v in zip(key, k)]
                    yield pa.RecordBatch.from_arrays([*data, pa.array(x[part].astype(np.int32)), pa.array(y[part].astype(np.int32)), pa.array(image[y[part], x[part]].astype(np.float64))], schema=schema)

    return mapped(images.select(*key, "h", "w", column), run, ddl)


def beside(frames: DataFrame, images: DataFrame, name: str = "back") -> DataFrame:
    """The frames with their video's image in a further column: broadcast if all images
    together are small (they are measured), else joined by video, where Spark splits a large one. A video without an
    image goes; an image of another size than the frame is an error."""
    total = images.agg(F.sum(F.length("pixels"))).first()[0] or 0
    side = images.select("video_id", F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("pixels").alias(name))
    both = frames.join(F.broadcast(side) if total <= BROADCAST_BYTES else side, "video_id")
    fits = (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))
    return both.withColumn("h", F.when(fits, F.col("h")).otherwise(F.raise_error(F.lit("a frame is not of its image's size")).cast("int"))).drop("_h", "_w")


# ---- along time: tiles

def tiles(images: DataFrame, tile: int = TILE, column: str = "pixels", kind: str = "u1") -> DataFrame:
    """Runs of ``tile`` pixels of each image: video_id, frame, h, w, tile, px."""
    size = np.dtype(_KINDS[kind]).itemsize
    ddl = "video_id string, frame long, h int, w int, tile int, px binary"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, image in enumerate(images_in(batch, column, kind)):
                raw = image.tobytes()
                px = [raw[a : a + tile * size] for a in range(0, len(raw), tile * size)]
                key = [pa.array([batch.column(c)[i].as_py()] * len(px), schema.field(c).type) for c in ("video_id", "frame", "h", "w")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(range(len(px)), pa.int32()), pa.array(px, pa.binary())], schema=schema)

    frame = F.col("frame") if "frame" in images.columns else F.lit(0).cast("long")
    return mapped(images.select("video_id", frame.alias("frame"), "h", "w", column), run, ddl)


def along_time(cut: DataFrame, measure: Callable[[np.ndarray], dict[str, np.ndarray]], kinds: dict[str, str], kind: str = "u1") -> DataFrame:
    """Images (video_id, h, w and a binary column for each of ``kinds``) of what a function makes of each
    tile's values in all frames, [frame, pixel] in the order of frames. A group is one tile of one video. Frames of several
    sizes in one video are an error."""
    ddl = "video_id string, h int, w int, tile int, " + ", ".join(f"{c} binary" for c in kinds)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sizes = set(zip(rows["h"].to_pylist(), rows["w"].to_pylist()))
        if len(sizes) > 1:
            raise ValueError(f"video {key[0].as_py()} has frames of several sizes: {sorted(sizes)}")
        rows = rows.sort_by("frame")
        stack = np.stack([np.frombuffer(b.as_buffer(), _KINDS[kind]) for b in rows["px"]])
        made = measure(stack)
        h, w = sizes.pop()
        return pa.table([[key[0].as_py()], [h], [w], [key[1].as_py()], *([made[c].astype(_KINDS[k]).tobytes()] for c, k in kinds.items())], schema=_schema(ddl))

    parts = cut.groupBy("video_id", "tile").applyInArrow(run, ddl)
    whole = "video_id string, h int, w int, " + ", ".join(f"{c} binary" for c in kinds)

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("tile")
        return pa.table([[key[0].as_py()], rows["h"][:1], rows["w"][:1], *([b"".join(rows[c].to_pylist())] for c in kinds)], schema=_schema(whole))

    return parts.groupBy("video_id").applyInArrow(put, whole)  # one image of a video


def frame_counts(frames: DataFrame) -> DataFrame:
    """video_id, frame_count: each video ends with its last frame."""
    return frames.groupBy("video_id").agg((F.max("frame") + 1).alias("frame_count"))


def context(counts: DataFrame, fps: DataFrame | float, start_sec: float, length_sec: float) -> DataFrame:
    """counts with [first, end) of each video's context in frames; a length of 0 or less is open."""
    rows = counts.withColumn("_fps", F.lit(float(fps))) if not isinstance(fps, DataFrame) else counts.join(fps.select("video_id", F.col("fps").cast("double").alias("_fps")), "video_id")
    n, first = F.col("frame_count"), F.rint(F.lit(float(start_sec)) * F.col("_fps")).cast("long")
    rows = rows.withColumn("first", F.least(F.greatest(F.lit(0), first), F.greatest(F.lit(0), n - 1)))
    length = F.greatest(F.lit(1), F.rint(F.lit(float(length_sec)) * F.col("_fps")).cast("long"))
    return rows.withColumn("end", F.least(n, F.col("first") + length) if length_sec > 0 else n).drop("_fps")


def sample_numbers(contexts: DataFrame, n: int, uniform: bool = True) -> DataFrame:
    """video_id, frame: so many frames of each video's [first, end), evenly spaced (cut down to whole numbers)
    or the first ones."""
    total = F.greatest(F.lit(0), F.col("end") - F.col("first"))
    rows = contexts.select("video_id", "first", total.alias("total"), F.least(F.lit(max(1, n)), total).cast("int").alias("n")).where("n > 0")
    rows = rows.select("video_id", "first", "total", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    even = F.floor(F.col("first") + F.col("i") * (F.col("total") - 1) / F.greatest(F.lit(1), F.col("n") - 1))
    place = F.when(F.lit(uniform) & (F.col("n") > 1), even).otherwise(F.col("first") + F.col("i"))
    return rows.select("video_id", place.cast("long").alias("frame")).distinct()


def at(frames: DataFrame, numbers: DataFrame) -> DataFrame:
    """The frames of a list (video_id, frame)."""
    return frames.join(numbers, ["video_id", "frame"], "left_semi")


def vegetation_samples(frames: DataFrame, counts: DataFrame, n: int = 220, last: int = 1250) -> DataFrame:
    """Evenly spaced frames of each video's first ``last`` + 1, 20 at least where there are so many; a short
    video's frames come several times, as the places of the sample fall on them. Videos that give under 20 go."""
    upto = F.least(F.greatest(F.col("frame_count"), F.lit(1)), F.lit(last + 1))
    n = max(20, n)
    places = counts.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), (upto - 1).alias("stop"))
    found = frames.join(places.select("video_id", F.floor(F.col("i") * F.col("stop") / (n - 1)).alias("frame")), ["video_id", "frame"])
    enough = found.groupBy("video_id").agg(F.count("*").alias("n")).where("n >= 20").select("video_id")
    return found.join(enough, "video_id", "left_semi")


def background(samples: DataFrame, tile: int = TILE) -> DataFrame:
    """The median of each pixel over a video's sampled frames, cut down to whole levels."""
    median = lambda stack: {"pixels": np.floor(np.median(stack, axis=0))}
    return along_time(tiles(samples, tile), median, {"pixels": "u1"})


def vegetation_scores(samples: DataFrame, tile: int = TILE) -> DataFrame:
    """video_id, h, w, score (doubles): half mean change, 35 % spread, 15 % gradient of the median, each scaled to [0, 1]."""

    def measure(stack: np.ndarray) -> dict[str, np.ndarray]:
        v = stack.astype(np.float64)
        change = np.abs(np.diff(v, axis=0)).mean(axis=0) if len(v) > 1 else np.zeros(v.shape[1])
        return {"change": change, "spread": v.std(axis=0), "median": np.floor(np.median(v, axis=0))}

    parts = along_time(tiles(samples, tile), measure, {"change": "f8", "spread": "f8", "median": "f8"})
    ddl = "video_id string, h int, w int, score binary"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for change, spread, median in zip(*(images_in(batch, c, "f8") for c in ("change", "spread", "median"))):
                unit = [(a - a.min()) / (a.max() - a.min() + 1e-6) for a in (change, spread, pixels.sobel(median))]
                out.append((0.50 * unit[0] + 0.35 * unit[1] + 0.15 * unit[2]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("h"), batch.column("w"), pa.array(out, pa.binary())], schema=_schema(ddl))

    return mapped(parts, score, ddl)


def vegetation_mask(samples: DataFrame, percent: float = 85.0, min_area: int = 24) -> DataFrame:
    """Pixels (video_id, x, y) of restless textured parts: top scores, opened, smoothed by a median, small parts
    dropped, eroded. One image of a video is worked on at a time."""
    square = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    schema = _schema("video_id string, h int, w int, pixels binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for score in images_in(batch, "score", "f8"):
                mask = score >= np.percentile(score, min(99.5, max(50.0, percent)))
                mask = pixels.moved(pixels.moved(mask, square, False), square, True)
                labels = pixels.label_image(pixels.median_blur(mask, 3) > 0)
                big = np.bincount(labels.ravel()) >= max(1, min_area)
                out.append(pixels.moved(big[labels] & (labels > 0), square, False).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("h"), batch.column("w"), pa.array(out, pa.binary())], schema=schema)

    masks = mapped(vegetation_scores(samples), run, "video_id string, h int, w int, pixels binary")
    return to_pixels(masks, above=0).drop("v")


# ---- an image of a video

def column_profile(images: DataFrame, blur: int = 0) -> DataFrame:
    """video_id, x, v: the mean of each column of the (blurred) image."""
    schema = _schema("video_id string, x int, v double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, image in zip(batch.column("video_id").to_pylist(), images_in(batch)):
                v = np.rint(pixels.gaussian(image, blur)).mean(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([video] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v)], schema=schema)

    return mapped(images.select("video_id", "h", "w", "pixels"), run, "video_id string, x int, v double")


def region_masks(images: DataFrame, bands: DataFrame, kernel: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Pixels (video_id, x, y) of a region of each video's image and its band (video_id, x_start, x_end)."""
    schema = _schema("video_id string, h int, w int, pixels binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = zip(batch.column("x_start").to_pylist(), batch.column("x_end").to_pylist())
            out = [kernel(image.astype(np.float64), *span).astype(np.uint8).tobytes() for image, span in zip(images_in(batch), spans)]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("h"), batch.column("w"), pa.array(out, pa.binary())], schema=schema)

    both = images.select("video_id", "h", "w", "pixels").join(bands.select("video_id", "x_start", "x_end"), "video_id")
    return to_pixels(mapped(both, run, "video_id string, h int, w int, pixels binary"), above=0).drop("v")


# ---- neighbouring frames: chunks

def motion_energy(frames: DataFrame, threshold: float = 0.0, blur: int = 0, open_size: int = 0, region: DataFrame | None = None, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """video_id, h, w, energy (doubles): the sum of each pixel's changes from a frame to the next one there is, above a
    threshold; frames are blurred before (to whole levels), changes opened after, in the pixels of a region (images) only, if asked for.
    A group is a chunk of a video with the last frame before it, which is sent to both."""
    part = F.floor(F.col("frame") / chunk).cast("long")
    lasts = frames.select("video_id", part.alias("chunk"), "frame").groupBy("video_id", "chunk").agg(F.max("frame").alias("frame"))
    heirs = lasts.select("video_id", "frame", F.lead("chunk").over(Window.partitionBy("video_id").orderBy("chunk")).alias("chunk")).where("chunk is not null")
    own = frames.select("video_id", "frame", "h", "w", "pixels", part.alias("chunk"))
    passed = frames.join(heirs, ["video_id", "frame"]).select("video_id", "frame", "h", "w", "pixels", "chunk")
    rows = own.unionByName(passed)
    rows = beside(rows, region, "only") if region is not None else rows.withColumn("only", F.lit(None).cast("binary"))
    kernel = pixels.ellipse(open_size)
    ddl = "video_id string, h int, w int, energy binary"
    bounded_batches(frames.sparkSession)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("frame")
        heat, last = None, None
        for image in images_in(group):
            image = np.rint(pixels.gaussian(image, blur))
            heat = np.zeros(image.shape) if heat is None else heat
            if last is not None:
                change = np.abs(image - last)
                mask = change > threshold
                for grow in (False, True) if open_size > 1 else ():
                    mask = pixels.moved(mask, kernel, grow)
                heat += np.where(mask, change, 0.0)
            last = image
        only = group["only"][0].as_buffer()
        heat = heat if only is None else np.where(np.frombuffer(only, np.uint8).reshape(heat.shape) > 0, heat, 0.0)
        return pa.table([[key[0].as_py()], [heat.shape[0]], [heat.shape[1]], [heat.tobytes()]], schema=_schema(ddl))

    chunks = rows.groupBy("video_id", "chunk").applyInArrow(run, ddl)
    return along_time(tiles(chunks, tile, "energy", "f8"), lambda stack: {"energy": stack.sum(axis=0)}, {"energy": "f8"}, "f8")


def blurred_heat(images: DataFrame, size: int = 9) -> DataFrame:
    """Heat (video_id, h, w, energy) blurred."""
    schema = _schema("video_id string, h int, w int, energy binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pixels.gaussian(image, size).tobytes() for image in images_in(batch, "energy", "f8")]
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("h"), batch.column("w"), pa.array(out, pa.binary())], schema=schema)

    return mapped(images, run, "video_id string, h int, w int, energy binary")


# ---- a frame alone

def blurred(frames: DataFrame, size: int) -> DataFrame:
    return changed(frames, lambda image: pixels.gaussian(image, size))


def frame_stats(frames: DataFrame, backgrounds: DataFrame, threshold: float) -> DataFrame:
    """video_id, frame, mean_shift (mean less the background's), foreground (share of pixels that differ by more than ``threshold``)."""

    def run(image: np.ndarray, back: np.ndarray) -> dict:
        image, back = image.astype(np.float64), back.astype(np.float64)
        return {"mean_shift": [image.mean() - back.mean()], "foreground": [(np.abs(image - back) > threshold).mean()]}

    return per_frame(beside(frames, backgrounds), run, "video_id string, frame long, mean_shift double, foreground double", ("back",))


def otsu(frames: DataFrame, offset: int = 0) -> DataFrame:
    """video_id, frame, threshold: the level that separates a frame's values best, with an offset, within 1..255."""
    return per_frame(frames, lambda image: {"threshold": [min(255, max(1, detection.otsu_level(image) + offset))]}, "video_id string, frame long, threshold int")


def masks(frames: DataFrame, backgrounds: DataFrame, cfg: dict) -> DataFrame:
    """Foreground masks (0 and 255) of the whole frames: difference, threshold, opening and closing by ``cfg``."""
    return changed(beside(frames, backgrounds), lambda image, back: detection.foreground_mask(detection.difference(image, back, cfg["blur_kernel"]), cfg), ("back",))


def labelled(frames: DataFrame) -> DataFrame:
    """video_id, frame, component, x, y of the pixels above 0: numbers of their 8-connected components."""

    def run(image: np.ndarray) -> dict:
        labels = pixels.label_image(image > 0)
        y, x = np.nonzero(labels)
        return {"component": labels[y, x], "x": x.astype(np.int32), "y": y.astype(np.int32)}

    return per_frame(frames, run, "video_id string, frame long, component long, x int, y int")


def detect(frames: DataFrame, backgrounds: DataFrame, cfg: dict, region: DataFrame | None = None) -> DataFrame:
    """``detection.detect`` over dense frames and backgrounds: one map over the frames."""

    def run(image: np.ndarray, back: np.ndarray) -> dict:
        x0, x1, y0, y1 = detection.process_window(image.shape[::-1], cfg)
        rows = detection.found_in(image[y0:y1, x0:x1].astype(np.float64), back[y0:y1, x0:x1].astype(np.float64), x0, y0, cfg)
        return dict(zip(detection.COLUMNS, map(list, zip(*rows)))) if rows else {c: [] for c in detection.COLUMNS}

    found = per_frame(beside(frames, backgrounds), run, detection.DDL, ("back",))
    return detection.filtered(found, cfg, region)
