"""Sources: schemas, videos, frames, masks, tracks of earlier runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import is_red
from flightloom.operators import dense
from flightloom.operators.pixels import closed, dilate, ellipse, opened

POINTS = "video_id string, track_id long, frame long, time_sec double, x double, y double, vx double, vy double, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, area double"
DETECTIONS = "video_id string, frame long, det_idx int, x double, y double, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, area double"
VIDEOS = "video_id string, fps double, frame_count int, width int, height int"
FRAMES = "video_id string, frame long, h int, w int, pixels binary"


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Video metadata: a rate of 25 where none is given, no negative counts."""
    v = spark.read.schema(VIDEOS).parquet(path)
    return v.select("video_id", F.when(F.col("fps") > 0, F.col("fps")).otherwise(25.0).alias("fps"), *(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("frame_count", "width", "height")))


def frames(spark: SparkSession, path: str, window: tuple[int, int] | None = None) -> DataFrame:
    """Dense frames (row-major bytes); a range of frames reaches the scan as a filter."""
    f = spark.read.schema(FRAMES).parquet(path)
    return f.where(F.col("frame").between(window[0], window[1] - 1)) if window else f


def frame_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """The same as a stream of files, so many a batch at most."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", per_trigger).parquet(path)


def pixels_of(frames: DataFrame) -> DataFrame:
    """Dense frames as pixel rows (video_id, frame, x, y, v), for what is best said about pixels; linear in the pixels."""
    return dense.to_pixels(frames)


def image_pixels(spark: SparkSession, path: str, video_id: str = "v0") -> DataFrame:
    """Pixels (x, y, channels b, g, r; equal for gray) of an image file; an unreadable one is an error."""
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    schema = pa.schema([("video_id", pa.string()), *((c, pa.int32()) for c in ("x", "y", "b", "g", "r"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["width"] <= 0:
                    raise ValueError(f"unreadable image: {path}")
                n = r["nChannels"]
                px = np.frombuffer(r["data"], np.uint8).reshape(-1, n).astype(np.int32)
                y, x = np.indices((r["height"], r["width"]), np.int32)
                channels = [px[:, min(c, n - 1)] for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([video_id] * len(px)), *(pa.array(np.ascontiguousarray(c)) for c in (x.ravel(), y.ravel(), *channels))], schema=schema)

    return dense.mapped(image.select("width", "height", "nChannels", "data"), run, "video_id string, x int, y int, b int, g int, r int")


def mask(spark: SparkSession, path: str, size: tuple[int, int] | None = None, video_id: str = "v0") -> DataFrame:
    """Pixels above 0 of a mask image; ValueError where it is not of the frame's size."""
    if size is not None:
        row = spark.read.format("image").load(path).select("image.width", "image.height").first()
        if row is None or (row[0], row[1]) != tuple(size):
            raise ValueError(f"mask {path} is {row and tuple(row)}, the frame {tuple(size)}")
    return image_pixels(spark, path, video_id).where("r > 0 or g > 0 or b > 0").select("video_id", "x", "y")


def annotation_mask(px: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """The red marks of an annotation, closed twice and opened once; an annotation
    that is not of the frame's size is an error, if that is given."""
    if size is not None:
        px = px.withColumn("x", F.when((F.max("x").over(Window.partitionBy("video_id")) == size[0] - 1) & (F.max("y").over(Window.partitionBy("video_id")) == size[1] - 1), F.col("x")).otherwise(F.raise_error(F.lit(f"the annotation is not {size[0]} x {size[1]}")).cast("int")))
    red, kernel = px.where(is_red(F.col("r"), F.col("g"), F.col("b"))).select("video_id", "x", "y"), ellipse(5)
    return opened(closed(red, kernel, size, 2), kernel, size)


def marked_region(spark: SparkSession, mask_path: str = "", annotation_path: str = "", size: tuple[int, int] | None = None, dilate_px: int = 0) -> DataFrame | None:
    """A region from a mask, or else an annotation, widened."""
    if not mask_path and not annotation_path:
        return None
    px = mask(spark, mask_path, size) if mask_path else annotation_mask(image_pixels(spark, annotation_path), size)
    return dilate(px, ellipse(2 * dilate_px + 1), size) if dilate_px > 0 else px


def tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).option("header", True).csv(path)


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Track events of a run, by the header's names; blank flags are null."""
    raw = spark.read.option("header", True).csv(path)
    whole = {"track_id", "frame_start", "frame_end", "num_detections"}
    kind = lambda c: "long" if c in whole else "string" if c in ("video_id", "direction", "reject_reasons") else "boolean" if c.endswith("region") or c == "accepted" else "double"
    return raw.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).cast(kind(c)).alias(c) for c in raw.columns))
