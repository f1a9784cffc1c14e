"""Trajectory-shaped views of the benchmark tables: points, big points, frames,
masks; each with the SQL of the same rows for an independent engine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.operators import dense

FPS = 25.0
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as track points, several to a track and frame (hour) at times."""
    frame = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(3600000000)).cast("long")
    return table(spark, sf_dir, "events").select(
        F.lit("v0").alias("video_id"), F.col("user_id").alias("track_id"), frame.alias("frame"), (frame / F.lit(FPS)).alias("time_sec"), F.col("value").cast("double").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("event_id") % 37 + 1).cast("double").alias("area"), F.col("event_id").alias("seq"),
    )


RAW_SQL = f"""raw AS (
  SELECT 'v0' AS video_id, user_id AS track_id, CAST(FLOOR((epoch_us(ts) - {EPOCH_US}) / 3600000000) AS BIGINT) AS frame,
         value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(event_id % 37 + 1 AS DOUBLE) AS area, event_id AS seq
  FROM events)"""
POINTS_SQL = (
    RAW_SQL
    + f""", pts AS (
  SELECT video_id, track_id, frame, frame / {FPS} AS time_sec, x, y, area FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, frame ORDER BY area DESC, x, y, seq) AS rn FROM raw) q
  WHERE rn = 1)"""
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flightloom.operators.summary import consolidate

    return consolidate(raw_points(spark, sf_dir), "seq")


def big_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as track points, for benchmarks."""
    frame = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("v0").alias("video_id"), F.col("l_suppkey").alias("track_id"), frame.alias("frame"), (frame / F.lit(FPS)).alias("time_sec"), F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_extendedprice") / 1000).cast("double").alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("l_partkey") % 37 + 1).cast("double").alias("area"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without their tracks, as boxes around the centre."""
    box = lambda c, d: (F.rint(c) + F.lit(d)).cast("int")
    order = F.row_number().over(Window.partitionBy("video_id", "frame").orderBy("seq")) - 1
    return raw_points(spark, sf_dir).select("video_id", "frame", order.cast("int").alias("det_idx"), "x", "y", box("x", -3).alias("bbox_x1"), box("y", -3).alias("bbox_y1"), box("x", 3).alias("bbox_x2"), box("y", 3).alias("bbox_y2"), "area")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 frames in sparse form: video_id, frame, x, y, v."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "px"))
    return e.select(F.lit("v0").alias("video_id"), "frame", (F.col("pos") % 8).cast("int").alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.col("px").cast("double").alias("v"))


FRAMES_SQL = """frames AS (
  SELECT vec_id AS frame, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, CAST(px AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(embedding) AS px, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e)"""

#: The stand-in region on the points' plane.
MASK = (100, 300, 20, 70)
FRAME_SIZE = (500, 100)


def mask_pixels(spark: SparkSession, kind: str = "valid") -> DataFrame:
    x0, x1, y0, y1 = MASK
    return spark.range(1).select(F.lit("v0").alias("video_id"), F.lit(kind).alias("kind"), F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x")).select("video_id", "kind", "x", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))


MASK_TEST_SQL = f"(round_even(x, 0) BETWEEN {MASK[0]} AND {MASK[1]} AND round_even(y, 0) BETWEEN {MASK[2]} AND {MASK[3]})"

#: Side of a dense frame, and of its grid of 8 x 8 blocks.
SIDE, BLOCKS = 32, 4


def dense_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dense 32 x 32 frames (sixteen vectors each, whole levels) of two videos of different length."""
    k, n = F.col("vec_id"), F.floor(F.col("vec_id") / BLOCKS**2)
    e = table(spark, sf_dir, "embeddings").select(n.alias("n"), (k % BLOCKS**2).alias("part"), F.col("embedding").cast("array<double>").alias("e"))
    whole = e.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("part", "e"))).alias("p")).where(F.size("p") == BLOCKS**2)
    video, frame = F.when(F.col("n") % 3 == 0, "a").otherwise("b"), F.when(F.col("n") % 3 == 0, F.floor(F.col("n") / 3)).otherwise(F.floor(F.col("n") / 3) * 2 + F.col("n") % 3 - 1)
    flat = whole.select(video.alias("video_id"), frame.cast("long").alias("frame"), F.flatten(F.col("p.e")).alias("e"))

    def run(batches):
        for batch in batches:
            values = batch.column("e").flatten().to_numpy().reshape(-1, BLOCKS, BLOCKS, 8, 8)
            image = np.clip(np.rint(values * 200 + 128), 0, 255).astype(np.uint8).transpose(0, 1, 3, 2, 4).reshape(-1, SIDE * SIDE)
            size = pa.array([SIDE] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame"), size, size, pa.array([i.tobytes() for i in image], pa.binary())], names=["video_id", "frame", "h", "w", "pixels"])

    return dense.mapped(flat, run, dense.FRAME)


DENSE_SQL = f"""whole AS (SELECT vec_id // {BLOCKS**2} AS n FROM embeddings GROUP BY vec_id // {BLOCKS**2} HAVING count(*) = {BLOCKS**2}),
  lv AS (SELECT CASE WHEN n % 3 = 0 THEN 'a' ELSE 'b' END AS video_id, CASE WHEN n % 3 = 0 THEN n // 3 ELSE n // 3 * 2 + n % 3 - 1 END AS frame,
    CAST(part % {BLOCKS} * 8 + pos % 8 AS INTEGER) AS x, CAST(part // {BLOCKS} * 8 + pos // 8 AS INTEGER) AS y,
    CAST(least(greatest(round_even(CAST(px AS DOUBLE) * 200 + 128, 0), 0), 255) AS DOUBLE) AS v
  FROM (SELECT vec_id // {BLOCKS**2} AS n, vec_id % {BLOCKS**2} AS part, unnest(embedding) AS px, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e JOIN whole USING (n))"""
