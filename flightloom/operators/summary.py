"""Consolidation, per-track summaries and the metrics built on them.

Everything is keyed by (video_id, track_id): one shuffle on that key serves the
windows and the aggregate after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import norm

KEY = ["video_id", "track_id"]


def by_frame():
    """The points of a track in order (made when asked for: a worker that imports this has no session)."""
    return Window.partitionBy(*KEY).orderBy("frame")


def of_track():
    return Window.partitionBy(*KEY)


def consolidate(points: DataFrame, order: str | None = None) -> DataFrame:
    """One point for each track and frame: the largest area, then the slowest, then the least x and y."""
    rank = [F.desc("area"), F.abs("vx") + F.abs("vy"), F.col("x"), F.col("y"), *([F.col(order)] if order else [])]
    w = Window.partitionBy(*KEY, "frame").orderBy(*rank)
    out = points.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out.drop(order) if order else out


def steps(points: DataFrame) -> DataFrame:
    """Length, frames and speed from the point before (null for the first)."""
    px, py, pf = (F.lag(c).over(by_frame()) for c in ("x", "y", "frame"))
    step = norm(F.col("x") - px, F.col("y") - py)
    gap = F.col("frame") - pf
    return points.withColumns({"step": step, "gap": gap, "step_per_frame": step / F.greatest(gap, F.lit(1))})


def summarise(points: DataFrame, guard: float = 0.0) -> DataFrame:
    """A row for each track: ends, counts, duration, displacement, path, straightness, speed, area.

    ``guard``: path and duration must exceed it for the two ratios not to be 0."""
    first, last = (lambda c: F.min_by(c, "frame")), (lambda c: F.max_by(c, "frame"))
    out = steps(points).groupBy(*KEY).agg(
        F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"), F.count("*").alias("num_detections"), first("time_sec").alias("time_start"), last("time_sec").alias("time_end"),
        first("x").alias("x_start"), first("y").alias("y_start"), last("x").alias("x_end"), last("y").alias("y_end"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length_px"), F.avg("area").alias("mean_area"),
        F.max("gap").alias("max_gap"), F.avg(F.col("step_per_frame")).alias("mean_step_per_frame"),
    )
    duration = F.col("time_end") - F.col("time_start")
    displacement = norm(F.col("x_end") - F.col("x_start"), F.col("y_end") - F.col("y_start"))
    out = out.withColumns({"duration_sec": duration, "displacement_px": displacement})
    ratio = lambda a, b: F.when(F.col(b) > guard, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"straightness": ratio("displacement_px", "path_length_px"), "mean_speed_px_sec": ratio("path_length_px", "duration_sec")}).drop("time_start", "time_end")


def run_metrics(points: DataFrame) -> DataFrame:
    """Totals of a run: points, tracks, least, largest and mean track length."""
    per = points.groupBy(*KEY).agg(F.count("*").alias("n"))
    return per.groupBy("video_id").agg(F.sum("n").alias("points_total"), F.count("*").alias("tracks_total"), F.min("n").alias("track_length_min"), F.max("n").alias("track_length_max"), F.avg("n").alias("track_length_mean"))


def distribution(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count, least, largest, mean, median and 90th percentile (linear) of a column; zeros of no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(column).alias("n"), zero(F.min(column)).alias("least"), zero(F.max(column)).alias("most"), zero(F.avg(column)).alias("mean"), zero(F.percentile(column, F.lit(0.5))).alias("median"), zero(F.percentile(column, F.lit(0.9))).alias("p90"))


def quality_distributions(summary: DataFrame) -> DataFrame:
    """The five distributions of track quality, a row each."""
    columns = ["num_detections", "duration_sec", "displacement_px", "straightness", "mean_speed_px_sec"]
    long = summary.select("video_id", F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("measure", "value"))
    return distribution(long, "value", ["video_id", "measure"])


def over_merge_suspects(summary: DataFrame, min_points: int = 40, min_duration: float = 1.5, max_straightness: float = 0.2) -> DataFrame:
    return summary.where((F.col("num_detections") >= min_points) & (F.col("duration_sec") >= min_duration) & (F.col("straightness") < max_straightness)).select(*KEY, "num_detections", "duration_sec", "straightness")


def merge_summary(merges: DataFrame) -> DataFrame:
    """Merges by reason and the largest group of distinct tracks (1 if there is none)."""
    group = merges.select("merged_to", F.explode(F.array("track_a", "track_b")).alias("t")).groupBy("merged_to").agg(F.count_distinct("t").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("max_group_size"))
    counts = merges.agg(F.count("*").alias("merges_total"), F.count(F.when(F.col("reason").startswith("overlap"), 1)).alias("overlap"), F.count(F.when(F.col("reason").startswith("handoff"), 1)).alias("handoff"))
    return counts.crossJoin(group)  # one row each


def recall_metrics(assessments: DataFrame) -> DataFrame:
    """Accepted and rejected tracks and points, and the rejected share of points."""
    n, ok = F.col("num_detections"), F.col("accepted")
    out = assessments.groupBy("video_id").agg(
        F.count("*").alias("tracks_total"), F.count(F.when(ok, 1)).alias("tracks_accepted"), F.count(F.when(~ok, 1)).alias("tracks_rejected"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("points_accepted"), F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)).alias("points_rejected"),
    )
    total = F.col("points_accepted") + F.col("points_rejected")
    return out.withColumn("orphan_percent", F.when(total > 0, 100.0 * F.col("points_rejected") / total).otherwise(0.0))


def reason_histogram(assessments: DataFrame) -> DataFrame:
    return assessments.select("video_id", F.explode("reject_reasons").alias("reason")).groupBy("video_id", "reason").agg(F.count("*").alias("tracks"))


def detection_totals(detections: DataFrame) -> DataFrame:
    per = detections.groupBy("video_id", "frame").agg(F.count("*").alias("n"))
    return per.groupBy("video_id").agg(F.sum("n").alias("detections_total"), F.count("*").alias("frames_with_detections"), F.max("n").alias("most_in_a_frame"))


def rollup_directions(tracks: DataFrame) -> DataFrame:
    """Tracks by video and direction with subtotals (an extension)."""
    return tracks.rollup("video_id", "direction").agg(F.count("*").alias("tracks"))
