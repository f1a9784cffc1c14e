"""Region look-ups and the direction of tracks. A region is a table of pixels
(video_id, kind, x, y); points meet it by an equi-join on their rounded pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.functions.expressions import direction, direction_by_motion, norm, pixel
from flightloom.operators.summary import KEY, by_frame, of_track


def flag_in_region(points: DataFrame, region: DataFrame, name: str = "inside") -> DataFrame:
    """``name``: whether the point's pixel (halves to even) is in the region. The
    engine broadcasts a region that its statistics prove small."""
    px = region.select("video_id", F.col("x").alias("_px"), F.col("y").alias("_py"), F.lit(True).alias("_in")).distinct()
    keyed = points.withColumns({"_px": pixel(F.col("x")), "_py": pixel(F.col("y"))})
    return keyed.join(px, ["video_id", "_px", "_py"], "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_px", "_py", "_in")


def flag_in_box(points: DataFrame, box: tuple[int, int, int, int], name: str = "inside") -> DataFrame:
    """The same for a rectangular region, without a join."""
    x, y = pixel(F.col("x")), pixel(F.col("y"))
    return points.withColumn(name, x.between(box[0], box[1]) & y.between(box[2], box[3]))


def track_ends(flagged: DataFrame, flag: str = "inside") -> DataFrame:
    """Ends of each track with their flags, and whether any point between is inside, or outside."""
    i, n = F.row_number().over(by_frame()), F.count("*").over(of_track())
    mid = flagged.withColumn("_mid", (i > 1) & (i < n))
    first, last = (lambda c: F.min_by(c, "frame")), (lambda c: F.max_by(c, "frame"))
    return mid.groupBy(*KEY).agg(
        F.count("*").alias("num_detections"), first(flag).alias("start_in"), last(flag).alias("end_in"), first("x").alias("x_start"), first("y").alias("y_start"), last("x").alias("x_end"), last("y").alias("y_end"),
        F.bool_or(F.col("_mid") & F.col(flag)).alias("mid_in"), F.bool_or(F.col("_mid") & ~F.col(flag)).alias("mid_out"), F.bool_or(flag).alias("any_in"),
    )


def simple_directions(flagged: DataFrame) -> DataFrame:
    return track_ends(flagged).withColumn("direction", direction(F.col("start_in"), F.col("end_in"))).select(*KEY, "start_in", "end_in", "direction")


def full_directions(flagged: DataFrame, centre: tuple[float, float] | None, height: float | None) -> DataFrame:
    """Direction by the whole track: one that leaves a region it starts and ends
    in is an exit; one that only crosses it is judged by its distances to the
    region's centre; one that never meets it, by its vertical motion."""
    t = track_ends(flagged)
    base = direction(F.col("start_in"), F.col("end_in"))
    moved = direction_by_motion(F.col("y_start"), F.col("y_end"), height) if height is not None else F.lit("outside")
    if centre is None:
        crossing = F.lit("inside")
    else:
        sx, sy, ex, ey = F.col("x_start") - centre[0], F.col("y_start") - centre[1], F.col("x_end") - centre[0], F.col("y_end") - centre[1]
        crossing = F.when(sx * ex + sy * ey > 0, "outside").when(norm(ex, ey) < norm(sx, sy) * 0.92, "entry").when(norm(sx, sy) < norm(ex, ey) * 0.92, "exit").otherwise("inside")
    full = F.when((base == "inside") & F.col("mid_out"), "exit").when((base == "outside") & F.col("mid_in"), crossing).when(base == "outside", moved).otherwise(base)
    # a crossing judged "outside" stays so: motion is asked only where the region was never met
    return t.withColumn("direction", full)


def region_centre(region: DataFrame) -> tuple[float, float] | None:
    row = region.agg(F.avg("x"), F.avg("y")).first()
    return None if row[0] is None else (float(row[0]), float(row[1]))


def keep_start_or_end_inside(points: DataFrame, flagged: DataFrame) -> DataFrame:
    kept = track_ends(flagged).where("start_in or end_in").select(*KEY)
    return points.join(kept, KEY, "left_semi")


def exclude_directions(points: DataFrame, directions: DataFrame, excluded: tuple[str, ...] = ("outside",)) -> DataFrame:
    return points.join(directions.where(F.col("direction").isin(*excluded)).select(*KEY), KEY, "left_anti")


def endpoint_diagnostics(flagged: DataFrame) -> DataFrame:
    t = track_ends(flagged)
    n = lambda c: F.count(F.when(F.col(c), 1))
    out = t.groupBy("video_id").agg(F.count("*").alias("tracks"), n("start_in").alias("starts_inside"), n("end_in").alias("ends_inside"), n("any_in").alias("touching"))
    return out.withColumns({f"{c}_percent": 100.0 * F.col(c) / F.col("tracks") for c in ("starts_inside", "ends_inside", "touching")})


def combine_regions(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """and / or / minus of two pixel sets."""
    px = ["video_id", "x", "y"]
    a, b = a.select(*px), b.select(*px)
    if mode == "and":
        return a.intersect(b)
    if mode == "or":
        return a.union(b).distinct()
    if mode == "minus":
        return a.subtract(b)
    raise ValueError(f"mode must be and, or or minus, got {mode}")
