"""Fast-motion events: fragments of one flight put together again."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import endpoint_distance, event_confidence, fast_direction
from flightloom.operators import pixels
from flightloom.operators.grouping import components
from flightloom.operators.blocks import tracks_met
from flightloom.operators.pairs import meeting
from flightloom.operators.summary import KEY, summarise
from flightloom.operators.windows import truncated_mean
from flightloom.sources.scratch import written

NAMES = ("frame", "time_sec", "x", "y", "area", "track_id")
EVENT = ["video_id", "event_id"]
#: In-function defaults, fixed values; a configuration overrides them by name.
DEFAULTS = {
    "include_rejected_candidates": True, "include_accepted_tracks": True, "require_entry_or_exit": False, "first_event_id": 10001, "min_source_track_points": 3, "min_source_displacement": 35.0, "min_source_path_length": 60.0,
    "min_source_mean_speed": 80.0, "min_source_straightness": 0.08, "max_source_duration_sec": 5.0, "max_group_gap_frames": 45, "max_group_endpoint_distance": 260.0, "max_group_overlap_distance": 180.0, "min_event_points": 4,
    "min_event_displacement": 80.0, "min_event_path_length": 120.0, "min_event_mean_speed": 120.0, "order_by_exit_projection": True,
}


def is_fast(cfg: dict) -> Column:
    """Whether an assessed track may belong to a fast event."""
    c = F.col
    ok = F.lit(True)
    ok = ok & ~c("accepted") if not cfg["include_accepted_tracks"] else ok
    ok = ok & c("accepted") if not cfg["include_rejected_candidates"] else ok
    ok = ok & c("direction").isin("entry", "exit") if cfg["require_entry_or_exit"] else ok
    ok = ok & (c("duration_sec") <= cfg["max_source_duration_sec"]) if cfg["max_source_duration_sec"] > 0 else ok
    ok = ok & (c("num_detections") >= cfg["min_source_track_points"]) & (c("straightness") >= cfg["min_source_straightness"])
    return ok & ((c("displacement_px") >= cfg["min_source_displacement"]) | (c("path_length_px") >= cfg["min_source_path_length"]) | (c("mean_speed_px_sec") >= cfg["min_source_mean_speed"]))


def select_sources(points: DataFrame, assessments: DataFrame, cfg: dict) -> DataFrame:
    """Summaries of the fast tracks, with accepted (unassessed: not) and direction."""
    a = assessments.select(*KEY, "accepted", "direction")
    s = summarise(points).join(a, KEY, "left").withColumns({"accepted": F.coalesce("accepted", F.lit(False)), "direction": F.coalesce("direction", F.lit(""))})
    return s.where(is_fast(cfg))


def group_pairs(tracks: DataFrame, cfg: dict, points: DataFrame | None = None) -> DataFrame:
    """Pairs of fast tracks of one event: close in time and by their ends, or by
    the mean distance over common frames (where points are given)."""
    near = meeting(tracks.select(*KEY, "frame_start", "frame_end", "x_start", "y_start", "x_end", "y_end"), cfg["max_group_gap_frames"])
    names = ("video_id", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"))
    near = near.where(endpoint_distance("a_", "b_") <= cfg["max_group_endpoint_distance"]).select(*names)
    if points is None or cfg["max_group_gap_frames"] < 0:
        return near
    # tracks that share a frame have no gap
    fast = points.join(tracks.select(*KEY), KEY, "left_semi")
    return near.unionByName(tracks_met(fast, max_mean=cfg["max_group_overlap_distance"]).select(*names))


def grouped(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    return tracks.join(components(pairs), KEY, "left").withColumn("group_id", F.coalesce("group_id", "track_id"))


POINT = "struct<frame:bigint,time_sec:double,x:double,y:double,area:double,track_id:bigint>"


def chain(points: DataFrame, by_exit: bool) -> DataFrame:
    """For each group (video_id, group_id) its points, one a frame: the largest
    first, then the nearest to the one chosen before (ties to the larger); in the
    order of exit (-(x + y), frame) if asked for. Each choice hangs on the last, so
    a group is a grouped map; it holds the points of one event."""

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[tuple] = []
        pdf = pdf.sort_values(["frame", "time_sec", "x", "y", "area", "track_id"], kind="stable")
        for _, at in pdf.groupby("frame", sort=True):
            x, y, area = (at[c].to_numpy(float) for c in ("x", "y", "area"))
            last = chosen[-1] if chosen else None
            i = np.lexsort((-(x + y), -area))[0] if last is None else np.lexsort((-area, np.hypot(x - last[2], y - last[3])))[0]
            chosen.append(tuple(at.iloc[int(i)][list(NAMES)]))
        if by_exit and len(chosen) > 2:
            chosen.sort(key=lambda p: (-(p[2] + p[3]), p[0]))
        return pd.DataFrame({"video_id": [key[0]], "group_id": [key[1]], "points": [[dict(zip(NAMES, (int(p[0]), *map(float, p[1:5]), int(p[5])))) for p in chosen]]})

    return points.select("video_id", "group_id", *NAMES).groupBy("video_id", "group_id").applyInPandas(pick, f"video_id string, group_id long, points array<{POINT}>")


def finish(events: DataFrame, cfg: dict, height: float | None, first_id: int) -> DataFrame:
    """Events that move enough, with confidence, direction and ids in the order of their least track."""
    first, last = "points[0]", "element_at(points, -1)"
    path = "aggregate(sequence(1, size(points) - 1), 0D, (s, i) -> s + sqrt(pow(points[i].x - points[i - 1].x, 2) + pow(points[i].y - points[i - 1].y, 2)))"
    e = events.where("size(points) >= 2").withColumns({
        "displacement_px": F.expr(f"sqrt(pow({last}.x - {first}.x, 2) + pow({last}.y - {first}.y, 2))"), "path_length_px": F.expr(path),
        "frame_start": F.expr("array_min(transform(points, p -> p.frame))"), "frame_end": F.expr("array_max(transform(points, p -> p.frame))"),
        "ordered_duration": F.expr(f"greatest(0D, {last}.time_sec - {first}.time_sec)"), "y0": F.expr(f"{first}.y"), "y1": F.expr(f"{last}.y"),
    })
    speed = lambda d: F.when(F.col(d) > 0, F.col("path_length_px") / F.col(d)).otherwise(0.0)
    e = e.withColumn("mean_speed_px_sec", speed("duration") if "duration" in events.columns else speed("ordered_duration"))
    e = e.where((F.col("displacement_px") >= cfg["min_event_displacement"]) & (F.col("path_length_px") >= cfg["min_event_path_length"]) & (F.col("mean_speed_px_sec") >= cfg["min_event_mean_speed"]))
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("group_id"))
    e = e.withColumns({"confidence": event_confidence(speed("ordered_duration"), F.size("accepted_track_ids"), F.size("rejected_track_ids"), cfg["min_event_mean_speed"]), "direction": fast_direction(F.col("y0"), F.col("y1"), height), "event_id": (F.lit(first_id - 1) + order).cast("long")})
    return e.select("video_id", "event_id", "source_track_ids", "accepted_track_ids", "rejected_track_ids", "points", "frame_start", "frame_end", "displacement_px", "path_length_px", "mean_speed_px_sec", "confidence", "direction")


def members(tracks: DataFrame) -> DataFrame:
    ids = lambda c: F.sort_array(F.collect_list(c))
    return tracks.groupBy("video_id", "group_id").agg(ids("track_id").alias("source_track_ids"), ids(F.when(F.col("accepted"), F.col("track_id"))).alias("accepted_track_ids"), ids(F.when(~F.col("accepted"), F.col("track_id"))).alias("rejected_track_ids"))


def fast_events(points: DataFrame, assessments: DataFrame, config: dict | None = None, height: float | None = None) -> DataFrame:
    """Events rebuilt from the points of fast tracks."""
    cfg = DEFAULTS | (config or {})
    tracks = select_sources(points, assessments, cfg)
    own = grouped(tracks, group_pairs(tracks, cfg, points))
    chained = chain(points.join(own.select(*KEY, "group_id"), KEY), cfg["order_by_exit_projection"]).where(F.size("points") >= cfg["min_event_points"])
    return finish(chained.join(members(own), ["video_id", "group_id"]), cfg, height, cfg["first_event_id"])


def candidate_events(assessments: DataFrame, config: dict | None = None, fps: float = 25.0, height: float | None = None, exclude: DataFrame | None = None, first_id: int | None = None) -> DataFrame:
    """Events from the ends of assessed tracks alone; ``exclude``: events whose sources are used up."""
    cfg = DEFAULTS | (config or {})
    rows = assessments.where(is_fast(cfg))
    if exclude is not None:
        rows = rows.join(exclude.select("video_id", F.explode("source_track_ids").alias("track_id")), KEY, "left_anti")
    own = grouped(rows, group_pairs(rows, cfg))
    end = lambda e: F.struct(F.col(f"frame_{e}").cast("long").alias("frame"), (F.col(f"frame_{e}") / fps).alias("time_sec"), F.col(f"x_{e}").alias("x"), F.col(f"y_{e}").alias("y"), F.col("mean_area").alias("area"), F.col("track_id"))
    ends = own.select("video_id", "group_id", "frame_start", F.explode(F.array(end("start"), end("end"))).alias("p"))
    rank = F.struct((-(F.col("p.x") + F.col("p.y"))).alias("k"), F.col("frame_start").alias("f"), F.col("p").alias("p"))
    chained = ends.groupBy("video_id", "group_id").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda q: q["p"]).alias("points"), (F.max("p.time_sec") - F.min("p.time_sec")).alias("duration"))
    return finish(chained.join(members(own), ["video_id", "group_id"]), cfg, height, first_id or cfg["first_event_id"])


def both_passes(points: DataFrame, assessments: DataFrame, config: dict | None = None, fps: float = 25.0, height: float | None = None) -> DataFrame:
    """The events from points, then those that the ends of tracks of none of these give; ids go on."""
    first = written(fast_events(points, assessments, config, height))
    more = candidate_events(assessments, config, fps, height, exclude=first)
    made = first.groupBy("video_id").agg(F.count("*").alias("_made"))
    more = more.join(made, "video_id", "left").withColumn("event_id", F.col("event_id") + F.coalesce("_made", F.lit(0)))
    return first.unionByName(more.drop("_made"))


def event_points(events: DataFrame) -> DataFrame:
    return events.select("video_id", "event_id", F.posexplode("points").alias("point_index", "p")).select("video_id", "event_id", "point_index", "p.*")


def corridor_paths(heat: DataFrame, axes: DataFrame, percentile: float = 76.0, width: float = 180.0, bins: int = 21, y_max: float = -1.0, seeds: bool = False) -> DataFrame:
    """For each event (video_id, event_id) with an axis (ax, ay, bx, by) the points, in
    the order of ``bin``, of a path through the warm pixels of a corridor: those of
    its heat (x, y, energy) at or above a percentile of all its positive energies,
    ``width`` or less from the axis, from 40 before its start to 80 past its end,
    opened by a 3 x 3 cross. In each of ``bins`` bins (the reference's setting of
    the name counts their edges, one more) from -20 to length + 50 with 5 pixels or
    more the mean weighted by energy^1.35 (three quarters) and its foot on the axis
    (one quarter); then the truncated mean. The path falls in x + y. Nothing where
    the corridor holds under 10 pixels or 2 bins, or the axis has no length.
    ``seeds`` adds the two ends, fills empty bins on the axis and keeps its order."""
    c, n_bins = F.col, bins if seeds else max(2, bins)
    axis = axes.select(*EVENT, *(c(k).cast("double").alias(k) for k in ("ax", "ay", "bx", "by")))
    axis = axis.withColumn("length", F.sqrt((c("bx") - c("ax")) * (c("bx") - c("ax")) + (c("by") - c("ay")) * (c("by") - c("ay")))).where("length > 1e-6")
    axis = axis.withColumns({"ux": (c("bx") - c("ax")) / c("length"), "uy": (c("by") - c("ay")) / c("length")})
    whole = heat.groupBy(*EVENT).agg(F.percentile(F.when(c("energy") > 0, c("energy")), F.lit(percentile / 100)).alias("edge"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    along = (c("x") - c("ax")) * c("ux") + (c("y") - c("ay")) * c("uy")
    across = F.abs(-(c("x") - c("ax")) * c("uy") + (c("y") - c("ay")) * c("ux"))
    band = heat.join(whole, EVENT).where((c("energy") > 0) & (c("energy") >= c("edge"))).join(axis, EVENT).withColumns({"t": along, "u": across})
    band = band.where((c("t") >= -40.0) & (c("t") <= c("length") + 80.0) & (c("u") <= width))
    band = band.where(c("y") < y_max) if y_max > 0 else band
    # neighbours outside the image hinder no pixel
    cross = pixels.ellipse(3)
    offsets = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in cross))
    near = lambda px: px.withColumn("o", F.explode(offsets)).select(*EVENT, (c("x") + c("o.dx")).alias("x"), (c("y") + c("o.dy")).alias("y"), "x1", "y1")
    inside = sum((((c("x") + i).between(0, c("x1")) & (c("y") + j).between(0, c("y1"))).cast("int") for i, j in cross), F.lit(0))
    core = near(band).where(c("x").between(0, c("x1")) & c("y").between(0, c("y1"))).groupBy(*EVENT, "x", "y", "x1", "y1").agg(F.count("*").alias("n")).where(c("n") == inside)
    warm = band.join(near(core).select(*EVENT, "x", "y").distinct(), [*EVENT, "x", "y"], "left_semi")
    edge = lambda k: F.lit(-20.0) + F.lit(float(k)) * (c("length") + 70.0) / n_bins
    place = sum(((c("t") >= edge(k)).cast("int") for k in range(n_bins + 1)), F.lit(0)) - 1
    w = F.pow("energy", F.lit(1.35))
    mean = warm.withColumn("bin", place).groupBy(*EVENT, "bin").agg(F.count("*").alias("n"), (F.sum(w * c("x")) / F.sum(w)).alias("mx"), (F.sum(w * c("y")) / F.sum(w)).alias("my"))
    of_event = Window.partitionBy(*EVENT)
    mean = mean.withColumn("support", F.sum("n").over(of_event)).where((c("support") >= 10) & c("bin").between(0, n_bins - 1)).join(axis, EVENT)
    foot = (c("mx") - c("ax")) * c("ux") + (c("my") - c("ay")) * c("uy")
    out = mean.where("n >= 5").select(*EVENT, "bin", (0.75 * c("mx") + 0.25 * (c("ax") + c("ux") * foot)).alias("px"), (0.75 * c("my") + 0.25 * (c("ay") + c("uy") * foot)).alias("py"))
    if seeds:
        middle = (edge(0) + (c("bin") + 0.5) * (c("length") + 70.0) / n_bins)
        fixed = axis.withColumn("bin", F.explode(F.sequence(F.lit(-1), F.lit(n_bins)))).withColumn("m", F.when(c("bin") == -1, 0.0).when(c("bin") == n_bins, c("length")).otherwise(middle))
        fixed = fixed.where((c("m") >= 0) & (c("m") <= c("length"))).select(*EVENT, "bin", (c("ax") + c("ux") * c("m")).alias("sx"), (c("ay") + c("uy") * c("m")).alias("sy"))
        enough = warm.groupBy(*EVENT).agg(F.count("*").alias("support")).where("support >= 10").select(*EVENT)
        out = fixed.join(out, [*EVENT, "bin"], "full").join(enough, EVENT, "left_semi").select(*EVENT, "bin", F.coalesce("px", "sx").alias("px"), F.coalesce("py", "sy").alias("py"))
    else:
        total = c("px") + c("py")
        rise = F.max_by(total, "bin").over(of_event) - F.min_by(total, "bin").over(of_event)
        out = out.withColumns({"rise": rise, "all": F.count("*").over(of_event)}).where("all >= 2")
        out = out.withColumn("bin", F.when(c("rise") > 0, n_bins - 1 - c("bin")).otherwise(c("bin")))
    rows = truncated_mean(truncated_mean(out, "px", "bin", EVENT), "py", "bin", EVENT)
    return rows.select(*EVENT, "bin", c("px_m").alias("x"), c("py_m").alias("y"))


def corridor_path(heat: DataFrame, start: tuple[float, float], end: tuple[float, float], percentile: float = 76.0, width: float = 180.0, bins: int = 21, y_max: float = -1.0, seeds: bool = False) -> DataFrame:
    """``corridor_paths`` along one axis in the heat of each video: video_id, bin, x, y."""
    if math.hypot(end[0] - start[0], end[1] - start[1]) <= 1e-6:
        raise ValueError("the ends of the axis coincide")
    event = heat.select("video_id", F.lit(0).alias("event_id"), "x", "y", "energy")
    ends = dict(zip(("ax", "ay", "bx", "by"), (*start, *end)))
    axes = event.select(*EVENT).distinct().withColumns({k: F.lit(float(v)) for k, v in ends.items()})
    return corridor_paths(event, axes, percentile, width, bins, y_max, seeds).drop("event_id")


def event_axis(events: DataFrame, y_min: float = -1.0) -> DataFrame:
    """For each event the ordered pair of its points that makes the axis: the
    greatest distance plus a quarter of the fall of x + y; the first of equals.
    Points above ``y_min`` count where two or more lie below it."""
    p = event_points(events)
    if y_min >= 0:
        low = F.count(F.when(F.col("y") >= y_min, 1)).over(Window.partitionBy("video_id", "event_id"))
        p = p.withColumn("_low", low).where((F.col("_low") < 2) | (F.col("y") >= y_min)).drop("_low")
    a = p.select("video_id", "event_id", F.col("point_index").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select("video_id", "event_id", F.col("point_index").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    score = F.sqrt(dx * dx + dy * dy) - 0.25 * (dx + dy)
    best = a.join(b, ["video_id", "event_id"]).where("i <> j").withColumn("score", score)  # points of one event
    return best.groupBy("video_id", "event_id").agg(F.max_by(F.struct("ax", "ay", "bx", "by"), F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("axis")).select("video_id", "event_id", "axis.*")
