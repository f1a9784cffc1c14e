"""Window and sequence functions over the points of a track."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import norm
from flightloom.operators.summary import KEY, by_frame, of_track


def smooth(points: DataFrame, window: int = 5) -> DataFrame:
    """x_s, y_s: centred moving average over an odd window, the ends padded with
    the end points; tracks shorter than the window stay as they are."""
    if window < 3 or window % 2 == 0:
        raise ValueError(f"window must be odd and 3 at least, got {window}")
    half = window // 2
    near = by_frame().rowsBetween(-half, half)
    n, i = F.count("*").over(of_track()), F.row_number().over(by_frame())
    before, after = F.greatest(half - (i - 1), F.lit(0)), F.greatest(half - (n - i), F.lit(0))
    every = by_frame().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = lambda c: (F.sum(c).over(near) + before * F.first(c).over(every) + after * F.last(c).over(every)) / window
    return points.withColumns({f"{c}_s": F.when(n < window, F.col(c)).otherwise(mean(c)) for c in ("x", "y")})


def smooth_profile(profile: DataFrame, value: str, position: str, by: list[str], window: int) -> DataFrame:
    """The same average along a profile, of whatever length."""
    half = window // 2
    w, whole = Window.partitionBy(*by).orderBy(position), Window.partitionBy(*by)
    n, i = F.count("*").over(whole), F.row_number().over(w)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(value).over(w.rowsBetween(-half, half)) + F.greatest(half - (i - 1), F.lit(0)) * F.first(value).over(every) + F.greatest(half - (n - i), F.lit(0)) * F.last(value).over(every)
    return profile.withColumn(f"{value}_s", total / window)


def truncated_mean(rows: DataFrame, value: str, position: str, by: list[str], reach: int = 2) -> DataFrame:
    """Mean over the neighbours there are, the two ends kept."""
    w = Window.partitionBy(*by).orderBy(position)
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn(f"{value}_m", F.when((i == 1) | (i == n), F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-reach, reach))))


def central_speed(points: DataFrame) -> DataFrame:
    """speed: from the point before to the one after (itself at the ends)."""
    at = lambda f, c: F.coalesce(f(c).over(by_frame()), F.col(c))
    dt = F.greatest(at(F.lead, "time_sec") - at(F.lag, "time_sec"), F.lit(1e-6))
    return points.withColumn("speed", norm(at(F.lead, "x") - at(F.lag, "x"), at(F.lead, "y") - at(F.lag, "y")) / dt)


def backward_velocity(points: DataFrame) -> DataFrame:
    """vx, vy per second from the point before; 0 for the first."""
    dt = F.greatest(F.col("time_sec") - F.lag("time_sec").over(by_frame()), F.lit(1e-6))
    return points.withColumns({f"v{c}": F.coalesce((F.col(c) - F.lag(c).over(by_frame())) / dt, F.lit(0.0)) for c in ("x", "y")})


def islands(rows: DataFrame, flag: str, by: list[str], order: str) -> DataFrame:
    """run: number of the run of equal flags, run_length: its rows."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.col(flag) == F.lag(flag).over(w), 0).otherwise(1)
    out = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
    return out.withColumn("run_length", F.count("*").over(Window.partitionBy(*by, "run")))


def strip_jitter(points: DataFrame, in_mask: str, min_speed: float, min_run: int = 3, strict: bool = False) -> DataFrame:
    """Points less the jitter in a mask: all of them (strict), or runs of
    ``min_run`` slow ones; tracks of fewer than three points, and such of which
    fewer than two would stay, are left alone (the latter not if strict)."""
    n = F.count("*").over(of_track())
    if strict:
        return points.withColumn("_n", n).where((F.col("_n") < 3) | ~F.col(in_mask)).drop("_n")
    noisy = central_speed(points).withColumn("_noisy", F.col(in_mask) & (F.col("speed") < min_speed))
    marked = islands(noisy, "_noisy", KEY, "frame").withColumn("_drop", F.col("_noisy") & (F.col("run_length") >= max(2, min_run)))
    left = F.sum(F.when(~F.col("_drop"), 1).otherwise(0)).over(of_track())
    return marked.withColumns({"_left": left, "_n": n}).where((F.col("_n") < 3) | (F.col("_left") < 2) | ~F.col("_drop")).drop("_left", "_n", "_drop", "_noisy", "speed", "run", "run_length")


def burst_frames(points: DataFrame, min_points: int, window: int, trigger: int, cooldown: int) -> DataFrame:
    """Intervals (video_id, first, last) of suppressed frames: where ``trigger``
    crowded frames lie in a window, from the first of them on, ``cooldown``
    frames past the window's end. Windows are looked at on all frames between
    the first and the last."""
    counts = points.groupBy("video_id", "frame").agg(F.count("*").alias("n"))
    span = counts.groupBy("video_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    high = counts.where(F.col("n") >= min_points).select("video_id", "frame")
    # a window that ends at f holds the crowded frames f - window + 1 .. f: each crowded frame tells the ends that see it
    seen = high.join(span, "video_id").select("video_id", F.col("frame").alias("high"), F.explode(F.expr(f"sequence(frame, least(b, frame + {window - 1}))")).alias("end"))
    hits = seen.groupBy("video_id", "end").agg(F.count("*").alias("n"), F.min("high").alias("first")).where(F.col("n") >= trigger)
    return hits.select("video_id", "first", (F.col("end") + max(0, cooldown)).alias("last"))


def suppress_bursts(points: DataFrame, min_points: int, window: int, trigger: int, cooldown: int) -> DataFrame:
    """Points less every track that has one in a suppressed frame."""
    if min_points <= 0 or window <= 0 or trigger <= 0:
        return points
    hit = burst_frames(points, min_points, window, trigger, cooldown).select("video_id", F.explode(F.sequence("first", "last")).alias("frame")).distinct()
    bad = points.join(hit, ["video_id", "frame"], "left_semi").select(*KEY).distinct()
    return points.join(bad, KEY, "left_anti")


class Gate:
    """The live gate: frames are kept unless ``trigger`` crowded ones lie in the
    last ``window`` frames, which starts a cooldown; hits count during one too."""

    def __init__(self, min_detections: int, window: int, trigger: int, cooldown: int):
        self.least, self.window, self.trigger, self.cooldown = min_detections, window, trigger, cooldown
        self.hits: deque = deque()
        self.until = -1

    def step(self, frame: int, n: int) -> bool:
        if n >= self.least:
            self.hits.append(frame)
        while self.hits and self.hits[0] <= frame - self.window:
            self.hits.popleft()
        cooling, fires = frame <= self.until, len(self.hits) >= self.trigger
        if fires and not cooling:
            self.until = frame + self.cooldown - 1
        return not cooling and not fires


def burst_gate(counts: DataFrame, min_detections: int, window: int, trigger: int, cooldown: int) -> DataFrame:
    """The live gate on per-frame counts (video_id, frame, n): keep. No state
    outlives window + cooldown frames without a crowded one, so a video falls
    into stretches there, and each is one pass over its frames."""
    w = Window.partitionBy("video_id").orderBy("frame")
    crowded = F.last(F.when(F.col("n") >= min_detections, F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when((F.col("n") >= min_detections) & (F.col("frame") - crowded <= window + cooldown), 0).when(F.col("n") >= min_detections, 1).otherwise(0)
    parts = counts.withColumn("_cut", cut).withColumn("stretch", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        gate = Gate(min_detections, window, trigger, cooldown)
        pdf = pdf.sort_values("frame")
        return pd.DataFrame({"video_id": key[0], "frame": pdf.frame, "keep": [gate.step(int(f), int(n)) for f, n in zip(pdf.frame, pdf.n)]})

    return parts.groupBy("video_id", "stretch").applyInPandas(run, "video_id string, frame long, keep boolean")


def coherent_trails(points: DataFrame, history: int = 12, max_gap: int = 2, min_points: int = 3, min_path: float = 14.0, min_displacement: float = 10.0, min_straightness: float = 0.2, radius: float = 14.0, min_segment: float = 4.0) -> DataFrame:
    """coherent: whether the last ``history`` points up to each one, since the
    last gap of over ``max_gap`` frames, look like flight."""
    gap = F.when(F.col("frame") - F.lag("frame").over(by_frame()) > max_gap, 1).otherwise(0)
    session = points.withColumn("_g", gap).withColumn("_s", F.sum("_g").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*KEY, "_s").orderBy("frame")
    last = own.rowsBetween(-(history - 1), 0)
    step = norm(F.col("x") - F.lag("x").over(own), F.col("y") - F.lag("y").over(own))
    out = session.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    # the first step of the history belongs to a point before it
    seg = own.rowsBetween(-(history - 2), 0)
    out = out.withColumns({
        "_n": F.count("*").over(last), "_path": F.sum("_step").over(seg), "_big": F.max("_step").over(seg), "_d": norm(F.col("x") - F.first("x").over(last), F.col("y") - F.first("y").over(last)),
        "_span": norm(F.max("x").over(last) - F.min("x").over(last), F.max("y").over(last) - F.min("y").over(last)),
    })
    straight = F.when(F.col("_path") > 1e-6, F.col("_d") / F.col("_path")).otherwise(1.0)
    ok = (F.col("_n") >= min_points) & (F.col("_path") >= min_path) & (F.col("_d") >= min_displacement) & (straight >= min_straightness) & (F.col("_span") >= radius) & (F.col("_big") >= min_segment)
    return out.withColumn("coherent", ok).drop("_g", "_s", "_step", "_n", "_path", "_big", "_d", "_span")


def sessions(points: DataFrame, max_gap: int) -> DataFrame:
    """session: number of the stretch of a track without a gap of over ``max_gap`` frames (an extension)."""
    gap = F.when(F.col("frame") - F.lag("frame").over(by_frame()) > max_gap, 1).otherwise(0)
    return points.withColumn("_g", gap).withColumn("session", F.sum("_g").over(by_frame().rowsBetween(Window.unboundedPreceding, 0))).drop("_g")
