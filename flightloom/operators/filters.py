"""Detection filters, and the track filter with its audit of reasons."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import join_list, ratio, resolution_scale
from flightloom.operators.summary import KEY, steps, summarise


@dataclass(frozen=True)
class TrackFilter:
    """Thresholds of the track filter; lengths in pixels of the reference resolution if ``scale``."""

    min_length: int = 1
    min_duration_sec: float = 0.0
    min_displacement: float = 0.0
    min_path: float = 0.0
    min_straightness: float = 0.0
    static_noise: bool = False
    static_min_duration_sec: float = 3.0
    static_max_speed_ratio: float = 0.0
    static_max_displacement_ratio: float = 0.0
    static_min_fraction: float = 0.0
    static_step_ratio: float = 0.0005
    max_gap: int = 0
    loiter: bool = False
    loiter_min_duration_sec: float = 10.0
    loiter_min_displacement_ratio: float = 0.0
    require_region: bool = False
    scale: bool = False

    @classmethod
    def from_config(cls, tracking: dict) -> TrackFilter:
        names = {
            "min_length": "min_track_length", "min_duration_sec": "min_track_duration_sec", "min_displacement": "min_track_displacement", "min_path": "min_track_path_length", "min_straightness": "min_track_straightness",
            "static_noise": "static_noise_filter_enabled", "static_min_duration_sec": "static_noise_min_duration_sec", "static_max_speed_ratio": "static_noise_max_mean_speed_ratio_per_sec", "static_max_displacement_ratio": "static_noise_max_displacement_ratio_per_sec",
            "static_min_fraction": "static_noise_min_static_fraction", "static_step_ratio": "static_noise_static_step_ratio_per_frame", "max_gap": "max_track_internal_gap_frames", "loiter": "loiter_filter_enabled", "loiter_min_duration_sec": "loiter_min_duration_sec",
            "loiter_min_displacement_ratio": "loiter_min_displacement_ratio", "require_region": "require_start_or_end_in_valid_region", "scale": "auto_scale_with_resolution",
        }
        return cls(**{k: tracking[v] for k, v in names.items() if v in tracking})


def by_area(detections: DataFrame, least: float, most: float) -> DataFrame:
    return detections.where(F.col("area").between(least, most))


def by_roi(detections: DataFrame, x_min: float = -1, x_max: float = -1, y_min: float = -1, y_max: float = -1) -> DataFrame:
    """Four bounds of their own; a negative one is off."""
    for bound, test in ((x_min, F.col("x") >= x_min), (x_max, F.col("x") <= x_max), (y_min, F.col("y") >= y_min), (y_max, F.col("y") <= y_max)):
        detections = detections.where(test) if bound >= 0 else detections
    return detections


def drop_crowded_frames(detections: DataFrame, most: int) -> DataFrame:
    """No detections of frames with more than ``most`` (0: off)."""
    if most <= 0:
        return detections
    n = F.count("*").over(Window.partitionBy("video_id", "frame"))
    return detections.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def drop_frames(detections: DataFrame, frame_stats: DataFrame, max_shift: float = -1, max_foreground: float = -1) -> DataFrame:
    """No detections of frames whose mean moved from the background's by more
    than ``max_shift``, or whose foreground share exceeds ``max_foreground``;
    frame_stats: video_id, frame, mean_shift, foreground."""
    bad = F.lit(False)
    bad = bad | (F.abs("mean_shift") > max_shift) if max_shift >= 0 else bad
    bad = bad | (F.col("foreground") > max_foreground) if max_foreground >= 0 else bad
    return detections.join(frame_stats.where(bad).select("video_id", "frame"), ["video_id", "frame"], "left_anti")


def assess(points: DataFrame, rules: TrackFilter, fps: float, size: tuple[int, int], stripped: DataFrame | None = None, directions: DataFrame | None = None) -> DataFrame:
    """A row for each track: its summary, score, reject_reasons (array, in the
    order of the rules), accepted, direction.

    ``stripped``: the points less jitter; a track with fewer than two of them is
    rejected as ``vegetation_mask`` with score 0, on its original points.
    ``directions`` brings direction, start_in, end_in (else unknown, null).
    A track rejected for its length alone is accepted all the same if it lasts
    long enough and scores 0.9 or more."""
    diag = max(1.0, math.hypot(*size))
    from_sec = math.ceil(max(0.0, rules.min_duration_sec) * max(1e-6, fps))
    min_length = max(rules.min_length, from_sec)
    min_displacement, min_path = (resolution_scale(v, size, rules.scale) for v in (rules.min_displacement, rules.min_path))
    c, n = F.col, F.col("num_detections")
    whole = summarise(points)
    static_step = rules.static_step_ratio * diag
    kept = stripped if stripped is not None else points
    share = steps(kept).where("step is not null").groupBy(*KEY).agg(F.avg(F.when(c("step_per_frame") < static_step, 1.0).otherwise(0.0)).alias("static_fraction"))
    own = summarise(kept).where("num_detections >= 2").join(share, KEY, "left")
    score = (ratio(n.cast("double"), min_length) + ratio(c("displacement_px"), min_displacement) + ratio(c("path_length_px"), min_path) + ratio(c("straightness"), rules.min_straightness)) / 4.0
    duration = c("duration_sec")
    noise = F.lit(False)
    if rules.static_noise:
        if rules.static_max_speed_ratio > 0 and rules.static_max_displacement_ratio > 0:
            rate = F.when(duration > 0, c("displacement_px") / duration).otherwise(0.0)
            noise = noise | ((c("mean_speed_px_sec") < rules.static_max_speed_ratio * diag) & (rate < rules.static_max_displacement_ratio * diag))
        if rules.static_min_fraction > 0:
            noise = noise | (c("static_fraction") >= rules.static_min_fraction)
        noise = noise & (duration >= rules.static_min_duration_sec)
    loiter = F.lit(rules.loiter and rules.loiter_min_duration_sec > 0 and rules.loiter_min_displacement_ratio > 0) & (duration >= rules.loiter_min_duration_sec) & (c("displacement_px") / diag < rules.loiter_min_displacement_ratio)
    tests = [
        ("min_track_length", n < min_length), ("min_track_displacement", c("displacement_px") < min_displacement), ("min_track_path_length", c("path_length_px") < min_path),
        ("min_track_straightness", F.lit(rules.min_straightness > 0) & (c("path_length_px") > 0) & (c("straightness") < rules.min_straightness)),
        ("static_noise", noise), ("temporal_gap", F.lit(rules.max_gap > 0) & (c("max_gap") > rules.max_gap)), ("loiter", loiter),
    ]
    if directions is not None:
        own = own.join(directions.select(*KEY, "direction", "start_in", "end_in"), KEY, "left")
    else:
        own = own.withColumns({"direction": F.lit("unknown"), "start_in": F.lit(None).cast("boolean"), "end_in": F.lit(None).cast("boolean")})
    if rules.require_region:  # the documented gate, an option of ours
        tests.append(("valid_region_gate", ~(F.coalesce("start_in", F.lit(False)) | F.coalesce("end_in", F.lit(False)))))
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests)))
    own = own.withColumns({"score": score, "_reasons": reasons})
    rescued = (F.size("_reasons") == 1) & F.array_contains("_reasons", "min_track_length") & (n >= from_sec) & (c("score") >= 0.9)
    empty = F.array().cast("array<string>")
    own = own.withColumn("reject_reasons", F.when(rescued, empty).otherwise(c("_reasons"))).drop("_reasons", "static_fraction")
    lost = whole.join(own.select(*KEY), KEY, "left_anti").withColumns({"score": F.lit(0.0), "reject_reasons": F.array(F.lit("vegetation_mask")), "direction": F.lit("unknown"), "start_in": F.lit(None).cast("boolean"), "end_in": F.lit(None).cast("boolean")})
    return own.unionByName(lost).withColumn("accepted", F.size("reject_reasons") == 0)


def accepted_points(points: DataFrame, assessments: DataFrame) -> DataFrame:
    return points.join(assessments.where("accepted").select(*KEY), KEY, "left_semi")


def with_reason_text(assessments: DataFrame) -> DataFrame:
    return assessments.withColumn("reject_reasons", join_list(F.col("reject_reasons")))


def rescue_by_motion(accepted: DataFrame, points: DataFrame, assessments: DataFrame, touching: DataFrame, reasons: tuple[str, ...] = ("valid_region_gate", "vegetation_mask"), min_points: int = 3, min_displacement: float = 18.0, min_path: float = 24.0, min_speed: float = 120.0, min_straightness: float = 0.0) -> DataFrame:
    """``accepted`` plus the unstripped points of rejected tracks that were
    rejected for the given reasons only, move like flight and touch the region
    (``touching``: keys of tracks with a point in it)."""
    c = F.col
    subset = (F.size("reject_reasons") > 0) & (F.size(F.array_except("reject_reasons", F.array(*map(F.lit, reasons)))) == 0)
    fit = (c("num_detections") >= min_points) & (c("displacement_px") >= min_displacement) & (c("path_length_px") >= min_path) & (c("mean_speed_px_sec") >= min_speed) & (c("straightness") >= min_straightness)
    whole = summarise(points).join(assessments.where(~c("accepted") & subset).select(*KEY), KEY, "left_semi").where(fit)
    keys = whole.join(touching.select(*KEY).distinct(), KEY, "left_semi").join(accepted.select(*KEY).distinct(), KEY, "left_anti").select(*KEY)
    return accepted.unionByName(points.join(keys, KEY, "left_semi").select(*accepted.columns))


def visible_tracks(points: DataFrame, assessments: DataFrame, min_length: int = 1, directions: tuple[str, ...] = (), suppressed: DataFrame | None = None) -> DataFrame:
    """Points of the tracks that a reviewer sees."""
    shown = assessments.where(F.col("num_detections") >= min_length)
    shown = shown.where(F.col("direction").isin(*directions)) if directions else shown
    shown = shown.join(suppressed.select(*KEY), KEY, "left_anti") if suppressed is not None else shown
    return points.join(shown.select(*KEY), KEY, "left_semi")


def trail_window(points: DataFrame, now: int, length: int) -> DataFrame:
    return points.where(F.col("frame").between(now - length, now))
