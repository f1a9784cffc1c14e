"""Depth layers of a scene, the lower contour of a region, events from heat, and
the summary of timings. What needs a whole image is a kernel on one array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import heatmap_direction
from flightloom.operators import dense, pixels
from flightloom.operators.fast_events import EVENT, corridor_paths, event_axis
from flightloom.operators.pairs import range_join

PX = pixels.PX


@dataclass(frozen=True)
class Layers:
    blur: int = 151
    percentile: float = 85.0
    kernel: int = 9
    min_area_ratio: float = 0.02
    more_percentiles: tuple[float, ...] = ()
    more_dilations: tuple[int, ...] = ()


@dataclass(frozen=True)
class Contour:
    up: int = 18
    down: int = 48
    window: int = 31
    quantile: float = 55.0
    penalty: float = 0.90
    max_step: int = 10
    down_bias: float = 0.10
    mix: float = 0.75
    strong: float = 0.70


def deep_layer(image: np.ndarray, allowed: np.ndarray | None = None, cfg: Layers = Layers()) -> np.ndarray:
    """The dark part at (or else nearest to) the centre column, and further
    layers of lesser depth beside it."""
    depth = 255.0 - np.rint(pixels.gaussian(image, cfg.blur))
    allowed = np.ones(image.shape, bool) if allowed is None else allowed
    kernel = pixels.ellipse(cfg.kernel)
    mask = (depth >= np.percentile(depth, min(99.9, max(50.0, cfg.percentile)))) & allowed
    for grow in (False, True, True, False):  # opened, then closed
        mask = pixels.moved(mask, kernel, grow)
    labels = pixels.label_image(mask)
    if not labels.max():
        return mask
    area = np.bincount(labels.ravel())
    least = max(1, int(cfg.min_area_ratio * mask.size))
    h, w = mask.shape
    chosen = labels[h // 2, w // 2]
    if not chosen or area[chosen] < least:
        columns = {i: np.flatnonzero((labels == i).any(axis=0)) for i in range(1, len(area)) if area[i] >= least}
        off = {i: abs((c[0] + c[-1] + 1) / 2 - w // 2) for i, c in columns.items()}
        chosen = min(off, key=off.get) if off else 1 + int(np.argmax(area[1:]))
    out = labels == chosen
    for percent, radius in zip(cfg.more_percentiles, cfg.more_dilations):
        layer = depth >= np.percentile(depth, min(99.9, max(0.0, percent)))
        out = out | (pixels.moved(out, pixels.ellipse(2 * radius + 1), True) & layer & allowed)
    return out


def smooth_path(score: np.ndarray, penalty: float, max_step: int) -> np.ndarray:
    """The row of each column of a score table (-inf: not allowed) that makes the
    greatest sum less ``penalty`` a row moved, at most ``max_step`` a column."""
    n, m = score.shape
    best, back = np.full((n, m), -np.inf), np.zeros((n, m), np.int64)
    best[0] = score[0]
    moves = np.arange(-max_step, max_step + 1)
    for i in range(1, n):
        padded = np.pad(best[i - 1], max_step, constant_values=-np.inf)
        reach = np.stack([padded[max_step + d : max_step + d + m] - penalty * abs(d) for d in moves])
        k = reach.argmax(axis=0)
        step = reach[k, np.arange(m)]
        fresh = not np.isfinite(best[i - 1]).any()
        best[i] = score[i] + (0.0 if fresh else step)
        back[i] = np.arange(m) + (0 if fresh else moves[k])
    path = np.empty(n, np.int64)
    path[-1] = m - 1 - int(np.argmax(best[-1][::-1]))  # the lowest of equals
    for i in range(n - 1, 0, -1):
        path[i - 1] = min(m - 1, max(0, back[i, path[i]]))
    return path


def snap_lower_contour(mask: np.ndarray, depth: np.ndarray, cfg: Contour = Contour()) -> np.ndarray:
    """The mask with its lower edge on the strong depth edges near it: in each
    column the deepest strong one, mixed with a smooth path through all columns,
    and averaged along x."""
    h, w = mask.shape
    p = np.pad(depth.astype(float), 1, mode="reflect")
    edge = np.abs((p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:]))
    floor = np.percentile(edge, cfg.quantile)
    columns = np.flatnonzero(mask.any(axis=0))
    top = np.array([np.flatnonzero(mask[:, x])[0] for x in columns], np.int64)
    low = np.array([np.flatnonzero(mask[:, x])[-1] for x in columns], np.int64)
    room = np.minimum(h - 1, low + cfg.down) > np.maximum(top, low - cfg.up)
    columns, top, low = columns[room], top[room], low[room]
    if not len(columns):
        return mask
    snapped = []
    for x, t, b in zip(columns, top, low):
        y0 = max(t, b - cfg.up)
        col = edge[y0 : min(h - 1, b + cfg.down) + 1, x]
        strong = np.flatnonzero(col >= max(floor, col.max() * cfg.strong))
        y = y0 + (strong[-1] if len(strong) else int(col.argmax()))
        y = b if col.max() < floor else y
        snapped.append(min(h - 1, t + 1) if y <= t else y)
    offsets = np.arange(-cfg.up, cfg.down + 1)
    y = low[:, None] + offsets
    ok = (y >= top[:, None] + 1) & (y <= h - 1)
    path = low
    if ok.any() and len(offsets) > 1:
        score = np.where(ok, edge[np.clip(y, 0, h - 1), columns[:, None]], -np.inf)
        score = score / max(1e-6, np.percentile(score[ok], 90)) + cfg.down_bias * offsets / max(1, cfg.down)
        path = np.clip(low + offsets[smooth_path(score, cfg.penalty, max(1, cfg.max_step))], top + 1, h - 1)
    mixed = (1 - cfg.mix) * np.array(snapped, float) + cfg.mix * path
    half = cfg.window // 2
    mean = np.convolve(np.pad(mixed, half, mode="edge"), np.ones(2 * half + 1) / (2 * half + 1), "valid")
    bottom = np.clip(np.rint(mean).astype(int), top + 1, h - 1)
    out = np.zeros_like(mask, bool)
    for x, t, b in zip(columns, top, bottom):
        out[t : b + 1, x] = True
    return out


def region_mask(image: np.ndarray, x_start: int, x_end: int, method: str = "horizontal_illumination_profile", mode: str = "and", cfg: Layers = Layers(), contour: Contour | None = None) -> np.ndarray:
    """The valid region of an image by one of three methods: the band of columns that was found in its
    profile, the deep layer, or the deep layer within the band, both (and / or) taken together, the larger of the two where
    nothing is left. The lower contour of the latter two is snapped to depth edges if asked for."""
    band = np.zeros(image.shape, bool)
    band[:, x_start : x_end + 1] = True
    if method == "horizontal_illumination_profile":
        return band
    if method == "central_deep_layer":
        mask = deep_layer(image, None, cfg)
    else:
        deep = deep_layer(image, band, cfg)
        mask = deep | band if mode == "or" else deep & band
        if not mask.any():
            mask = deep if deep.sum() >= band.sum() else band
    return mask if contour is None else snap_lower_contour(mask, 255.0 - np.rint(pixels.gaussian(image, cfg.blur)), contour)


def deep_layers(images: DataFrame, region: DataFrame | None = None, cfg: Layers = Layers(), contour: Contour | None = None) -> DataFrame:
    """Pixels of each video's deep layer from its image (video_id, x, y, v)."""
    own = images.select(*PX, F.col("v").cast("double").alias("v"))
    own = own.join(region.select(*PX, F.lit(True).alias("ok")), PX, "left").withColumn("ok", F.coalesce("ok", F.lit(False))) if region is not None else own.withColumn("ok", F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, ok = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1)), np.zeros((pdf.y.max() + 1, pdf.x.max() + 1), bool)
        image[pdf.y, pdf.x], ok[pdf.y, pdf.x] = pdf.v, pdf.ok
        mask = deep_layer(image, ok, cfg)
        if contour is not None:
            mask = snap_lower_contour(mask, 255.0 - pixels.gaussian(image, cfg.blur), contour) & ok
        y, x = np.nonzero(mask)
        return pd.DataFrame({"video_id": pdf.video_id.iloc[0], "x": x.astype(np.int32), "y": y.astype(np.int32)})

    return own.groupBy("video_id").applyInPandas(run, "video_id string, x int, y int")


def combined_region(band: DataFrame | None, deep: DataFrame | None, mode: str = "and") -> DataFrame:
    """The band, the deep layer, or both (and / or); where "and" leaves a video
    nothing, its larger one of the two."""
    if band is None or deep is None:
        return deep if band is None else band
    if mode == "or":
        return band.select(*PX).union(deep.select(*PX)).distinct()
    both = band.select(*PX).intersect(deep.select(*PX))
    n = lambda m, name: m.groupBy("video_id").agg(F.count("*").alias(name))
    empty = n(band, "nb").join(n(deep, "nd"), "video_id", "full").join(both.select("video_id").distinct(), "video_id", "left_anti")
    pick = lambda m, cond: m.select(*PX).join(empty.where(cond).select("video_id"), "video_id", "left_semi")
    return both.unionByName(pick(band, "coalesce(nb, 0) >= coalesce(nd, 0)")).unionByName(pick(deep, "coalesce(nb, 0) < coalesce(nd, 0)"))


def region_box(region: DataFrame) -> DataFrame:
    return region.groupBy("video_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def exclude_zone(vegetation: DataFrame, zone: DataFrame, background: DataFrame, mode: str = "weak_evidence", dilate_px: int = 0, texture_percent: float = 88.0, intensity_percent: float = 35.0, min_gradient: float = 4.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Vegetation less the pixels in the entry zone; under ``weak_evidence`` those
    with strong texture and enough light stay, under ``none`` all do."""
    if mode == "none":
        return vegetation
    zone = pixels.dilate(zone, pixels.ellipse(2 * dilate_px + 1), size) if dilate_px > 0 else zone
    inside = vegetation.select(*PX).join(zone.select(*PX).distinct(), PX, "left_semi")
    if mode == "weak_evidence":
        grad = pixels.per_image(background.select(*PX, F.col("v").cast("double").alias("v")), pixels.sobel, ("video_id",)).withColumnRenamed("v", "g").join(background.select(*PX, "v"), PX)
        share = lambda p, a, b: F.lit(min(b, max(a, p)) / 100)
        edges = grad.groupBy("video_id").agg(F.greatest(F.lit(min_gradient), F.percentile("g", share(texture_percent, 50.0, 99.5))).alias("eg"), F.percentile("v", share(intensity_percent, 1.0, 95.0)).alias("ev"))
        structural = grad.join(edges, "video_id").where("g >= eg and v >= ev").select(*PX)
        inside = inside.join(structural, PX, "left_anti")
    return vegetation.join(inside, PX, "left_anti")


def heatmap_events(events: DataFrame, frames: DataFrame, frame_count: int | None = None, threshold: float = 14.0, padding: int = 0, percentile: float = 76.0, width: float = 180.0, bins: int = 21, min_points: int = 6, min_displacement: float = 80.0, first_id: int = 20001, max_events: int = 0, y_min: float = -1.0, y_max: float = -1.0, blur: int = 0) -> DataFrame:
    """An event for each fast event whose heat makes a path: its frames by a band
    join, motion summed within them and blurred, the path along its axis, all in one
    plan keyed by (video, event). frames: pixel rows, or dense frames, whose changes are then blurred (``blur``) and opened. Ids and ``max_events`` count within a video;
    without ``frame_count`` a video ends with its last frame."""
    last = F.lit(frame_count - 1) if frame_count else F.col("_last")
    events = events.join(frames.groupBy("video_id").agg(F.max("frame").alias("_last")), "video_id")
    if max_events > 0:
        events = events.withColumn("_rank", F.row_number().over(Window.partitionBy("video_id").orderBy("event_id"))).where(F.col("_rank") <= max_events)
    spans = events.select(*EVENT, "source_track_ids", F.greatest(F.col("frame_start") - padding, F.lit(0)).alias("l_start"), F.least(F.col("frame_end") + padding, last).alias("l_end")).where("l_end > l_start")
    at = frames.select("video_id", "frame").distinct().select("video_id", "frame", F.col("frame").alias("r_start"), F.col("frame").alias("r_end"))
    own = range_join(spans.drop("source_track_ids"), at, 0, 64).select(*EVENT, "frame").join(frames, ["video_id", "frame"])
    name = F.concat_ws("#", "video_id", "event_id")
    own = own.withColumn("video_id", name).drop("event_id")
    if "pixels" in own.columns:
        heat = dense.to_pixels(dense.blurred_heat(dense.motion_energy(own, threshold, blur, 3)), "energy", "f8", "energy")
    else:
        heat = pixels.blurred_heat(pixels.motion_energy(own, threshold))
    heat = heat.withColumnRenamed("video_id", "_name")
    heat = heat.join(spans.select(*EVENT, name.alias("_name")), "_name").drop("_name")
    found = corridor_paths(heat, event_axis(events, y_min), percentile, width, bins, y_max)
    paths = found.groupBy(*EVENT).agg(F.sort_array(F.collect_list(F.struct("bin", "x", "y"))).alias("p")).where(F.size("p") >= min_points)
    first, end = F.col("p")[0], F.element_at("p", -1)
    paths = paths.where(F.sqrt(F.pow(end["x"] - first["x"], 2) + F.pow(end["y"] - first["y"], 2)) >= min_displacement)
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("event_id"))
    out = paths.join(spans, EVENT).withColumn("_id", (F.lit(first_id - 1) + number).cast("long"))
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    out = out.select("video_id", F.col("_id").alias("event_id"), F.col("event_id").alias("source_fast_event_id"), "source_track_ids", F.col("l_start").alias("frame_start"), F.col("l_end").alias("frame_end"), points.alias("points"))
    return out.withColumn("direction", heatmap_direction(F.col("points")[0]["y"], F.element_at("points", -1)["y"]))


def timings(records: DataFrame, total_sec: float, frames: int) -> DataFrame:
    """phase, total_sec, percent_total, mean / median / p95 a frame, executions
    from records (phase, frame, duration_sec, executions); frames without one count as 0."""
    n = max(1, frames)
    per = records.where(F.col("frame").between(0, n - 1)).groupBy("phase", "frame").agg(F.sum("duration_sec").alias("d"))
    spine = records.select("phase").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("phase", F.col("frame").cast("long").alias("frame"))
    dense = spine.join(per, ["phase", "frame"], "left").fillna(0.0, ["d"]).groupBy("phase").agg(F.avg("d").alias("mean_sec_per_frame"), F.percentile("d", F.lit(0.5)).alias("median_sec_per_frame"), F.percentile("d", F.lit(0.95)).alias("p95_sec_per_frame"))
    whole = records.groupBy("phase").agg(F.sum("duration_sec").alias("total_sec"), F.sum("executions").alias("executions"))
    return whole.join(dense, "phase").withColumn("percent_total", F.lit(100.0) * F.col("total_sec") / total_sec if total_sec > 0 else F.lit(0.0))
