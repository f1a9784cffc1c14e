"""Detections of frames: difference from the background, threshold, morphology,
contours. A frame is a group of a grouped map; what filters whole frames or single
detections are DataFrame operations around it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.operators import filters, pixels, regions

DDL = "video_id string, frame long, det_idx int, x double, y double, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, area double"


def process_window(size: tuple[int, int], cfg: dict) -> tuple[int, int, int, int]:
    """x0, x1, y0, y1 (ends excluded) of the part of a frame that is worked on: the
    region of interest with room for the kernels."""
    pad = max(16, cfg["blur_kernel"] + cfg["morph_open"] + cfg["morph_close"])
    out = []
    for low, high, whole in ((cfg["roi_x_min"], cfg["roi_x_max"], size[0]), (cfg["roi_y_min"], cfg["roi_y_max"], size[1])):
        out.append(max(0, math.floor(low) - pad) if low >= 0 else 0)
        out.append(min(whole, math.ceil(high) + pad + 1) if high >= 0 else whole)
    return tuple(out)


def otsu_level(levels: np.ndarray) -> int:
    """The level that separates the two classes of values 0..255 best; the first of equals."""
    n = np.bincount(levels.ravel(), minlength=256).astype(float)
    low, total = np.cumsum(n), n.sum()
    first, whole = np.cumsum(n * np.arange(256)), float(np.dot(n, np.arange(256)))
    ok = (low > 0) & (low < total)
    gap = np.where(ok, first / np.maximum(low, 1) - (whole - first) / np.maximum(total - low, 1), 0.0)
    return int(np.argmax(low / total * (1 - low / total) * gap * gap))


def difference(frame: np.ndarray, background: np.ndarray, blur: int) -> np.ndarray:
    """Whole levels between the blurred images."""
    smooth = lambda image: np.rint(pixels.gaussian(image, blur)) if blur > 1 and blur % 2 else np.rint(image)
    return np.abs(smooth(frame) - smooth(background))


def foreground_mask(diff: np.ndarray, cfg: dict) -> np.ndarray:
    """Pixels above the threshold (fixed, Otsu's or that of the surroundings), opened and closed."""
    mode = str(cfg["threshold_mode"]).lower()
    if mode == "otsu":
        mask = diff > min(255, max(1, otsu_level(np.clip(diff, 0, 255).astype(int)) + cfg["otsu_offset"]))
    elif mode == "adaptive":
        block = max(3, int(cfg["adaptive_block_size"])) | 1
        mask = pixels.adaptive_threshold(diff, block, cfg["adaptive_c"])
    else:
        mask = diff > cfg["diff_threshold"]
    for size, steps in ((cfg["morph_open"], (False, True)), (cfg["morph_close"], (True, False))):
        if size > 1 and mask.any():
            kernel = pixels.ellipse(size)
            for grow in steps:
                mask = pixels.moved(mask, kernel, grow)
    return mask


def centre_of_mass(path: list[tuple[int, int]]) -> tuple[float, float] | None:
    """Of the surface within a closed line; None where it has none."""
    x, y = np.array(path, float).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    whole = cross.sum()
    if abs(whole) < 1e-9:
        return None
    return tuple(float(((v + np.roll(v, -1)) * cross).sum() / (3 * whole)) for v in (x, y))


COLUMNS = [c.split()[0] for c in DDL.split(", ")][2:]
TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in DDL.split(", ")]


def found_in(frame: np.ndarray, back: np.ndarray, left: int, top: int, cfg: dict) -> list[tuple]:
    """Detections (COLUMNS) of an image beside its background; left, top: where its first pixel lies in the frame.
    None if its mean moved or its foreground is too large."""
    shift = abs(float(frame.mean()) - float(back.mean())) if frame.size else 0.0
    if 0 <= cfg["max_global_intensity_shift"] < shift:
        return []
    mask = foreground_mask(difference(frame, back, cfg["blur_kernel"]), cfg)
    if not mask.any() or 0 < cfg["max_foreground_ratio"] < mask.mean():
        return []
    rows = []
    for i, path in enumerate(pixels.outlines(pixels.label_image(mask))):
        xs, ys = zip(*path)
        box = (min(xs) + left, min(ys) + top, max(xs) + left + 1, max(ys) + top + 1)
        place = centre_of_mass(path) if str(cfg["centroid_mode"]).lower() == "moments" else None
        at = (place[0] + left, place[1] + top) if place else ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
        rows.append((i, *at, *box, pixels.polygon_area(path)))
    return rows


def filtered(found: DataFrame, cfg: dict, region: DataFrame | None = None) -> DataFrame:
    """Area, region (on the detection's pixel), region of interest and crowding, in this order."""
    found = filters.by_area(found, cfg["min_area"], cfg["max_area"])
    if region is not None:
        found = regions.flag_in_region(found, region, "_in").where("_in").drop("_in")
    found = filters.by_roi(found, cfg["roi_x_min"], cfg["roi_x_max"], cfg["roi_y_min"], cfg["roi_y_max"])
    return filters.drop_crowded_frames(found, cfg["max_detections_per_frame"])


def detect(frames: DataFrame, background: DataFrame, cfg: dict, size: tuple[int, int] | None = None, region: DataFrame | None = None) -> DataFrame:
    """Detections (video_id, frame, det_idx, x, y, box with its ends excluded, contour
    area) of frames (video_id, frame, x, y, v of 0..255). A frame whose mean moved, or
    whose foreground is too large, gives none; then area, region (on the
    detection's pixel), region of interest and crowding filter, in this order."""
    px = frames
    if size is not None:
        x0, x1, y0, y1 = process_window(size, cfg)
        px = px.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    both = px.join(background.select(*pixels.PX, F.col("v").alias("b")), pixels.PX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in pixels.whole_groups(batches, ["video_id", "frame"]):
            video, at = (table.column(c).take(pa.array(first)).to_pylist() for c in ("video_id", "frame"))
            px = [table.column(c).to_numpy() for c in ("x", "y", "v", "b")]
            rows = []
            for key, own in zip(zip(video, at), map(slice, first, [*first[1:], table.num_rows])):
                x, y, v, b = (c[own] for c in px)
                left, top = int(x.min()), int(y.min())
                frame, back = (np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1)) for _ in range(2))
                frame[y - top, x - left], back[y - top, x - left] = v, b
                rows += [(*key, *r) for r in found_in(frame, back, left, top, cfg)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=["video_id", "frame", *COLUMNS])

    return filtered(pixels.grouped(both.select("video_id", "frame", "x", "y", "v", "b"), ["video_id", "frame"]).mapInArrow(run, DDL), cfg, region)
