"""Scalar expressions on track points and tracks, as Column builders (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def distance(x0, y0, x1, y1) -> Column:
    dx, dy = F.col(x1) - F.col(x0) if isinstance(x0, str) else x1 - x0, F.col(y1) - F.col(y0) if isinstance(y0, str) else y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def vector_cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Null where either vector is (nearly) of no length."""
    na, nb = norm(ax, ay), norm(bx, by)
    return F.when((na > EPS) & (nb > EPS), (ax * bx + ay * by) / (na * nb))


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def ratio(value: Column, threshold: float) -> Column:
    """value / threshold within [0, 1]; 1 where the threshold asks for nothing."""
    return F.lit(1.0) if threshold <= 0 else clip01(value / F.lit(float(threshold)))


def speed_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) <= EPS, F.lit(1.0)).otherwise(clip01(F.least(a, b) / F.greatest(a, b)))


def bbox_iou(a: str, b: str) -> Column:
    """IoU of two boxes given by column prefixes; 0 where they do not meet."""
    c = lambda p, n: F.col(f"{p}bbox_{n}").cast("double")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    size = lambda p: F.greatest(c(p, "x2") - c(p, "x1"), F.lit(0.0)) * F.greatest(c(p, "y2") - c(p, "y1"), F.lit(0.0))
    union = size(a) + size(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def resolution_scale(value: float, size: tuple[int, int] | None, enabled: bool = True, reference: tuple[int, int] = (1024, 576)) -> float:
    """A length in pixels of the reference resolution as one of ``size``."""
    if size is None or not enabled:
        return float(value)
    return float(value) * max(1.0, math.hypot(max(1, size[0]), max(1, size[1]))) / max(1.0, math.hypot(*reference))


def area_scale(value: float, size: tuple[int, int] | None, enabled: bool = True, reference: tuple[int, int] = (1024, 576)) -> int:
    """An area in pixels of the reference resolution as one of ``size``, 1 at least."""
    if size is None or not enabled:
        return max(1, int(value))
    return max(1, round(value * size[0] * size[1] / (reference[0] * reference[1])))


def pixel(value: Column) -> Column:
    """The pixel of a coordinate, halves to even."""
    return F.rint(value).cast("int")


def direction(start_in: Column, end_in: Column) -> Column:
    return F.when(start_in & end_in, "inside").when(start_in, "exit").when(end_in, "entry").otherwise("outside")


def direction_by_motion(start_y: Column, end_y: Column, height: float) -> Column:
    """For tracks that touch no region: a long vertical move to or from the top band."""
    dy, least, top = end_y - start_y, max(40.0, 0.15 * height), 0.20 * height
    return F.when((dy <= -least) & (end_y <= top), "exit").when((dy >= least) & (start_y <= top), "entry").otherwise("outside")


def fast_direction(start_y: Column, end_y: Column, height: float | None) -> Column:
    if height is None:
        return F.lit("unknown")
    dy = end_y - start_y
    return F.when(dy < -0.12 * height, "exit").when(dy > 0.12 * height, "entry").otherwise("inside")


def heatmap_direction(start_y: Column, end_y: Column) -> Column:
    return F.when(end_y < start_y, "exit").otherwise("entry")


def event_confidence(speed: Column, n_accepted: Column, n_rejected: Column, min_speed: float) -> Column:
    gain = F.lit(0.55) + F.lit(0.35) * F.least(F.lit(1.0), speed / F.lit(max(1.0, 2 * min_speed)))
    return clip01(gain + F.when(n_accepted > 0, 0.2).otherwise(0.0) - F.least(F.lit(0.25), F.lit(0.04) * n_rejected))


def track_quality(n: Column, displacement: Column, path: Column, straightness: Column) -> Column:
    return 0.30 * clip01(n / 12.0) + 0.25 * clip01(displacement / 80.0) + 0.25 * clip01(path / 120.0) + 0.20 * clip01(straightness)


def interval_gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Frames between two intervals; 0 where they meet."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def endpoint_distance(a: str, b: str) -> Column:
    """Least of the four distances between the ends of two tracks (column prefixes)."""
    d = lambda p, q: norm(F.col(f"{a}x_{p}") - F.col(f"{b}x_{q}"), F.col(f"{a}y_{p}") - F.col(f"{b}y_{q}"))
    return F.least(d("start", "start"), d("start", "end"), d("end", "start"), d("end", "end"))


def colour(track_id: Column) -> Column:
    """A stable hex colour of an id."""
    mixed = F.pmod(F.pmod(track_id.cast("long"), F.lit(1 << 24)) * F.lit(2654435761), F.lit(1 << 24))
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(mixed)), 6, "0"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.rint(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def is_red(r: Column, g: Column, b: Column) -> Column:
    """Whether an annotation's pixel is red: hue in [0, 12] or [168, 180] of 180, saturation and value from 70 of 255 on."""
    high, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, 60 * (g - b) / span).when(high == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    half = F.rint(F.when(hue < 0, hue + 360).otherwise(hue) / 2)
    saturation = F.when(high == 0, 0.0).otherwise(F.rint(255 * span / high))
    return ((half <= 12) | (half >= 168)) & (saturation >= 70) & (high >= 70)


def split_list(text: Column) -> Column:
    """Items of a ';' list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def join_list(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), ";")
