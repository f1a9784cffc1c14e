"""Pixel algebra. Frames and masks are sparse tables (video_id, frame, x, y, v /
video_id, x, y); what needs neighbourhoods of whole images runs on arrays, an
image a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.operators.windows import islands, smooth_profile

PX = ["video_id", "x", "y"]


def sample_frames(frame_count: int, n: int, uniform: bool = True, start: int = 0, end: int | None = None) -> list[int]:
    """Frame numbers of a sample: n evenly spaced (cut down to whole ones) or the first n of [start, end)."""
    stop = frame_count if end is None else min(end, frame_count)
    start = max(0, min(start, max(0, stop - 1)))
    total = max(0, stop - start)
    n = min(max(1, n), total)
    if n <= 0:
        return []
    if not uniform or n == 1:
        return list(range(start, start + n))
    return sorted({int(start + i * (total - 1) / (n - 1)) for i in range(n)})


def at_frames(frames: DataFrame, numbers: list[int]) -> DataFrame:
    """The sampled frames only; the list is short and goes into the scan's filter."""
    return frames.where(F.col("frame").isin(*numbers)) if len(numbers) <= 1000 else frames.join(frames.sparkSession.createDataFrame([(n,) for n in numbers], "frame long"), "frame", "left_semi")


def background_median(frames: DataFrame, truncate: bool = False) -> DataFrame:
    """Median of each pixel over the frames (cut down to a whole number if asked for)."""
    v = F.percentile("v", F.lit(0.5))
    return frames.groupBy(*PX).agg((F.floor(v).cast("int") if truncate else v).alias("v"))


def motion_energy(frames: DataFrame, threshold: float = 0.0, blur: int = 0, open_size: int = 0, region: DataFrame | None = None) -> DataFrame:
    """Sum of each pixel's changes from frame to frame above a threshold. If asked
    for, frames are blurred before, the pixels above it opened after, and
    only the pixels of a region count."""
    frames = per_image(frames.select(*PX, "frame", "v"), lambda image: gaussian(image, blur)) if blur > 1 else frames
    change = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy(*PX).orderBy("frame")))
    d = frames.withColumn("v", change)
    if open_size > 1:
        kernel = ellipse(open_size)
        whole = lambda image: np.where(moved(moved(image > threshold, kernel, False), kernel, True), image, 0.0)
        d, threshold = per_image(d.select(*PX, "frame", "v").where("v is not null"), whole), 0.0
    d = d.join(region.select(*PX).distinct(), PX, "left_semi") if region is not None else d
    return d.groupBy(*PX).agg(F.coalesce(F.sum(F.when(F.col("v") > threshold, F.col("v"))), F.lit(0.0)).alias("energy"))


def above_percentile(heat: DataFrame, percent: float, column: str = "energy", positive: bool = True, least: float = 50.0, most: float = 99.5) -> DataFrame:
    """Pixels at or above a percentile of the (positive) values of their video."""
    rows = heat.where(F.col(column) > 1e-6) if positive else heat
    edge = rows.groupBy("video_id").agg(F.percentile(column, F.lit(min(most, max(least, percent)) / 100)).alias("_edge"))
    return rows.join(edge, "video_id").where(F.col(column) >= F.col("_edge")).select(*PX)


def below_percentile(background: DataFrame, percent: float, column: str = "v", least: float = 1.0, most: float = 60.0) -> DataFrame:
    edge = background.groupBy("video_id").agg(F.percentile(column, F.lit(min(most, max(least, percent)) / 100)).alias("_edge"))
    return background.join(edge, "video_id").where(F.col(column) <= F.col("_edge")).select(*PX)


def normalised_heat(heat: DataFrame, percent: float = 97.5, gamma: float = 0.75) -> DataFrame:
    edge = heat.where("energy > 0").groupBy("video_id").agg(F.percentile("energy", F.lit(percent / 100)).alias("_edge"))
    return heat.join(edge, "video_id", "left").withColumn("heat", F.pow(F.least(F.col("energy") / F.coalesce("_edge", F.lit(1.0)), F.lit(1.0)), F.lit(gamma))).drop("_edge")


def foreground(frames: DataFrame, background: DataFrame, threshold: float) -> DataFrame:
    """Pixels that differ from the background by more than a threshold."""
    b = background.select(*PX, F.col("v").alias("_b"))
    return frames.join(b, PX).withColumn("v", F.abs(F.col("v") - F.col("_b"))).where(F.col("v") > threshold).drop("_b")


def otsu(frames: DataFrame, offset: int = 0) -> DataFrame:
    """video_id, frame, threshold: the level (0..255) that separates the two
    classes of a frame's values best, with an offset, within 1..255."""
    level = F.least(F.greatest(F.rint("v").cast("int"), F.lit(0)), F.lit(255))
    h = frames.groupBy("video_id", "frame", level.alias("level")).agg(F.count("*").alias("n"))
    key = ["video_id", "frame"]
    w, whole = Window.partitionBy(*key).orderBy("level"), Window.partitionBy(*key)
    low, total = F.sum("n").over(w), F.sum("n").over(whole)
    low_sum, sum_all = F.sum(F.col("n") * F.col("level")).over(w), F.sum(F.col("n") * F.col("level")).over(whole)
    h = h.withColumns({"w0": low / total, "m0": low_sum / low, "w1": 1 - low / total, "m1": F.when(total > low, (sum_all - low_sum) / (total - low)).otherwise(0.0)})
    h = h.withColumn("between", F.col("w0") * F.col("w1") * (F.col("m0") - F.col("m1")) * (F.col("m0") - F.col("m1")))
    best = h.groupBy(*key).agg(F.max_by("level", F.struct("between", (-F.col("level")).alias("neg"))).alias("t"))
    return best.select(*key, F.least(F.greatest(F.col("t") + offset, F.lit(1)), F.lit(255)).alias("threshold"))


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel; a size of 1 or less is the pixel itself."""
    r = max(0, size // 2)
    if r == 0:
        return [(0, 0)]
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round(r * np.sqrt(max(0.0, 1 - (dy / r) ** 2)))]


def _around(mask: DataFrame, kernel: list[tuple[int, int]], sign: int) -> DataFrame:
    offsets = F.array(*(F.struct(F.lit(sign * a).alias("dx"), F.lit(sign * b).alias("dy")) for a, b in kernel))
    return mask.select("video_id", "x", "y", F.explode(offsets).alias("o")).select("video_id", (F.col("x") + F.col("o.dx")).cast("int").alias("x"), (F.col("y") + F.col("o.dy")).cast("int").alias("y"))


def dilate(mask: DataFrame, kernel: list[tuple[int, int]], size: tuple[int, int] | None = None) -> DataFrame:
    """Union of the mask moved by every offset, within the frame."""
    out = _around(mask, kernel, 1).where((F.col("x") >= 0) & (F.col("y") >= 0))
    out = out.where((F.col("x") < size[0]) & (F.col("y") < size[1])) if size else out
    return out.distinct()


def erode(mask: DataFrame, kernel: list[tuple[int, int]], size: tuple[int, int] | None = None) -> DataFrame:
    """Pixels all of whose neighbours are in the mask; neighbours outside the image hinder none if its size is given."""
    seen = _around(mask.select(*PX).distinct(), kernel, -1).groupBy(*PX).agg(F.count("*").alias("n"))
    if size is None:
        return seen.where(F.col("n") == len(kernel)).select(*PX)
    x, y = F.col("x"), F.col("y")
    inside = sum((((x + a).between(0, size[0] - 1) & (y + b).between(0, size[1] - 1)).cast("int") for a, b in kernel), F.lit(0))
    return seen.where(x.between(0, size[0] - 1) & y.between(0, size[1] - 1) & (F.col("n") == inside)).select(*PX)


def opened(mask: DataFrame, kernel: list[tuple[int, int]], size: tuple[int, int] | None = None) -> DataFrame:
    return dilate(erode(mask, kernel, size), kernel, size)


def closed(mask: DataFrame, kernel: list[tuple[int, int]], size: tuple[int, int] | None = None, times: int = 1) -> DataFrame:
    """Dilated ``times`` times, then eroded as often."""
    for _ in range(times):
        mask = dilate(mask, kernel, size) if size else _around(mask, kernel, 1).distinct()
    for _ in range(times):
        mask = erode(mask, kernel, size)
    return mask


def cleaned(mask: DataFrame, kernel: list[tuple[int, int]], size: tuple[int, int], times: int = 2) -> DataFrame:
    """``opened(closed(mask, kernel, size, times), kernel, size)`` over each video's image as a whole: one
    shuffle of a mask's pixels in place of one for each step. A group is one image."""
    steps = [True] * times + [False] * times + [False, True]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros(size[::-1], bool)
        inside = pdf[pdf.x.between(0, size[0] - 1) & pdf.y.between(0, size[1] - 1)]
        image[inside.y, inside.x] = True
        for grow in steps:
            image = moved(image, kernel, grow)
        y, x = np.nonzero(image)
        return pd.DataFrame({"video_id": pdf.video_id.iloc[0], "x": x.astype(np.int32), "y": y.astype(np.int32)})

    return mask.select(*PX).groupBy("video_id").applyInPandas(run, "video_id string, x int, y int")


def label_image(binary: np.ndarray) -> np.ndarray:
    """8-connected components of an image, numbered from 1 in scan order of their
    first pixels: runs of each row, joined to those that they touch in the row above."""
    h, w = binary.shape
    edge = np.diff(np.pad(binary.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                p, q = sorted((root(i), root(j)))
                up[q] = p
            i, j = (i + 1, j) if end[i] < end[j] else (i, j + 1)
    _, name = np.unique([root(i) for i in range(len(row))], return_inverse=True)
    out = np.zeros((h, w), np.int64)
    for y, a, z, n in zip(row, start, end, name):
        out[y, a:z] = n + 1
    return out


#: Neighbours of a pixel, clockwise from the left one (y grows downwards).
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def outline(part: np.ndarray) -> list[tuple[int, int]]:
    """Pixels (x, y) of the outer border of a component, in order, from its first
    pixel in scan order on; one that is passed twice comes twice."""
    ys, xs = np.nonzero(part)
    if not len(xs):
        return []
    start = at = (int(xs[0]), int(ys[0]))
    inside = lambda x, y: 0 <= y < part.shape[0] and 0 <= x < part.shape[1] and part[y, x]
    path, back, first = [start], 0, None  # back: direction of the last pixel outside
    while True:
        for d in ((back + k) % 8 for k in range(1, 9)):
            if inside(at[0] + AROUND[d][0], at[1] + AROUND[d][1]):
                break
        else:
            return path  # a single pixel
        if at == start and first == d:
            return path[:-1]
        first = d if first is None else first
        outside, to = AROUND[d - 1], AROUND[d]
        at = (at[0] + to[0], at[1] + to[1])
        back = AROUND.index((outside[0] - to[0], outside[1] - to[1]))
        path.append(at)


def outlines(labels: np.ndarray) -> list[list[tuple[int, int]]]:
    """The outer border of each component 1, 2, ..., each traced within its own box."""
    ys, xs = np.nonzero(labels)
    order = np.argsort(labels[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    start = np.r_[0, np.flatnonzero(np.diff(labels[ys, xs])) + 1] if len(ys) else np.zeros(0, int)
    out = []
    for i, (a, z) in enumerate(zip(start, np.r_[start[1:], len(ys)]), 1):
        y0, x0, y1, x1 = ys[a:z].min(), xs[a:z].min(), ys[a:z].max() + 1, xs[a:z].max() + 1
        out.append([(x + int(x0), y + int(y0)) for x, y in outline(labels[y0:y1, x0:x1] == i)])
    return out


def polygon_area(path: list[tuple[int, int]]) -> float:
    """Area within a closed line through pixel centres."""
    x, y = np.array(path, float).T if path else (np.zeros(0), np.zeros(0))
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the first row of each group, from batches sorted by the columns: many small images
    come at once, a large one alone."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.arange(table.num_rows) == 0
        for c in by:
            v = table.column(c).to_pandas().to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        # a batch that goes on with the image held is looked at by its own rows alone
        if held and all(batch.column(c)[batch.num_rows - 1].as_py() == held[0].column(c)[0].as_py() for c in by):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        first = cut(table)
        if len(first) > 1:
            yield table.slice(0, int(first[-1])), first[:-1]
        held = table.slice(int(first[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows for ``whole_groups``."""
    return rows.repartition(*by).sortWithinPartitions(*by)


#: Pixels of the images that are labelled at once (one image at least).
CANVAS = 1 << 22


def component_numbers(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number, within its image, of each pixel's 8-connected component, in scan order of their first pixels; first: where
    each image's pixels begin. Images are labelled below each other, an empty row between them."""
    last, out = np.append(first[1:], len(x)), np.empty(len(x), np.int64)
    x0, y0 = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
    wide, high = np.maximum.reduceat(x, first) - x0 + 1, np.maximum.reduceat(y, first) - y0 + 2
    i = 0
    while i < len(first):
        k = i + 1
        width, height = int(wide[i]), int(high[i])
        while k < len(first) and max(width, int(wide[k])) * (height + int(high[k])) <= CANVAS:
            width, height, k = max(width, int(wide[k])), height + int(high[k]), k + 1
        own = slice(first[i], last[k - 1])
        size = last[i:k] - first[i:k]
        top = np.cumsum(high[i:k]) - high[i:k]
        row, column = y[own] + np.repeat(top - y0[i:k], size), x[own] - np.repeat(x0[i:k], size)
        canvas = np.zeros((height, width), bool)
        canvas[row, column] = True
        found = label_image(canvas)[row, column]
        out[own] = found - np.repeat(np.minimum.reduceat(found, first[i:k] - first[i]), size) + 1
        i = k
    return out


def components(mask: DataFrame, by: list[str]) -> DataFrame:
    """The mask with component: number of each pixel's 8-connected component. The
    images (of the columns ``by``) of an Arrow batch are labelled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, by):
            x, y = (table.column(c).to_numpy().astype(np.int64) for c in "xy")
            yield from table.append_column("component", pa.array(component_numbers(x, y, first))).combine_chunks().to_batches()

    schema = mask.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", component long"
    return grouped(mask, by).mapInArrow(run, schema)


def blobs(foreground_px: DataFrame, min_area: float = 0, max_area: float = float("inf"), moments: bool = False) -> DataFrame:
    """Detections of each frame: components with box (ends excluded), pixel area (a
    contour's area is a little less: see ``contours``) and centre of the box or of mass."""
    parts = components(foreground_px.select("video_id", "frame", "x", "y"), ["video_id", "frame"])
    c = F.col
    b = parts.groupBy("video_id", "frame", "component").agg(F.min("x").alias("bbox_x1"), F.min("y").alias("bbox_y1"), (F.max("x") + 1).alias("bbox_x2"), (F.max("y") + 1).alias("bbox_y2"), F.count("*").cast("double").alias("area"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    place = (c("mx"), c("my")) if moments else ((c("bbox_x1") + c("bbox_x2")) / 2.0, (c("bbox_y1") + c("bbox_y2")) / 2.0)
    order = F.row_number().over(Window.partitionBy("video_id", "frame").orderBy("component")) - 1
    return b.where(c("area").between(min_area, max_area)).select("video_id", "frame", order.cast("int").alias("det_idx"), place[0].alias("x"), place[1].alias("y"), "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "area")


def contours(foreground_px: DataFrame) -> DataFrame:
    """video_id, frame, component, area, points: the border of each component as a
    polygon of pixel centres and the area within it (a contour's area)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf.x.min(), pdf.y.min()
        image = np.zeros((pdf.y.max() - y0 + 1, pdf.x.max() - x0 + 1), bool)
        image[pdf.y - y0, pdf.x - x0] = True
        paths = outlines(label_image(image))
        return pd.DataFrame({"video_id": key[0], "frame": key[1], "component": range(1, len(paths) + 1), "area": [polygon_area(p) for p in paths], "points": [[{"x": int(x + x0), "y": int(y + y0)} for x, y in p] for p in paths]})

    return foreground_px.groupBy("video_id", "frame").applyInPandas(run, "video_id string, frame long, component long, area double, points array<struct<x:int,y:int>>")


def frame_stats(frames: DataFrame, background: DataFrame, threshold: float) -> DataFrame:
    """video_id, frame, mean_shift (mean of the frame less the background's),
    foreground (share of pixels that differ from it by more than ``threshold``)."""
    px = frames.join(background.select(*PX, F.col("v").alias("_b")), PX)
    return px.groupBy("video_id", "frame").agg((F.avg("v") - F.avg("_b")).alias("mean_shift"), F.avg(F.when(F.abs(F.col("v") - F.col("_b")) > threshold, 1.0).otherwise(0.0)).alias("foreground"))


def binary_masks(frames: DataFrame, background: DataFrame, threshold: float, blur: int = 0, open_size: int = 0, close_size: int = 0) -> DataFrame:
    """video_id, frame, x, y: foreground of each frame: difference of the blurred frame
    from the blurred background above a threshold, opened and closed. A frame is a group."""
    open_kernel, close_kernel = ellipse(open_size), ellipse(close_size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1))
        image[pdf.y, pdf.x] = pdf.v
        mask = np.abs(gaussian(image, blur)) > threshold
        if mask.any():
            for kernel, grow in ((open_kernel, False), (open_kernel, True), (close_kernel, True), (close_kernel, False)):
                mask = moved(mask, kernel, grow)
        y, x = np.nonzero(mask)
        return pd.DataFrame({"video_id": pdf.video_id.iloc[0], "frame": pdf.frame.iloc[0], "x": x.astype(np.int32), "y": y.astype(np.int32)})

    px = frames.join(background.select(*PX, F.col("v").alias("_b")), PX).select("video_id", "frame", "x", "y", (F.col("v") - F.col("_b")).alias("v"))
    return px.groupBy("video_id", "frame").applyInPandas(run, "video_id string, frame long, x int, y int")


def moved(mask: np.ndarray, kernel: list[tuple[int, int]], grow: bool) -> np.ndarray:
    """Dilation (grow) or erosion of a mask; beyond the image there is nothing to grow from or to erode by."""
    h, w = mask.shape
    r = max(max(abs(a), abs(b)) for a, b in kernel)
    p = np.pad(mask, r, constant_values=not grow)
    parts = [p[r + b : r + b + h, r + a : r + a + w] for a, b in kernel]
    return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)


def median_blur(image: np.ndarray, size: int) -> np.ndarray:
    """Median of the square of an odd size around each pixel, borders repeated."""
    if size <= 1:
        return image.astype(float)
    r = size // 2
    p = np.pad(image.astype(float), r, mode="edge")
    return np.median([p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)], axis=0)


def gaussian(image: np.ndarray, size: int) -> np.ndarray:
    """Separable blur of an odd size, borders mirrored."""
    if size <= 1:
        return image.astype(float)
    if size % 2 == 0:
        raise ValueError(f"the size must be odd, got {size}")
    sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        mode = "reflect" if out.shape[axis] > r else "edge"
        p = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        out = sum(w * np.take(p, np.arange(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(image.astype(float), r, mode="edge").cumsum(0).cumsum(1)
    p = np.pad(p, ((1, 0), (1, 0)))
    h, w = image.shape
    n = 2 * r + 1
    return (p[n : n + h, n : n + w] - p[:h, n : n + w] - p[n : n + h, :w] + p[:h, :w]) / n**2


def adaptive_threshold(image: np.ndarray, block: int, c: float) -> np.ndarray:
    return image > box_mean(image, block) - c


def sobel(image: np.ndarray) -> np.ndarray:
    p = np.pad(image.astype(float), 1, mode="reflect" if min(image.shape) > 1 else "edge")
    part = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    gx = part(-1, 1) + 2 * part(0, 1) + part(1, 1) - part(-1, -1) - 2 * part(0, -1) - part(1, -1)
    gy = part(1, -1) + 2 * part(1, 0) + part(1, 1) - part(-1, -1) - 2 * part(-1, 0) - part(-1, 1)
    return np.hypot(gx, gy)


def per_image(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], by: tuple[str, ...] = ("video_id", "frame")) -> DataFrame:
    """A kernel over each (dense) image: the same rows with new values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1))
        image[pdf.y, pdf.x] = pdf.v
        return pdf.assign(v=np.asarray(kernel(image), dtype=float)[pdf.y, pdf.x])

    types = dict(frames.dtypes)
    return frames.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {'double' if c == 'v' else types[c]}" for c in frames.columns))


def blurred_heat(heat: DataFrame, size: int = 9) -> DataFrame:
    """The heat (video_id, x, y, energy) of each video blurred as one dense image; pixels not given are cold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1))
        image[pdf.y, pdf.x] = pdf.energy
        y, x = np.indices(image.shape)
        return pd.DataFrame({"video_id": pdf.video_id.iloc[0], "x": x.ravel(), "y": y.ravel(), "energy": gaussian(image, size).ravel()})

    return heat.groupBy("video_id").applyInPandas(run, "video_id string, x int, y int, energy double")


def column_profile(background: DataFrame) -> DataFrame:
    return background.groupBy("video_id", "x").agg(F.avg("v").alias("v"))


def valid_band(profile: DataFrame, window: int = 31, threshold: float = 0.45, margin: int = 10, min_width: float = 0.35) -> DataFrame:
    """video_id, x_start, x_end: the widest stretch of columns at or above a share
    of the peak of the smoothed profile, less a margin; the central 70 % where
    contrast is below 8 % or nothing wide enough is left."""
    s = smooth_profile(profile, "v", "x", ["video_id"], window)
    stats = s.groupBy("video_id").agg(F.max("v_s").alias("top"), F.min("v_s").alias("low"), F.count("*").alias("width"))
    runs = islands(s.join(stats, "video_id").withColumn("on", F.col("v_s") >= threshold * F.col("top")), "on", ["video_id"], "x").where("on")
    seg = runs.groupBy("video_id", "run").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n"))
    best = seg.groupBy("video_id").agg(F.max_by(F.struct("a", "b"), F.struct("n", (-F.col("a")).alias("neg"))).alias("s"))
    c = F.col
    least = F.greatest(F.lit(2), F.rint(c("width") * min_width).cast("int"))
    x0 = F.greatest(F.lit(0), F.least(c("width") - 2, c("s.a") + margin))
    x1 = F.greatest(F.lit(1), F.least(c("width") - 1, c("s.b") - margin))
    out = stats.join(best, "video_id", "left").withColumns({"x0": x0, "x1": x1, "least": least})
    contrast = c("top") - c("low")
    bad = (contrast < 1e-6) | (contrast / F.greatest(F.lit(1.0), F.abs("top")) < 0.08) | c("s").isNull() | (c("x1") <= c("x0")) | (c("x1") - c("x0") + 1 < c("least"))
    span = F.greatest(F.lit(2), F.rint(c("width") * 0.7).cast("int"))
    start = F.floor((c("width") - span) / 2)
    return out.select("video_id", F.when(bad, start).otherwise(c("x0")).cast("int").alias("x_start"), F.when(bad, start + span - 1).otherwise(c("x1")).cast("int").alias("x_end"))


def vegetation_score(frames: DataFrame) -> DataFrame:
    """score of each pixel: half activity, 35 % spread, 15 % gradient of the median, each scaled to [0, 1]."""
    d = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy(*PX).orderBy("frame")))
    s = frames.withColumn("d", d).groupBy(*PX).agg(F.avg("d").alias("activity"), F.stddev_pop("v").alias("spread"), F.floor(F.percentile("v", F.lit(0.5))).alias("v"))
    grad = per_image(s.select("video_id", "x", "y", F.col("v").cast("double").alias("v")), sobel, ("video_id",)).withColumnRenamed("v", "gradient")
    s = s.drop("v").join(grad, PX)
    whole = s.groupBy("video_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("activity", "spread", "gradient") for n, f in (("low", F.min), ("top", F.max))))
    unit = lambda c: (F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_top") - F.col(f"{c}_low") + 1e-6)
    return s.join(whole, "video_id").select(*PX, (0.50 * unit("activity") + 0.35 * unit("spread") + 0.15 * unit("gradient")).alias("score"))


def median_mask(mask: DataFrame, size: int) -> DataFrame:
    """The pixels most of whose neighbourhood (a square of an odd size) is in the mask."""
    r = size // 2
    square = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    offsets = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in square))
    seen = mask.select(*PX).distinct().select("video_id", "x", "y", F.explode(offsets).alias("o")).groupBy("video_id", (F.col("x") + F.col("o.dx")).cast("int").alias("x"), (F.col("y") + F.col("o.dy")).cast("int").alias("y")).agg(F.count("*").alias("n"))
    return seen.where((F.col("n") * 2 > len(square)) & (F.col("x") >= 0) & (F.col("y") >= 0)).select(*PX)


def vegetation_mask(frames: DataFrame, percent: float = 85.0, min_area: int = 24, size: tuple[int, int] | None = None, median: int = 0) -> DataFrame:
    """Restless textured pixels: top scores, opened, smoothed by a median if asked
    for, small parts dropped, eroded; none from under 20 frames."""
    enough = frames.groupBy("video_id").agg(F.count_distinct("frame").alias("n")).where("n >= 20").select("video_id")
    px = above_percentile(vegetation_score(frames.join(enough, "video_id", "left_semi")), percent, "score", positive=False)
    square = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    px = opened(px, square, size)
    parts = components(median_mask(px, median) if median > 1 else px, ["video_id"])
    big = parts.groupBy("video_id", "component").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, min_area)).drop("n")
    return erode(parts.join(big, ["video_id", "component"], "left_semi").select(*PX), square)
