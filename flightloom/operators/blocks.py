"""Pairs of tracks that share frames, by blocks of tracks.

Points of a frame all meet, and so do most tracks of a busy video, so neither the
pairs of points nor those of tracks are shuffled: a track goes once to each pair of
blocks that its own is part of, and a task sums the distances of such a pair of blocks a
bounded number of points at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a block at most; points worth a block of their own, up to SPREAD blocks.
POINTS, WORTH, SPREAD = 1_000_000, 20_000, 16
#: Pairs of points, and of tracks, that a task holds at once (one track of the one block at least).
HELD = 4_000_000
ROWS = 200_000  # of a batch that is given back


def packed(points: DataFrame, side: int, tracks: DataFrame | None = None) -> DataFrame:
    """A row for each track with its points, and its columns in ``tracks``, if given."""
    key = ["video_id", "track_id"]
    whole = points.where(F.col("video_id").isNotNull() & F.col("track_id").isNotNull() & F.col("frame").isNotNull())
    lists = F.sort_array(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    rows = whole.groupBy(*key).agg(lists.alias("p")).select("video_id", F.col("track_id").cast("long").alias("track_id"), F.lit(side).alias("side"), F.col("p.frame").alias("frame"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return rows if tracks is None else rows.join(tracks, key)


class Side:
    """The points of a block's tracks: index of the track, frame, place, whether the place is missing."""

    def __init__(self, table: pa.Table, tracks: np.ndarray):
        rows = table.take(pa.array(tracks))
        column = lambda c: rows.column(c).combine_chunks()
        size = np.diff(column("frame").offsets.to_numpy())
        x, y = (column(c).flatten() for c in "xy")
        self.track, self.frame = np.repeat(tracks, size), column("frame").flatten().to_numpy()
        self.lost = x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)
        self.x, self.y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)

    def sort(self, order: np.ndarray) -> Side:
        for c in ("track", "frame", "lost", "x", "y"):
            setattr(self, c, getattr(self, c)[order])
        return self


def quantiles(d: np.ndarray, code: np.ndarray, n: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Linear percentiles of the distances of each pair (its number: code; its count: n, all over 0)."""
    d = d[np.argsort(code, kind="stable")]
    since, out = np.cumsum(n) - n, [np.empty(len(n)) for _ in shares]
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        row = np.sort(d[since[at][:, None] + np.arange(k)], axis=1)
        for got, share in zip(out, shares):
            place = (k - 1) * share
            low, high = int(np.floor(place)), int(np.ceil(place))
            a, b = row[:, low], row[:, high]
            got[at] = a if low == high else np.where(a == b, a, (high - place) * a + (place - low) * b)
    return out


def meet(table: pa.Table, a: np.ndarray, b: np.ndarray, both: bool, shares: tuple[float, ...], max_mean: float | None) -> Iterator[tuple]:
    """The pairs of tracks a and b (rows of the table) that share a frame: rows, count, mean and
    percentiles of their distances. ``both``: a and b are of one set, so each pair comes once."""
    left, right = Side(table, a), Side(table, b)
    right.sort(np.lexsort((right.track, right.frame)))
    kept = np.isin(left.frame, right.frame)
    left.sort(np.flatnonzero(kept))
    if not len(left.frame):
        return
    first = np.searchsorted(right.frame, left.frame, "left")
    many = np.searchsorted(right.frame, left.frame, "right") - first
    before = np.concatenate([[0], np.cumsum(many)])
    place = np.full(int(b.max()) + 1, -1)
    place[b] = np.arange(len(b))
    heads = np.flatnonzero(np.concatenate([[True], left.track[1:] != left.track[:-1], [True]]))
    at, last = 0, len(heads) - 1
    while at < last:
        upto = int(np.searchsorted(before[heads], before[heads[at]] + HELD, "right")) - 1
        upto = min(last, at + max(1, HELD // len(b)), max(upto, at + 1))
        p, q = heads[at], heads[upto]
        names = left.track[heads[at:upto]]
        own = np.repeat(np.arange(p, q), many[p:q])
        other = np.arange(before[p], before[q]) - np.repeat(before[p:q] - first[p:q], many[p:q])
        at = upto
        if both:
            once = right.track[other] > left.track[own]
            own, other = own[once], other[once]
        code = np.searchsorted(names, left.track[own]) * len(b) + place[right.track[other]]
        with np.errstate(all="ignore"):
            dx, dy = left.x[own] - right.x[other], left.y[own] - right.y[other]
            d = np.sqrt(dx * dx + dy * dy)
        lost = left.lost[own] | right.lost[other]
        cells = None
        if max_mean is not None:  # a mean is no less than the least distance, so few pairs of tracks are summed
            near = np.zeros(len(names) * len(b), bool)
            near[code[(d <= max_mean + 1e-9 * (1 + abs(max_mean))) & ~lost]] = True
            some = np.flatnonzero(near[code])
            d, lost = d[some], lost[some]
            cells, code = np.unique(code[some], return_inverse=True)
        common = np.bincount(code, minlength=len(names) * len(b) if cells is None else len(cells))
        if lost.any():
            code, d = code[~lost], d[~lost]
        n = np.bincount(code, minlength=len(common)) if lost.any() else common
        met = np.flatnonzero(common)
        with np.errstate(all="ignore"):
            mean = np.bincount(code, weights=d, minlength=len(common))[met] / n[met]
        middle = []
        if shares:
            middle = [np.full(len(met), np.nan) for _ in shares]
            for whole, got in zip(middle, quantiles(d, code, n[n > 0], shares)):
                whole[n[met] > 0] = got
        keep = np.flatnonzero(mean <= max_mean) if max_mean is not None else np.arange(len(met))
        met = met[keep]
        pair = met if cells is None else cells[met]
        yield names[pair // len(b)], b[pair % len(b)], common[met], mean[keep], [m[keep] for m in middle], n[met] == 0


def tracks_met(left: DataFrame, right: DataFrame | None = None, tracks: DataFrame | None = None, percentiles: dict[str, float] | None = None, max_mean: float | None = None) -> DataFrame:
    """video_id, a_track_id, b_track_id, common_frames, mean_distance and the named percentiles of
    the distances for every pair of tracks that shares frames (a < b), or of one of ``left`` and one of ``right``; with
    the columns of ``tracks`` (a row for each track) as a_ and b_. ``max_mean``: only pairs of that mean distance at most.
    Distances without a place (null) count as common frames only."""
    from flightloom.sources.scratch import written

    rows = packed(left, 0, tracks) if right is None else packed(left, 0).unionByName(packed(right, 1))
    rows = written(rows, "blocks")
    points_of = lambda k: F.sum(F.when(F.col("side") == k, F.size("frame")).otherwise(0))
    many = lambda n: F.greatest(F.ceil(F.col(n) / POINTS), F.least(F.lit(SPREAD), F.ceil(F.col(n) / WORTH))).cast("int")
    sizes = rows.groupBy("video_id").agg(points_of(0).alias("n0"), points_of(1).alias("n1")).withColumn("_p", many("n0")).withColumn("_q", F.col("_p") if right is None else many("n1"))
    groups = sizes.agg(F.sum(F.col("_p") * F.col("_q"))).first()[0] or 1
    mine, theirs = (F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("_p", "_q"), ("_q", "_p")))
    met = F.broadcast(sizes.where("_p > 0 and _q > 0").drop("n0", "n1"))
    spread = rows.join(met, "video_id").withColumn("_own", F.pmod(F.xxhash64("track_id"), mine).cast("int")).withColumn("_of", F.explode(F.sequence(F.lit(0), theirs - 1))).drop("_p", "_q")
    i, j = (F.least("_own", "_of"), F.greatest("_own", "_of")) if right is None else (F.when(F.col("side") == 0, F.col("_own")).otherwise(F.col("_of")), F.when(F.col("side") == 0, F.col("_of")).otherwise(F.col("_own")))
    spread = spread.withColumns({"_i": i, "_j": j}).drop("_of").repartition(int(min(2000, max(groups, 1))), "video_id", "_i", "_j")
    extra = [f for f in rows.schema.fields if f.name not in ("video_id", "track_id", "side", "frame", "x", "y")]
    shares, names, both = tuple((percentiles or {}).values()), list(percentiles or {}), right is None
    schema = ", ".join(["video_id string, a_track_id long, b_track_id long, common_frames long, mean_distance double", *(f"{m} double" for m in names), *(f"{s}_{f.name} {f.dataType.simpleString()}" for s in "ab" for f in extra)])
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("track_id")
        block, side, ids = (table.column(c).to_numpy() for c in ("_own", "side", "track_id"))
        one = both and key[1] == key[2]
        a, b = (np.flatnonzero(block == k.as_py()) for k in key[1:]) if both else (np.flatnonzero(side == k) for k in (0, 1))
        if not len(a) or not len(b):
            return
        for p, q, n, mean, middle, none in meet(table, a, b, one, shares, max_mean):
            if both:
                p, q = np.minimum(p, q), np.maximum(p, q)  # rows are in the order of the ids
            for s in range(0, len(p), ROWS):
                cut = slice(s, s + ROWS)
                number = lambda v: pa.array(v[cut], pa.float64(), mask=none[cut])
                given = [pa.array([key[0].as_py()] * len(p[cut]), pa.string()), pa.array(ids[p[cut]]), pa.array(ids[q[cut]]), pa.array(n[cut].astype(np.int64)), number(mean), *map(number, middle)]
                given += [table.column(f.name).combine_chunks().take(pa.array(k[cut])) for k in (p, q) for f in extra]
                yield pa.RecordBatch.from_arrays(given, names=columns)

    return spread.groupBy("video_id", "_i", "_j").applyInArrow(run, schema)
