"""Merges of tracks as they start, for groups of bounded size.

Merges are made in the order of the later start, so a walk over the tracks in that order needs, for
each, the tracks before it that have not ended for long and whose groups have room: in a crowded video groups are
full soon, and pairs with their tracks are never made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.functions.expressions import EPS
from flightloom.operators.blocks import packed
from flightloom.operators.grouping import guarded_merges, merge_features, ordered
from flightloom.operators.pairs import edges, stretches
from flightloom.operators.summary import KEY
from flightloom.sources.scratch import written

_EDGES = ["x_start", "y_start", "x_end", "y_end", "svx", "svy", "evx", "evy"]


def _lists(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


class Walk:
    """The tracks of a batch and those before it that may still merge, one after the other."""

    def __init__(self, table: pa.Table):
        number = lambda c: table.column(c).to_numpy()
        self.ids, self.start, self.end = number("track_id"), number("frame_start"), number("frame_end")
        self.at = {c: number(c) for c in _EDGES}
        offsets = _lists(table, "frame").offsets.to_numpy()
        self.off, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.frame = _lists(table, "frame").flatten().to_numpy()
        x, y = _lists(table, "x").flatten(), _lists(table, "y").flatten()
        self.lost = x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)
        self.x, self.y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)

    def frames(self, i: int) -> np.ndarray:
        return self.frame[self.off[i] : self.off[i] + self.size[i]]

    def beside(self, b: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common frames and mean distance (NaN without one) of track b and each of the others."""
        first, own = self.start[b], self.frames(b)
        place = np.full(int(own[-1] - first) + 1, -1)
        place[own - first] = np.arange(self.off[b], self.off[b] + len(own))
        many = self.size[others]
        who = np.repeat(np.arange(len(others)), many)
        point = np.arange(len(who)) + np.repeat(self.off[others] - (np.cumsum(many) - many), many)
        since = self.frame[point] - first
        within = np.flatnonzero((since >= 0) & (since < len(place)))
        of = place[since[within]]
        within, of = within[of >= 0], of[of >= 0]
        who, point = who[within], point[within]
        common = np.bincount(who, minlength=len(others))
        with np.errstate(all="ignore"):
            dx, dy = self.x[point] - self.x[of], self.y[point] - self.y[of]
            d, lost = np.sqrt(dx * dx + dy * dy), self.lost[point] | self.lost[of]
            if lost.any():
                who, d = who[~lost], d[~lost]
            return common, np.bincount(who, weights=d, minlength=len(others)) / np.bincount(who, minlength=len(others))

    def cosine(self, a: np.ndarray, u: str, b: np.ndarray, v: str) -> tuple[np.ndarray, np.ndarray]:
        """Of the vectors u of a and v of b; and whether there is one."""
        ax, ay, bx, by = self.at[f"{u}x"][a], self.at[f"{u}y"][a], self.at[f"{v}x"][b], self.at[f"{v}y"][b]
        with np.errstate(all="ignore"):
            na, nb = np.sqrt(ax * ax + ay * ay), np.sqrt(bx * bx + by * by)
            return (ax * bx + ay * by) / (na * nb), (na > EPS) & (nb > EPS)


def _reasons(walk: Walk, b: int, others: np.ndarray, common: np.ndarray, mean: np.ndarray, min_common: int, max_mean: float, min_cosine: float, proximity: float) -> np.ndarray:
    """As of ``merge_features``, for tracks that share frames; an empty text for none."""
    low, high = np.minimum(walk.ids[others], walk.ids[b]) == walk.ids[b], np.full(len(others), b)
    a, z = np.where(low, high, others), np.where(low, others, high)
    (start, s), (end, e), (link, k) = (walk.cosine(a, u, z, v) for u, v in (("sv", "sv"), ("ev", "ev"), ("ev", "sv")))
    both = np.where(s & e, (start + end) / 2, np.where(s, start, end))
    local = max(0.65, min_cosine - 0.15)
    close, enough = mean <= max_mean, common >= min_common
    agree = ~(s | e) | (both >= min_cosine) | (k & (link >= min_cosine))
    tests = [(proximity > 0) & (mean <= proximity), enough & close & agree, enough & close & s & (start >= local), ~enough & close & k & (link >= local)]
    return np.select(tests, ["overlap_proximity", "overlap", "overlap_start_aligned", "overlap_local"], "")


def auto_merges(points: DataFrame, max_gap: int = 8, max_endpoint: float = 80.0, min_common: int = 3, max_mean: float = 60.0, min_cosine: float = 0.8, proximity: float = 0.0, max_shared: int = 6, duplicate_distance: float = 12.0, max_group: int = 0) -> DataFrame:
    """``guarded_merges`` of ``merge_features``. With ``max_group`` over 0 pairs are made as the walk needs them; a
    group to Spark is a stretch of a video that no pair leaves."""
    how = (min_common, max_mean, min_cosine, proximity)
    if max_group <= 0:
        return guarded_merges(points, written(merge_features(points, max_gap, max_endpoint, *how)), max_shared, duplicate_distance, max_group)
    base = edges(points).select(*KEY, F.col("frame_start").cast("long").alias("frame_start"), F.col("frame_end").cast("long").alias("frame_end"), *(F.col(c).cast("double").alias(c) for c in _EDGES))
    base = stretches(base, max_gap)
    rows = packed(points, 0, base).drop("side")
    names = ["video_id", "track_a", "track_b", "merged_to", "reason"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        groups: dict[int, list] = {}  # of a track: the group's tracks and frames
        for batch in batches:
            table = pa.Table.from_batches([batch])
            first = kept.num_rows if kept is not None else 0
            table = pa.concat_tables([kept, table]) if first else table
            walk, out = Walk(table), []
            ids, end, place = walk.ids, walk.end, {int(t): i for i, t in enumerate(walk.ids)}
            room = np.array([max_group - (len(groups[int(t)][0]) if int(t) in groups else 1) for t in ids])
            active = np.flatnonzero(room[:first] > 0)
            for b in range(first, len(ids)):
                own, now = int(ids[b]), walk.start[b]
                active = active[(room[active] > 0) & (end[active] + max_gap >= now)]
                groups[own] = [[own], set(walk.frames(b).tolist())]

                def merge(others: np.ndarray, reasons: np.ndarray, means: np.ndarray) -> None:
                    for i in np.lexsort((np.maximum(ids[others], own), np.minimum(ids[others], own), end[others])).tolist():
                        mine, other = groups[own], int(ids[others[i]])
                        theirs = groups[other]
                        if mine is theirs or len(mine[0]) + len(theirs[0]) > max_group:
                            if len(mine[0]) >= max_group:
                                return
                            continue
                        twice = reasons[i] != "handoff" and means[i] <= duplicate_distance
                        if max_shared >= 0 and not twice and len(mine[1] & theirs[1]) > max_shared:
                            continue
                        whole = [mine[0] + theirs[0], mine[1] | theirs[1]]
                        for t in whole[0]:
                            groups[t] = whole
                            if t in place:
                                room[place[t]] = max_group - len(whole[0])
                        out.append((key[0].as_py(), min(own, other), max(own, other), min(whole[0]), str(reasons[i])))

                ended = active[end[active] < now]
                with np.errstate(all="ignore"):
                    dx, dy = walk.at["x_end"][ended] - walk.at["x_start"][b], walk.at["y_end"][ended] - walk.at["y_start"][b]
                    ended = ended[np.sqrt(dx * dx + dy * dy) <= max_endpoint]
                if len(ended):  # their ends are the earlier ones
                    merge(ended, np.full(len(ended), "handoff"), np.zeros(len(ended)))
                if room[b] > 0 and 0 <= max_endpoint:
                    others = active[(end[active] >= now) & (room[active] > 0)]
                    if len(others):
                        common, mean = walk.beside(b, others)
                        met = np.flatnonzero((common > 0) & (mean <= max(max_mean, proximity)))
                        others, common, mean = others[met], common[met], mean[met]
                        why = _reasons(walk, b, others, common, mean, *how)
                        fit = np.flatnonzero(why != "")
                        merge(others[fit], why[fit], mean[fit])
                if room[b] > 0:
                    active = np.append(active, b)
            kept = table.take(pa.array(active))
            alive = set(ids[active].tolist())
            groups = {t: g for t, g in groups.items() if not alive.isdisjoint(g[0])}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    return ordered(rows, "frame_start", "track_id").applyInArrow(run, "video_id string, track_a long, track_b long, merged_to long, reason string")
