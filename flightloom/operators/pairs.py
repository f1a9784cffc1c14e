"""Joins between tracks: same-frame pairs, band joins on intervals, features of
duplicate pairs, anti-joins against primary tracks."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.functions.expressions import clip01, norm, speed_similarity, vector_cosine
from flightloom.operators.blocks import tracks_met
from flightloom.operators.summary import KEY, by_frame, of_track, summarise
from flightloom.sources.scratch import dropped, written


def sided(rows: DataFrame, side: str, keep: tuple[str, ...] = ("video_id",)) -> DataFrame:
    return rows.select(*keep, *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in keep))


def same_frame_pairs(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pairs of points of two tracks (a < b) in one frame, with their distance:
    an equi-join on (video_id, frame), whose groups are what one frame holds."""
    p = points.select("video_id", "frame", "track_id", *columns)
    a, b = sided(p, "a", ("video_id", "frame")), sided(p, "b", ("video_id", "frame"))
    return a.join(b, ["video_id", "frame"]).where("a_track_id < b_track_id").withColumn("distance", norm(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))


#: Percentiles of the distances of a pair.
SPREAD = {"median_distance": 0.5, "p90_distance": 0.9}


def pair_distances(points: DataFrame) -> DataFrame:
    return tracks_met(points, percentiles=SPREAD).withColumnsRenamed({"a_track_id": "track_a", "b_track_id": "track_b"})


def range_join(left: DataFrame, right: DataFrame, gap: int, bucket: int | None = None) -> DataFrame:
    """Pairs of intervals (columns l_start, l_end; r_start, r_end, with video_id in
    both) at most ``gap`` frames apart. Each interval goes to the buckets of
    frames it reaches, so the join has an equality and no nested loop; a pair is
    made in the first bucket that both reach, so nothing needs removing after.
    A row comes once for each of its buckets: give keys, and join the rest after."""
    size = bucket or max(64, 2 * gap)
    slot = lambda c: F.floor(c / F.lit(size)).cast("long")
    l_from, l_to = F.col("l_start") - gap, F.col("l_end") + gap
    lb = left.withColumns({"_lf": slot(l_from), "_b": F.explode(F.sequence(slot(l_from), slot(l_to)))})
    rb = right.withColumns({"_rf": slot(F.col("r_start")), "_b": F.explode(F.sequence(slot(F.col("r_start")), slot(F.col("r_end"))))})
    near = (F.col("r_start") <= l_to) & (F.col("r_end") >= l_from) & (F.col("_b") == F.greatest("_lf", "_rf"))
    return lb.join(rb, ["video_id", "_b"]).where(near).drop("_b", "_lf", "_rf")


def edges(points: DataFrame) -> DataFrame:
    """Summary of each track with the vectors over its first and last three points."""
    i, n = F.row_number().over(by_frame()), F.count("*").over(of_track())
    at = points.withColumns({"_i": i, "_n": n})
    pick = lambda c, k: F.max(F.when(F.col("_i") == k, F.col(c)))
    third, back = F.least(F.lit(3), F.col("_n")), F.greatest(F.lit(1), F.col("_n") - 2)
    extra = at.groupBy(*KEY).agg(*(e for c in ("x", "y") for e in (pick(c, third).alias(f"{c}_3"), pick(c, back).alias(f"{c}_b3"))))
    s = summarise(points, guard=1e-6).join(extra, KEY)
    return s.withColumns({"svx": F.col("x_3") - F.col("x_start"), "svy": F.col("y_3") - F.col("y_start"), "evx": F.col("x_end") - F.col("x_b3"), "evy": F.col("y_end") - F.col("y_b3"), "vecx": F.col("x_end") - F.col("x_start"), "vecy": F.col("y_end") - F.col("y_start")})


def stretches(tracks: DataFrame, gap: int = 0) -> DataFrame:
    """The tracks with group_id: the stretch of their video, beyond whose ends no track starts within ``gap`` frames."""
    w = Window.partitionBy("video_id").orderBy("frame_start", "track_id")
    new = F.when(F.col("frame_start") > F.max("frame_end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap, 1).otherwise(0)
    return tracks.withColumn("_new", new).withColumn("group_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def followed(tracks: DataFrame, since: Column, until: Column, bucket: int = 8) -> DataFrame:
    """Pairs of a track (columns e_) and another (s_) that starts in a frame from ``since`` to ``until`` (of the
    track's own columns). The one goes to the buckets of those frames, the other to that of its start, with
    their columns: a pair comes up once, and is not shuffled after."""
    slot = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    e = sided(tracks.withColumns({"since": since, "until": until}), "e").where("e_since <= e_until").withColumn("_b", F.explode(F.sequence(slot(F.col("e_since")), slot(F.col("e_until")))))
    s = sided(tracks, "s").withColumn("_b", slot(F.col("s_frame_start")))
    return e.join(s, ["video_id", "_b"]).where(F.col("s_frame_start").between(F.col("e_since"), F.col("e_until")) & (F.col("e_track_id") != F.col("s_track_id"))).drop("_b", "e_since", "e_until")


def in_order(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of ``followed`` with the columns of the lower id as a_, of the other as b_."""
    lower = F.col("e_track_id") < F.col("s_track_id")
    of = lambda c, e: F.when(lower if e else ~lower, F.col(f"e_{c}")).otherwise(F.col(f"s_{c}"))
    return pairs.select("video_id", *(of(c, True).alias(f"a_{c}") for c in columns), *(of(c, False).alias(f"b_{c}") for c in columns))


def meeting(tracks: DataFrame, max_gap: int) -> DataFrame:
    """Pairs of tracks (all columns, prefixed a_ for the lower id and b_) that overlap in time or follow each
    other within ``max_gap`` frames, each found where the later of them starts."""
    first = F.struct("e_frame_start", "e_track_id") < F.struct("s_frame_start", "s_track_id")
    met = followed(tracks, F.col("frame_start"), F.col("frame_end") + max_gap).where(first)
    return in_order(met, [c for c in tracks.columns if c != "video_id"])


def merge_candidates(tracks: DataFrame, max_gap: int, max_distance: float) -> DataFrame:
    """Pairs of tracks (columns of ``edges``, prefixed a_ for the lower id and b_)
    that overlap in time, or follow each other within ``max_gap`` frames and
    ``max_distance``."""
    pairs = meeting(tracks, max_gap)
    ab = norm(F.col("a_x_end") - F.col("b_x_start"), F.col("a_y_end") - F.col("b_y_start"))
    ba = norm(F.col("b_x_end") - F.col("a_x_start"), F.col("b_y_end") - F.col("a_y_start"))
    a_first, b_first = F.col("a_frame_end") < F.col("b_frame_start"), F.col("b_frame_end") < F.col("a_frame_start")
    out = pairs.withColumns({
        "kind": F.when(a_first | b_first, "handoff").otherwise("overlap"),
        "gap_frames": F.when(a_first, F.col("b_frame_start") - F.col("a_frame_end")).when(b_first, F.col("a_frame_start") - F.col("b_frame_end")).otherwise(0),
        "endpoint_distance": F.when(a_first, ab).when(b_first, ba).otherwise(0.0),
    })
    return out.where(F.col("endpoint_distance") <= max_distance)


def handoffs(tracks: DataFrame, max_gap: int) -> DataFrame:
    """Pairs of tracks that follow each other within ``max_gap`` frames (columns as
    of ``merge_candidates``): ends meet the starts in the frames that they look forward to."""
    met = followed(tracks, F.col("frame_end") + 1, F.col("frame_end") + max_gap)
    gap, apart = F.col("s_frame_start") - F.col("e_frame_end"), norm(F.col("e_x_end") - F.col("s_x_start"), F.col("e_y_end") - F.col("s_y_start"))
    met = met.withColumns({"e_gap_frames": gap, "s_gap_frames": gap, "e_endpoint_distance": apart, "s_endpoint_distance": apart})
    pairs = in_order(met, [c for c in tracks.columns if c != "video_id"] + ["gap_frames", "endpoint_distance"])
    return pairs.withColumnsRenamed({"a_gap_frames": "gap_frames", "a_endpoint_distance": "endpoint_distance"}).drop("b_gap_frames", "b_endpoint_distance")


def near_tracks(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """video_id, a_track_id (of left), b_track_id (of right): tracks with points at most
    ``reach`` apart in some frame. Points meet by cells of some that size, a right one in its own
    and the eight around it, so far pairs of a crowded frame are never made. Points
    without a place (null, NaN) meet none."""
    # a grouped sum rounds, so means just within a limit may come from distances just beyond it
    limit = reach + 1e-9 * (1 + abs(reach))
    side = max(1.01 * limit, 1.0)
    # places beyond 2^40 cells share the outermost one, which keeps whole numbers exact
    cell = lambda c: F.floor(F.greatest(F.lit(-(2.0**40)), F.least(F.lit(2.0**40), F.col(c) / side))).cast("long")
    placed = lambda rows, s: rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).select("video_id", "frame", F.col("track_id").alias(f"{s}_track_id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), cell("x").alias("_i"), cell("y").alias("_j"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    spread = placed(right, "b").withColumn("_i", around("_i")).withColumn("_j", around("_j"))
    met = placed(left, "a").join(spread, ["video_id", "frame", "_i", "_j"])
    return met.where(norm(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= limit).select("video_id", "a_track_id", "b_track_id").distinct()


def distances_of(points: DataFrame, pairs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """video_id, a_track_id, b_track_id, common_frames, mean_distance for the given
    pairs only: their points meet, not all points of a frame. Tracks b are from
    ``others``, if given."""
    own = lambda rows, s: rows.select("video_id", F.col("track_id").alias(f"{s}_track_id"), "frame", F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    a = pairs.select("video_id", "a_track_id", "b_track_id").join(own(points, "a"), ["video_id", "a_track_id"])
    both = a.join(own(points if others is None else others, "b"), ["video_id", "b_track_id", "frame"])
    return both.groupBy("video_id", "a_track_id", "b_track_id").agg(F.count("*").alias("common_frames"), F.avg(norm(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).alias("mean_distance"))


#: Partners in its frame that a point has on average, beyond which cells are used, if the ``limit`` is
#: so small beside the places that they leave few of them.
CROWDED = 500


def close_on_average(left: DataFrame, right: DataFrame, limit: float) -> DataFrame:
    """video_id, a_track_id (of left), b_track_id (of right), common_frames, mean_distance for
    tracks whose mean distance over common frames is at most ``limit``: all points of a frame meet, in pairs of
    blocks of tracks, so that no pair of points or tracks that lies further apart is ever shuffled."""
    return tracks_met(left, right, max_mean=limit)


#: Tracks of a video that others meet in the first round, and by how much later rounds are larger.
ROUND, LARGER = 256, 8


def met_in_rounds(left: DataFrame, right: DataFrame, limit: float, settled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``close_on_average``: all of them for the tracks of ``left`` that are never settled, for the others as many as
    settle them. The tracks of ``right`` come in rounds, each of some times as many as the one before, until all have come;
    ``settled`` gives, of the rows so far (a_track_id named track_id), the keys of those that need to meet no more."""
    columns, scale = [*KEY, "frame", "x", "y"], 2**20
    left, right = written(left.select(*columns), "left"), written(right.select(*columns), "right")
    most = right.groupBy("video_id").agg(F.count_distinct("track_id").alias("n")).agg(F.max("n")).first()[0] or 1
    place, share, upto, found = F.pmod(F.xxhash64("track_id", F.lit("round")), F.lit(scale)), ROUND / most, 0, None
    while True:
        since, upto, share = upto, min(scale, max(upto + 1, ceil(scale * share))), share * LARGER
        met = written(close_on_average(left, right.where((place >= since) & (place < upto)), limit).withColumnRenamed("a_track_id", "track_id"), "met")
        found = met if found is None else found.unionByName(met)
        if upto >= scale:
            return found
        whole, left = left, written(left.join(settled(found).select(*KEY).distinct(), KEY, "left_anti"), "left")
        dropped(whole)
        if left.isEmpty():
            return found


DUPLICATE = ["video_id", "track_a", "track_b", "relation", "reason", "duplicate_score", "common_frames", "overlap_ratio_short", "mean_distance", "median_distance", "p90_distance", "gap_frames", "endpoint_distance", "direction_similarity", "speed_similarity"]


def _scored(rows: DataFrame, score: Column, blockers: Column, fine: str, relation: str) -> DataFrame:
    c = F.col
    rows = rows.withColumns({"_s": score, "_b": blockers}).withColumnsRenamed({"a_track_id": "track_a", "b_track_id": "track_b"})
    return rows.withColumns({"relation": F.lit(relation), "duplicate_score": F.when(F.size("_b") > 0, F.least("_s", F.lit(0.49))).otherwise(c("_s")), "reason": F.when(F.size("_b") > 0, F.concat(F.lit("blocked:"), F.array_join("_b", ","))).otherwise(fine)}).select(*DUPLICATE)


def _blocks(first: str, test: Column, min_direction: float, min_speed: float) -> Column:
    c = F.col
    return F.array_compact(F.array(F.when(test, first), F.when(c("direction_similarity") < min_direction, "direction"), F.when(c("speed_similarity") < min_speed, "speed")))


def _whole() -> Column:
    return F.coalesce(vector_cosine(*map(F.col, ("a_vecx", "a_vecy", "b_vecx", "b_vecy"))), F.lit(1.0))


def overlap_pairs(points: DataFrame, max_spatial: float = 16.0, max_gap: int = 8, min_direction: float = 0.75, min_speed: float = 0.5) -> DataFrame:
    """Every pair of tracks that shares frames with its features, blockers and duplicate_score."""
    c = F.col
    base = edges(points).select(*KEY, "num_detections", "vecx", "vecy", "mean_speed_px_sec")
    over = tracks_met(points, tracks=base, percentiles=SPREAD).withColumns({"direction_similarity": _whole(), "speed_similarity": speed_similarity(c("a_mean_speed_px_sec"), c("b_mean_speed_px_sec"))})
    ratio, zero = c("common_frames") / F.greatest(F.lit(1), F.least("a_num_detections", "b_num_detections")), F.lit(0.0)
    raw = 0.45 * clip01(1 - c("median_distance") / max_spatial) + 0.25 * clip01(ratio) + 0.20 * clip01((c("direction_similarity") + 1) / 2) + 0.10 * c("speed_similarity")
    rows = over.withColumns({"overlap_ratio_short": ratio, "gap_frames": F.lit(0).cast("long"), "endpoint_distance": zero})
    return _scored(rows, raw, _blocks("spatial_distance", c("median_distance") > max_spatial, min_direction, min_speed), "overlap_close", "overlap")


def handoff_pairs(points: DataFrame, max_spatial: float = 16.0, max_gap: int = 8, min_direction: float = 0.75, min_speed: float = 0.5) -> DataFrame:
    """Every pair of tracks that follow each other closely, with its features, blockers and duplicate_score."""
    c, zero = F.col, F.lit(0.0)
    base = edges(points).select(*KEY, "frame_start", "frame_end", "num_detections", "x_start", "y_start", "x_end", "y_end", "svx", "svy", "evx", "evy", "vecx", "vecy", "mean_speed_px_sec")
    hand = handoffs(base, max_gap)
    a_first = c("a_frame_end") < c("b_frame_start")
    local = F.when(a_first, vector_cosine(c("a_evx"), c("a_evy"), c("b_svx"), c("b_svy"))).otherwise(vector_cosine(c("b_evx"), c("b_evy"), c("a_svx"), c("a_svy")))
    hand = hand.withColumns({"direction_similarity": F.least(_whole(), F.coalesce(local, F.lit(1.0))), "speed_similarity": speed_similarity(c("a_mean_speed_px_sec"), c("b_mean_speed_px_sec")), "gap_frames": c("gap_frames").cast("long")})
    near = 0.40 * clip01(1 - c("endpoint_distance") / (2 * max_spatial)) + 0.20 * clip01(1 - (c("gap_frames") - 1) / max(1.0, float(max_gap))) + 0.25 * clip01((c("direction_similarity") + 1) / 2) + 0.15 * c("speed_similarity")
    hand = hand.withColumns({"common_frames": F.lit(0).cast("long"), "overlap_ratio_short": zero, "mean_distance": zero, "median_distance": zero, "p90_distance": zero})
    return _scored(hand, near, _blocks("endpoint_distance", c("endpoint_distance") > max_spatial, min_direction, min_speed), "temporal_continuation", "handoff")


def duplicate_pairs(points: DataFrame, max_spatial: float = 16.0, max_gap: int = 8, min_direction: float = 0.75, min_speed: float = 0.5) -> DataFrame:
    """Every pair of tracks that shares frames (overlap) or follows closely
    (handoff), with its features, blockers and duplicate_score."""
    how = (max_spatial, max_gap, min_direction, min_speed)
    return overlap_pairs(points, *how).unionByName(handoff_pairs(points, *how))


def secondary_only(primary: DataFrame, secondary: DataFrame, max_distance: float = 45.0, min_frames: int = 4, min_ratio: float = 0.6, offset: int = 1_000_000) -> DataFrame:
    """Points of secondary tracks that no primary track accompanies, under new
    ids from ``offset`` on, in the order of the old ones."""
    secondary = written(secondary, "secondary")  # read in each round
    size = secondary.groupBy(*KEY).agg(F.count("*").alias("n"))
    accompanied = lambda met: met.join(size, KEY).where((F.col("common_frames") >= min_frames) & (F.col("common_frames") / F.col("n") >= min_ratio))
    bad = accompanied(met_in_rounds(secondary, primary, max_distance, accompanied)).select(*KEY).distinct()
    kept = size.join(bad, KEY, "left_anti")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("track_id"))
    names = kept.select(*KEY, (F.lit(offset) + rank - 1).cast("long").alias("new_id"))
    return secondary.join(names, KEY).withColumn("track_id", F.col("new_id")).drop("new_id")


def frame_intervals(points: DataFrame, padding: int = 0) -> DataFrame:
    """For each track the frames of its clip: l_start, l_end as its padded interval."""
    return summarise(points).select("video_id", "track_id", F.greatest(F.col("frame_start") - padding, F.lit(0)).alias("l_start"), (F.col("frame_end") + padding).alias("l_end"))


def clip_frames(points: DataFrame, frames: DataFrame, padding: int = 0) -> DataFrame:
    """video_id, track_id, frame: the frames of each track's clip, by a band join."""
    at = frames.select("video_id", "frame", F.col("frame").alias("r_start"), F.col("frame").alias("r_end"))
    return range_join(frame_intervals(points, padding), at, 0, 64).select("video_id", "track_id", "frame")


def overlapping_boxes(boxes: DataFrame, side: int = 16) -> DataFrame:
    """Pairs (a_, b_) of boxes of a frame that may overlap: a box goes to all cells that it reaches,
    and a pair is made in the cell of the corner where both begin, so far pairs of a crowded frame are never made."""
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    whole = boxes.where("bbox_x1 <= bbox_x2 and bbox_y1 <= bbox_y2")
    placed = whole.withColumn("_i", F.explode(F.sequence(cell("bbox_x1"), cell("bbox_x2")))).withColumn("_j", F.explode(F.sequence(cell("bbox_y1"), cell("bbox_y2"))))
    at = ["video_id", "frame", "_i", "_j"]
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / F.lit(side)).cast("long")
    met = sided(placed, "a", tuple(at)).join(sided(placed, "b", tuple(at)), at)
    return met.where((F.col("_i") == corner("bbox_x1")) & (F.col("_j") == corner("bbox_y1"))).drop("_i", "_j")


def nearest_at(points: DataFrame, frame: int, x: float, y: float, reach: float = 20.0) -> DataFrame:
    """The track nearest to a place in a frame."""
    d = norm(F.col("x") - x, F.col("y") - y)
    return points.where(F.col("frame") == frame).withColumn("distance", d).where(F.col("distance") <= reach).groupBy("video_id").agg(F.min_by("track_id", F.struct("distance", "track_id")).alias("track_id"), F.min("distance").alias("distance"))
