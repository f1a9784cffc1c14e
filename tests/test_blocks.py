"""Pairs of tracks by blocks, and what is made of them without a shuffle of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.operators import blocks, grouping, pairs

DDL = "video_id string, track_id long, frame long, x double, y double"


def scattered(rng, tracks, frames, ids):
    rows = [("ab"[t % 2], int(ids[t]), int(f), float(rng.uniform(0, 50)), float(rng.uniform(0, 50))) for t in range(tracks) for f in rng.choice(frames, 6, replace=False)]
    odd = {3: (None, 1.0), 7: (float("nan"), 1.0), 11: (float("inf"), 2.0)}
    return [(v, t, f, *odd.get(i, (x, y))) for i, (v, t, f, x, y) in enumerate(rows)] + [(None, 1, 1, 0.0, 0.0), ("a", None, 1, 0.0, 0.0), ("a", 1, None, 0.0, 0.0)]


def same(a, b):
    return a == b or (a is not None and b is not None and (a != a and b != b or abs(a - b) < 1e-9))


def joined(p, q, condition):
    d = F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2))
    other = q.select("video_id", "frame", F.col("track_id").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"))
    met = p.withColumnRenamed("track_id", "a").join(other, ["video_id", "frame"]).where(condition).groupBy("video_id", "a", "b")
    return met.agg(F.count("*"), F.avg(d), F.percentile(d, F.lit(0.5)), F.percentile(d, F.lit(0.9)))


@pytest.mark.parametrize("worth", [1, 20, 10**6])
def test_blocks_give_the_pairs_of_a_join(spark, monkeypatch, worth):
    monkeypatch.setattr(blocks, "WORTH", worth)
    rng = np.random.default_rng(worth)
    p = spark.createDataFrame(scattered(rng, 30, 20, rng.permutation(30) * 7 - 50), DDL)
    q = spark.createDataFrame(scattered(rng, 12, 20, np.arange(12)), DDL)
    shares = {"median_distance": 0.5, "p90_distance": 0.9}
    for got, want in ((blocks.tracks_met(p, percentiles=shares), joined(p, p, "a < b")), (blocks.tracks_met(p, q, percentiles=shares), joined(p, q, "a is not null and b is not null"))):
        got, want = ({tuple(r)[:3]: tuple(r)[3:] for r in rows.collect()} for rows in (got, want))
        assert want and set(got) == set(want)
        assert [k for k in want if not all(map(same, got[k], want[k]))] == []
    plan = blocks.tracks_met(p)._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_held_points_are_bounded(spark, monkeypatch):
    """Pieces of a pair of blocks give the pairs of the whole."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    frames = [sorted(rng.choice(30, 8, replace=False).tolist()) for _ in range(40)]
    table = pa.table({"track_id": np.arange(40), "frame": pa.array(frames, pa.list_(pa.int64())), **{c: pa.array([rng.uniform(0, 9, 8).tolist() for _ in frames], pa.list_(pa.float64())) for c in "xy"}})
    found = []
    for held in (1, 300, 10**6):
        monkeypatch.setattr(blocks, "HELD", held)
        parts = list(blocks.meet(table, np.arange(25), np.arange(10, 40), True, (0.5,), None))
        assert len(parts) > 1 or held == 10**6
        found.append(sorted((p, q, n, m, h) for a, b, c, d, e, _ in parts for p, q, n, m, h in zip(a, b, c, d, e[0])))
    assert found[0] == found[1] == found[2] and found[0]


def test_meeting_tracks_are_not_shuffled_after(spark):
    rng = np.random.default_rng(4)
    start = rng.integers(0, 60, 80)
    rows = [(f"v{i % 2}", int(i), int(s), int(s + rng.integers(0, 30)), float(rng.uniform(0, 9)), 1.0, float(rng.uniform(0, 9)), 2.0) for i, s in enumerate(start)]
    t = spark.createDataFrame(rows, "video_id string, track_id long, frame_start long, frame_end long, x_start double, y_start double, x_end double, y_end double")
    ordered = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    near = [(a[1], b[1]) for a, b in ordered if b[2] <= a[3] + 5 and b[3] >= a[2] - 5]
    met = pairs.merge_candidates(t, 5, 1e9)
    assert sorted((r.a_track_id, r.b_track_id) for r in met.collect()) == sorted(near)
    follow = sorted((a[1], b[1], max(b[2] - a[3], a[2] - b[3])) for a, b in ordered if 0 < max(b[2] - a[3], a[2] - b[3]) <= 5)
    hand = pairs.handoffs(t, 5)
    assert sorted((r.a_track_id, r.b_track_id, r.gap_frames) for r in hand.collect()) == follow
    for df in (met, hand):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 1 and "NestedLoop" not in plan


def test_dense_pairs_are_thinned_to_what_links(spark):
    rng = np.random.default_rng(6)
    rows = [(f"v{a % 3}", int(a), int(b)) for a, b in rng.integers(0, 400, (6000, 2)) if a != b and a % 3 == b % 3]
    p = spark.createDataFrame(rows, "video_id string, a long, b long").repartition(2)
    few = grouping.linking(p).collect()
    assert len(few) < 2 * 400 < len(rows)
    sets = grouping.Groups()
    for r in few:
        if sets.find(r.a) != sets.find(r.b):
            sets.join(r.a, r.b)
    assert all(sets.find(a) == sets.find(b) for _, a, b in rows)
    assert {r.track_id: r.group_id for r in grouping.components(p.toDF("video_id", "track_a", "track_b")).collect()} == {i: sets.find(i) for r in rows for i in r[1:]}


def test_components_are_read_in_their_order(spark):
    """Pieces of a component come in order, however many batches they fill."""
    rng = np.random.default_rng(8)
    p = spark.createDataFrame([("v", 0, int(i)) for i in rng.permutation(25_000)], "video_id string, group_id long, s long").repartition(7)

    seen = grouping.ordered(p, "s")._df.select("s").toPandas().s.to_numpy()
    assert (np.diff(seen) > 0).all() and len(seen) == 25_000


def test_boxes_meet_by_cells(spark):
    rng = np.random.default_rng(9)
    corner, size = rng.integers(-60, 60, (120, 2)), rng.integers(0, 40, (120, 2))
    rows = [("v", i % 2, i, int(x), int(y), int(x + w), int(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(corner, size))]
    met = pairs.overlapping_boxes(spark.createDataFrame(rows, "video_id string, frame long, det_idx int, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int"))
    over = lambda r, q, k: min(r[k + 2], q[k + 2]) > max(r[k], q[k])
    got = [(r.a_det_idx, r.b_det_idx) for r in met.where("least(a_bbox_x2, b_bbox_x2) > greatest(a_bbox_x1, b_bbox_x1) and least(a_bbox_y2, b_bbox_y2) > greatest(a_bbox_y1, b_bbox_y1)").collect()]
    assert sorted(got) == [(r[2], q[2]) for r in rows for q in rows if r[1] == q[1] and over(r, q, 3) and over(r, q, 4)]
    assert met.count() < 2 * 60 * 60  # fewer than all pairs of the frames


def test_tracks_meet_in_rounds(spark, monkeypatch):
    """Tracks that are settled meet no more; all others meet all tracks, and what is found is that of all pairs."""
    monkeypatch.setattr(pairs, "ROUND", 2)
    rng = np.random.default_rng(12)
    p = spark.createDataFrame(scattered(rng, 30, 20, np.arange(30)), DDL)
    q = spark.createDataFrame(scattered(rng, 40, 20, np.arange(40)), DDL)
    whole = {tuple(r)[:3]: tuple(r)[3:] for r in pairs.close_on_average(p, q, 12.0).collect()}
    met = {tuple(r)[:3]: tuple(r)[3:] for r in pairs.met_in_rounds(p, q, 12.0, lambda rows: rows.where("false")).collect()}
    assert set(met) == set(whole) and all(met[k][0] == whole[k][0] and same(met[k][1], whole[k][1]) for k in met)
    few = {tuple(r)[:3] for r in pairs.met_in_rounds(p, q, 12.0, lambda rows: rows).collect()}
    assert few < set(whole) and {k[:2] for k in few} == {k[:2] for k in whole}
