"""Merges as tracks start: those of all candidate pairs in their order."""

import numpy as np
import pytest

from flightloom.operators import grouping, merging

DDL = "video_id string, track_id long, frame long, time_sec double, x double, y double, vx double, vy double, area double"


def crowd(spark, seed, tracks=90):
    rng = np.random.default_rng(seed)
    rows, ids = [], rng.permutation(tracks) * 3
    for i in range(tracks):
        start, n = int(rng.integers(0, 40)) + 200 * int(rng.random() < 0.2), int(rng.integers(1, 12))
        x, y, u, v = rng.uniform(0, 120), rng.uniform(0, 60), *rng.normal(0, 4, 2)
        for f in sorted(rng.choice(np.arange(start, start + 16), n, replace=False).tolist()):
            lost = rng.random() < 0.02
            rows.append(("ab"[i % 2], int(ids[i]), int(f), f / 25.0, None if lost else float(x + u * (f - start)), float(y + v * (f - start)), 0.0, 0.0, 1.0))
    return spark.createDataFrame(rows, DDL)


@pytest.mark.parametrize(("group", "shared", "proximity"), [(3, 2, 0.0), (6, 6, 20.0), (2, -1, 0.0), (0, 1, 0.0)])
def test_walk_gives_the_merges_of_all_pairs(spark, group, shared, proximity):
    p = crowd(spark, group + shared)
    want = grouping.guarded_merges(p, grouping.merge_features(p, 8, 40.0, 2, 30.0, 0.5, proximity), shared, 6.0, group)
    want = sorted(map(tuple, want.collect()))
    for size in ("10000", "7"):  # tracks that have ended leave between batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = merging.auto_merges(p, 8, 40.0, 2, 30.0, 0.5, proximity, shared, 6.0, group).collect()
        assert sorted(map(tuple, got)) == want and len(want) > 20 and {r[4] for r in want} > {"handoff"}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")



def test_coexisting_walk_gives_what_all_pairs_give(spark):
    """Each pair of tracks that share frames, in the order of their ids."""
    rows = sorted(tuple(r) for r in crowd(spark, 11, 150).select("video_id", "track_id", "frame", "x", "y").collect())
    tracks = {}
    for v, t, f, x, y in rows:
        tracks.setdefault((v, t), []).append((f, x, y))
    out = set()
    for a in sorted(tracks):
        if a in out:
            continue
        for b in sorted(tracks):
            both = [(p, q) for p in tracks[a] for q in tracks[b] if p[0] == q[0]] if a[0] == b[0] and a < b and b not in out else []
            d = [((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 for p, q in both if p[1] is not None and q[1] is not None]
            short, long = (a, b) if len(tracks[a]) <= len(tracks[b]) else (b, a)
            s, t = tracks[short], tracks[long]
            beside = s[0][0] >= t[0][0] and s[-1][0] <= t[-1][0] and (abs(s[0][0] - t[0][0]) <= 1 or abs(s[-1][0] - t[-1][0]) <= 1 or len(s) / len(t) <= 0.7)
            if d and beside and len(both) >= 1 and len(s) <= 8 and len(both) / len(s) >= 0.3 and sum(d) / len(d) <= 40.0:
                out.add(short)
    got = grouping.coexisting_duplicates(crowd(spark, 11, 150), 1, 40.0, 0.3, 8, 0.7, -1.0).collect()
    assert {tuple(r) for r in got} == out and 10 < len(got) == len(out)


def test_coexisting_tracks_of_a_crowd_meet_once(monkeypatch):
    """A track that is out is looked at no more, nor are its points."""
    import pyarrow as pa

    n = 4000
    table = pa.table({"track_id": np.arange(n), **{c: pa.array([list(range(8))] * n, pa.list_(k)) for c, k in (("frame", pa.int64()), ("x", pa.float64()), ("y", pa.float64()))}})
    held, seen = grouping.Frames(table), 0
    for a in range(n):
        if not held.out[a]:
            b, common, mean = held.look(a, 1)
            seen += len(b)
            assert (common == 8).all() and (mean == 0).all()
            held.out[b[: len(b) // 2]] = True
            held.thin(a)
    assert seen < 3 * n and len(held.own) <= 8 * n
