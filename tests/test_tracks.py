"""Scenarios on small tables: trackers, pairs, merges, filters, windows, regions, events."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.operators import fast_events as fe
from flightloom.operators import filters, grouping, pairs, pixels, regions, summary, tracking, windows
from flightloom.plans import run
from flightloom.sources import config

FPS = 25.0
DDL = "video_id string, track_id long, frame long, time_sec double, x double, y double, vx double, vy double, area double"
DET = "video_id string, frame long, det_idx int, x double, y double, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, area double"


def points(spark, *tracks):
    return spark.createDataFrame([("v", i, f, f / FPS, float(x), float(y), 0.0, 0.0, 16.0) for i, rows in tracks for f, x, y in rows], DDL)


def dets(spark, rows):
    return spark.createDataFrame([("v", f, i, float(x), float(y), int(x) - 3, int(y) - 3, int(x) + 3, int(y) + 3, 36.0) for f, i, x, y in rows], DET)


def line(start, n, x0, y0, dx, dy=0.0):
    return [(start + i, x0 + dx * i, y0 + dy * i) for i in range(n)]


def test_assign_is_optimal():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2), (5, 5)):
        c = rng.random((n, m))
        got = tracking.assign(c)
        small, big = (c, m) if n <= m else (c.T, n)
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(big), small.shape[0]))
        assert len(got) == min(n, m) and abs(sum(c[i, j] for i, j in got) - best) < 1e-9
    assert tracking.assign(np.zeros((0, 3))) == []


def column_by_column(cost):
    """Shortest augmenting paths from row minima that leave one column at a time; the total of the matching."""
    n, m = cost.shape
    u, v, owner = cost.min(axis=1), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, done, i, column, total = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), row, -1, 0.0
        while True:
            through = total + cost[i] - u[i] - v
            better = ~done & (through < least)
            least[better], back[better] = through[better], column
            column = int(np.argmin(np.where(done, np.inf, least)))
            total, done[column] = least[column], True
            if owner[column] < 0:
                break
            i = owner[column]
        u[row] += total
        for j in np.flatnonzero(done):
            if j != column:
                u[owner[j]] += total - least[j]
                v[j] -= total - least[j]
        while column >= 0:
            owner[column], column = (owner[back[column]] if back[column] >= 0 else row), back[column]
    return sum(cost[owner[j], j] for j in range(m) if owner[j] >= 0)


def test_assign_of_crowded_frames():
    """Six copies of each place, as in a crowded frame: the least total, well before a search that leaves one column at a time."""
    rng = np.random.default_rng(3)
    a, b = (np.repeat(np.c_[rng.exponential(50.0, 100), rng.integers(0, 100, 100)], 6, axis=0) for _ in range(2))
    cost = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    began = time.perf_counter()
    got = tracking.assign(cost)
    took, began = time.perf_counter() - began, time.perf_counter()
    plain = column_by_column(cost)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(cost) and abs(sum(cost[p] for p in got) - plain) < 1e-6
    assert took < 0.6 * (time.perf_counter() - began)


@pytest.mark.parametrize("kind", ["kalman", "greedy"])
def test_crossing_and_gap(spark, kind):
    rows = [(f, i, *((10 * f, 8 * f) if i == 0 else (10 * f, 160 - 8 * f))) for f in range(21) for i in range(2)]
    out = tracking.track(dets(spark, rows), kind, max_distance=60.0, max_missed=8, fps=FPS).groupBy("track_id").count().collect()
    assert sorted(r["count"] >= 15 for r in out) == [True, True]
    gap = [(f, 0, 20 + 12 * f, 100) for f in range(16) if f not in (6, 7, 8)]
    out = tracking.track(dets(spark, gap), kind, max_distance=60.0, max_missed=6, fps=FPS).groupBy("track_id").count().collect()
    assert len(out) == 1 and out[0]["count"] >= 10


def test_stretches_are_tracked_apart(spark):
    rows = [(f, 0, 10 * f, 50) for f in range(8)] + [(200 + f, 0, 10 * f, 50) for f in range(8)]
    assert tracking.track(dets(spark, rows), "greedy", max_missed=5).select("track_id").distinct().count() == 2


def test_fusion(spark):
    first, second = dets(spark, [(0, 0, 20, 20), (0, 1, 60, 60)]), dets(spark, [(0, 0, 22, 21), (0, 1, 95, 95)])
    out = tracking.fuse_detections(first, second, 5.0, 0.1).groupBy("origin").count().collect()
    assert {r["origin"]: r["count"] for r in out} == {"primary": 2, "secondary": 1}


def plainly_unmatched(x, y, box, first, max_distance, min_iou):
    """Each row against all that stay."""
    area, chosen = np.prod(np.maximum(box[:, 2:] - box[:, :2], 0), axis=1), []
    for i in range(len(x)):
        if i >= first and chosen:
            k = np.array(chosen)
            inter = np.prod(np.maximum(np.minimum(box[k, 2:], box[i, 2:]) - np.maximum(box[k, :2], box[i, :2]), 0), axis=1)
            union = area[k] + area[i] - inter
            iou = np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), 0)
            if ((np.hypot(x[k] - x[i], y[k] - y[i]) <= max_distance) | (iou >= min_iou)).any():
                continue
        chosen.append(i)
    return chosen


@pytest.mark.parametrize("max_distance, min_iou", [(8.0, 0.1), (0.0, 0.3), (5.0, 0.0), (3.0, 2.0), (40.0, 0.01)])
def test_fusion_against_a_plain_walk(max_distance, min_iou):
    rng = np.random.default_rng(4)
    for t in range(40):
        n, side = int(rng.integers(1, 120)), float(rng.choice([20.0, 100.0, 1000.0]))
        x, y = rng.random(n) * side, rng.random(n) * side
        x, y = (x.round(), y.round()) if t % 2 else (x, y)
        x[rng.random(n) < 0.02] = np.nan
        at, size = (rng.random((n, 2)) * side).round() if t % 3 == 0 else np.nan_to_num(np.c_[x, y]).round(), rng.integers(0, 9, (n, 2)) ** rng.integers(1, 3)
        box, first = np.c_[at - size, at + size].astype(float), int(rng.integers(0, n + 1))
        assert tracking.unmatched(x, y, box, first, max_distance, min_iou).tolist() == plainly_unmatched(x, y, box, first, max_distance, min_iou)


def test_fusion_of_a_crowded_frame():
    """Well before a walk that compares each detection with all that stay."""
    rng = np.random.default_rng(5)
    x, y = rng.exponential(50.0, 12000), rng.integers(0, 100, 12000).astype(float)
    box = np.c_[x - 3, y - 3, x + 3, y + 3]
    began = time.perf_counter()
    got = tracking.unmatched(x, y, box, 6000, 8.0, 0.1)
    took, began = time.perf_counter() - began, time.perf_counter()
    assert got.tolist() == plainly_unmatched(x, y, box, 6000, 8.0, 0.1)
    assert took < 0.5 * (time.perf_counter() - began)


def merged_ids(spark, p, **options):
    found = grouping.merge_features(p)
    merges = grouping.guarded_merges(p, found, **options)
    return merges.collect(), grouping.apply_merges(p, merges).select("track_id").distinct().count()


def test_merges(spark):
    parallel = points(spark, *((i, line(0, 20, 10, 100 * i, 12)) for i in (1, 2, 3)))
    assert merged_ids(spark, parallel) == ([], 3)
    fragment = points(spark, (1, line(0, 10, 10, 100, 10)), (2, line(12, 10, 130, 100, 10)))
    merges, n = merged_ids(spark, fragment)
    assert n == 1 and [(m.track_a, m.track_b, m.merged_to, m.reason) for m in merges] == [(1, 2, 1, "handoff")]
    beside = points(spark, (1, line(0, 10, 10, 100, 10)), (2, line(12, 10, 130, 100, 10)), (3, line(0, 22, 10, 260, 10)))
    assert merged_ids(spark, beside)[1] == 2


def test_dedup_strategies(spark):
    p = points(spark, (1, line(0, 12, 0, 50, 10)), (2, line(0, 12, 0, 53, 10)), (3, line(0, 12, 0, 300, 10)))
    found = pairs.duplicate_pairs(p)
    d = {r.track_id_original: r.decision for r in grouping.dedup_decisions(p, found, "discard").collect()}
    assert sorted(d.values()) == ["discard", "keep", "keep"] and d[3] == "keep"
    p = points(spark, (1, line(0, 10, 0, 50, 10)), (2, line(12, 10, 108, 50, 10)))
    found = pairs.duplicate_pairs(p, max_spatial=20.0)
    decisions = grouping.dedup_decisions(p, found, "auto")
    assert {r.decision for r in decisions.collect()} == {"merge"}
    assert grouping.apply_decisions(p, decisions).groupBy("track_id").count().collect()[0]["count"] == 20
    with pytest.raises(ValueError):
        grouping.dedup_decisions(p, found, "other")


def reasons(spark, rows, rules, size=(1280, 720)):
    return filters.assess(points(spark, (1, rows)), rules, FPS, size).first()


def test_filter_reasons(spark):
    static = filters.TrackFilter(static_noise=True, static_max_speed_ratio=0.025, static_max_displacement_ratio=0.02)
    assert reasons(spark, line(0, 101, 500, 300, 0.2), static).reject_reasons == ["static_noise"]
    swing = [(f, 500 + (80 if f % 2 else -80), 300) for f in range(101)]
    assert reasons(spark, swing, static).accepted
    gap = line(0, 13, 0, 0, 10) + line(1176, 10, 200, 0, 10)
    assert reasons(spark, gap, filters.TrackFilter(max_gap=45)).reject_reasons == ["temporal_gap"]
    circle = [(f, 300 + 30 * np.cos(f / 5), 300 + 30 * np.sin(f / 5)) for f in range(300)]
    assert reasons(spark, circle, filters.TrackFilter(loiter=True, loiter_min_displacement_ratio=0.2)).reject_reasons == ["loiter"]
    one = reasons(spark, [(5, 1.0, 1.0)], filters.TrackFilter())
    assert (one.accepted, one.reject_reasons, one.score) == (False, ["vegetation_mask"], 0.0)
    strong = reasons(spark, line(0, 9, 0, 0, 30), filters.TrackFilter(min_length=10, min_displacement=20, min_path=20))
    assert strong.accepted and strong.score >= 0.9


def test_gate_is_an_option(spark):
    p = points(spark, (1, line(0, 10, 10, 50, 5)))
    d = regions.full_directions(regions.flag_in_box(p, (150, 249, 0, 200)), (200, 100), 200.0)
    on = filters.assess(p, filters.TrackFilter(require_region=True), FPS, (400, 200), directions=d).first()
    off = filters.assess(p, filters.TrackFilter(), FPS, (400, 200), directions=d).first()
    assert on.reject_reasons == ["valid_region_gate"] and off.accepted


def test_directions(spark):
    p = points(spark, (1, [(0, 50, 50), (1, 200, 50)]), (2, [(0, 200, 50), (1, 50, 50)]), (3, [(0, 50, 50), (1, 200, 50), (2, 60, 50)]))
    d = regions.full_directions(regions.flag_in_box(p, (0, 100, 0, 100)), (50, 50), 576.0).collect()
    assert {r.track_id: r.direction for r in d} == {1: "exit", 2: "entry", 3: "exit"}


def test_bursts(spark):
    p = points(spark, *((i, line(10, 4, 10 * i, 10, 1)) for i in range(1, 6)), (9, line(30, 4, 0, 0, 1)))
    left = windows.suppress_bursts(p, 5, 4, 3, 2)
    assert [r.track_id for r in left.select("track_id").distinct().collect()] == [9]
    assert windows.burst_frames(p, 5, 4, 3, 2).agg(F.min("first")).first()[0] == 10


def test_burst_gate_matches_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 6, 80)
    got = {r.frame: r.keep for r in windows.burst_gate(spark.createDataFrame([("v", i, int(c)) for i, c in enumerate(n)], "video_id string, frame long, n int"), 3, 5, 3, 4).collect()}
    hits, until = [], -1
    for f, c in enumerate(n):
        hits = [h for h in hits + [f] * int(c >= 3) if h > f - 5]
        keep = f > until and len(hits) < 3
        if f > until and len(hits) >= 3:
            until = f + 3
        assert got[f] == keep


def test_smoothing_edges(spark):
    rows = line(0, 7, 0, 0, 3)
    got = [r.x_s for r in windows.smooth(points(spark, (1, rows)), 5).orderBy("frame").collect()]
    x = np.pad([r[1] for r in rows], 2, mode="edge")
    assert np.allclose(got, [x[i : i + 5].mean() for i in range(7)])
    assert [r.x_s for r in windows.smooth(points(spark, (1, rows[:3])), 5).orderBy("frame").collect()] == [0.0, 3.0, 6.0]


def test_range_join_is_exact(spark):
    rng = np.random.default_rng(2)
    a = [(int(s), int(s + rng.integers(0, 60)), i) for i, s in enumerate(rng.integers(0, 500, 120))]
    left = spark.createDataFrame([("v", *r) for r in a], "video_id string, l_start long, l_end long, l long")
    right = spark.createDataFrame([("v", *r) for r in a], "video_id string, r_start long, r_end long, r long")
    got = [(r.l, r.r) for r in pairs.range_join(left, right, 7).collect()]
    want = {(i, j) for s, e, i in a for t, f, j in a if t - e <= 7 and s - f <= 7}
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in pairs.range_join(left, right, 7)._jdf.queryExecution().toString()


def test_crossing_rescue(spark):
    accepted = points(spark, (1, line(0, 5, 0, 0, 10)))
    source = accepted.unionByName(points(spark, (2, [(4 + i, 42 + 10 * i, 4) for i in range(5)])))
    a = spark.createDataFrame([("v", 2, False, ["valid_region_gate"])], "video_id string, track_id long, accepted boolean, reject_reasons array<string>")
    r = grouping.crossing_rescues(source, accepted, a).collect()
    assert [(x.track_id, x.source_track_id, x.points_added, x.gap_frames) for x in r] == [(1, 2, 4, 0)]
    assert round(r[0].start_distance, 3) == 4.472 and round(r[0].score, 3) == -3.528
    assert grouping.apply_rescues(accepted, source, grouping.crossing_rescues(source, accepted, a)).where("track_id = 1").count() == 9


def test_fast_event(spark):
    p = points(spark, (24, line(0, 5, 400, 400, -30, -30)), (23, line(6, 5, 220, 220, -30, -30)))
    a = filters.assess(p, filters.TrackFilter(), FPS, (640, 480))
    e = fe.fast_events(p, a, {"first_event_id": 900}, 480.0).collect()
    assert [(x.event_id, x.source_track_ids, x.direction) for x in e] == [(900, [23, 24], "exit")] and e[0].confidence > 0.5


def test_run_makes_events_of_each_kind(spark):
    # eight points make an event of their own; three are too few, but their ends are far apart
    p = points(spark, (24, line(0, 8, 130, 130, -15, -15)), (30, line(100, 3, 20, 140, 60, 0)))
    frames = spark.createDataFrame([("v", f, x, y, 200.0 if abs(x - 130 + 15 * f) <= 5 and abs(y - 130 + 15 * f) <= 5 else 0.0) for f in range(8) for x in range(160) for y in range(160)], "video_id string, frame long, x int, y int, v double")
    on = {"fast_events": {"enabled": True, "first_event_id": 900}, "heatmap_events": {"enabled": True, "min_points": 3, "bins": 8, "corridor_width": 30.0}}
    r = run.run(on, (160, 160), FPS, raw_points=p, frames=frames)
    e = r.fast_events.orderBy("event_id").collect()
    assert [(x.event_id, x.source_track_ids, len(x.points)) for x in e] == [(900, [24], 8), (901, [30], 2)]
    h = r.heatmap_events.collect()
    assert [(x.event_id, x.source_fast_event_id, x.direction) for x in h] == [(20001, 900, "exit")] and h[0].points[0].x > 100 and h[0].points[-1].x < 50


def test_merge_summary(spark):
    m = spark.createDataFrame([("v", 1, 2, 1, "overlap"), ("v", 1, 3, 1, "overlap_local"), ("v", 1, 4, 1, "handoff")], "video_id string, track_a long, track_b long, merged_to long, reason string")
    r = summary.merge_summary(m).first()
    assert (r.overlap, r.handoff, r.max_group_size) == (2, 1, 4)
    r = summary.merge_summary(m.where("false")).first()
    assert (r.merges_total, r.max_group_size) == (0, 1)


def test_pixels(spark):
    image = np.zeros((6, 8), bool)
    image[0, 0] = image[1, 1] = image[4, 5] = True
    assert pixels.label_image(image).max() == 2
    full = np.full((5, 5), 7.0)
    assert np.allclose(pixels.gaussian(full, 5), 7) and np.allclose(pixels.box_mean(full, 3), 7) and np.allclose(pixels.sobel(full), 0)
    assert pixels.sample_frames(10, 4) == [0, 3, 6, 9] and pixels.sample_frames(0, 4) == []
    px = spark.createDataFrame([("v", x, y) for x in range(2, 5) for y in range(2, 5)], "video_id string, x int, y int")
    square = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert pixels.dilate(px, square).count() == 25 and [tuple(r) for r in pixels.erode(px, square).collect()] == [("v", 3, 3)]
    assert pixels.opened(px, square).count() == 9 and pixels.closed(px, square).count() == 9


def test_settings():
    assert config.load({"tracking": {"tracker": "greedy"}, "own": {"x": 1}})["own"] == {"x": 1}
    for bad in ({"tracking": {"tracker": "x"}}, {"output": {"trajectory_smoothing_window": 4}}, {"background": {"context_duration_sec": 0}}, {"cave_zones": {"max_components": 0}}, {"tracking": 3}):
        with pytest.raises(ValueError):
            config.load(bad)
    assert config.odd(4) == 5 and config.number_list("1; 2") == [1, 2]


def flights(seed=5, frames=400, n=30, size=2000.0):
    """Fliers that come and go in a wide scene, with misses and noise; never more than a few apart at once."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        begin, length = int(rng.integers(0, frames - 60)), int(rng.integers(50, 220))
        x, y = rng.uniform(0, size, 2)
        vx, vy = rng.uniform(-5, 5, 2)
        for f in range(begin, min(frames, begin + length)):
            if rng.random() < 0.93:
                rows.append((f, x + vx * (f - begin) + rng.normal(0, 0.5), y + vy * (f - begin) + rng.normal(0, 0.5), float(rng.integers(5, 60))))
    rows += [(f, 5.0, 5.0 + f % 3, 9.0) for f in range(frames)]  # the video is never silent
    out, seen = [], {}
    for f, x, y, area in sorted(rows):
        seen[f] = seen.get(f, -1) + 1
        out.append(("v", f, seen[f], float(x), float(y), int(x) - 2, int(y) - 2, int(x) + 2, int(y) + 2, area))
    return out


def as_sets(points):
    """Tracks as sets of (frame, place), whatever their ids."""
    found = {}
    for r in points:
        found.setdefault(r.track_id, set()).add((r.frame, round(r.x, 6), round(r.y, 6)))
    return {frozenset(t) for t in found.values()}


@pytest.mark.parametrize("kind", ["greedy", "kalman"])
def test_chunks_give_the_tracks_of_one_walk(spark, kind):
    from flightloom.sources.readers import DETECTIONS

    d = spark.createDataFrame(flights(), DETECTIONS)
    options = {"max_distance": 30.0, "max_missed": 5, "fps": FPS}
    whole = tracking.track(d, kind, **options).collect()
    cut = tracking.track(d, kind, chunk=80, overlap=40, **options).collect()
    assert as_sets(whole) == as_sets(cut) and len(cut) == len(whole) and max(len(t) for t in as_sets(cut)) > 200
    speed = {(r.frame, r.x, r.y): (r.vx, r.vy) for r in whole}
    assert all(abs(r.vx - speed[r.frame, r.x, r.y][0]) + abs(r.vy - speed[r.frame, r.x, r.y][1]) < 0.05 for r in cut)
    late = d.where("frame >= 170")  # a video that begins in a later chunk keeps its head
    assert as_sets(tracking.track(late, kind, **options).collect()) == as_sets(tracking.track(late, kind, chunk=80, overlap=40, **options).collect())
    with pytest.raises(ValueError):
        tracking.track(d, kind, chunk=10, overlap=10, **options)
    assert tracking.track(d.where("false"), kind, chunk=80, **options).count() == 0


class PlainKalman:
    """The Kalman step in the plainest form: lists, full covariance matrices, one matching over the whole frame by trying all."""

    def __init__(self, reach, missed, fps, sigma, measured, strong_area, weak_reach=1.0):
        self.reach, self.missed, self.fps, self.sigma, self.measured, self.strong, self.weak = reach, missed, fps, sigma, measured, strong_area, weak_reach
        self.tracks, self.waiting, self.next = [], [], 0

    def predict(self, t):
        step = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1.0]])
        g = np.array([[0.5, 0], [0, 0.5], [1, 0], [0, 1.0]]) * self.sigma
        t["m"], t["p"] = step @ t["m"], step @ t["p"] @ step.T + g @ g.T

    def correct(self, t, place):
        look = np.eye(2, 4)
        s = look @ t["p"] @ look.T + self.measured**2 * np.eye(2)
        k = t["p"] @ look.T @ np.linalg.inv(s)
        t["m"] = t["m"] + k @ (np.array(place) - look @ t["m"])
        t["p"] = (np.eye(4) - k @ look) @ t["p"]
        t["missed"] = 0

    def match(self, tracks, rows, reach):
        """Most pairs within reach, then the least total distance, by trying every way."""
        best = (0, 0.0, [])

        def go(i, used, total, chosen):
            nonlocal best
            if i == len(tracks):
                if (-len(chosen), total) < (-best[0], best[1]) or not best[2] and chosen:
                    best = (len(chosen), total, list(chosen))
                return
            go(i + 1, used, total, chosen)
            for j, r in rows:
                far = float(np.hypot(tracks[i]["m"][0] - r[0], tracks[i]["m"][1] - r[1]))
                if j not in used and far <= reach:
                    go(i + 1, used | {j}, total + far, [*chosen, (i, j)])

        go(0, frozenset(), 0.0, [])
        return best[2]

    def step(self, frame, rows):
        for t in self.tracks:
            self.predict(t)
        strong, weak = [(j, r) for j, r in enumerate(rows) if r[6] >= self.strong], [(j, r) for j, r in enumerate(rows) if r[6] < self.strong]
        out, told, hit, used = [], [], set(), set()
        for group, reach in ((strong, self.reach), (weak, self.reach * self.weak)):
            free = [t for t in self.tracks if t["id"] not in hit]
            for i, j in self.match(free, group, reach):
                t = free[i]
                self.correct(t, rows[j][:2])
                hit.add(t["id"])
                used.add(j)
                out.append((t["id"], frame, rows[j][:2], t["m"][2] * self.fps, t["m"][3] * self.fps))
                told.append(tuple(t["m"][:2]))
        for t in self.tracks:
            t["missed"] += t["id"] not in hit
        self.tracks = [t for t in self.tracks if t["missed"] <= self.missed]
        self.waiting = [w for w in self.waiting if frame - w[0] <= 2]
        rest = []
        for j, r in strong:
            if j in used:
                continue
            near = sorted((float(np.hypot(w[1][0] - r[0], w[1][1] - r[1])), k) for k, w in enumerate(self.waiting))
            if not near or near[0][0] >= 0.7 * self.reach:
                rest.append(r)
                continue
            then, first = self.waiting.pop(near[0][1])
            v = [(r[0] - first[0]) / max(1, frame - then), (r[1] - first[1]) / max(1, frame - then)]
            wide, fast = 2 * self.measured**2, max(1.0, self.reach / 2) ** 2
            t = {"id": self.next, "m": np.array([first[0], first[1], *v]), "p": np.diag([wide, wide, fast, fast]), "missed": 0}
            self.next += 1
            out.append((t["id"], then, first[:2], v[0] * self.fps, v[1] * self.fps))
            self.correct(t, r[:2])
            out.append((t["id"], frame, r[:2], t["m"][2] * self.fps, t["m"][3] * self.fps))
            told.append(tuple(r[:2]))
            self.tracks.append(t)
        self.waiting += [(frame, r) for r in rest if all(np.hypot(c[0] - r[0], c[1] - r[1]) >= min(120.0, 0.8 * self.reach) for c in told)]
        return out


@pytest.mark.parametrize("seed", range(12))
def test_kalman_step_against_a_plain_twin(seed):
    """Random crowded frames with misses, weak detections and gaps: the same points, velocities and ends of tracks."""
    rng = np.random.default_rng(seed)
    reach, missed, strong = 25.0, 3, 20.0
    ours, plain = tracking.Kalman(reach, missed, FPS, 3.0, 2.0, strong, 0.8), PlainKalman(reach, missed, FPS, 3.0, 2.0, strong, 0.8)
    place, speed = rng.uniform(0, 90, (5, 2)), rng.uniform(-6, 6, (5, 2))
    ids = set()
    for frame in range(60):
        place = place + speed
        rows = [(float(x), float(y), 0, 0, 0, 0, float(rng.choice([10.0, 30.0])), 0) for x, y in place[rng.random(5) < 0.8] + rng.normal(0, 1, 2)]
        rows += [(float(x), float(y), 0, 0, 0, 0, 30.0, 0) for x, y in rng.uniform(-50, 150, (int(rng.integers(0, 2)), 2))]
        rows = [] if frame in (20, 21, 22, 23, 24, 40) else rows
        place = np.where(rng.random((5, 1)) < 0.02, rng.uniform(0, 90, (5, 2)), place)
        a, b = ours.step(frame, rows), plain.step(frame, rows)
        key = lambda out: sorted((f, round(r[0], 9), round(r[1], 9), round(vx, 6), round(vy, 6)) for _, f, r, vx, vy in out)
        assert key(a) == key(b)
        ids |= {(x[0], y[0]) for x in a for y in b if x[1:2] + tuple(x[2][:2]) == y[1:2] + tuple(y[2])}
        assert len(ours.active) == len(plain.tracks) and len(ours.pending) == len(plain.waiting)
    assert len({a for a, _ in ids}) == len(ids) == len({b for _, b in ids})  # the same tracks under other ids


@pytest.mark.parametrize("crowded", [-1, 500])
def test_near_tracks_meet_by_cells(spark, monkeypatch, crowded):
    """Pairs close on average are those of all pairs of a frame; far pairs of a crowded
    frame are never made; points at the limit, across cells, and without a place."""
    monkeypatch.setattr(pairs, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    tracks = [(i, [(f, *(rng.uniform(-60, 60, 2) if i % 3 else (10.0 * (i // 3) + f, 5.0))) for f in range(i % 4, 6 + i % 4)]) for i in range(60)]
    tracks += [(100, [(0, 0.0, 0.0), (1, 0.0, 0.0)]), (101, [(0, 20.0, 0.0), (1, -20.0, 0.0)]), (102, [(0, float("nan"), 0.0), (1, 1.0, 1.0)]), (103, [(0, float("inf"), 0.0), (2, -1e300, 1e300)]), (104, [(2, -1e300, 1e300)])]
    p = points(spark, *tracks)
    for limit in (0.0, 20.0, 55.5):
        plain = {(r.track_a, r.track_b): (r.common_frames, r.mean_distance) for r in pairs.pair_distances(p).where(F.col("mean_distance") <= limit).collect()}
        got = {(r.a_track_id, r.b_track_id): (r.common_frames, r.mean_distance) for r in pairs.close_on_average(p, p, limit).where("a_track_id < b_track_id").collect()}
        assert set(got) == set(plain) and all(got[k][0] == plain[k][0] and abs(got[k][1] - plain[k][1]) < 1e-9 for k in got)
        assert ((100, 101) in got) == (limit >= 20) and (103, 104) in got
    crowd = points(spark, *((i, [(0, 100.0 * (i % 40), 100.0 * (i // 40))]) for i in range(1600)))
    assert pairs.near_tracks(crowd, crowd, 30.0).where("a_track_id <> b_track_id").count() == 0
    plan = pairs.near_tracks(crowd, crowd, 30.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs.close_on_average(p.limit(0), p, 5.0).count() == 0 and pairs.close_on_average(p, p.limit(0), 5.0).count() == 0
