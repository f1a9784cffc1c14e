import numpy as np
from pyspark.sql import functions as F

from flightloom.operators import layers, pixels


def test_deep_layer_is_the_dark_middle():
    image = np.full((60, 80), 200.0)
    image[20:45, 30:52] = 10
    image[5:12, 2:8] = 10
    mask = layers.deep_layer(image, cfg=layers.Layers(blur=3, percentile=90, kernel=3))
    assert mask[30, 40] and not mask[8, 5]
    wider = layers.deep_layer(image, cfg=layers.Layers(blur=3, percentile=90, kernel=3, more_percentiles=(50.0,), more_dilations=(3,)))
    assert wider.sum() >= mask.sum() * 0.5


def test_smooth_path_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    score = rng.random((4, 5))
    total = lambda p: sum(score[i, j] for i, j in enumerate(p)) - 0.3 * sum(abs(a - b) for a, b in zip(p, p[1:]))
    best = max((p for p in product(range(5), repeat=4) if all(abs(a - b) <= 2 for a, b in zip(p, p[1:]))), key=total)
    assert layers.smooth_path(score, 0.3, 2).tolist() == list(best)


def test_contour_snaps_to_the_edge():
    depth = np.zeros((60, 50))
    depth[:30] = 100
    mask = np.zeros((60, 50), bool)
    mask[5:25, 10:40] = True
    out = layers.snap_lower_contour(mask, depth, layers.Contour(up=5, down=15, window=5))
    bottoms = [np.flatnonzero(out[:, x])[-1] for x in range(12, 38)]
    assert max(abs(b - 30) for b in bottoms) <= 2


def px(spark, rows):
    return spark.createDataFrame([("v", *r) for r in rows], "video_id string, x int, y int")


def test_regions_and_exclusion(spark):
    a, b = px(spark, [(0, 0), (1, 0)]), px(spark, [(5, 5)])
    assert layers.combined_region(a, b).count() == 2 and layers.combined_region(a, b, "or").count() == 3
    assert layers.region_box(a).first()[1:] == (0, 0, 1, 0)
    flat = spark.createDataFrame([("v", x, y, 50.0) for x in range(30) for y in range(30)], "video_id string, x int, y int, v double")
    veg = flat.where("x < 20 and y < 20").select("video_id", "x", "y")
    assert veg.count() - layers.exclude_zone(veg, flat.where("x < 25 and y < 25"), flat).count() == 400
    assert layers.exclude_zone(veg, flat, flat, "none").count() == 400


def test_timings(spark):
    r = spark.createDataFrame([("blur", 0, 1.0, 1), ("blur", 1, 3.0, 1), ("decode", 0, 2.0, 1)], "phase string, frame long, duration_sec double, executions int")
    got = {x.phase: x for x in layers.timings(r, 10.0, 4).collect()}
    assert got["blur"].total_sec == 4.0 and got["blur"].mean_sec_per_frame == 1.0 and got["decode"].percent_total == 20.0


def test_heatmap_event(spark):
    frames = spark.createDataFrame([("v", f, x, y, 100.0 if abs(x - 4 * f) <= 2 and abs(y - 4 * f) <= 2 else 0.0) for f in range(12) for x in range(0, 48, 2) for y in range(0, 48, 2)], "video_id string, frame long, x int, y int, v double")
    pts = [(f, f / 25, 4.0 * f, 4.0 * f, 9.0, 1) for f in range(12)]
    kind = "struct<frame:bigint,time_sec:double,x:double,y:double,area:double,track_id:bigint>"
    events = spark.createDataFrame([("v", 10001, [1], pts, 0, 11)], f"video_id string, event_id long, source_track_ids array<long>, points array<{kind}>, frame_start long, frame_end long")
    out = layers.heatmap_events(events, frames, 12, 14.0, percentile=10.0, width=16.0, bins=4, min_points=3, min_displacement=20.0).collect()
    assert [(e.event_id, e.source_fast_event_id, e.direction) for e in out] == [(20001, 10001, "exit")]
    assert pixels.normalised_heat(pixels.motion_energy(frames)).agg(F.max("heat")).first()[0] == 1.0


def corridor_by_numpy(heat, start, end, percentile, width, bins, y_max, seeds):
    start, end = np.array(start), np.array(end)
    length = float(np.linalg.norm(end - start))
    unit = (end - start) / length
    ys, xs = np.indices(heat.shape)
    t = (xs - start[0]) * unit[0] + (ys - start[1]) * unit[1]
    u = np.abs(-(xs - start[0]) * unit[1] + (ys - start[1]) * unit[0])
    on = (t >= -40) & (t <= length + 80) & (u <= width) & (heat >= np.percentile(heat[heat > 0], percentile))
    on = on & (ys < y_max) if y_max > 0 else on

    def moved(image, f, fill):
        p = np.pad(image, 1, constant_values=fill)
        return f.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    on = moved(moved(on, np.logical_and, True), np.logical_or, False)
    assert on.sum() >= 10
    edges, path = np.linspace(-20, length + 50, bins), [tuple(start)] if seeds else []
    for lo, hi in zip(edges, edges[1:]):
        at = on & (t >= lo) & (t < hi)
        if at.sum() >= 5:
            xy = np.array([np.average(xs[at], weights=heat[at] ** 1.35), np.average(ys[at], weights=heat[at] ** 1.35)])
            path.append(tuple(0.75 * xy + 0.25 * (start + unit * np.dot(xy - start, unit))))
        elif seeds and 0 <= (lo + hi) / 2 <= length:
            path.append(tuple(start + unit * (lo + hi) / 2))
    path += [tuple(end)] if seeds else []
    if not seeds and sum(path[0]) < sum(path[-1]):
        path.reverse()
    return [path[i] if i in (0, len(path) - 1) else tuple(np.mean(path[max(0, i - 2) : i + 3], axis=0)) for i in range(len(path))]


def test_corridor_by_numpy(spark):
    from flightloom.operators.fast_events import corridor_path

    rng = np.random.default_rng(4)
    image = np.where(rng.random((120, 170)) < 0.2, rng.random((120, 170)), 0.0)  # noise that the opening takes
    for x, y, r in ((0, 3, 4), (40, 35, 5), (60, 48, 6), (75, 70, 3), (100, 62, 7), (135, 92, 6), (155, 105, 4), (80, 20, 5)):  # past both ends, beside the axis
        yy, xx = np.indices(image.shape)
        image = np.maximum(image, np.where(np.hypot(xx - x, yy - y) <= r, 2 + rng.random(image.shape), 0.0))
    heat = spark.createDataFrame([("v", x, y, float(image[y, x])) for y in range(120) for x in range(170)], "video_id string, x int, y int, energy double")
    a, b = (20.0, 16.0), (110.0, 76.0)
    for start, end, width, bins, y_max, seeds in ((a, b, 14.0, 12, -1.0, False), (b, a, 14.0, 12, 100.0, False), (a, b, 60.0, 16, -1.0, True)):
        got = [(p.x, p.y) for p in corridor_path(heat, start, end, 60.0, width, bins - 1, y_max, seeds).orderBy("bin").collect()]
        want = corridor_by_numpy(image, start, end, 60.0, width, bins, y_max, seeds)
        assert len(got) == len(want) and np.allclose(got, want)
    assert corridor_path(heat.where("x < 2 and y < 4"), a, b).count() == 0  # under 10 pixels
