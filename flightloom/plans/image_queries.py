"""Named queries on pixels, regions, sources, sinks and streams, with the SQL of an
independent engine. Frames are the 8 x 8 stand-ins of ``sources.adapters``."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from flightloom.operators import fast_events as fe
from flightloom.operators import detection, filters, grouping, layers, pairs, pixels, regions, summary, zones
from flightloom.plans import catalog as base
from flightloom.plans.catalog import ASSESS, HEAT, PTS, points, sql_summary
from flightloom.sources import adapters as ad
from flightloom.sources import config as settings
from flightloom.sources import readers, scratch, sinks
from flightloom.streaming import stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}
OWN = ["video_id", "track_id"]
W = H = 8


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- SQL of pixel operations: tables of (x, y), or (frame, x, y)

def kernel_sql(kernel: list[tuple[int, int]]) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in kernel) + ") k(dx, dy)"


def dilate_sql(name: str, source: str, kernel: list[tuple[int, int]], key: str = "") -> str:
    key = f"{key}, " if key else ""
    return f"{name} AS (SELECT DISTINCT {key}CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM {source}, {kernel_sql(kernel)} WHERE x + dx BETWEEN 0 AND {W - 1} AND y + dy BETWEEN 0 AND {H - 1})"


def erosion(name: str, source: str, kernel: list[tuple[int, int]], key: str = "") -> str:
    """Erosion in two steps: neighbours that are there, against those that lie inside."""
    keys = f"{key}, " if key else ""
    seen = f"{name}_n AS (SELECT {keys}CAST(x - dx AS INTEGER) AS x, CAST(y - dy AS INTEGER) AS y, count(*) AS n FROM {source}, {kernel_sql(kernel)} GROUP BY ALL)"
    inside = f"{name}_i AS (SELECT p.x, p.y, count(*) AS n FROM (SELECT CAST(i % {W} AS INTEGER) AS x, CAST(i // {W} AS INTEGER) AS y FROM range({W * H}) r(i)) p, {kernel_sql(kernel)} WHERE p.x + dx BETWEEN 0 AND {W - 1} AND p.y + dy BETWEEN 0 AND {H - 1} GROUP BY ALL)"
    return f"{seen}, {inside}, {name} AS (SELECT {keys}x, y FROM {name}_n JOIN {name}_i USING (x, y, n))"


def morph_sql(steps: str, source: str, name: str, kernel: list[tuple[int, int]], key: str = "") -> str:
    """d and e of ``steps``: dilations and erosions, one after the other."""
    parts, at = [], source
    for i, step in enumerate(steps):
        to = name if i == len(steps) - 1 else f"{name}_{i}"
        parts.append((dilate_sql if step == "d" else erosion)(to, at, kernel, key))
        at = to
    return ", ".join(parts)


def components_sql(name: str, source: str, key: str = "") -> str:
    """The pixels with ``root``, the least place in scan order of their 8-connected component."""
    keys, same = (f"{key}, ", f"r.{key} = m.{key} AND ") if key else ("", "")
    r_keys = f"r.{key}, " if key else ""
    return f"""{name}_r AS (SELECT {keys}x, y, y * {W} + x AS root FROM {source} UNION SELECT {r_keys}m.x, m.y, r.root FROM {name}_r r JOIN {source} m ON {same}abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1),
    {name} AS (SELECT {keys}x, y, min(root) AS root FROM {name}_r GROUP BY ALL)"""


BG = f"{ad.FRAMES_SQL}, bg AS (SELECT x, y, quantile_cont(v, 0.5) AS v FROM frames GROUP BY x, y)"
SCALED = f"{ad.FRAMES_SQL}, sf AS (SELECT frame, x, y, v * 200 + 128 AS v FROM frames)"


def scaled(spark, d):
    return ad.frames(spark, d).withColumn("v", F.col("v") * 200 + 128)


@query("frame_statistics", f"WITH {BG} SELECT 'v0' AS video_id, frame, avg(f.v) - avg(bg.v) AS mean_shift, avg(CASE WHEN abs(f.v - bg.v) > 0.15 THEN 1.0 ELSE 0.0 END) AS foreground FROM frames f JOIN bg USING (x, y) GROUP BY frame")
def _(spark, d):
    f = ad.frames(spark, d)
    return pixels.frame_stats(f, pixels.background_median(f), 0.15)


@query("frames_rejected_whole", f"""WITH {BG}, s AS (SELECT frame, avg(f.v) - avg(bg.v) AS mean_shift, avg(CASE WHEN abs(f.v - bg.v) > 0.15 THEN 1.0 ELSE 0.0 END) AS foreground FROM frames f JOIN bg USING (x, y) GROUP BY frame)
  SELECT 'v0' AS video_id, frame FROM s WHERE abs(mean_shift) <= 0.015 AND foreground <= 0.23""")
def _(spark, d):
    f = ad.frames(spark, d)
    stats = pixels.frame_stats(f, pixels.background_median(f), 0.15)
    return filters.drop_frames(f.select("video_id", "frame").distinct(), stats, 0.015, 0.23)


@query("foreground_pixels", f"WITH {BG} SELECT 'v0' AS video_id, frame, x, y, abs(f.v - bg.v) AS v FROM frames f JOIN bg USING (x, y) WHERE abs(f.v - bg.v) > 0.25")
def _(spark, d):
    f = ad.frames(spark, d)
    return pixels.foreground(f, pixels.background_median(f), 0.25)


@query("otsu_thresholds", f"""WITH {SCALED}, h AS (SELECT frame, CAST(least(greatest(round_even(v, 0), 0), 255) AS INTEGER) AS level, count(*) AS n FROM sf GROUP BY ALL),
  c AS (SELECT frame, level, sum(n) OVER w AS low, sum(n) OVER (PARTITION BY frame) AS total, sum(n * level) OVER w AS ls, sum(n * level) OVER (PARTITION BY frame) AS ts FROM h WINDOW w AS (PARTITION BY frame ORDER BY level)),
  b AS (SELECT frame, level, (low / total) * (1 - low / total) * (ls / low - CASE WHEN total > low THEN (ts - ls) / (total - low) ELSE 0.0 END) * (ls / low - CASE WHEN total > low THEN (ts - ls) / (total - low) ELSE 0.0 END) AS between_ FROM c),
  t AS (SELECT frame, level FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY between_ DESC, level) AS rn FROM b) z WHERE rn = 1)
  SELECT 'v0' AS video_id, frame, CAST(least(greatest(level - 4, 1), 255) AS INTEGER) AS threshold FROM t""")
def _(spark, d):
    return pixels.otsu(scaled(spark, d), -4)


def gauss_weights(size: int) -> list[float]:
    sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return (k / k.sum()).tolist()


def blur_sql(source: str, name: str, size: int) -> str:
    """A separable blur, borders mirrored without their own pixel."""
    w = ", ".join(f"({i - size // 2}, {v!r})" for i, v in enumerate(gauss_weights(size)))
    axis = lambda to, at, c, o: f"{to} AS (SELECT p.frame, p.x, p.y, sum(p.w * f.v) AS v FROM (SELECT frame, x, y, w, {c} + d AS q FROM {at}, (VALUES {w}) g(d, w)) p JOIN {at} f ON f.frame = p.frame AND f.{o} = p.{o} AND f.{c} = CASE WHEN p.q < 0 THEN -p.q WHEN p.q > 7 THEN 14 - p.q ELSE p.q END GROUP BY ALL)"
    return f"{axis(name + '_y', source, 'y', 'x')}, {axis(name, name + '_y', 'x', 'y')}"


@query("gaussian_blur", f"WITH {ad.FRAMES_SQL}, {blur_sql('frames', 'g', 5)} SELECT 'v0' AS video_id, frame, x, y, v FROM g")
def _(spark, d):
    return pixels.per_image(ad.frames(spark, d), lambda image: pixels.gaussian(image, 5)).select("video_id", "frame", "x", "y", "v")


@query("median_blur", f"""WITH {ad.FRAMES_SQL} SELECT 'v0' AS video_id, p.frame, p.x, p.y, quantile_cont(f.v, 0.5) AS v FROM (SELECT frame, x, y, dx, dy FROM frames, {kernel_sql([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])}) p
  JOIN frames f ON f.frame = p.frame AND f.x = least(greatest(p.x + p.dx, 0), {W - 1}) AND f.y = least(greatest(p.y + p.dy, 0), {H - 1}) GROUP BY p.frame, p.x, p.y""")
def _(spark, d):
    return pixels.per_image(ad.frames(spark, d), lambda image: pixels.median_blur(image, 3)).select("video_id", "frame", "x", "y", "v")


@query("adaptive_threshold", f"""WITH {ad.FRAMES_SQL}, m AS (SELECT p.frame, p.x, p.y, min(p.v) AS v, avg(f.v) AS a FROM (SELECT frame, x, y, v, dx, dy FROM frames, {kernel_sql([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])}) p
  JOIN frames f ON f.frame = p.frame AND f.x = least(greatest(p.x + p.dx, 0), {W - 1}) AND f.y = least(greatest(p.y + p.dy, 0), {H - 1}) GROUP BY p.frame, p.x, p.y) SELECT 'v0' AS video_id, frame, x, y FROM m WHERE v > a - (-0.1)""")
def _(spark, d):
    on = pixels.per_image(ad.frames(spark, d), lambda image: pixels.adaptive_threshold(image, 3, -0.1))
    return on.where("v > 0").select("video_id", "frame", "x", "y")


CROSS = pixels.ellipse(3)


@query("binary_pipeline", f"""WITH {BG}, dv AS (SELECT frame, x, y, f.v - bg.v AS v FROM frames f JOIN bg USING (x, y)), {blur_sql('dv', 'g', 3)}, on0 AS (SELECT frame, x, y FROM g WHERE abs(v) > 0.07),
  {morph_sql('edde', 'on0', 'done', CROSS, 'frame')} SELECT 'v0' AS video_id, frame, x, y FROM done""")
def _(spark, d):
    f = ad.frames(spark, d)
    return pixels.binary_masks(f, pixels.background_median(f), 0.07, 3, 3, 3)


TOP = f"{HEAT}, m0 AS (SELECT x, y FROM heat WHERE energy >= (SELECT quantile_cont(energy, 0.6) FROM heat))"


def top(spark, d):
    return pixels.above_percentile(base.heat_of(spark, d), 60.0, positive=False)


@query("morphology", f"""WITH {TOP}, {dilate_sql('di', 'm0', CROSS)}, {erosion('er', 'm0', CROSS)}, {morph_sql('ed', 'm0', 'op', CROSS)}, {morph_sql('de', 'm0', 'cl', CROSS)}, {morph_sql('ddee', 'm0', 'cc', CROSS)}
  SELECT 'v0' AS video_id, s.step, s.x, s.y FROM (""" + " UNION ALL ".join(f"SELECT '{k}' AS step, x, y FROM {t}" for k, t in (("dilate", "di"), ("erode", "er"), ("open", "op"), ("close", "cl"), ("close twice", "cc"))) + ") s")
def _(spark, d):
    m, out = top(spark, d), None
    for step, px in (("dilate", pixels.dilate(m, CROSS, (W, H))), ("erode", pixels.erode(m, CROSS, (W, H))), ("open", pixels.opened(m, CROSS, (W, H))), ("close", pixels.closed(m, CROSS, (W, H))), ("close twice", pixels.closed(m, CROSS, (W, H), 2))):
        px = px.select("video_id", F.lit(step).alias("step"), "x", "y")
        out = px if out is None else out.unionByName(px)
    return out


@query("region_algebra", f"""WITH {HEAT}, a AS (SELECT x, y FROM heat WHERE energy >= (SELECT quantile_cont(energy, 0.5) FROM heat)), b AS (SELECT x, y FROM heat WHERE x < 5),
  s AS (SELECT 'and' AS mode, x, y FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i UNION ALL SELECT 'or', x, y FROM (SELECT * FROM a UNION SELECT * FROM b) u UNION ALL SELECT 'minus', x, y FROM (SELECT * FROM a EXCEPT SELECT * FROM b) e) SELECT 'v0' AS video_id, mode, x, y FROM s""")
def _(spark, d):
    heat = base.heat_of(spark, d)
    a, b, out = pixels.above_percentile(heat, 50.0, positive=False), heat.where("x < 5"), None
    for mode in ("and", "or", "minus"):
        px = regions.combine_regions(a, b, mode).select("video_id", F.lit(mode).alias("mode"), "x", "y")
        out = px if out is None else out.unionByName(px)
    return out


FORE = f"{BG}, m0 AS (SELECT frame, x, y FROM frames f JOIN bg USING (x, y) WHERE abs(f.v - bg.v) > 0.25)"


@query("foreground_components", f"WITH RECURSIVE {FORE}, {components_sql('c', 'm0', 'frame')} SELECT 'v0' AS video_id, frame, x, y, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS component FROM c")
def _(spark, d):
    f = ad.frames(spark, d)
    px = pixels.foreground(f, pixels.background_median(f), 0.25).select("video_id", "frame", "x", "y")
    return pixels.components(px, ["video_id", "frame"])


@query("foreground_blobs", f"""WITH RECURSIVE {FORE}, {components_sql('c', 'm0', 'frame')}, b AS (SELECT frame, root, min(x) AS bbox_x1, min(y) AS bbox_y1, max(x) + 1 AS bbox_x2, max(y) + 1 AS bbox_y2, CAST(count(*) AS DOUBLE) AS area FROM c GROUP BY ALL)
  SELECT 'v0' AS video_id, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS INTEGER) AS det_idx, (bbox_x1 + bbox_x2) / 2.0::DOUBLE AS x, (bbox_y1 + bbox_y2) / 2.0::DOUBLE AS y, bbox_x1, bbox_y1, bbox_x2, bbox_y2, area FROM b WHERE area >= 1""")
def _(spark, d):
    f = ad.frames(spark, d)
    return pixels.blobs(pixels.foreground(f, pixels.background_median(f), 0.25), 1)


LEVELS = f"{ad.FRAMES_SQL}, lv AS (SELECT frame, x, y, CAST(least(greatest(round_even(v * 200 + 128, 0), 0), 255) AS DOUBLE) AS v FROM frames), bg AS (SELECT x, y, floor(quantile_cont(v, 0.5)) AS v FROM lv GROUP BY x, y)"
CHAIN = settings.DEFAULTS["detection"] | {"blur_kernel": 0, "threshold_mode": "fixed", "diff_threshold": 24, "morph_open": 1, "morph_close": 3, "min_area": 0, "max_global_intensity_shift": 3.0, "max_foreground_ratio": 0.35, "roi_x_min": 1.0, "max_detections_per_frame": 4}


@query("detection_chain", f"""WITH RECURSIVE {LEVELS}, st AS (SELECT frame, abs(avg(l.v) - avg(bg.v)) AS shift FROM lv l JOIN bg USING (x, y) GROUP BY frame), m0 AS (SELECT frame, x, y FROM lv l JOIN bg USING (x, y) JOIN st USING (frame) WHERE abs(l.v - bg.v) > 24 AND shift <= 3.0),
  {morph_sql('de', 'm0', 'm1', CROSS, 'frame')}, mk AS (SELECT * FROM m1 WHERE frame IN (SELECT frame FROM m1 GROUP BY frame HAVING count(*) / 64.0 <= 0.35)), {components_sql('c', 'mk', 'frame')},
  b AS (SELECT frame, root, CAST(row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS INTEGER) AS det_idx, min(x) AS bbox_x1, min(y) AS bbox_y1, max(x) + 1 AS bbox_x2, max(y) + 1 AS bbox_y2 FROM c GROUP BY frame, root),
  k AS (SELECT *, (bbox_x1 + bbox_x2) / 2.0::DOUBLE AS x, (bbox_y1 + bbox_y2) / 2.0::DOUBLE AS y FROM b), f AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n FROM k WHERE x >= 1)
  SELECT 'v0' AS video_id, frame, det_idx, x, y, bbox_x1, bbox_y1, bbox_x2, bbox_y2 FROM f WHERE n <= 4""")
def _(spark, d):
    f = ad.frames(spark, d).withColumn("v", F.least(F.greatest(F.rint(F.col("v") * 200 + 128), F.lit(0.0)), F.lit(255.0)))
    return detection.detect(f, pixels.background_median(f, truncate=True), CHAIN, (W, H)).drop("area")


@query("valid_band", f"""WITH {BG}, p AS (SELECT x, avg(v) AS v FROM bg GROUP BY x), q AS (SELECT x, (sum(v) OVER w + CASE WHEN x = 0 THEN v ELSE 0 END + CASE WHEN x = 7 THEN v ELSE 0 END) / 3 AS s FROM p WINDOW w AS (ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  st AS (SELECT max(s) AS top, min(s) AS low FROM q), f AS (SELECT x, s >= 0.45 * top AS on_ FROM q, st), r AS (SELECT x, on_, x - row_number() OVER (PARTITION BY on_ ORDER BY x) AS g FROM f),
  sg AS (SELECT min(x) AS a, max(x) AS b, count(*) AS n FROM r WHERE on_ GROUP BY g), best AS (SELECT greatest(0, least(6, a + 1)) AS x0, greatest(1, least(7, b - 1)) AS x1 FROM sg ORDER BY n DESC, a LIMIT 1),
  z AS (SELECT coalesce(x0, -1) AS x0, coalesce(x1, -1) AS x1, top - low < 1e-6 OR (top - low) / greatest(1.0, abs(top)) < 0.08 OR x0 IS NULL OR x1 <= x0 OR x1 - x0 + 1 < 3 AS bad FROM st LEFT JOIN best ON true)
  SELECT 'v0' AS video_id, CAST(CASE WHEN bad THEN 1 ELSE x0 END AS INTEGER) AS x_start, CAST(CASE WHEN bad THEN 6 ELSE x1 END AS INTEGER) AS x_end FROM z""")
def _(spark, d):
    return pixels.valid_band(pixels.column_profile(pixels.background_median(ad.frames(spark, d))), 3, 0.45, 1, 0.35)


def sobel_sql(source: str, name: str) -> str:
    """Gradient length, borders mirrored without their own pixel."""
    w = [(-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)]
    fold = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"
    return f"""{name} AS (SELECT x, y, sqrt(sum(gx * v) * sum(gx * v) + sum(gy * v) * sum(gy * v)) AS g FROM (
      SELECT p.x, p.y, k.gx, k.gy, f.v FROM {source} p, (VALUES {', '.join(map(str, w))}) k(dx, dy, gx, gy), {source} f WHERE f.x = {fold('p.x + k.dx')} AND f.y = {fold('p.y + k.dy')}) z GROUP BY x, y)"""


@query("sobel_gradient", f"WITH {BG}, {sobel_sql('bg', 'gr')} SELECT 'v0' AS video_id, x, y, g AS v FROM gr")
def _(spark, d):
    return pixels.per_image(pixels.background_median(ad.frames(spark, d)).select("video_id", "x", "y", "v"), pixels.sobel, ("video_id",))


VEG = f"""{SCALED}, dv AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY x, y ORDER BY frame)) AS dv FROM sf), s AS (SELECT x, y, avg(dv) AS a, stddev_pop(v) AS sd, floor(quantile_cont(v, 0.5)) AS v FROM dv GROUP BY x, y),
  {sobel_sql('s', 'gr')}, u AS (SELECT s.x, s.y, a, sd, g FROM s JOIN gr USING (x, y)), m AS (SELECT min(a) AS a0, max(a) AS a1, min(sd) AS s0, max(sd) AS s1, min(g) AS g0, max(g) AS g1 FROM u),
  veg AS (SELECT x, y, 0.50 * (a - a0) / (a1 - a0 + 1e-6) + 0.35 * (sd - s0) / (s1 - s0 + 1e-6) + 0.15 * (g - g0) / (g1 - g0 + 1e-6) AS score FROM u, m)"""
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


@query("vegetation_scores", f"WITH {VEG} SELECT 'v0' AS video_id, x, y, score FROM veg")
def _(spark, d):
    return pixels.vegetation_score(scaled(spark, d))


@query("zone_exclusion", f"""WITH {BG}, v AS (SELECT x, y FROM bg WHERE v >= (SELECT quantile_cont(v, 0.3) FROM bg)), z AS (SELECT x, y FROM bg WHERE x BETWEEN 2 AND 5), {sobel_sql('bg', 'gr')},
  t AS (SELECT quantile_cont(g, 0.5) AS eg FROM gr), e AS (SELECT quantile_cont(v, 0.2) AS ev FROM bg), s AS (SELECT gr.x, gr.y FROM gr JOIN bg USING (x, y), t, e WHERE g >= greatest(0.01, eg) AND bg.v >= ev)
  SELECT 'v0' AS video_id, x, y FROM v WHERE NOT ((x, y) IN (SELECT (x, y) FROM z) AND (x, y) NOT IN (SELECT (x, y) FROM s))""")
def _(spark, d):
    bg = base.background_of(spark, d)
    veg = bg.join(bg.groupBy("video_id").agg(F.percentile("v", F.lit(0.3)).alias("e")), "video_id").where("v >= e")
    return layers.exclude_zone(veg.select("video_id", "x", "y"), bg.where("x between 2 and 5"), bg, texture_percent=50.0, intensity_percent=20.0, min_gradient=0.01)


# ---- zones, sources, corridors

ZONES = f"""{HEAT}, bgz AS (SELECT x, y, quantile_cont(v, 0.5) AS v FROM frames GROUP BY x, y), m0 AS (SELECT x, y FROM heat WHERE energy > 1e-6 AND energy >= (SELECT quantile_cont(energy, 0.6) FROM heat WHERE energy > 1e-6)),
  {morph_sql('ddeeed', 'm0', 'mz', pixels.ellipse(1))}, {components_sql('c', 'mz')},
  ev AS (SELECT c.x, c.y, c.root, CASE WHEN b.v <= (SELECT quantile_cont(v, 0.18) FROM bgz) THEN 1.0 ELSE 0.0 END AS dark, least(greatest(h.energy / greatest((SELECT quantile_cont(energy, 0.95) FROM heat WHERE energy > 1e-6), 1e-6), 0), 1) AS motion FROM c JOIN bgz b USING (x, y) JOIN heat h USING (x, y)),
  rw AS (SELECT root, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS area, avg(dark) AS dark_ratio, avg(motion) AS motion_density FROM ev GROUP BY root),
  sc AS (SELECT *, area / 64.0::DOUBLE AS area_ratio, 0.42 * motion_density + 0.34 * dark_ratio + 0.24 * (1 - least(1.0, abs(area / 64.0::DOUBLE - 0.04) / 0.12)) AS score FROM rw)"""


@query("zone_topk", f"WITH RECURSIVE {ZONES} SELECT 'v0' AS video_id, CAST(row_number() OVER (ORDER BY score DESC, root) AS INTEGER) AS zone_id, x1, y1, x2, y2, area, area_ratio, dark_ratio, motion_density, score FROM sc QUALIFY zone_id <= 3")
def _(spark, d):
    heat, bg = base.heat_of(spark, d), base.background_of(spark, d)
    mask = zones.candidate_zones(bg, heat, (W, H), method="motion", motion_percent=60.0, kernels=(1, 1))
    return zones.top_zones(zones.score_components(mask, bg, heat, (W, H))).drop("component")


@query("entry_zone_pixels", f"""WITH RECURSIVE {HEAT}, bgz AS (SELECT x, y, quantile_cont(v, 0.5) AS v FROM frames GROUP BY x, y), m0 AS (SELECT x, y FROM bgz WHERE v <= (SELECT quantile_cont(v, 0.3) FROM bgz)), {morph_sql('ddeeed', 'm0', 'mz', pixels.ellipse(1))}, {components_sql('c', 'mz')},
  ev AS (SELECT c.x, c.y, c.root, CASE WHEN b.v <= (SELECT quantile_cont(v, 0.18) FROM bgz) THEN 1.0 ELSE 0.0 END AS dark, least(greatest(h.energy / greatest((SELECT quantile_cont(energy, 0.95) FROM heat WHERE energy > 1e-6), 1e-6), 0), 1) AS motion FROM c JOIN bgz b USING (x, y) JOIN heat h USING (x, y)),
  sc AS (SELECT root, 0.42 * avg(motion) + 0.34 * avg(dark) + 0.24 * (1 - least(1.0, abs(count(*) / 64.0::DOUBLE - 0.04) / 0.12)) AS score FROM ev GROUP BY root), best AS (SELECT root FROM sc ORDER BY score DESC, root LIMIT 1), px AS (SELECT x, y FROM c JOIN best USING (root)),
  {dilate_sql('fin', 'px', pixels.ellipse(3))} SELECT 'v0' AS video_id, x, y FROM fin""")
def _(spark, d):
    heat, bg = base.heat_of(spark, d), base.background_of(spark, d)
    return zones.entry_zones(bg, heat, (W, H), 1, 1, method="dark", dark_percent=30.0, kernels=(1, 1))[1].select("video_id", "x", "y")


@query("source_scores", f"""WITH {HEAT}, {PTS}, bgz AS (SELECT x, y, quantile_cont(v, 0.5) AS v FROM frames GROUP BY x, y),
  mk AS (SELECT 'cave_zones' AS kind, x, y FROM heat WHERE energy > 1e-6 AND energy >= (SELECT quantile_cont(energy, 0.8) FROM heat WHERE energy > 1e-6) UNION ALL SELECT 'valid_region', x, y FROM bgz WHERE v <= (SELECT quantile_cont(v, 0.4) FROM bgz)),
  ev AS (SELECT m.kind, m.x, m.y, CASE WHEN b.v <= (SELECT quantile_cont(v, 0.18) FROM bgz) THEN 1.0 ELSE 0.0 END AS dark, least(greatest(h.energy / greatest((SELECT quantile_cont(energy, 0.95) FROM heat WHERE energy > 1e-6), 1e-6), 0), 1) AS motion FROM mk m JOIN bgz b USING (x, y) JOIN heat h USING (x, y)),
  ar AS (SELECT kind, count(*) AS area, avg(dark) AS dark_ratio, avg(motion) AS motion_support FROM ev GROUP BY kind), fl AS (SELECT k.kind, p.track_id, p.frame, h.x IS NOT NULL AS i,
    row_number() OVER (PARTITION BY k.kind, p.track_id ORDER BY p.frame) AS r, count(*) OVER (PARTITION BY k.kind, p.track_id) AS n FROM pts p CROSS JOIN (SELECT DISTINCT kind FROM mk) k LEFT JOIN mk h ON h.kind = k.kind AND h.x = round_even(p.x, 0) AND h.y = round_even(p.y, 0)),
  en AS (SELECT kind, avg(CASE WHEN s THEN 1.0 WHEN m THEN 0.5 ELSE 0.0 END) AS endpoint_support FROM (SELECT kind, track_id, bool_or(i AND (r = 1 OR r = n)) AS s, bool_or(i AND r > 1 AND r < n) AS m FROM fl GROUP BY ALL) z GROUP BY kind)
  SELECT 'v0' AS video_id, kind, area, dark_ratio, motion_support, 0.0::DOUBLE AS vegetation_overlap, endpoint_support, area / 64.0::DOUBLE AS area_ratio,
    0.25 * motion_support + 0.25 * dark_ratio + 0.30 * endpoint_support + 0.20 * (1 - least(1.0, abs(area / 64.0::DOUBLE - 0.04) / 0.18)) + CASE WHEN kind = 'valid_region' THEN -0.15 ELSE 0.0 END AS score FROM ar JOIN en USING (kind)""")
def _(spark, d):
    heat, bg = base.heat_of(spark, d), base.background_of(spark, d)
    masks = pixels.above_percentile(heat, 80.0).withColumn("kind", F.lit("cave_zones")).unionByName(pixels.below_percentile(bg, 40.0).withColumn("kind", F.lit("valid_region")))
    return zones.source_scores(masks, points(spark, d), bg, heat, (W, H))


@query("source_arbitration", SQL["source_scores"].replace("SELECT 'v0' AS video_id, kind, area,", "SELECT video_id, kind, score FROM (SELECT 'v0' AS video_id, kind, area,") + ") z ORDER BY score DESC, kind LIMIT 1")
def _(spark, d):
    return zones.choose_source(QUERIES["source_scores"](spark, d))


CORRIDOR = {"ax": 7.0, "ay": 7.0, "bx": 0.0, "by": 0.0}
_L = (49.0 + 49.0) ** 0.5


@query("corridor_path", f"""WITH {HEAT}, b AS (SELECT x, y, energy, (x - 7.0) * ({-7 / _L!r}) + (y - 7.0) * ({-7 / _L!r}) AS t, abs(-(x - 7.0) * ({-7 / _L!r}) + (y - 7.0) * ({-7 / _L!r})) AS u FROM heat WHERE energy > 0 AND energy >= (SELECT quantile_cont(energy, 0.2) FROM heat WHERE energy > 0)),
  m0 AS (SELECT x, y FROM b WHERE t BETWEEN -40 AND {_L + 80!r} AND u <= 8.0), {morph_sql('ed', 'm0', 'wm', CROSS)}, wb AS (SELECT b.*, CAST(floor((t + 20) / ({_L + 70!r} / 21)) AS INTEGER) AS bin FROM b JOIN wm USING (x, y)),
  mn AS (SELECT bin, count(*) AS n, sum(pow(energy, 1.35) * x) / sum(pow(energy, 1.35)) AS mx, sum(pow(energy, 1.35) * y) / sum(pow(energy, 1.35)) AS my FROM wb GROUP BY bin),
  ft AS (SELECT *, (mx - 7.0) * ({-7 / _L!r}) + (my - 7.0) * ({-7 / _L!r}) AS f FROM mn WHERE n >= 5 AND (SELECT count(*) FROM wb) >= 10),
  pt AS (SELECT bin, 0.75 * mx + 0.25 * (7.0 + ({-7 / _L!r}) * f) AS px, 0.75 * my + 0.25 * (7.0 + ({-7 / _L!r}) * f) AS py FROM ft),
  od AS (SELECT CAST(CASE WHEN (SELECT max_by(px + py, bin) - min_by(px + py, bin) FROM pt) > 0 THEN 20 - bin ELSE bin END AS INTEGER) AS bin, px, py FROM pt),
  sm AS (SELECT *, row_number() OVER (ORDER BY bin) AS i, count(*) OVER () AS n, avg(px) OVER w AS ax, avg(py) OVER w AS ay FROM od WINDOW w AS (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT 'v0' AS video_id, bin, CASE WHEN i = 1 OR i = n THEN px ELSE ax END AS x, CASE WHEN i = 1 OR i = n THEN py ELSE ay END AS y FROM sm WHERE n >= 2""")
def _(spark, d):
    return fe.corridor_path(base.heat_of(spark, d), (7.0, 7.0), (0.0, 0.0), 20.0, 8.0, 21)


# ---- sources

@query("sampled_frames", f"WITH {ad.FRAMES_SQL}, n AS (SELECT max(frame) + 1 AS n FROM frames), s AS (SELECT DISTINCT CAST(floor(i * (n - 1)::DOUBLE / 11) AS BIGINT) AS frame FROM n, range(12) r(i)) SELECT 'v0' AS video_id, f.frame, x, y, v FROM frames f JOIN s USING (frame)")
def _(spark, d):
    f = ad.frames(spark, d)
    return pixels.at_frames(f, pixels.sample_frames(f.agg(F.max("frame")).first()[0] + 1, 12))


@query("dense_frame_scan", f"WITH {SCALED} SELECT 'v0' AS video_id, frame, x, y, CAST(least(greatest(round_even(v, 0), 0), 255) AS DOUBLE) AS v FROM sf WHERE frame BETWEEN 10 AND 59")
def _(spark, d):
    byte = F.least(F.greatest(F.rint(F.col("v") * 200 + 128), F.lit(0)), F.lit(255)).cast("int")
    rows = ad.frames(spark, d).groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", F.lpad(F.hex(byte), 2, "0").alias("b")))).alias("p"))
    dense = rows.select("video_id", "frame", F.lit(H).alias("h"), F.lit(W).alias("w"), F.unhex(F.array_join(F.col("p.b"), "")).alias("pixels"))
    path = scratch.fresh_path(spark, "frames")
    dense.write.parquet(path)
    return readers.pixels_of(readers.frames(spark, path, (10, 60)))


@query("video_metadata", "SELECT 'v' || nationkey AS video_id, CASE WHEN nationkey % 3 = 0 THEN 25.0 ELSE nationkey::DOUBLE END AS fps, CAST(greatest(nationkey * 10 - 30, 0) AS INTEGER) AS frame_count, CAST(CASE WHEN nationkey % 4 = 0 THEN 0 ELSE 1024 END AS INTEGER) AS width, CAST(576 AS INTEGER) AS height FROM (SELECT n_nationkey AS nationkey FROM nation) n")
def _(spark, d):
    k = F.col("n_nationkey")
    path = scratch.fresh_path(spark, "videos")
    ad.table(spark, d, "nation").select(F.concat(F.lit("v"), k.cast("string")).alias("video_id"), F.when(k % 3 != 0, k.cast("double")).otherwise(-1.0 * k).alias("fps"), (k * 10 - 30).cast("int").alias("frame_count"), F.when(k % 4 != 0, F.lit(1024)).alias("width"), F.lit(576).alias("height")).write.parquet(path)
    return readers.videos(spark, path)


# ---- sinks, written and read again

@query("tracks_csv", f"WITH {PTS} SELECT video_id, track_id, frame, time_sec, x, y, area FROM pts")
def _(spark, d):
    path = scratch.fresh_path(spark, "tracks")
    p = points(spark, d).withColumns({c: F.lit(0).cast("int") for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")})
    sinks.export_tracks(p, path)
    return readers.tracks_csv(spark, path).select("video_id", "track_id", "frame", "time_sec", "x", "y", "area")


@query("events_csv", f"WITH {PTS}, {sql_summary()} SELECT video_id, track_id, frame_start, frame_end, num_detections, displacement_px, straightness FROM sm")
def _(spark, d):
    path = scratch.fresh_path(spark, "events")
    sinks.export_events(points(spark, d), path)
    return readers.events_csv(spark, path).select("video_id", "track_id", "frame_start", "frame_end", "num_detections", "displacement_px", "straightness")


@query("candidates_csv", f"WITH {ASSESS} SELECT video_id, track_id, score, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ';') END AS reject_reasons, len(reasons) = 0 AS accepted FROM ass")
def _(spark, d):
    path = scratch.fresh_path(spark, "candidates")
    sinks.export_assessments(base.assessed(spark, d), path)
    return readers.events_csv(spark, path).select("video_id", "track_id", "score", "reject_reasons", "accepted")


@query("dedup_decisions_csv", base.SQL["dedup_decisions"])
def _(spark, d):
    path = scratch.fresh_path(spark, "dedup")
    found = scratch.written(base.dup_overlaps(spark, d).select("video_id", "track_a", "track_b", "relation", "reason", "duplicate_score"), "pairs")
    decided = scratch.written(grouping.dedup_decisions(points(spark, d), found, "discard", base.MIN_DUP), "decisions")
    sinks.export_decisions(decided, found, f"{path}/csv", f"{path}/json")
    scratch.dropped(found, decided)
    kind = "video_id string, track_id_original long, track_id_final long, group_id long, decision string, score double, reason string, source_track_ids string, paired_track_ids string"
    return spark.read.schema(kind).option("header", True).csv(f"{path}/csv").select("video_id", "track_id_original", "track_id_final", "group_id", "decision", "score")


@query("zones_json", f"WITH RECURSIVE {ZONES} SELECT 'v0' AS video_id, CAST(row_number() OVER (ORDER BY score DESC, root) AS BIGINT) AS zone_id, CAST(area AS BIGINT) AS area, score FROM sc QUALIFY zone_id <= 3")
def _(spark, d):
    path = scratch.fresh_path(spark, "zones")
    found = QUERIES["zone_topk"](spark, d)
    sinks.export_zones(found, found.select("video_id", "zone_id"), path)
    return spark.read.schema("video_id string, zone_id long, area long, score double").json(f"{path}/zones")


@query("track_clips", f"""WITH {PTS}, {sql_summary()}, {ad.FRAMES_SQL}, c AS (SELECT video_id, track_id, greatest(frame_start - 2, 0) AS a, frame_end + 2 AS b FROM sm)
  SELECT c.video_id, c.track_id, count(*) AS pixels, sum(f.v) AS total FROM c JOIN frames f ON f.frame BETWEEN c.a AND c.b GROUP BY ALL""")
def _(spark, d):
    path = scratch.fresh_path(spark, "clips")
    f = ad.frames(spark, d)
    clips = pairs.clip_frames(points(spark, d), f.select("video_id", "frame").distinct(), 2)
    sinks.clip_table(f, clips, path)
    seen = spark.read.parquet(path).select("video_id", F.col("track_id").cast("long").alias("track_id"), F.explode("v").alias("v"))
    return seen.groupBy("video_id", "track_id").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


@query("run_document", base.SQL["run_metrics"])
def _(spark, d):
    path = scratch.fresh_path(spark, "meta")
    sinks.export_meta(path, {}, summary.run_metrics(points(spark, d)), {})
    kind = "metrics struct<video_id:string,points_total:bigint,tracks_total:bigint,track_length_min:bigint,track_length_max:bigint,track_length_mean:double>"
    return spark.read.schema(kind).json(path).select("metrics.*")


# ---- streams: the same rows as in a batch

def in_batches(spark, rows, order: str, n: int = 4):
    """The rows as a stream of n files in order."""
    path = scratch.fresh_path(spark, "stream")
    rows = scratch.written(rows, "streamed")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - low) * n / (high - low + 1))
    for i in range(n):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)
    scratch.dropped(rows)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def gathered(spark, stream, mode: str = "append"):
    """All that a stream gives, once it has read what there is: rows of its end are files; those of the
    other modes, which are as many as its state, are held by the driver."""
    name = f"s{uuid.uuid4().hex}"
    out = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", scratch.fresh_path(spark, "checkpoint")).trigger(availableNow=True)
    if mode != "append":
        out.format("memory").start().awaitTermination()
        return spark.table(name)
    path = scratch.fresh_path(spark, "gathered")
    sinks.make_folder(spark, path)
    out.format("parquet").start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("burst_gate_stream", base.SQL["burst_gate_frames"])
def _(spark, d):
    counts = points(spark, d).groupBy("video_id", "frame").agg(F.count("*").alias("n"))
    return gathered(spark, stateful.gate_stream(in_batches(spark, counts, "frame"), *base.GATE))


@query("detection_counts_stream", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    e = ad.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = gathered(spark, stateful.counts_stream(in_batches(spark, e, "at"), "10 minutes", "1 day"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("motion_heat_stream", base.SQL["motion_heatmap"])
def _(spark, d):
    energy = gathered(spark, stateful.motion_heat_stream(in_batches(spark, ad.frames(spark, d), "frame"), 0.05), "update")
    return energy.groupBy("video_id", "x", "y").agg(F.max_by("energy", "frame").alias("energy"))


@query("trail_coherent_stream", base.SQL["trail_coherent_points"])
def _(spark, d):
    p = points(spark, d).select("video_id", "track_id", "frame", "x", "y")
    return gathered(spark, stateful.trail_stream(in_batches(spark, p, "frame"), max_gap=12, idle_ms=None))

