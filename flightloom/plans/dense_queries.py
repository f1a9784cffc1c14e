"""Named queries on dense frames of two videos of different length, and on video and
image files written from them, with the SQL of an independent engine on pixel rows."""

from __future__ import annotations

import struct
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from flightloom.operators import dense, layers, pixels, zones
from flightloom.plans.image_queries import gathered, gauss_weights, in_batches, kernel_sql
from flightloom.sources import adapters as ad
from flightloom.sources import config as settings
from flightloom.sources import readers, scratch, video_files
from flightloom.streaming import stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}
S = ad.SIDE
CROSS = pixels.ellipse(3)
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- SQL of images: tables of (key, x, y) or (key, x, y, v), key being video_id or video_id and frame

def dilated(name: str, source: str, kernel: list, key: str, w: int = S, h: int = S) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM {source}, {kernel_sql(kernel)}
    WHERE x + dx BETWEEN 0 AND {w - 1} AND y + dy BETWEEN 0 AND {h - 1})"""


def eroded(name: str, source: str, kernel: list, key: str, w: int = S, h: int = S) -> str:
    """Neighbours that are there, against those that lie in the image."""
    return f"""{name}_n AS (SELECT {key}, CAST(x - dx AS INTEGER) AS x, CAST(y - dy AS INTEGER) AS y, count(*) AS n FROM {source}, {kernel_sql(kernel)} GROUP BY ALL),
  {name}_i AS (SELECT p.x, p.y, count(*) AS n FROM (SELECT CAST(i % {w} AS INTEGER) AS x, CAST(i // {w} AS INTEGER) AS y FROM range({w * h}) r(i)) p, {kernel_sql(kernel)}
    WHERE p.x + dx BETWEEN 0 AND {w - 1} AND p.y + dy BETWEEN 0 AND {h - 1} GROUP BY ALL),
  {name} AS (SELECT {key}, x, y FROM {name}_n JOIN {name}_i USING (x, y, n))"""


def steps(name: str, source: str, todo: str, kernel: list, key: str, w: int = S, h: int = S) -> str:
    """d and e of ``todo``: dilations and erosions, one after the other."""
    parts, at = [], source
    for i, step in enumerate(todo):
        to = name if i == len(todo) - 1 else f"{name}_{i}"
        parts.append((dilated if step == "d" else eroded)(to, at, kernel, key, w, h))
        at = to
    return ", ".join(parts)


def components(name: str, source: str, key: str, w: int = S) -> str:
    """The pixels with root, the least place in scan order of their 8-connected component."""
    same = " AND ".join(f"r.{k} = m.{k}" for k in key.split(", "))
    keys = ", ".join(f"m.{k}" for k in key.split(", "))
    return f"""{name}_r AS (SELECT {key}, x, y, y * {w} + x AS root FROM {source}
    UNION SELECT {keys}, m.x, m.y, r.root FROM {name}_r r JOIN {source} m ON {same} AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1),
  {name} AS (SELECT {key}, x, y, min(root) AS root FROM {name}_r GROUP BY ALL)"""


def blurred(name: str, source: str, size: int, key: str, w: int = S, h: int = S) -> str:
    """A separable blur to whole levels, borders mirrored without their own pixel."""
    weights = ", ".join(f"({i - size // 2}, {v!r})" for i, v in enumerate(gauss_weights(size)))

    def axis(to: str, at: str, c: str, other: str, most: int) -> str:
        same = " AND ".join(f"f.{k} = p.{k}" for k in (*key.split(", "), other))
        keys = ", ".join(f"p.{k}" for k in key.split(", "))
        return f"""{to} AS (SELECT {keys}, p.x, p.y, sum(p.g * f.v) AS v FROM (SELECT {key}, x, y, g, {c} + d AS q FROM {at}, (VALUES {weights}) k(d, g)) p
    JOIN {at} f ON {same} AND f.{c} = CASE WHEN p.q < 0 THEN -p.q WHEN p.q > {most} THEN {2 * most} - p.q ELSE p.q END GROUP BY {keys}, p.x, p.y)"""

    return f"{axis(name + '_y', source, 'y', 'x', h - 1)}, {axis(name + '_x', name + '_y', 'x', 'y', w - 1)}, {name} AS (SELECT {key}, x, y, round_even(v, 0) AS v FROM {name}_x)"


def gradient(name: str, source: str) -> str:
    """Sobel's gradient length of each video's image."""
    w = [(-1, -1, -1, -1), (0, -1, 0, -2), (1, -1, 1, -1), (-1, 0, -2, 0), (1, 0, 2, 0), (-1, 1, -1, 1), (0, 1, 0, 2), (1, 1, 1, 1)]
    fold = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > {S - 1} THEN {2 * S - 2} - ({e}) ELSE {e} END"
    return f"""{name} AS (SELECT video_id, x, y, sqrt(sum(gx * v) * sum(gx * v) + sum(gy * v) * sum(gy * v)) AS g FROM (
    SELECT p.video_id, p.x, p.y, k.gx, k.gy, f.v FROM {source} p, (VALUES {', '.join(map(str, w))}) k(dx, dy, gx, gy), {source} f
    WHERE f.video_id = p.video_id AND f.x = {fold('p.x + k.dx')} AND f.y = {fold('p.y + k.dy')}) z GROUP BY ALL)"""


COUNTS = "cn AS (SELECT video_id, max(frame) + 1 AS n FROM lv GROUP BY video_id)"
#: Of each video 7 frames of the 12 s after the first 0.08 s, at 25 frames a second.
SAMPLES, START, LENGTH, FPS = 7, 0.08, 12.0, 25.0
BACK = f"""{ad.DENSE_SQL}, {COUNTS}, cx AS (SELECT video_id, least({round(START * FPS)}, n - 1) AS a, least(n, least({round(START * FPS)}, n - 1) + {round(LENGTH * FPS)}) AS z FROM cn),
  sn AS (SELECT DISTINCT video_id, CAST(CASE WHEN least({SAMPLES}, z - a) > 1 THEN floor(a + i * (z - a - 1)::DOUBLE / (least({SAMPLES}, z - a) - 1)) ELSE a + i END AS BIGINT) AS frame
    FROM cx, range({SAMPLES}) r(i) WHERE i < least({SAMPLES}, z - a)),
  bg AS (SELECT video_id, x, y, floor(quantile_cont(v, 0.5)) AS v FROM lv JOIN sn USING (video_id, frame) GROUP BY ALL)"""


def backgrounds(frames):
    numbers = dense.sample_numbers(dense.context(dense.frame_counts(frames), FPS, START, LENGTH), SAMPLES)
    return scratch.written(dense.background(dense.at(frames, numbers), tile=300))


def written_frames(spark, d):
    return scratch.written(ad.dense_frames(spark, d), "frames")


# ---- files

@query("video_file_frames", f"WITH {ad.DENSE_SQL} SELECT video_id, frame, {S} AS h, {S} AS w, sum(v) AS total, sum(v * (y * {S} + x)) AS placed FROM lv WHERE frame BETWEEN 3 AND 8 GROUP BY ALL")
def _(spark, d):
    """Frames of files, of a range of frames only, by their sums and sums weighted by place."""
    path = scratch.fresh_path(spark, "video_files")
    video_files.write_y4m(ad.dense_frames(spark, d), path, segment=4).write.format("noop").mode("overwrite").save()
    px = dense.to_pixels(video_files.frames(spark, path, 4000).where(F.col("frame").between(3, 8)))
    return px.groupBy("video_id", "frame").agg(F.lit(S).alias("h"), F.lit(S).alias("w"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("y") * S + F.col("x"))).alias("placed"))


@query("video_file_metadata", f"WITH {ad.DENSE_SQL} SELECT video_id, 25.0::DOUBLE AS fps, CAST(max(frame) + 1 AS INTEGER) AS frame_count, {S} AS width, {S} AS height FROM lv GROUP BY video_id")
def _(spark, d):
    path = scratch.fresh_path(spark, "video_files")
    video_files.write_y4m(ad.dense_frames(spark, d), path, segment=4).write.format("noop").mode("overwrite").save()
    return video_files.videos(spark, path)


def bitmap(rows: list[list[tuple[int, int, int]]]) -> bytes:
    """A 24-bit bitmap file of rows of (b, g, r)."""
    w, h = len(rows[0]), len(rows)
    data = b"".join(b"".join(bytes(p) for p in row) + b"\0" * (-3 * w % 4) for row in reversed(rows))
    return struct.pack("<2sIHHI", b"BM", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


def image_file(spark, d, name: str, colour) -> str:
    """A bitmap of what a function makes of the levels of frame 0 of both videos, in the shared folder."""
    first = {r.video_id: np.frombuffer(r.pixels, np.uint8).reshape(S, S).tolist() for r in ad.dense_frames(spark, d).where("frame = 0").collect()}  # two images
    path = f"{scratch.fresh_path(spark, 'images')}/{name}.bmp"
    system, place = video_files.file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(bitmap([[colour(first["a"][y][x], first["b"][y][x]) for x in range(S)] for y in range(S)]))
    return path


IMAGE = f"{ad.DENSE_SQL}, im AS (SELECT 'v0' AS video_id, a.x, a.y, CAST(a.v AS INTEGER) AS a, CAST(b.v AS INTEGER) AS b FROM lv a JOIN lv b USING (x, y) WHERE a.video_id = 'a' AND b.video_id = 'b' AND a.frame = 0 AND b.frame = 0)"


@query("image_scan", f"WITH {IMAGE} SELECT video_id, x, y, a AS b, b AS g, (a + b) // 2 AS r FROM im")
def _(spark, d):
    return readers.image_pixels(spark, image_file(spark, d, "scan", lambda a, b: (a, b, (a + b) // 2)))


@query("marked_region", f"WITH {IMAGE}, m AS (SELECT video_id, x, y FROM im WHERE a > 150), {dilated('di', 'm', CROSS, 'video_id')} SELECT video_id, x, y FROM di")
def _(spark, d):
    path = image_file(spark, d, "mask", lambda a, b: (255,) * 3 if a > 150 else (0,) * 3)
    return readers.marked_region(spark, path, size=(S, S), dilate_px=1)


@query("annotation_region", f"WITH {IMAGE}, m AS (SELECT video_id, x, y FROM im WHERE a > 160 AND b > 130), {steps('cl', 'm', 'ddeeed', pixels.ellipse(5), 'video_id')} SELECT video_id, x, y FROM cl")
def _(spark, d):
    path = image_file(spark, d, "marks", lambda a, b: (10, 10, 240) if a > 160 and b > 130 else (200, 180, 20))
    return readers.marked_region(spark, annotation_path=path, size=(S, S))


# ---- along time

@query("dense_backgrounds", f"WITH {BACK} SELECT video_id, x, y, v FROM bg")
def _(spark, d):
    return dense.to_pixels(backgrounds(written_frames(spark, d)))


HEAT = f"""{blurred('bl', 'lv', 3, 'video_id, frame')}, ch AS (SELECT video_id, frame, x, y, abs(v - lag(v) OVER (PARTITION BY video_id, x, y ORDER BY frame)) AS v FROM bl),
  h0 AS (SELECT video_id, frame, x, y FROM ch WHERE v > 14), {steps('ho', 'h0', 'ed', CROSS, 'video_id, frame')},
  heat AS (SELECT video_id, x, y, coalesce(sum(v) FILTER (o.x IS NOT NULL), 0.0) AS energy FROM ch LEFT JOIN (SELECT *, x AS ox FROM ho) o USING (video_id, frame, x, y) GROUP BY video_id, x, y)""".replace("o.x IS NOT NULL", "o.ox IS NOT NULL")


@query("dense_motion_heat", f"WITH {ad.DENSE_SQL}, {HEAT} SELECT video_id, x, y, energy FROM heat")
def _(spark, d):
    return dense.to_pixels(dense.motion_energy(written_frames(spark, d), 14.0, 3, 3, chunk=4, tile=300), "energy", "f8", "energy")


VEGETATION = f"""{ad.DENSE_SQL}, {COUNTS}, {blurred('lb', 'lv', 9, 'video_id, frame')}, sn AS (SELECT video_id, i, CAST(floor(i * least(n - 1, 1250)::DOUBLE / 219) AS BIGINT) AS frame FROM cn, range(220) r(i)),
  sv AS (SELECT video_id, i, x, y, v, abs(v - lag(v) OVER (PARTITION BY video_id, x, y ORDER BY i)) AS dv FROM lb JOIN sn USING (video_id, frame)),
  s AS (SELECT video_id, x, y, avg(dv) AS a, stddev_pop(v) AS sd, floor(quantile_cont(v, 0.5)) AS v FROM sv GROUP BY video_id, x, y), {gradient('gr', 's')},
  u AS (SELECT video_id, x, y, a, sd, g FROM s JOIN gr USING (video_id, x, y)),
  m AS (SELECT video_id, min(a) AS a0, max(a) AS a1, min(sd) AS s0, max(sd) AS s1, min(g) AS g0, max(g) AS g1 FROM u GROUP BY video_id),
  sc AS (SELECT video_id, x, y, 0.50 * (a - a0) / (a1 - a0 + 1e-6) + 0.35 * (sd - s0) / (s1 - s0 + 1e-6) + 0.15 * (g - g0) / (g1 - g0 + 1e-6) AS score FROM u JOIN m USING (video_id))"""


@query("dense_vegetation_scores", f"WITH {VEGETATION} SELECT video_id, x, y, score FROM sc")
def _(spark, d):
    f = scratch.written(dense.blurred(ad.dense_frames(spark, d), 9))
    return dense.to_pixels(dense.vegetation_scores(dense.vegetation_samples(f, dense.frame_counts(f)), tile=300), "score", "f8", "score")


@query("dense_vegetation_mask", f"""WITH RECURSIVE {VEGETATION}, p0 AS (SELECT video_id, x, y FROM sc JOIN (SELECT video_id, quantile_cont(score, 0.5) AS e FROM sc GROUP BY video_id) t USING (video_id) WHERE score >= e),
  {steps('po', 'p0', 'ed', SQUARE, 'video_id')}, px AS (SELECT CAST(i % {S} AS INTEGER) AS x, CAST(i // {S} AS INTEGER) AS y FROM range({S * S}) r(i)),
  pm AS (SELECT v.video_id, p.x, p.y FROM (SELECT DISTINCT video_id FROM po) v, (SELECT x, y, dx, dy FROM px, {kernel_sql(SQUARE)}) p
    JOIN po ON po.video_id = v.video_id AND po.x = least(greatest(p.x + p.dx, 0), {S - 1}) AND po.y = least(greatest(p.y + p.dy, 0), {S - 1}) GROUP BY v.video_id, p.x, p.y HAVING count(*) >= 5),
  {components('pc', 'pm', 'video_id')}, pb AS (SELECT video_id, x, y FROM pc WHERE (video_id, root) IN (SELECT (video_id, root) FROM pc GROUP BY video_id, root HAVING count(*) >= 24)),
  {eroded('pe', 'pb', SQUARE, 'video_id')} SELECT video_id, x, y FROM pe""")
def _(spark, d):
    f = scratch.written(dense.blurred(ad.dense_frames(spark, d), 9))
    return dense.vegetation_mask(dense.vegetation_samples(f, dense.frame_counts(f)), 50.0, 24)


@query("motion_heat_tiles_stream", f"WITH {ad.DENSE_SQL}, ch AS (SELECT video_id, x, y, abs(v - lag(v) OVER (PARTITION BY video_id, x, y ORDER BY frame)) AS d FROM lv) SELECT video_id, x, y, coalesce(sum(d) FILTER (d > 14), 0.0) AS energy FROM ch GROUP BY ALL")
def _(spark, d):
    """The heat that a stream of dense frames has at its end, by the states of its tiles."""
    tiles = gathered(spark, stateful.motion_heat_tile_stream(in_batches(spark, ad.dense_frames(spark, d), "frame"), 14.0, 300), "update")
    return dense.to_pixels(stateful.whole_heat(tiles), "energy", "f8", "energy")


# ---- a frame beside its background

@query("dense_frame_statistics", f"WITH {BACK} SELECT video_id, frame, avg(l.v) - avg(bg.v) AS mean_shift, avg(CASE WHEN abs(l.v - bg.v) > 24 THEN 1.0 ELSE 0.0 END) AS foreground FROM lv l JOIN bg USING (video_id, x, y) GROUP BY ALL")
def _(spark, d):
    f = written_frames(spark, d)
    return dense.frame_stats(f, backgrounds(f), 24.0)


@query("dense_otsu_thresholds", f"""WITH {ad.DENSE_SQL}, h AS (SELECT video_id, frame, CAST(v AS INTEGER) AS level, count(*) AS n FROM lv GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER w AS low, sum(n) OVER k AS total, sum(n * level) OVER w AS ls, sum(n * level) OVER k AS ts FROM h
    WINDOW w AS (PARTITION BY video_id, frame ORDER BY level), k AS (PARTITION BY video_id, frame)),
  b AS (SELECT video_id, frame, level, (low / total) * (1 - low / total) * pow(ls / low - CASE WHEN total > low THEN (ts - ls) / (total - low) ELSE 0.0 END, 2) AS between_ FROM c)
  SELECT video_id, frame, CAST(least(greatest(arg_max(level, between_) - 4, 1), 255) AS INTEGER) AS threshold FROM b GROUP BY video_id, frame""")
def _(spark, d):
    return dense.otsu(written_frames(spark, d), -4)


@query("dense_blur", f"WITH {ad.DENSE_SQL}, {blurred('g', 'lv', 5, 'video_id, frame')} SELECT video_id, frame, x, y, v FROM g")
def _(spark, d):
    return dense.to_pixels(dense.blurred(written_frames(spark, d), 5))


CHAIN = settings.DEFAULTS["detection"] | {
    "blur_kernel": 3, "threshold_mode": "fixed", "diff_threshold": 18, "morph_open": 3, "morph_close": 3, "min_area": 0, "max_global_intensity_shift": 4.0, "max_foreground_ratio": 0.5,
    "roi_x_min": 20.0, "max_detections_per_frame": 60,
}
#: The window that is worked on begins 16 pixels before the region of interest.
LEFT = 4
MASKS = f"""{BACK}, fw AS (SELECT video_id, frame, x - {LEFT} AS x, y, v FROM lv WHERE x >= {LEFT}), bw AS (SELECT video_id, x - {LEFT} AS x, y, v FROM bg WHERE x >= {LEFT}),
  st AS (SELECT video_id, frame FROM fw f JOIN bw b USING (video_id, x, y) GROUP BY ALL HAVING abs(avg(f.v) - avg(b.v)) <= 4.0),
  {blurred('fb', 'fw', 3, 'video_id, frame', S - LEFT)}, {blurred('bb', 'bw', 3, 'video_id', S - LEFT)},
  m0 AS (SELECT f.video_id, f.frame, f.x, f.y FROM fb f JOIN st USING (video_id, frame) JOIN bb b ON b.video_id = f.video_id AND b.x = f.x AND b.y = f.y WHERE abs(f.v - b.v) > 18),
  {steps('mo', 'm0', 'edde', CROSS, 'video_id, frame', S - LEFT)}"""


@query("dense_detections", f"""WITH RECURSIVE {MASKS}, mk AS (SELECT * FROM mo WHERE (video_id, frame) IN (SELECT (video_id, frame) FROM mo GROUP BY video_id, frame HAVING count(*) <= 0.5 * {(S - LEFT) * S})),
  {components('c', 'mk', 'video_id, frame', S - LEFT)},
  b AS (SELECT video_id, frame, CAST(row_number() OVER (PARTITION BY video_id, frame ORDER BY root) - 1 AS INTEGER) AS det_idx, CAST(min(x) + {LEFT} AS INTEGER) AS bbox_x1, CAST(min(y) AS INTEGER) AS bbox_y1,
    CAST(max(x) + {LEFT + 1} AS INTEGER) AS bbox_x2, CAST(max(y) + 1 AS INTEGER) AS bbox_y2 FROM c GROUP BY video_id, frame, root),
  k AS (SELECT *, (bbox_x1 + bbox_x2) / 2.0::DOUBLE AS x, (bbox_y1 + bbox_y2) / 2.0::DOUBLE AS y FROM b), f AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame) AS n FROM k WHERE x >= 20)
  SELECT video_id, frame, det_idx, x, y, bbox_x1, bbox_y1, bbox_x2, bbox_y2 FROM f WHERE n <= 60""")
def _(spark, d):
    f = written_frames(spark, d)
    return dense.detect(f, backgrounds(f), CHAIN).drop("area")


# ---- zones and regions with the kernels of real images

CONNECT = 2
ZONES = f"""{BACK}, {HEAT}, me AS (SELECT video_id, quantile_cont(energy, 0.80) AS e, quantile_cont(energy, 0.95) AS top FROM heat WHERE energy > 1e-6 GROUP BY video_id),
  de AS (SELECT video_id, quantile_cont(v, 0.40) AS e, quantile_cont(v, 0.18) AS dark FROM bg GROUP BY video_id),
  z0 AS (SELECT video_id, x, y FROM heat JOIN me USING (video_id) WHERE energy > 1e-6 AND energy >= e), d0 AS (SELECT video_id, x, y FROM bg JOIN de USING (video_id) WHERE v <= e),
  {steps('zm', 'z0', 'ddeeed', pixels.ellipse(zones.MOTION_KERNEL), 'video_id')}, {steps('zd', 'd0', 'ddeeed', pixels.ellipse(zones.DARK_KERNEL), 'video_id')},
  {dilated('zn', 'zm', pixels.ellipse(2 * CONNECT + 1), 'video_id')},
  zh AS (SELECT video_id, x, y FROM zd INTERSECT SELECT video_id, x, y FROM zn UNION ALL SELECT video_id, x, y FROM zd WHERE video_id NOT IN (SELECT video_id FROM zm)),
  cand AS (SELECT 'motion_heatmap' AS source, video_id, x, y FROM zm UNION ALL SELECT 'dark_regions', video_id, x, y FROM zh)"""


@query("dense_zone_candidates", f"WITH {ZONES} SELECT source, video_id, x, y FROM cand")
def _(spark, d):
    out = None
    for source, mask in candidate_sources(spark, d)[0].items():
        mask = mask.select(F.lit(source).alias("source"), *pixels.PX)
        out = mask if out is None else out.unionByName(mask)
    return out


def candidate_sources(spark, d):
    f = written_frames(spark, d)
    background = scratch.written(dense.to_pixels(backgrounds(f)))
    heat = scratch.written(dense.to_pixels(dense.motion_energy(f, 14.0, 3, 3), "energy", "f8", "energy"))
    return zones.candidate_masks(background, heat, (S, S), motion_percent=80.0, dark_percent=40.0, connect=CONNECT), background, heat


@query("dense_entry_zones", f"""WITH RECURSIVE {ZONES}, {components('zc', 'cand', 'source, video_id')},
  ev AS (SELECT c.source, c.video_id, c.x, c.y, c.root, CASE WHEN b.v <= de.dark THEN 1.0 ELSE 0.0 END AS dark, least(greatest(h.energy / greatest(coalesce(me.top, 1.0), 1e-6), 0), 1) AS motion
    FROM zc c JOIN bg b USING (video_id, x, y) JOIN heat h USING (video_id, x, y) JOIN de USING (video_id) LEFT JOIN me USING (video_id)),
  rw AS (SELECT source, video_id, root, avg(dark) AS dark, avg(motion) AS motion, count(*) / {S * S}.0::DOUBLE AS ratio FROM ev GROUP BY ALL HAVING count(*) >= greatest(1, round_even(0.002 * {S * S}, 0))),
  sc AS (SELECT *, 0.42 * motion + 0.34 * dark + 0.24 * (1 - least(1.0, abs(ratio - 0.04) / 0.12)) AS score FROM rw),
  best AS (SELECT source, video_id, root FROM sc QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, source, root) <= 2),
  fp AS (SELECT DISTINCT video_id, x, y FROM zc JOIN best USING (source, video_id, root)), {dilated('fin', 'fp', pixels.ellipse(3), 'video_id')} SELECT video_id, x, y FROM fin""")
def _(spark, d):
    _, background, heat = candidate_sources(spark, d)
    return zones.entry_zones(background, heat, (S, S), 2, 1, motion_percent=80.0, dark_percent=40.0, connect=CONNECT)[1].select("video_id", "x", "y")


BLUR, KERNEL, DEEP = 5, 3, 60.0
REGIONS = f"""{BACK}, {blurred('il', 'bg', BLUR, 'video_id')}, pf AS (SELECT video_id, x, avg(v) AS v FROM il GROUP BY video_id, x),
  q AS (SELECT video_id, x, (sum(v) OVER w + CASE WHEN x = 0 THEN v ELSE 0 END + CASE WHEN x = {S - 1} THEN v ELSE 0 END) / 3 AS s FROM pf WINDOW w AS (PARTITION BY video_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  st AS (SELECT video_id, max(s) AS top, min(s) AS low FROM q GROUP BY video_id), f AS (SELECT video_id, x, s >= 0.99 * top AS on_ FROM q JOIN st USING (video_id)),
  r AS (SELECT video_id, x, x - row_number() OVER (PARTITION BY video_id, on_ ORDER BY x) AS g FROM f WHERE on_), sg AS (SELECT video_id, min(x) AS a, max(x) AS b, count(*) AS n FROM r GROUP BY video_id, g),
  bs AS (SELECT video_id, greatest(0, least({S - 2}, a)) AS x0, greatest(1, least({S - 1}, b)) AS x1 FROM sg QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, a) = 1),
  bd AS (SELECT st.video_id, CASE WHEN bad THEN {(S - round(S * 0.7)) // 2} ELSE x0 END AS x0, CASE WHEN bad THEN {(S - round(S * 0.7)) // 2 + round(S * 0.7) - 1} ELSE x1 END AS x1 FROM st JOIN (
    SELECT video_id, x0, x1, top - low < 1e-6 OR (top - low) / greatest(1.0, abs(top)) < 0.08 OR x0 IS NULL OR x1 <= x0 OR x1 - x0 + 1 < {round(S * 0.1)} AS bad FROM st LEFT JOIN bs USING (video_id)) z USING (video_id)),
  band AS (SELECT video_id, x, y FROM il JOIN bd USING (video_id) WHERE x BETWEEN x0 AND x1),
  dp AS (SELECT video_id, x, y FROM il JOIN (SELECT video_id, quantile_cont(255 - v, {DEEP / 100}) AS e FROM il GROUP BY video_id) t USING (video_id) WHERE 255 - v >= e),
  src AS (SELECT 'deep' AS kind, video_id, x, y FROM dp UNION ALL SELECT 'within', dp.video_id, x, y FROM dp JOIN band USING (video_id, x, y)),
  {steps('mm', 'src', 'edde', pixels.ellipse(KERNEL), 'kind, video_id')}, {components('lc', 'mm', 'kind, video_id')},
  ar AS (SELECT kind, video_id, root, count(*) AS area, min(x) AS a, max(x) + 1 AS b, bool_or(x = {S // 2} AND y = {S // 2}) AS mid FROM lc GROUP BY ALL),
  pk AS (SELECT kind, video_id, root FROM ar QUALIFY row_number() OVER (PARTITION BY kind, video_id ORDER BY CASE WHEN mid AND area >= {int(0.02 * S * S)} THEN 0 WHEN area >= {int(0.02 * S * S)} THEN 1 ELSE 2 END,
    CASE WHEN area >= {int(0.02 * S * S)} THEN abs((a + b) / 2.0 - {S // 2}) ELSE -area END, root) = 1),
  lay AS (SELECT kind, video_id, x, y FROM lc JOIN pk USING (kind, video_id, root)),
  both_ AS (SELECT l.video_id, l.x, l.y FROM lay l JOIN band b USING (video_id, x, y) WHERE kind = 'within'),
  reg AS (SELECT 'horizontal_illumination_profile' AS method, video_id, x, y FROM band UNION ALL SELECT 'central_deep_layer', video_id, x, y FROM lay WHERE kind = 'deep'
    UNION ALL SELECT 'hybrid_deep_layer_profile', video_id, x, y FROM both_
    UNION ALL SELECT 'hybrid_deep_layer_profile', video_id, x, y FROM band WHERE video_id NOT IN (SELECT video_id FROM both_))"""


@query("dense_valid_regions", f"WITH RECURSIVE {REGIONS} SELECT method, video_id, x, y FROM reg")
def _(spark, d):
    images, out = backgrounds(written_frames(spark, d)), None
    band = scratch.written(pixels.valid_band(dense.column_profile(images, BLUR), 3, 0.99, 0, 0.1))
    for method in ("horizontal_illumination_profile", "central_deep_layer", "hybrid_deep_layer_profile"):
        kernel = partial(layers.region_mask, method=method, cfg=layers.Layers(BLUR, DEEP, KERNEL, 0.02))
        px = dense.region_masks(images, band, kernel).select(F.lit(method).alias("method"), "video_id", "x", "y")
        out = px if out is None else out.unionByName(px)
    return out
