"""One named query for each further operator, with the SQL of an independent
engine: scalar expressions, filters, pairs, events, merges and rescues."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.functions import expressions as ex
from flightloom.operators import fast_events as fe
from flightloom.operators import filters, grouping, layers, pairs, regions, summary, tracking, windows
from flightloom.plans import catalog as base
from flightloom.plans.catalog import ASSESS, ENDS, FAST_WHERE, FRAG_EDGES, FRAG_PTS, MET, PTS, RULES, SIZE, cosine_sql, fragments, points, sql_summary
from flightloom.sources import adapters as ad
from flightloom.sources import scratch, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}
OWN = ["video_id", "track_id"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


DET = f"""{ad.RAW_SQL}, det AS (
  SELECT video_id, frame, CAST(row_number() OVER (PARTITION BY video_id, frame ORDER BY seq) - 1 AS INTEGER) AS det_idx, x, y, area,
         CAST(round_even(x, 0) - 3 AS INTEGER) AS x1, CAST(round_even(y, 0) - 3 AS INTEGER) AS y1,
         CAST(round_even(x, 0) + 3 AS INTEGER) AS x2, CAST(round_even(y, 0) + 3 AS INTEGER) AS y2
  FROM raw)"""
BOXES = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]


def iou_sql(a: str, b: str) -> str:
    """IoU of two boxes of 6 x 6."""
    w, h = (f"greatest(0, least({a}{c}2, {b}{c}2) - greatest({a}{c}1, {b}{c}1))" for c in "xy")
    return f"({w} * {h} / (72.0 - {w} * {h}))"


@query("box_iou_pairs", f"""WITH {DET}
  SELECT a.video_id, a.frame, a.det_idx AS a_det_idx, b.det_idx AS b_det_idx, {iou_sql('a.', 'b.')} AS iou
  FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame = b.frame AND a.det_idx < b.det_idx
  WHERE {iou_sql('a.', 'b.')} > 0""")
def _(spark, d):
    met = pairs.overlapping_boxes(ad.detections(spark, d).select("video_id", "frame", "det_idx", *BOXES))
    return met.where("a_det_idx < b_det_idx").withColumn("iou", ex.bbox_iou("a_", "b_")).where("iou > 0").select("video_id", "frame", "a_det_idx", "b_det_idx", "iou")


@query("resolution_scaled_filter", f"""WITH {PTS}
  SELECT video_id, track_id, frame, x, y, area FROM pts
  WHERE area >= greatest(1, round_even(200.0 * {SIZE[0]} * {SIZE[1]} / (1024.0 * 576.0), 0))
    AND sqrt((x - 250) * (x - 250) + (y - 50) * (y - 50)) <= 300.0 * sqrt({SIZE[0]}.0 * {SIZE[0]} + {SIZE[1]}.0 * {SIZE[1]}) / sqrt(1024.0 * 1024 + 576.0 * 576)""")
def _(spark, d):
    p = points(spark, d).where(F.col("area") >= ex.area_scale(200, SIZE))
    near = ex.norm(F.col("x") - 250, F.col("y") - 50) <= ex.resolution_scale(300.0, SIZE)
    return p.where(near).select(*OWN, "frame", "x", "y", "area")


@query("event_expressions", f"""WITH {PTS}, {sql_summary()}
  SELECT video_id, track_id, CASE WHEN y_end - y_start < -12.0 THEN 'exit' WHEN y_end - y_start > 12.0 THEN 'entry' ELSE 'inside' END AS fast_direction,
         CASE WHEN y_end < y_start THEN 'exit' ELSE 'entry' END AS heat_direction,
         greatest(0.0, least(1.0, 0.55 + 0.35 * least(1.0, mean_speed_px_sec / 240.0) + CASE WHEN num_detections % 3 > 0 THEN 0.2 ELSE 0.0 END - least(0.25, 0.04 * (num_detections % 7)))) AS confidence,
         printf('#%06x', ((track_id % 16777216) * 2654435761) % 16777216) AS colour
  FROM sm""")
def _(spark, d):
    c, s = F.col, summary.summarise(points(spark, d))
    return s.select(
        *OWN, ex.fast_direction(c("y_start"), c("y_end"), float(SIZE[1])).alias("fast_direction"), ex.heatmap_direction(c("y_start"), c("y_end")).alias("heat_direction"),
        ex.event_confidence(c("mean_speed_px_sec"), c("num_detections") % 3, c("num_detections") % 7, 120.0).alias("confidence"), ex.colour(c("track_id")).alias("colour"),
    )


@query("pixel_colours", f"""WITH {PTS}, c AS (
    SELECT video_id, track_id, frame, CAST(frame * 7 % 256 AS INTEGER) AS r, CAST(track_id * 13 % 256 AS INTEGER) AS g, CAST(frame * 3 % 256 AS INTEGER) AS b FROM pts), s AS (
    SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS span FROM c), h AS (
    SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN hi = r THEN 60.0 * (g - b) / span WHEN hi = g THEN 120 + 60.0 * (b - r) / span ELSE 240 + 60.0 * (r - g) / span END AS hue FROM s), v AS (
    SELECT *, round_even(CAST(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END AS DOUBLE) / 2, 0) AS half, CASE WHEN hi = 0 THEN 0.0 ELSE round_even(255.0::DOUBLE * span / hi, 0) END AS sat FROM h)
  SELECT video_id, track_id, frame, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS INTEGER) AS gray, (half <= 12 OR half >= 168) AND sat >= 70 AND hi >= 70 AS red FROM v""")
def _(spark, d):
    c = F.col
    p = points(spark, d).select(*OWN, "frame", (c("frame") * 7 % 256).cast("int").alias("r"), (c("track_id") * 13 % 256).cast("int").alias("g"), (c("frame") * 3 % 256).cast("int").alias("b"))
    return p.select(*OWN, "frame", ex.gray(c("r"), c("g"), c("b")).alias("gray"), ex.is_red(c("r"), c("g"), c("b")).alias("red"))


@query("list_codec", f"""WITH {PTS}, l AS (SELECT video_id, track_id, list(frame ORDER BY frame) AS f FROM pts GROUP BY ALL)
  SELECT video_id, track_id, array_to_string(f, ';') AS joined, CAST(len(f) AS INTEGER) AS n, CAST(f[1] AS VARCHAR) AS first FROM l""")
def _(spark, d):
    l = points(spark, d).groupBy(*OWN).agg(F.sort_array(F.collect_list("frame")).alias("f"))
    text = l.select(*OWN, ex.join_list(F.col("f")).alias("joined"))
    items = text.withColumn("i", ex.split_list(F.concat(F.lit(" "), F.regexp_replace("joined", ";", " ; ;"), F.lit(";"))))
    return items.select(*OWN, "joined", F.size("i").alias("n"), F.col("i")[0].alias("first"))


@query("detections_in_mask", f"WITH {DET} SELECT video_id, frame, det_idx, x, y FROM det WHERE {ad.MASK_TEST_SQL}")
def _(spark, d):
    return regions.flag_in_region(ad.detections(spark, d), ad.mask_pixels(spark)).where("inside").select("video_id", "frame", "det_idx", "x", "y")


@query("stripped_away_tracks", f"""WITH {FRAG_PTS}, t AS (
    SELECT video_id, track_id, count(*) AS n, count(*) FILTER (NOT {ad.MASK_TEST_SQL}) AS outside FROM pts GROUP BY ALL)
  SELECT video_id, track_id, n AS num_detections, CASE WHEN n < 3 THEN n < 2 ELSE outside < 2 END AS lost FROM t""")
def _(spark, d):
    p = fragments(spark, d)
    stripped = windows.strip_jitter(regions.flag_in_box(p, ad.MASK), "inside", 0.0, strict=True).drop("inside")
    a = filters.assess(p, filters.TrackFilter(), ad.FPS, SIZE, stripped).select(*OWN, F.array_contains("reject_reasons", "vegetation_mask").alias("lost"))
    return p.groupBy(*OWN).agg(F.count("*").alias("num_detections")).join(a, OWN)


@query("jitter_strict", f"WITH {FRAG_PTS}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM pts) SELECT video_id, track_id, frame, x, y FROM n WHERE n < 3 OR NOT {ad.MASK_TEST_SQL}")
def _(spark, d):
    p = regions.flag_in_box(fragments(spark, d), ad.MASK)
    return windows.strip_jitter(p, "inside", 0.0, strict=True).select(*OWN, "frame", "x", "y")


@query("visible_tracks", f"""WITH {ENDS}, t AS (SELECT video_id, track_id FROM dirs WHERE num_detections >= 60 AND direction IN ('entry', 'exit') AND track_id % 5 <> 0)
  SELECT p.video_id, p.track_id, p.frame, p.x, p.y FROM pts p JOIN t USING (video_id, track_id)""")
def _(spark, d):
    p, way = points(spark, d), base.directed(spark, d)
    a = filters.assess(p, RULES, ad.FPS, SIZE, directions=way)
    shown = filters.visible_tracks(p, a, 60, ("entry", "exit"), a.where("track_id % 5 = 0"))
    return shown.select(*OWN, "frame", "x", "y")


@query("trail_window", f"WITH {PTS} SELECT video_id, track_id, frame, x, y FROM pts WHERE frame BETWEEN 180 AND 200")
def _(spark, d):
    return filters.trail_window(points(spark, d), 200, 20).select(*OWN, "frame", "x", "y")


@query("nearest_track_at", f"""WITH {PTS}, n AS (SELECT *, sqrt((x - 250) * (x - 250) + (y - 50) * (y - 50)) AS distance FROM pts)
  SELECT video_id, min_by(track_id, distance) AS track_id, min(distance) AS distance FROM n
  WHERE frame = (SELECT min(frame) FROM n WHERE distance <= 60 AND frame >= 300) AND distance <= 60 GROUP BY video_id""")
def _(spark, d):
    p = points(spark, d)
    now = p.where((F.col("frame") >= 300) & (ex.norm(F.col("x") - 250, F.col("y") - 50) <= 60)).agg(F.min("frame")).first()[0]  # a cursor of the user's
    return pairs.nearest_at(p, now, 250.0, 50.0, 60.0)


@query("secondary_antijoin_renumbered", base.SQL["secondary_antijoin_renumbered"].replace("dd <= 120.0", "dd <= 35.0"))
def _(spark, d):
    p = points(spark, d)
    return pairs.secondary_only(p.where("track_id % 2 = 0"), p.where("track_id % 2 = 1"), 35.0, 3, 0.04).select(*OWN, "frame", "x", "y")


@query("profile_smoothing", f"""WITH {PTS}, q AS (
    SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY video_id, track_id) AS n, first_value(y) OVER f AS y0, last_value(y) OVER f AS y1, sum(y) OVER s AS sy, avg(y) OVER s AS ay FROM pts
    WINDOW o AS (PARTITION BY video_id, track_id ORDER BY frame), f AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
           s AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT video_id, track_id, frame, (sy + greatest(2 - (i - 1), 0) * y0 + greatest(2 - (n - i), 0) * y1) / 5 AS y_s, CASE WHEN i = 1 OR i = n THEN y ELSE ay END AS y_m FROM q""")
def _(spark, d):
    p = windows.truncated_mean(points(spark, d), "y", "frame", OWN, 2)
    return windows.smooth_profile(p, "y", "frame", OWN, 5).select(*OWN, "frame", "y_s", "y_m")


@query("timings", """WITH r AS (SELECT event_type AS phase, event_id % 50 AS frame, value / 1000 AS s FROM events), per AS (SELECT phase, frame, sum(s) AS s FROM r WHERE frame BETWEEN 0 AND 39 GROUP BY ALL),
  dense AS (SELECT p.phase, f.frame, coalesce(per.s, 0.0) AS s FROM (SELECT DISTINCT phase FROM r) p CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS frame) f LEFT JOIN per ON per.phase = p.phase AND per.frame = f.frame),
  a AS (SELECT phase, avg(s) AS mean_sec_per_frame, quantile_cont(s, 0.5) AS median_sec_per_frame, quantile_cont(s, 0.95) AS p95_sec_per_frame FROM dense GROUP BY phase)
  SELECT a.*, t.total_sec, t.executions, 100.0::DOUBLE * t.total_sec / 5000 AS percent_total FROM a JOIN (SELECT phase, sum(s) AS total_sec, count(*) AS executions FROM r GROUP BY phase) t USING (phase)""")
def _(spark, d):
    e = ad.table(spark, d, "events")
    r = e.select(F.col("event_type").alias("phase"), (F.col("event_id") % 50).alias("frame"), (F.col("value").cast("double") / 1000).alias("duration_sec"), F.lit(1).cast("long").alias("executions"))
    return layers.timings(r, 5000.0, 40)


# ---- events of fast tracks

FAST = base.FAST | {"max_group_endpoint_distance": 6.0, "max_group_overlap_distance": 60.0}
LOOSE = FAST | {"min_event_displacement": 10.0, "min_event_path_length": 10.0, "min_event_mean_speed": 5.0}


def _d4() -> str:
    return "least(" + ", ".join(base._d4(p, q) for p in ("start", "end") for q in ("start", "end")) + ")"


def groups_sql(with_points: bool, sources: str = "src", tag: str = "") -> str:
    met = " LEFT JOIN met m ON m.video_id = a.video_id AND m.track_a = a.track_id AND m.track_b = b.track_id" if with_points else ""
    near = f"({_d4()} <= 6.0 OR coalesce(m.mean_distance <= 60.0, false))" if with_points else f"{_d4()} <= 6.0"
    return f"""dp{tag} AS (SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b FROM {sources} a JOIN {sources} b ON a.video_id = b.video_id AND a.track_id < b.track_id
      AND greatest(0, b.frame_start - a.frame_end, a.frame_start - b.frame_end) <= 45{met} WHERE {near}),
    e{tag} AS (SELECT video_id, track_a AS a, track_b AS b FROM dp{tag} UNION SELECT video_id, track_b, track_a FROM dp{tag}),
    reach{tag} AS (SELECT video_id, track_id, track_id AS r FROM {sources} UNION SELECT o.video_id, o.track_id, e.b FROM reach{tag} o JOIN e{tag} e ON e.video_id = o.video_id AND e.a = o.r),
    grp{tag} AS (SELECT video_id, track_id, min(r) AS group_id FROM reach{tag} GROUP BY ALL)"""


SRC = f"{ASSESS}, src AS (SELECT * FROM ass WHERE {FAST_WHERE})"
CHAIN = """fr AS (SELECT p.video_id, g.group_id, p.frame, p.time_sec, p.x, p.y, p.area, p.track_id, dense_rank() OVER (PARTITION BY g.video_id, g.group_id ORDER BY p.frame) AS k FROM pts p JOIN grp g USING (video_id, track_id)),
    ch AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, group_id ORDER BY area DESC, x + y DESC, time_sec, x, y, track_id) AS rn FROM fr WHERE k = 1) f WHERE rn = 1
      UNION ALL SELECT * EXCLUDE (rn) FROM (
        SELECT f.*, row_number() OVER (PARTITION BY f.video_id, f.group_id ORDER BY sqrt((f.x - ch.x) * (f.x - ch.x) + (f.y - ch.y) * (f.y - ch.y)), f.area DESC, f.time_sec, f.x, f.y, f.track_id) AS rn
        FROM ch JOIN fr f ON f.video_id = ch.video_id AND f.group_id = ch.group_id AND f.k = ch.k + 1) f WHERE rn = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, group_id ORDER BY CASE WHEN n > 2 THEN -(x + y) ELSE 0 END, frame) AS i FROM (SELECT *, count(*) OVER (PARTITION BY video_id, group_id) AS n FROM ch) z)"""


def finish_sql(displacement: float, path: float, speed: float, two_ends: bool, first_id: str = "10000", name: str = "ev") -> str:
    duration = "dur" if two_ends else "od"
    at_least = "" if two_ends else " AND n >= 4"
    return f"""st{name} AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM o{name if two_ends else ''} WINDOW w AS (PARTITION BY video_id, group_id ORDER BY i)),
    a{name} AS (SELECT video_id, group_id, count(*) AS n, min(frame) AS frame_start, max(frame) AS frame_end, sum(step) AS path_length_px, min_by(x, i) AS x0, max_by(x, i) AS x1, min_by(y, i) AS y0, max_by(y, i) AS y1,
      max(time_sec) - min(time_sec) AS dur, greatest(0.0, max_by(time_sec, i) - min_by(time_sec, i)) AS od FROM st{name} GROUP BY ALL),
    b{name} AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS displacement_px, CASE WHEN {duration} > 0 THEN path_length_px / {duration} ELSE 0.0 END AS mean_speed_px_sec, CASE WHEN od > 0 THEN path_length_px / od ELSE 0.0 END AS os FROM a{name}),
    m{name} AS (SELECT g.video_id, g.group_id, array_to_string(list(g.track_id ORDER BY g.track_id), ';') AS source_track_ids, count(*) FILTER (len(s.reasons) = 0) AS na, count(*) FILTER (len(s.reasons) > 0) AS nr FROM grp{name if two_ends else ''} g JOIN src s USING (video_id, track_id) GROUP BY ALL),
    {name} AS (SELECT b.*, m.source_track_ids, {first_id} + row_number() OVER (PARTITION BY b.video_id ORDER BY b.group_id) AS event_id,
      greatest(0.0, least(1.0, 0.55 + 0.35 * least(1.0, os / greatest(1.0, {2 * speed})) + CASE WHEN na > 0 THEN 0.2 ELSE 0.0 END - least(0.25, 0.04 * nr))) AS confidence,
      CASE WHEN y1 - y0 < -12.0 THEN 'exit' WHEN y1 - y0 > 12.0 THEN 'entry' ELSE 'inside' END AS direction
      FROM b{name} b JOIN m{name} m USING (video_id, group_id) WHERE displacement_px >= {displacement} AND path_length_px >= {path} AND mean_speed_px_sec >= {speed}{at_least})"""


FROM_POINTS = f"{SRC}, {MET}, {groups_sql(True)}, {CHAIN}, {finish_sql(10.0, 120.0, 120.0, False)}"
EVENT_COLUMNS = "video_id, event_id, source_track_ids, frame_start, frame_end, displacement_px, path_length_px, mean_speed_px_sec, confidence, direction"


def shown(events):
    return events.select(*(ex.join_list(F.col(c)).alias(c) if c.endswith("_ids") else c for c in EVENT_COLUMNS.split(", ")))


def events_of(spark, d):
    return fe.fast_events(points(spark, d), base.assessed(spark, d), FAST, float(SIZE[1]))


@query("fast_events", f"WITH RECURSIVE {FROM_POINTS} SELECT {EVENT_COLUMNS} FROM ev")
def _(spark, d):
    return shown(events_of(spark, d))


@query("fast_tracks", f"WITH RECURSIVE {FROM_POINTS} SELECT o.video_id, ev.event_id, CAST(o.i - 1 AS INTEGER) AS point_index, o.frame, o.time_sec, o.x, o.y, o.area, o.track_id FROM o JOIN ev USING (video_id, group_id)")
def _(spark, d):
    return fe.event_points(events_of(spark, d))


@query("event_axes", f"""WITH RECURSIVE {FROM_POINTS}, p AS (SELECT o.video_id, ev.event_id, o.i, o.x, o.y FROM o JOIN ev USING (video_id, group_id)),
  s AS (SELECT a.video_id, a.event_id, a.i AS ai, b.i AS bi, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) - 0.25 * ((b.x - a.x) + (b.y - a.y)) AS score FROM p a JOIN p b ON a.video_id = b.video_id AND a.event_id = b.event_id AND a.i <> b.i)
  SELECT video_id, event_id, ax, ay, bx, "by" FROM (SELECT *, row_number() OVER (PARTITION BY video_id, event_id ORDER BY score DESC, ai, bi) AS rn FROM s) z WHERE rn = 1""")
def _(spark, d):
    return fe.event_axis(events_of(spark, d))


@query("heatmap_event_tracks", f"""WITH RECURSIVE {FROM_POINTS}
  SELECT o.video_id, ev.event_id, CAST(o.i - 1 AS INTEGER) AS point_index, ev.frame_start + (ev.frame_end - ev.frame_start) * (o.i - 1)::DOUBLE / greatest(ev.n - 1, 1) AS frame_est, o.x, o.y FROM o JOIN ev USING (video_id, group_id)""")
def _(spark, d):
    return sinks.heatmap_tracks(events_of(spark, d))


def two_ends_sql(sources: str, name: str, first_id: str = "10000") -> str:
    groups = groups_sql(False, sources, name)
    end = lambda e: f"SELECT g.video_id, g.group_id, s.frame_start AS fs, s.frame_{e} AS frame, s.frame_{e} / 25.0 AS time_sec, s.x_{e} AS x, s.y_{e} AS y, s.mean_area AS area, s.track_id FROM grp{name} g JOIN {sources} s USING (video_id, track_id)"
    return f"""{groups}, o{name} AS (SELECT *, row_number() OVER (PARTITION BY video_id, group_id ORDER BY -(x + y), fs, frame, time_sec, x, y, area, track_id) AS i FROM ({end('start')} UNION ALL {end('end')}) z),
    {finish_sql(10.0, 10.0, 5.0, True, first_id, name)}"""


@query("fast_candidate_events", f"WITH RECURSIVE {SRC}, {two_ends_sql('src', 'ce')} SELECT {EVENT_COLUMNS} FROM ce")
def _(spark, d):
    return shown(fe.candidate_events(base.assessed(spark, d), LOOSE, ad.FPS, float(SIZE[1])))


# ---- duplicates, merges, rescues, fusion

@query("coexisting_dedupe", f"""WITH RECURSIVE {FRAG_EDGES}, {MET}, f AS (
    SELECT m.video_id, m.track_a AS a, m.track_b AS b, m.common_frames AS c, m.mean_distance AS dd, x.frame_start AS fa, x.frame_end AS ea, x.num_detections AS na, y.frame_start AS fb, y.frame_end AS eb, y.num_detections AS nb, {cosine_sql('x.vecx', 'x.vecy', 'y.vecx', 'y.vecy')} AS cosine
    FROM met m JOIN ed x ON x.video_id = m.video_id AND x.track_id = m.track_a JOIN ed y ON y.video_id = m.video_id AND y.track_id = m.track_b),
  g AS (SELECT *, CASE WHEN na <= nb THEN a ELSE b END AS short, least(na, nb) AS ns, greatest(na, nb) AS nl, CASE WHEN na <= nb THEN fa ELSE fb END AS ss, CASE WHEN na <= nb THEN ea ELSE eb END AS se, CASE WHEN na <= nb THEN fb ELSE fa END AS ls, CASE WHEN na <= nb THEN eb ELSE ea END AS le FROM f),
  fit AS (SELECT * FROM g WHERE ns <= 30 AND ss >= ls AND se <= le AND (abs(fa - fb) <= 1 OR abs(ea - eb) <= 1 OR ns / nl <= 0.9) AND c >= 1 AND c / ns >= 0.3 AND dd <= 200.0 AND (cosine IS NULL OR cosine >= -1.0)),
  od AS (SELECT video_id, a, b, short, row_number() OVER (PARTITION BY video_id ORDER BY a, b) AS i, row_number() OVER (PARTITION BY video_id, a ORDER BY b) AS j FROM fit),
  go AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone, true AS ok FROM od
    UNION ALL SELECT video_id, i, CASE WHEN now AND NOT list_contains(gone, b) THEN list_append(gone, short) ELSE gone END, now FROM (
      SELECT go.video_id, od.i, od.b, od.short, go.gone, CASE WHEN od.j = 1 THEN NOT list_contains(go.gone, od.a) ELSE go.ok END AS now FROM go JOIN od ON od.video_id = go.video_id AND od.i = go.i + 1) z)
  SELECT DISTINCT video_id, unnest(gone) AS track_id FROM (SELECT video_id, arg_max(gone, i) AS gone FROM go GROUP BY video_id) z""")
def _(spark, d):
    return grouping.coexisting_duplicates(fragments(spark, d), 1, 200.0, 0.3, 30, 0.9, -1.0)


COS = {"sc": ("a.svx", "a.svy", "b.svx", "b.svy"), "ec": ("a.evx", "a.evy", "b.evx", "b.evy"), "lc": ("a.evx", "a.evy", "b.svx", "b.svy")}
MERGES = f"""{FRAG_EDGES}, c0 AS (
    SELECT a.video_id, a.track_id AS ta, b.track_id AS tb, a.frame_start AS fa, b.frame_start AS fb, a.frame_end AS ea, b.frame_end AS eb, {', '.join(f'{cosine_sql(*v)} AS {k}' for k, v in COS.items())},
      CASE WHEN a.frame_end < b.frame_start THEN sqrt((a.x_end - b.x_start) * (a.x_end - b.x_start) + (a.y_end - b.y_start) * (a.y_end - b.y_start))
           WHEN b.frame_end < a.frame_start THEN sqrt((b.x_end - a.x_start) * (b.x_end - a.x_start) + (b.y_end - a.y_start) * (b.y_end - a.y_start)) ELSE 0.0 END AS gapd
    FROM ed a JOIN ed b ON a.video_id = b.video_id AND a.track_id < b.track_id AND b.frame_start <= a.frame_end + 8 AND b.frame_end >= a.frame_start - 8),
  {MET}, c1 AS (SELECT c0.*, m.common_frames AS cf, m.mean_distance AS md, ea < fb OR eb < fa AS hand, CASE WHEN sc IS NOT NULL AND ec IS NOT NULL THEN (sc + ec) / 2 ELSE coalesce(sc, ec) END AS mc
    FROM c0 LEFT JOIN met m ON m.video_id = c0.video_id AND m.track_a = ta AND m.track_b = tb WHERE gapd <= 60.0),
  c2 AS (SELECT *, CASE WHEN hand THEN 'handoff' WHEN cf >= 3 AND md <= 60.0 AND (mc IS NULL OR mc >= 0.8 OR coalesce(lc >= 0.8, false)) THEN 'overlap'
    WHEN cf >= 3 AND md <= 60.0 AND sc >= 0.65 THEN 'overlap_start_aligned' WHEN NOT cf >= 3 AND md <= 60.0 AND lc >= 0.65 THEN 'overlap_local' END AS reason FROM c1),
  c3 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY greatest(fa, fb), CASE WHEN fa <= fb THEN tb ELSE ta END, CASE WHEN fa <= fb THEN ea ELSE eb END, ta, tb) AS i FROM c2 WHERE reason IS NOT NULL),
  tr AS (SELECT p.video_id, p.track_id, list(p.frame) AS frames, row_number() OVER (PARTITION BY p.video_id ORDER BY p.track_id) AS k FROM pts p
    WHERE EXISTS (SELECT 1 FROM c3 WHERE c3.video_id = p.video_id AND p.track_id IN (c3.ta, c3.tb)) GROUP BY p.video_id, p.track_id),
  od AS (SELECT c3.video_id, c3.i, c3.ta, c3.tb, c3.reason, c3.md, x.k AS ka, y.k AS kb FROM c3 JOIN tr x ON x.video_id = c3.video_id AND x.track_id = c3.ta JOIN tr y ON y.video_id = c3.video_id AND y.track_id = c3.tb),
  go AS (SELECT video_id, CAST(0 AS BIGINT) AS i, list(k ORDER BY k) AS label, list(frames ORDER BY k) AS held, CAST(NULL AS BIGINT) AS ta, CAST(NULL AS BIGINT) AS tb, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS VARCHAR) AS reason FROM tr GROUP BY video_id
    UNION ALL SELECT video_id, i, CASE WHEN ok THEN [CASE WHEN v = hi THEN lo ELSE v END FOR v IN label] ELSE label END, CASE WHEN ok THEN [CASE WHEN n = lo THEN list_distinct(list_concat(held[lo], held[hi])) ELSE v END FOR v, n IN held] ELSE held END,
        CASE WHEN ok THEN ta END, CASE WHEN ok THEN tb END, CASE WHEN ok THEN lo END, CASE WHEN ok THEN reason END FROM (
      SELECT *, lo <> hi AND (len(list_intersect(held[lo], held[hi])) <= 6 OR (md IS NOT NULL AND reason <> 'handoff' AND md <= 12.0)) AND len([v FOR v IN label IF v = lo OR v = hi]) <= 6 AS ok FROM (
        SELECT go.video_id, od.i, go.label, go.held, od.ta, od.tb, od.reason, od.md, least(go.label[od.ka], go.label[od.kb]) AS lo, greatest(go.label[od.ka], go.label[od.kb]) AS hi FROM go JOIN od ON od.video_id = go.video_id AND od.i = go.i + 1) y) z),
  done AS (SELECT go.video_id, go.ta AS track_a, go.tb AS track_b, tr.track_id AS merged_to, go.reason FROM go JOIN tr ON tr.video_id = go.video_id AND tr.k = go.lo WHERE go.ta IS NOT NULL)"""


@query("auto_merge", f"WITH RECURSIVE {MERGES} SELECT * FROM done")
def _(spark, d):
    return base.merges_of(spark, d)


@query("auto_merge_summary", f"""WITH RECURSIVE {MERGES} SELECT count(*) AS merges_total, count(*) FILTER (reason LIKE 'overlap%') AS overlap, count(*) FILTER (reason LIKE 'handoff%') AS handoff,
  coalesce((SELECT max(n) FROM (SELECT count(DISTINCT t) AS n FROM (SELECT merged_to, track_a AS t FROM done UNION ALL SELECT merged_to, track_b FROM done) y GROUP BY merged_to) z), 1) AS max_group_size FROM done""")
def _(spark, d):
    return summary.merge_summary(base.merges_of(spark, d))


FRAG_SM = f"{FRAG_PTS}, {sql_summary()}"
RESCUES = f"""{FRAG_SM}, ass AS (SELECT *, (least(1.0, num_detections / 12.0) + 1.0 + least(1.0, path_length_px / 100.0) + 1.0) / 4.0 AS score FROM sm WHERE num_detections >= 2),
  acc AS (SELECT video_id, track_id, frame_end, x_end, y_end FROM ass WHERE path_length_px >= 100.0 AND (num_detections >= 12 OR score >= 0.9)),
  rej AS (SELECT video_id, track_id, frame_start, x_start, y_start FROM ass WHERE num_detections < 12 AND path_length_px >= 100.0 AND score < 0.9),
  near AS (SELECT a.video_id, a.track_id AS a, r.track_id AS r, a.frame_end AS fe, r.frame_start - a.frame_end AS gap, sqrt((r.x_start - a.x_end) * (r.x_start - a.x_end) + (r.y_start - a.y_end) * (r.y_start - a.y_end)) AS dd FROM acc a JOIN rej r ON a.video_id = r.video_id AND r.frame_start - a.frame_end BETWEEN -1 AND 2),
  fresh AS (SELECT n.*, p.frame, p.x, p.y FROM near n JOIN pts p ON p.video_id = n.video_id AND p.track_id = n.r AND p.frame > n.fe WHERE n.dd <= 200.0),
  cnt AS (SELECT video_id, a, r, gap, dd, count(*) AS n FROM fresh GROUP BY ALL),
  close AS (SELECT DISTINCT video_id, a, r FROM (SELECT f.video_id, f.a, f.r, p.track_id AS o, avg(sqrt((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y))) AS m FROM fresh f JOIN acc USING (video_id) JOIN pts p ON p.video_id = f.video_id AND p.track_id = acc.track_id AND p.frame = f.frame AND p.track_id <> f.a GROUP BY ALL) z WHERE m <= 5.0),
  cand AS (SELECT *, dd + greatest(0, gap) * 200.0 - 2.0 * n AS score FROM cnt WHERE NOT EXISTS (SELECT 1 FROM close c WHERE c.video_id = cnt.video_id AND c.a = cnt.a AND c.r = cnt.r)),
  od AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score, a, r) AS i FROM cand),
  go AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ur, false AS ok FROM od
    UNION ALL SELECT video_id, i, CASE WHEN free THEN list_append(ua, a) ELSE ua END, CASE WHEN free THEN list_append(ur, r) ELSE ur END, free FROM (
      SELECT go.video_id, od.i, od.a, od.r, go.ua, go.ur, NOT list_contains(go.ua, od.a) AND NOT list_contains(go.ur, od.r) AS free FROM go JOIN od ON od.video_id = go.video_id AND od.i = go.i + 1) z)"""


@query("crossing_rescue", f"WITH RECURSIVE {RESCUES} SELECT od.video_id, od.a AS track_id, od.r AS source_track_id, od.n AS points_added, od.gap AS gap_frames, od.dd AS start_distance, od.score FROM go JOIN od ON od.video_id = go.video_id AND od.i = go.i WHERE go.ok")
def _(spark, d):
    p = fragments(spark, d)
    a = filters.assess(p, filters.TrackFilter(min_length=12, min_path=100.0), ad.FPS, SIZE)
    return grouping.crossing_rescues(p, filters.accepted_points(p, a), a, ("min_track_length",), 2, 200.0, 2, 1, 5.0)


@query("detection_fusion", f"""WITH RECURSIVE {DET}, q AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY det_idx % 2, det_idx) AS i FROM det),
  go AS (SELECT DISTINCT video_id, frame, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(p BOOLEAN, x DOUBLE, y DOUBLE, x1 INTEGER, y1 INTEGER, x2 INTEGER, y2 INTEGER, area DOUBLE)[]) AS kept FROM q
    UNION ALL SELECT go.video_id, go.frame, q.i, CASE WHEN q.det_idx % 2 = 0 OR len([k FOR k IN go.kept IF sqrt((k.x - q.x) * (k.x - q.x) + (k.y - q.y) * (k.y - q.y)) <= 8.0 OR {iou_sql('k.', 'q.')} >= 0.1]) = 0
      THEN list_append(go.kept, struct_pack(p := q.det_idx % 2 = 0, x := q.x, y := q.y, x1 := q.x1, y1 := q.y1, x2 := q.x2, y2 := q.y2, area := q.area)) ELSE go.kept END
    FROM go JOIN q ON q.video_id = go.video_id AND q.frame = go.frame AND q.i = go.i + 1),
  done AS (SELECT video_id, frame, arg_max(kept, i) AS kept FROM go GROUP BY ALL), u AS (SELECT video_id, frame, unnest(kept) AS k, generate_subscripts(kept, 1) AS n FROM done)
  SELECT video_id, frame, CAST(n - 1 AS INTEGER) AS det_idx, k.x AS x, k.y AS y, k.x1 AS bbox_x1, k.y1 AS bbox_y1, k.x2 AS bbox_x2, k.y2 AS bbox_y2, k.area AS area, CASE WHEN k.p THEN 'primary' ELSE 'secondary' END AS origin FROM u""")
def _(spark, d):
    det = ad.detections(spark, d)
    return tracking.fuse_detections(det.where("det_idx % 2 = 0"), det.where("det_idx % 2 = 1"), 8.0, 0.1)


# ---- exports

@query("tracks_svg", f"""WITH {PTS}, l AS (SELECT video_id, track_id, string_agg(printf('%.2f,%.2f', x, y), ' ' ORDER BY frame) AS line, min_by(x, frame) AS x0, min_by(y, frame) AS y0, max_by(x, frame) AS x1, max_by(y, frame) AS y1, printf('#%06x', ((track_id % 16777216) * 2654435761) % 16777216) AS c FROM pts GROUP BY ALL)
  SELECT video_id, track_id, '<g id="track-' || track_id || '"><polyline fill="none" stroke="' || c || '" stroke-width="1.5" points="' || line || '"/><circle r="3" fill="' || c || '" cx="' || printf('%.2f', x0) || '" cy="' || printf('%.2f', y0)
    || '"/><circle r="2" fill="' || c || '" cx="' || printf('%.2f', x1) || '" cy="' || printf('%.2f', y1) || '"/><text x="' || printf('%.2f', x1) || '" y="' || printf('%.2f', y1) || '">' || track_id || '</text></g>' AS svg FROM l""")
def _(spark, d):
    return sinks.svg_tracks(points(spark, d))


@query("tracks_render_json", f"WITH {ENDS} SELECT p.video_id, p.track_id, printf('#%06x', ((p.track_id % 16777216) * 2654435761) % 16777216) AS color, d.direction, p.frame, p.x, p.y FROM pts p JOIN dirs d USING (video_id, track_id)")
def _(spark, d):
    doc = sinks.render_payload(points(spark, d), base.directed(spark, d))
    kind = "struct<tracks:array<struct<track_id:bigint,direction:string,color:string,points:array<struct<frame:bigint,x:double,y:double>>>>>"
    t = doc.select("video_id", F.explode(F.from_json("value", kind)["tracks"]).alias("t"))
    return t.select("video_id", "t.track_id", "t.color", "t.direction", F.explode("t.points").alias("p")).select("video_id", "track_id", "color", "direction", "p.*")


@query("render_documents", f"""WITH {ENDS} SELECT p.video_id, p.track_id, any_value(d.direction) AS direction, min(p.frame) AS frame_start, max(p.frame) AS frame_end, count(*) AS n, arg_min(p.x, p.frame) AS x_start,
  {ad.FRAME_SIZE[0]} AS width, {ad.FRAME_SIZE[1]} AS height, 1 AS parts, 4 AS corners FROM pts p JOIN dirs d USING (video_id, track_id) GROUP BY p.video_id, p.track_id""")
def _(spark, d):
    path = scratch.fresh_path(spark, "render")
    sinks.export_render(points(spark, d), path, ad.FRAME_SIZE, base.directed(spark, d), ad.mask_pixels(spark)).write.format("noop").mode("overwrite").save()
    track = "struct<track_id:bigint,direction:string,frame_start:bigint,frame_end:bigint,point_start:struct<x:double>,points:array<struct<x:double>>>"
    doc = spark.read.schema(f"video_id string, width int, height int, valid_region struct<contours:array<array<struct<x:int,y:int>>>>, tracks array<{track}>").json(path)
    contours = F.col("valid_region.contours")
    t = doc.select("video_id", "width", "height", F.size(contours).alias("parts"), F.size(contours[0]).alias("corners"), F.explode("tracks").alias("t"))
    return t.select("video_id", "t.track_id", "t.direction", "t.frame_start", "t.frame_end", F.size("t.points").cast("long").alias("n"), F.col("t.point_start.x").alias("x_start"), "width", "height", "parts", "corners")


@query("review_suppressions", f"WITH {ASSESS} SELECT video_id, track_id, array_to_string(reasons, ';') AS reject_reasons FROM ass WHERE len(reasons) > 0")
def _(spark, d):
    return filters.with_reason_text(sinks.review_tables(spark.createDataFrame([], "video_id string, track_a long, track_b long, merged_to long, reason string"), base.assessed(spark, d))[1])

