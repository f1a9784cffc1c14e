"""Named queries over the benchmark tables, each with the SQL that an independent
engine answers it by, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.operators import fast_events as fe
from flightloom.operators import filters, grouping, merging, pairs, pixels, regions, summary, tracking, windows
from flightloom.sources import adapters as ad

KEY = summary.KEY
QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE = ad.FRAME_SIZE
DIAG = (SIZE[0] ** 2 + SIZE[1] ** 2) ** 0.5
RULES = filters.TrackFilter(min_length=55, min_displacement=20.0, min_path=3000.0, min_straightness=0.01, static_noise=True, static_min_duration_sec=3.0, static_max_speed_ratio=0.45, static_max_displacement_ratio=0.02, static_min_fraction=0.9, static_step_ratio=0.01, max_gap=45, loiter=True, loiter_min_duration_sec=10.0, loiter_min_displacement_ratio=0.05)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


PTS = ad.POINTS_SQL
STEP = """step AS (
  SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step, frame - lag(frame) OVER w AS gap
  FROM pts WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))"""


def sql_summary(guard: str = "0") -> str:
    return f"""{STEP}, agg AS (
  SELECT video_id, track_id, min(frame) AS frame_start, max(frame) AS frame_end, count(*) AS num_detections, min_by(time_sec, frame) AS t0, max_by(time_sec, frame) AS t1,
         min_by(x, frame) AS x_start, min_by(y, frame) AS y_start, max_by(x, frame) AS x_end, max_by(y, frame) AS y_end, coalesce(sum(step), 0.0) AS path_length_px, avg(area) AS mean_area, max(gap) AS max_gap,
         avg(CASE WHEN step IS NULL THEN NULL WHEN step / greatest(gap, 1) < {RULES.static_step_ratio * DIAG!r} THEN 1.0 ELSE 0.0 END) AS static_fraction
  FROM step GROUP BY ALL), sm0 AS (
  SELECT *, t1 - t0 AS duration_sec, sqrt((x_end - x_start) * (x_end - x_start) + (y_end - y_start) * (y_end - y_start)) AS displacement_px FROM agg), sm AS (
  SELECT *, CASE WHEN path_length_px > {guard} THEN displacement_px / path_length_px ELSE 0.0 END AS straightness,
         CASE WHEN duration_sec > {guard} THEN path_length_px / duration_sec ELSE 0.0 END AS mean_speed_px_sec FROM sm0)"""


SM_COLUMNS = "video_id, track_id, frame_start, frame_end, num_detections, x_start, y_start, x_end, y_end, path_length_px, mean_area, duration_sec, displacement_px, straightness, mean_speed_px_sec"


def points(spark, d):
    return ad.points(spark, d)


@query("track_points_consolidated", f"WITH {PTS} SELECT video_id, track_id, frame, x, y, area FROM pts")
def _(spark, d):
    return points(spark, d).select("video_id", "track_id", "frame", "x", "y", "area")


@query("track_summary", f"WITH {PTS}, {sql_summary()} SELECT {SM_COLUMNS} FROM sm")
def track_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarise(points(spark, d)).select(*SM_COLUMNS.split(", "))


@query("run_metrics", f"WITH {PTS}, per AS (SELECT video_id, track_id, count(*) AS n FROM pts GROUP BY ALL) SELECT video_id, CAST(sum(n) AS BIGINT) AS points_total, count(*) AS tracks_total, min(n) AS track_length_min, max(n) AS track_length_max, avg(n) AS track_length_mean FROM per GROUP BY video_id")
def _(spark, d):
    return summary.run_metrics(points(spark, d))


def assessed(spark, d):
    return filters.assess(points(spark, d), RULES, ad.FPS, SIZE)


R = RULES
ASSESS = f"""{PTS}, {sql_summary()}, asr AS (
  SELECT *, (least(1.0, num_detections / {R.min_length}.0) + least(1.0, displacement_px / {R.min_displacement}) + least(1.0, path_length_px / {R.min_path}) + least(1.0, straightness / {R.min_straightness})) / 4.0 AS score,
    list_filter_null([CASE WHEN num_detections < {R.min_length} THEN 'min_track_length' END, CASE WHEN displacement_px < {R.min_displacement} THEN 'min_track_displacement' END,
     CASE WHEN path_length_px < {R.min_path} THEN 'min_track_path_length' END, CASE WHEN path_length_px > 0 AND straightness < {R.min_straightness} THEN 'min_track_straightness' END,
     CASE WHEN duration_sec >= {R.static_min_duration_sec} AND ((mean_speed_px_sec < {R.static_max_speed_ratio * DIAG!r} AND displacement_px / duration_sec < {R.static_max_displacement_ratio * DIAG!r}) OR static_fraction >= {R.static_min_fraction}) THEN 'static_noise' END,
     CASE WHEN max_gap > {R.max_gap} THEN 'temporal_gap' END, CASE WHEN duration_sec >= {R.loiter_min_duration_sec} AND displacement_px / {DIAG!r} < {R.loiter_min_displacement_ratio} THEN 'loiter' END]) AS rs
  FROM sm WHERE num_detections >= 2), ass AS (
  SELECT *, CASE WHEN rs = ['min_track_length'] AND score >= 0.9 THEN [] ELSE rs END AS reasons FROM asr)""".replace("list_filter_null([", "(SELECT coalesce(list(r ORDER BY o), []) FROM (SELECT unnest([").replace("'loiter' END]) AS rs", "'loiter' END]) AS r, generate_subscripts([1,2,3,4,5,6,7], 1) AS o) z WHERE r IS NOT NULL) AS rs")


@query("track_filter_assessments", f"WITH {ASSESS} SELECT video_id, track_id, num_detections, score, array_to_string(reasons, ';') AS reject_reasons, len(reasons) = 0 AS accepted FROM ass")
def _(spark, d):
    return filters.with_reason_text(assessed(spark, d)).select("video_id", "track_id", "num_detections", "score", "reject_reasons", "accepted")


@query("candidate_recall", f"""WITH {ASSESS}, r AS (SELECT video_id, count(*) AS tracks_total, count(*) FILTER (len(reasons) = 0) AS tracks_accepted, count(*) FILTER (len(reasons) > 0) AS tracks_rejected,
  CAST(coalesce(sum(num_detections) FILTER (len(reasons) = 0), 0) AS BIGINT) AS points_accepted, CAST(coalesce(sum(num_detections) FILTER (len(reasons) > 0), 0) AS BIGINT) AS points_rejected FROM ass GROUP BY video_id)
  SELECT *, CASE WHEN points_accepted + points_rejected > 0 THEN 100.0::DOUBLE * points_rejected / (points_accepted + points_rejected) ELSE 0.0 END AS orphan_percent FROM r""")
def _(spark, d):
    return summary.recall_metrics(assessed(spark, d))


@query("reject_reason_histogram", f"WITH {ASSESS} SELECT video_id, reason, count(*) AS tracks FROM (SELECT video_id, unnest(reasons) AS reason FROM ass) t GROUP BY ALL")
def _(spark, d):
    return summary.reason_histogram(assessed(spark, d))


def flagged(spark, d):
    return regions.flag_in_region(points(spark, d), ad.mask_pixels(spark))


CENTRE = ((ad.MASK[0] + ad.MASK[1]) / 2, (ad.MASK[2] + ad.MASK[3]) / 2)
ENDS = f"""{PTS}, fl AS (SELECT *, {ad.MASK_TEST_SQL} AS inside, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS i, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM pts), ends AS (
  SELECT video_id, track_id, count(*) AS num_detections, min_by(inside, frame) AS start_in, max_by(inside, frame) AS end_in, min_by(x, frame) AS x_start, min_by(y, frame) AS y_start, max_by(x, frame) AS x_end, max_by(y, frame) AS y_end,
         bool_or(i > 1 AND i < n AND inside) AS mid_in, bool_or(i > 1 AND i < n AND NOT inside) AS mid_out, bool_or(inside) AS any_in FROM fl GROUP BY ALL), dir0 AS (
  SELECT *, CASE WHEN start_in AND end_in THEN 'inside' WHEN start_in THEN 'exit' WHEN end_in THEN 'entry' ELSE 'outside' END AS base, x_start - {CENTRE[0]} AS sx, y_start - {CENTRE[1]} AS sy, x_end - {CENTRE[0]} AS ex, y_end - {CENTRE[1]} AS ey FROM ends), dirs AS (
  SELECT *, CASE WHEN base = 'inside' AND mid_out THEN 'exit'
    WHEN base = 'outside' AND mid_in THEN CASE WHEN sx * ex + sy * ey > 0 THEN 'outside' WHEN sqrt(ex * ex + ey * ey) < sqrt(sx * sx + sy * sy) * 0.92 THEN 'entry' WHEN sqrt(sx * sx + sy * sy) < sqrt(ex * ex + ey * ey) * 0.92 THEN 'exit' ELSE 'inside' END
    WHEN base = 'outside' THEN CASE WHEN y_end - y_start <= -40 AND y_end <= 20 THEN 'exit' WHEN y_end - y_start >= 40 AND y_start <= 20 THEN 'entry' ELSE 'outside' END
    ELSE base END AS direction FROM dir0)"""


def directed(spark, d):
    return regions.full_directions(flagged(spark, d), CENTRE, float(SIZE[1]))


@query("track_direction_simple", f"WITH {ENDS} SELECT video_id, track_id, start_in, end_in, base AS direction FROM dir0")
def _(spark, d):
    return regions.simple_directions(flagged(spark, d))


@query("track_direction_full", f"WITH {ENDS} SELECT video_id, track_id, start_in, end_in, mid_in, mid_out, direction FROM dirs")
def _(spark, d):
    return directed(spark, d).select("video_id", "track_id", "start_in", "end_in", "mid_in", "mid_out", "direction")


@query("start_or_end_in_mask", f"WITH {ENDS} SELECT p.video_id, p.track_id, p.frame, p.x, p.y FROM pts p JOIN ends e USING (video_id, track_id) WHERE e.start_in OR e.end_in")
def _(spark, d):
    return regions.keep_start_or_end_inside(points(spark, d), flagged(spark, d)).select("video_id", "track_id", "frame", "x", "y")


@query("final_direction_exclusion", f"WITH {ENDS} SELECT p.video_id, p.track_id, p.frame, p.x, p.y FROM pts p JOIN dirs e USING (video_id, track_id) WHERE e.direction <> 'outside'")
def _(spark, d):
    return regions.exclude_directions(points(spark, d), directed(spark, d)).select("video_id", "track_id", "frame", "x", "y")


@query("endpoint_diagnostics", f"""WITH {ENDS}, e AS (SELECT video_id, count(*) AS tracks, count(*) FILTER (start_in) AS starts_inside, count(*) FILTER (end_in) AS ends_inside, count(*) FILTER (any_in) AS touching FROM ends GROUP BY video_id)
  SELECT *, 100.0::DOUBLE * starts_inside / tracks AS starts_inside_percent, 100.0::DOUBLE * ends_inside / tracks AS ends_inside_percent, 100.0::DOUBLE * touching / tracks AS touching_percent FROM e""")
def _(spark, d):
    return regions.endpoint_diagnostics(flagged(spark, d))


@query("direction_rollup", f"WITH {ENDS} SELECT video_id, direction, count(*) AS tracks FROM dirs GROUP BY ROLLUP (video_id, direction)")
def _(spark, d):
    return summary.rollup_directions(directed(spark, d))


_MEASURES = ["num_detections", "duration_sec", "displacement_px", "straightness", "mean_speed_px_sec"]


@query("quality_distributions", f"WITH {PTS}, {sql_summary()}, long AS (" + " UNION ALL ".join(f"SELECT video_id, '{m}' AS measure, CAST({m} AS DOUBLE) AS v FROM sm" for m in _MEASURES) + ") SELECT video_id, measure, count(v) AS n, min(v) AS least, max(v) AS most, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90 FROM long GROUP BY ALL")
def _(spark, d):
    return summary.quality_distributions(summary.summarise(points(spark, d)))


@query("over_merge_suspects", f"WITH {PTS}, {sql_summary()} SELECT video_id, track_id, num_detections, duration_sec, straightness FROM sm WHERE num_detections >= 40 AND duration_sec >= 1.5 AND straightness < 0.2")
def _(spark, d):
    return summary.over_merge_suspects(summary.summarise(points(spark, d)))


@query("smoothed_tracks", f"""WITH {PTS}, q AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY video_id, track_id) AS n, first_value(x) OVER f AS x0, last_value(x) OVER f AS x1, first_value(y) OVER f AS y0, last_value(y) OVER f AS y1,
  sum(x) OVER s AS sx, sum(y) OVER s AS sy FROM pts WINDOW o AS (PARTITION BY video_id, track_id ORDER BY frame), f AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), s AS (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT video_id, track_id, frame, CASE WHEN n < 5 THEN x ELSE (sx + greatest(2 - (i - 1), 0) * x0 + greatest(2 - (n - i), 0) * x1) / 5 END AS x_s, CASE WHEN n < 5 THEN y ELSE (sy + greatest(2 - (i - 1), 0) * y0 + greatest(2 - (n - i), 0) * y1) / 5 END AS y_s FROM q""")
def _(spark, d):
    return windows.smooth(points(spark, d), 5).select("video_id", "track_id", "frame", "x_s", "y_s")


CENTRAL = """cs AS (SELECT *, sqrt((coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) ** 2 + (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) ** 2) / greatest(coalesce(lead(time_sec) OVER w, time_sec) - coalesce(lag(time_sec) OVER w, time_sec), 1e-6) AS speed
  FROM pts WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))"""


@query("central_speed", f"WITH {PTS}, {CENTRAL} SELECT video_id, track_id, frame, speed FROM cs")
def _(spark, d):
    return windows.central_speed(points(spark, d)).select("video_id", "track_id", "frame", "speed")


@query("backward_velocity", f"WITH {PTS} SELECT video_id, track_id, frame, coalesce((x - lag(x) OVER w) / greatest(time_sec - lag(time_sec) OVER w, 1e-6), 0.0) AS vx, coalesce((y - lag(y) OVER w) / greatest(time_sec - lag(time_sec) OVER w, 1e-6), 0.0) AS vy FROM pts WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)")
def _(spark, d):
    return windows.backward_velocity(points(spark, d)).select("video_id", "track_id", "frame", "vx", "vy")


JITTER = 120.0


def stripped(spark, d):
    return windows.strip_jitter(flagged(spark, d), "inside", JITTER, 2)


@query("jitter_runs_removed", f"""WITH {PTS}, {CENTRAL}, f AS (SELECT *, {ad.MASK_TEST_SQL} AND speed < {JITTER} AS noisy FROM cs), c AS (SELECT *, CASE WHEN noisy = lag(noisy) OVER w THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS run FROM c), l AS (SELECT *, noisy AND count(*) OVER (PARTITION BY video_id, track_id, run) >= 2 AS gone, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM r),
  k AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id) AS stay FROM l) SELECT video_id, track_id, frame, x, y FROM k WHERE n < 3 OR stay < 2 OR NOT gone""")
def _(spark, d):
    return stripped(spark, d).select("video_id", "track_id", "frame", "x", "y")


BURST = (22, 4, 3, 1)


@query("burst_suppressed_tracks", f"""WITH {PTS}, c AS (SELECT video_id, frame, count(*) AS n FROM pts GROUP BY ALL), spine AS (SELECT video_id, unnest(generate_series(min(frame), max(frame))) AS f FROM c GROUP BY video_id),
  h AS (SELECT s.video_id, s.f, count(*) AS hits, min(c.frame) AS first FROM spine s JOIN c ON c.video_id = s.video_id AND c.n >= {BURST[0]} AND c.frame BETWEEN s.f - {BURST[1] - 1} AND s.f GROUP BY ALL HAVING count(*) >= {BURST[2]}),
  bad AS (SELECT DISTINCT p.video_id, p.track_id FROM pts p JOIN h ON p.video_id = h.video_id AND p.frame BETWEEN h.first AND h.f + {BURST[3]}) SELECT video_id, track_id, frame, x, y FROM pts p WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.video_id = p.video_id AND b.track_id = p.track_id)""")
def _(spark, d):
    return windows.suppress_bursts(points(spark, d), *BURST).select("video_id", "track_id", "frame", "x", "y")


GATE = (20, 6, 3, 4)


@query("burst_gate_frames", f"""WITH RECURSIVE {PTS}, c0 AS (SELECT video_id, frame, count(*) AS n FROM pts GROUP BY video_id, frame), c AS (SELECT video_id, frame, n >= {GATE[0]} AS hit, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS i FROM c0),
  w AS (SELECT a.video_id, a.frame, a.i, count(*) FILTER (b.hit) >= {GATE[2]} AS fires FROM c a JOIN c b ON a.video_id = b.video_id AND b.frame BETWEEN a.frame - {GATE[1] - 1} AND a.frame GROUP BY ALL),
  g AS (SELECT video_id, frame, i, NOT fires AS keep, CASE WHEN fires THEN frame + {GATE[3] - 1} ELSE -1 END AS until FROM w WHERE i = 1
        UNION ALL SELECT w.video_id, w.frame, w.i, NOT w.fires AND w.frame > g.until, CASE WHEN w.fires AND w.frame > g.until THEN w.frame + {GATE[3] - 1} ELSE g.until END FROM g JOIN w ON w.video_id = g.video_id AND w.i = g.i + 1)
  SELECT video_id, frame, keep FROM g""")
def _(spark, d):
    counts = points(spark, d).groupBy("video_id", "frame").agg(F.count("*").alias("n"))
    return windows.burst_gate(counts, *GATE)


MET = "met AS (SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b, count(*) AS common_frames, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS mean_distance, quantile_cont(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 0.5) AS median_distance, quantile_cont(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 0.9) AS p90_distance FROM pts a JOIN pts b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id GROUP BY ALL)"


@query("same_frame_pairs", f"WITH {PTS}, {MET} SELECT * FROM met")
def _(spark, d):
    return pairs.pair_distances(points(spark, d))


def cosine_sql(ax, ay, bx, by):
    return f"CASE WHEN sqrt({ax} * {ax} + {ay} * {ay}) > 1e-6 AND sqrt({bx} * {bx} + {by} * {by}) > 1e-6 THEN ({ax} * {bx} + {ay} * {by}) / (sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by})) END"


def clip_sql(e):
    return f"greatest(0.0, least(1.0, {e}))"


EDGES = f"""{PTS}, {sql_summary('1e-6')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS i, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM pts),
  third AS (SELECT video_id, track_id, max(CASE WHEN i = least(3, n) THEN x END) AS x3, max(CASE WHEN i = least(3, n) THEN y END) AS y3, max(CASE WHEN i = greatest(1, n - 2) THEN x END) AS xb, max(CASE WHEN i = greatest(1, n - 2) THEN y END) AS yb FROM ranked GROUP BY ALL),
  ed AS (SELECT sm.*, x3 - x_start AS svx, y3 - y_start AS svy, x_end - xb AS evx, y_end - yb AS evy, x_end - x_start AS vecx, y_end - y_start AS vecy FROM sm JOIN third USING (video_id, track_id))"""
SPEED_SIM = f"CASE WHEN greatest(a.mean_speed_px_sec, b.mean_speed_px_sec) <= 1e-6 THEN 1.0 ELSE {clip_sql('least(a.mean_speed_px_sec, b.mean_speed_px_sec) / greatest(a.mean_speed_px_sec, b.mean_speed_px_sec)')} END"
DUP = {"max_spatial": 160.0, "max_gap": 20, "min_direction": 0.3, "min_speed": 0.5}
OVERLAP = f"""ov0 AS (SELECT m.*, m.common_frames / greatest(1, least(a.num_detections, b.num_detections)) AS overlap_ratio_short, coalesce({cosine_sql('a.vecx', 'a.vecy', 'b.vecx', 'b.vecy')}, 1.0) AS ds, {SPEED_SIM} AS ss
  FROM met m JOIN ed a ON a.video_id = m.video_id AND a.track_id = m.track_a JOIN ed b ON b.video_id = m.video_id AND b.track_id = m.track_b),
  ov AS (SELECT *, 0.45 * {clip_sql(f"1 - median_distance / {DUP['max_spatial']}")} + 0.25 * {clip_sql('overlap_ratio_short')} + 0.20 * {clip_sql('(ds + 1) / 2')} + 0.10 * ss AS raw, median_distance > {DUP['max_spatial']} OR ds < {DUP['min_direction']} OR ss < {DUP['min_speed']} AS blocked FROM ov0),
  ovs AS (SELECT *, CASE WHEN blocked THEN least(raw, 0.49) ELSE raw END AS duplicate_score FROM ov)"""


@query("dup_pairs_overlap", f"WITH {EDGES}, {MET}, {OVERLAP} SELECT video_id, track_a, track_b, common_frames, overlap_ratio_short, mean_distance, median_distance, p90_distance, ds AS direction_similarity, ss AS speed_similarity, duplicate_score FROM ovs")
def _(spark, d):
    p = pairs.overlap_pairs(points(spark, d), **DUP)
    return p.select("video_id", "track_a", "track_b", "common_frames", "overlap_ratio_short", "mean_distance", "median_distance", "p90_distance", "direction_similarity", "speed_similarity", "duplicate_score")


def fragments(spark, d):
    """Points with tracks cut where they pause, so that some follow others."""
    s = windows.sessions(points(spark, d), 24)
    return s.withColumn("track_id", F.col("track_id") * 1000 + F.col("session")).drop("session")


FRAG_PTS = PTS.replace("pts AS (", "pts0 AS (") + ", pts AS (SELECT video_id, track_id * 1000 + CAST(sum(g) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS BIGINT) AS track_id, frame, time_sec, x, y, area FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame) > 24 THEN 1 ELSE 0 END AS g FROM pts0) z)"
FRAG_EDGES = EDGES.replace(PTS, FRAG_PTS)
HAND = f"""hp AS (SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b, a.frame_end < b.frame_start AS af, CASE WHEN a.frame_end < b.frame_start THEN b.frame_start - a.frame_end ELSE a.frame_start - b.frame_end END AS gap_frames,
  CASE WHEN a.frame_end < b.frame_start THEN sqrt((a.x_end - b.x_start) * (a.x_end - b.x_start) + (a.y_end - b.y_start) * (a.y_end - b.y_start)) ELSE sqrt((b.x_end - a.x_start) * (b.x_end - a.x_start) + (b.y_end - a.y_start) * (b.y_end - a.y_start)) END AS endpoint_distance,
  coalesce({cosine_sql('a.vecx', 'a.vecy', 'b.vecx', 'b.vecy')}, 1.0) AS whole, coalesce(CASE WHEN a.frame_end < b.frame_start THEN {cosine_sql('a.evx', 'a.evy', 'b.svx', 'b.svy')} ELSE {cosine_sql('b.evx', 'b.evy', 'a.svx', 'a.svy')} END, 1.0) AS local, {SPEED_SIM} AS ss
  FROM ed a JOIN ed b ON a.video_id = b.video_id AND a.track_id < b.track_id AND (a.frame_end < b.frame_start OR b.frame_end < a.frame_start) AND greatest(b.frame_start - a.frame_end, a.frame_start - b.frame_end) <= {DUP['max_gap']}),
  hs AS (SELECT *, least(whole, local) AS ds FROM hp), hr AS (SELECT *, 0.40 * {clip_sql(f"1 - endpoint_distance / {2 * DUP['max_spatial']}")} + 0.20 * {clip_sql(f"1 - (gap_frames - 1) / {float(DUP['max_gap'])}")} + 0.25 * {clip_sql('(ds + 1) / 2')} + 0.15 * ss AS raw, endpoint_distance > {DUP['max_spatial']} OR ds < {DUP['min_direction']} OR ss < {DUP['min_speed']} AS blocked FROM hs),
  hss AS (SELECT *, CASE WHEN blocked THEN least(raw, 0.49) ELSE raw END AS duplicate_score FROM hr)"""


@query("dup_pairs_handoff", f"WITH {FRAG_EDGES}, {HAND} SELECT video_id, track_a, track_b, gap_frames, endpoint_distance, ds AS direction_similarity, ss AS speed_similarity, duplicate_score FROM hss")
def _(spark, d):
    p = pairs.handoff_pairs(fragments(spark, d), **DUP)
    return p.select("video_id", "track_a", "track_b", "gap_frames", "endpoint_distance", "direction_similarity", "speed_similarity", "duplicate_score")


@query("merge_candidates_bandjoin", f"""WITH {FRAG_EDGES} SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b, CASE WHEN a.frame_end < b.frame_start OR b.frame_end < a.frame_start THEN 'handoff' ELSE 'overlap' END AS kind,
  greatest(0, b.frame_start - a.frame_end, a.frame_start - b.frame_end) AS gap_frames FROM ed a JOIN ed b ON a.video_id = b.video_id AND a.track_id < b.track_id AND b.frame_start <= a.frame_end + 8 AND b.frame_end >= a.frame_start - 8
  WHERE CASE WHEN a.frame_end < b.frame_start THEN sqrt((a.x_end - b.x_start) * (a.x_end - b.x_start) + (a.y_end - b.y_start) * (a.y_end - b.y_start)) WHEN b.frame_end < a.frame_start THEN sqrt((b.x_end - a.x_start) * (b.x_end - a.x_start) + (b.y_end - a.y_start) * (b.y_end - a.y_start)) ELSE 0.0 END <= 80.0""")
def _(spark, d):
    c = pairs.merge_candidates(pairs.edges(fragments(spark, d)), 8, 80.0)
    return c.select("video_id", F.col("a_track_id").alias("track_a"), F.col("b_track_id").alias("track_b"), "kind", F.col("gap_frames").cast("long").alias("gap_frames"))


MIN_DUP = 0.65
GROUPS = f"dp AS (SELECT video_id, track_a, track_b FROM ovs WHERE duplicate_score >= {MIN_DUP}), e AS (SELECT video_id, track_a AS a, track_b AS b FROM dp UNION SELECT video_id, track_b, track_a FROM dp), reach AS (SELECT DISTINCT video_id, a AS track_id, a AS r FROM e UNION SELECT reach.video_id, reach.track_id, e.b FROM reach JOIN e ON e.video_id = reach.video_id AND e.a = reach.r), grp AS (SELECT video_id, track_id, min(r) AS group_id FROM reach GROUP BY ALL)"


def dup_overlaps(spark, d):
    return pairs.overlap_pairs(points(spark, d), **DUP)


@query("dedup_groups", f"WITH RECURSIVE {EDGES}, {MET}, {OVERLAP}, {GROUPS} SELECT * FROM grp")
def _(spark, d):
    return grouping.components(dup_overlaps(spark, d).where(F.col("duplicate_score") >= MIN_DUP))


QUALITY = f"0.30 * {clip_sql('num_detections / 12.0')} + 0.25 * {clip_sql('displacement_px / 80.0')} + 0.25 * {clip_sql('path_length_px / 120.0')} + 0.20 * {clip_sql('straightness')}"


@query("dedup_decisions", f"""WITH RECURSIVE {EDGES}, {MET}, {OVERLAP}, {GROUPS}, qual AS (SELECT g.*, row_number() OVER (PARTITION BY g.video_id, g.group_id ORDER BY {QUALITY} DESC, num_detections DESC, path_length_px DESC, g.track_id) AS rk FROM grp g JOIN sm USING (video_id, track_id)),
  best AS (SELECT video_id, group_id, track_id AS best_id FROM qual WHERE rk = 1), sc AS (SELECT video_id, t, max(duplicate_score) AS score FROM (SELECT video_id, track_a AS t, duplicate_score FROM ovs WHERE duplicate_score >= {MIN_DUP} UNION ALL SELECT video_id, track_b, duplicate_score FROM ovs WHERE duplicate_score >= {MIN_DUP}) z GROUP BY ALL)
  SELECT s.video_id, s.track_id AS track_id_original, coalesce(b.best_id, s.track_id) AS track_id_final, g.group_id, CASE WHEN g.group_id IS NULL OR b.best_id = s.track_id THEN 'keep' ELSE 'discard' END AS decision, coalesce(sc.score, 0.0) AS score
  FROM sm s LEFT JOIN grp g ON g.video_id = s.video_id AND g.track_id = s.track_id LEFT JOIN best b ON b.video_id = g.video_id AND b.group_id = g.group_id LEFT JOIN sc ON sc.video_id = s.video_id AND sc.t = s.track_id""")
def _(spark, d):
    return grouping.dedup_decisions(points(spark, d), dup_overlaps(spark, d), "discard", MIN_DUP).select("video_id", "track_id_original", "track_id_final", "group_id", "decision", "score")


@query("secondary_antijoin_renumbered", f"""WITH {PTS}, p AS (SELECT * FROM pts WHERE track_id % 2 = 0), s AS (SELECT * FROM pts WHERE track_id % 2 = 1), size AS (SELECT video_id, track_id, count(*) AS n FROM s GROUP BY ALL),
  m AS (SELECT s.video_id, s.track_id, p.track_id AS pid, count(*) AS c, avg(sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y))) AS dd FROM s JOIN p ON s.video_id = p.video_id AND s.frame = p.frame GROUP BY ALL),
  bad AS (SELECT DISTINCT m.video_id, m.track_id FROM m JOIN size USING (video_id, track_id) WHERE c >= 3 AND c / n >= 0.04 AND dd <= 120.0), kept AS (SELECT video_id, track_id, 1000000 + row_number() OVER (PARTITION BY video_id ORDER BY track_id) - 1 AS new_id FROM size WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.video_id = size.video_id AND bad.track_id = size.track_id))
  SELECT s.video_id, new_id AS track_id, frame, x, y FROM s JOIN kept USING (video_id, track_id)""")
def _(spark, d):
    p = points(spark, d)
    return pairs.secondary_only(p.where("track_id % 2 = 0"), p.where("track_id % 2 = 1"), 120.0, 3, 0.04).select("video_id", "track_id", "frame", "x", "y")


@query("clip_frame_intervals", f"WITH {PTS}, {sql_summary()} SELECT s.video_id, s.track_id, f.frame FROM sm s JOIN (SELECT DISTINCT video_id, frame FROM pts) f ON f.video_id = s.video_id AND f.frame BETWEEN greatest(s.frame_start - 3, 0) AND s.frame_end + 3")
def _(spark, d):
    p = points(spark, d)
    return pairs.clip_frames(p, p.select("video_id", "frame").distinct(), 3)


FAST = {"max_source_duration_sec": 28.0, "min_source_straightness": 0.02, "min_source_track_points": 40, "max_group_gap_frames": 45, "max_group_endpoint_distance": 30.0, "max_group_overlap_distance": 5.0, "min_event_displacement": 10.0}
FAST_WHERE = "duration_sec <= 28.0 AND num_detections >= 40 AND straightness >= 0.02 AND (displacement_px >= 35.0 OR path_length_px >= 60.0 OR mean_speed_px_sec >= 80.0)"


@query("fast_source_selection", f"WITH {PTS}, {sql_summary()} SELECT video_id, track_id, num_detections, duration_sec, displacement_px FROM sm WHERE {FAST_WHERE}")
def _(spark, d):
    return fe.select_sources(points(spark, d), assessed(spark, d), fe.DEFAULTS | FAST).select("video_id", "track_id", "num_detections", "duration_sec", "displacement_px")


def _d4(p, q):
    return f"sqrt((a.x_{p} - b.x_{q}) * (a.x_{p} - b.x_{q}) + (a.y_{p} - b.y_{q}) * (a.y_{p} - b.y_{q}))"


@query("fast_candidate_groups", f"""WITH RECURSIVE {PTS}, {sql_summary()}, src AS (SELECT * FROM sm WHERE {FAST_WHERE}), dp AS (SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b FROM src a JOIN src b ON a.video_id = b.video_id AND a.track_id < b.track_id AND greatest(0, b.frame_start - a.frame_end, a.frame_start - b.frame_end) <= 45 WHERE least({_d4('start', 'start')}, {_d4('start', 'end')}, {_d4('end', 'start')}, {_d4('end', 'end')}) <= 30.0),
  e AS (SELECT video_id, track_a AS a, track_b AS b FROM dp UNION SELECT video_id, track_b, track_a FROM dp), reach AS (SELECT video_id, track_id, track_id AS r FROM src UNION SELECT reach.video_id, reach.track_id, e.b FROM reach JOIN e ON e.video_id = reach.video_id AND e.a = reach.r)
  SELECT video_id, track_id, min(r) AS group_id FROM reach GROUP BY ALL""")
def _(spark, d):
    cfg = fe.DEFAULTS | FAST
    rows = assessed(spark, d).where(fe.is_fast(cfg))
    return fe.grouped(rows, fe.group_pairs(rows, cfg)).select("video_id", "track_id", "group_id")


def merges_of(spark, d):
    return merging.auto_merges(fragments(spark, d), max_endpoint=60.0, max_group=6)


@query("motion_rescue", f"""WITH {ASSESS}, fl AS (SELECT DISTINCT video_id, track_id FROM pts WHERE {ad.MASK_TEST_SQL}), ok AS (SELECT a.video_id, a.track_id FROM ass a JOIN fl USING (video_id, track_id) WHERE len(reasons) > 0 AND len(list_intersect(reasons, ['min_track_displacement', 'loiter', 'static_noise', 'min_track_straightness'])) = len(reasons) AND path_length_px >= 24.0 AND mean_speed_px_sec >= 60.0)
  SELECT video_id, track_id, frame, x, y FROM pts JOIN (SELECT video_id, track_id FROM ass WHERE len(reasons) = 0 UNION SELECT * FROM ok) k USING (video_id, track_id)""")
def _(spark, d):
    p, a = points(spark, d), assessed(spark, d)
    touching = regions.flag_in_box(p, ad.MASK).where("inside")
    out = filters.rescue_by_motion(filters.accepted_points(p, a), p, a, touching, ("min_track_displacement", "loiter", "static_noise", "min_track_straightness"), min_displacement=0.0, min_speed=60.0)
    return out.select("video_id", "track_id", "frame", "x", "y")


@query("trail_coherent_points", f"""WITH {PTS}, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame) > 12 THEN 1 ELSE 0 END AS g FROM pts), s AS (SELECT *, sum(g) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS s FROM g),
  st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS step FROM s WINDOW w AS (PARTITION BY video_id, track_id, s ORDER BY frame)),
  h AS (SELECT *, count(*) OVER l AS n, sum(step) OVER p AS path, max(step) OVER p AS big, first_value(x) OVER l AS fx, first_value(y) OVER l AS fy, max(x) OVER l - min(x) OVER l AS rx, max(y) OVER l - min(y) OVER l AS ry FROM st
    WINDOW l AS (PARTITION BY video_id, track_id, s ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), p AS (PARTITION BY video_id, track_id, s ORDER BY frame ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
  q AS (SELECT *, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) AS dd FROM h)
  SELECT video_id, track_id, frame, n >= 3 AND path >= 14.0 AND dd >= 10.0 AND CASE WHEN path > 1e-6 THEN dd / path ELSE 1.0 END >= 0.2 AND sqrt(rx * rx + ry * ry) >= 14.0 AND big >= 4.0 AS coherent FROM q""")
def _(spark, d):
    return windows.coherent_trails(points(spark, d), max_gap=12).select("video_id", "track_id", "frame", "coherent")


@query("sessionised_tracks", f"WITH {PTS}, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame) > 24 THEN 1 ELSE 0 END AS g FROM pts), s AS (SELECT *, CAST(sum(g) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS BIGINT) AS session FROM g) SELECT video_id, track_id, session, count(*) AS points, min(frame) AS first_frame, max(frame) AS last_frame FROM s GROUP BY ALL")
def _(spark, d):
    return windows.sessions(points(spark, d), 24).groupBy("video_id", "track_id", "session").agg(F.count("*").alias("points"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


DET = f"{ad.RAW_SQL}, det AS (SELECT video_id, frame, x, y, area FROM raw)"


@query("detection_totals", f"WITH {DET}, c AS (SELECT video_id, frame, count(*) AS n FROM det GROUP BY ALL) SELECT video_id, CAST(sum(n) AS BIGINT) AS detections_total, count(*) AS frames_with_detections, max(n) AS most_in_a_frame FROM c GROUP BY video_id")
def _(spark, d):
    return summary.detection_totals(ad.detections(spark, d))


@query("detection_filters", f"WITH {DET}, f AS (SELECT * FROM det WHERE area BETWEEN 6 AND 30 AND x >= 5 AND y <= 90), c AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame) AS n FROM f) SELECT video_id, frame, x, y, area FROM c WHERE n <= 14")
def _(spark, d):
    kept = filters.by_roi(filters.by_area(ad.detections(spark, d), 6, 30), x_min=5, y_max=90)
    return filters.drop_crowded_frames(kept, 14).select("video_id", "frame", "x", "y", "area")


@query("detection_fusion_antijoin", f"WITH {DET}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY seq) - 1 AS i FROM raw), p AS (SELECT * FROM n WHERE i % 2 = 0), s AS (SELECT * FROM n WHERE i % 2 = 1) SELECT video_id, frame, x, y FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = s.video_id AND p.frame = s.frame AND sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 8.0)")
def _(spark, d):
    det = ad.detections(spark, d)
    p = det.where("det_idx % 2 = 0").select("video_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"))
    s = det.where("det_idx % 2 = 1")
    near = s.join(p, ["video_id", "frame"]).where("sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= 8.0").select("video_id", "frame", "det_idx").distinct()
    return s.join(near, ["video_id", "frame", "det_idx"], "left_anti").select("video_id", "frame", "x", "y")


@query("kalman_tracks")
def _(spark, d):
    return tracking.track(ad.detections(spark, d), "kalman", max_distance=40.0, max_missed=3, fps=ad.FPS)


@query("greedy_tracks")
def _(spark, d):
    return tracking.track(ad.detections(spark, d), "greedy", max_distance=40.0, max_missed=3, fps=ad.FPS)


@query("background_median", f"WITH {ad.FRAMES_SQL} SELECT 'v0' AS video_id, x, y, quantile_cont(v, 0.5) AS v FROM frames GROUP BY x, y")
def _(spark, d):
    return pixels.background_median(ad.frames(spark, d))


HEAT = f"{ad.FRAMES_SQL}, df AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY x, y ORDER BY frame)) AS dv FROM frames), heat AS (SELECT 'v0' AS video_id, x, y, coalesce(sum(CASE WHEN dv > 0.05 THEN dv END), 0.0) AS energy FROM df GROUP BY x, y)"


def heat_of(spark, d):
    return pixels.motion_energy(ad.frames(spark, d), 0.05)


@query("motion_heatmap", f"WITH {HEAT} SELECT * FROM heat")
def _(spark, d):
    return heat_of(spark, d)


@query("heatmap_percentile_mask", f"WITH {HEAT} SELECT video_id, x, y FROM heat WHERE energy > 1e-6 AND energy >= (SELECT quantile_cont(energy, 0.8) FROM heat WHERE energy > 1e-6)")
def _(spark, d):
    return pixels.above_percentile(heat_of(spark, d), 80.0)


@query("heatmap_normalised", f"WITH {HEAT} SELECT video_id, x, y, energy, pow(least(energy / (SELECT quantile_cont(energy, 0.975) FROM heat WHERE energy > 0), 1.0), 0.75) AS heat FROM heat")
def _(spark, d):
    return pixels.normalised_heat(heat_of(spark, d))


@query("column_profile", f"WITH {ad.FRAMES_SQL}, bg AS (SELECT x, y, quantile_cont(v, 0.5) AS v FROM frames GROUP BY x, y) SELECT 'v0' AS video_id, x, avg(v) AS v FROM bg GROUP BY x")
def _(spark, d):
    return pixels.column_profile(pixels.background_median(ad.frames(spark, d)))


@query("dilated_mask", f"WITH {HEAT}, m AS (SELECT video_id, x, y FROM heat WHERE energy >= (SELECT quantile_cont(energy, 0.8) FROM heat)) SELECT DISTINCT video_id, CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM m, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7")
def _(spark, d):
    return pixels.dilate(pixels.above_percentile(heat_of(spark, d), 80.0, positive=False), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], (8, 8))


def background_of(spark, d):
    return pixels.background_median(ad.frames(spark, d))


@query("big_track_summary", f"""WITH raw AS (SELECT 'v0' AS video_id, l_suppkey AS track_id, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, CAST(l_partkey % 37 + 1 AS DOUBLE) AS area, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
  pts AS (SELECT video_id, track_id, frame, frame / 25.0 AS time_sec, x, y, area FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY area DESC, x, y, seq) AS rn FROM raw) q WHERE rn = 1), {sql_summary()} SELECT video_id, track_id, frame_start, frame_end, num_detections, path_length_px, displacement_px FROM sm""")
def _(spark, d):
    return summary.summarise(summary.consolidate(ad.big_points(spark, d), "seq")).select("video_id", "track_id", "frame_start", "frame_end", "num_detections", "path_length_px", "displacement_px")
