import json
import xml.dom.minidom

from pyspark.sql import functions as F

from flightloom.operators import grouping, tracking
from flightloom.plans import catalog, image_queries
from flightloom.sources import adapters, readers, sinks
from flightloom.streaming import stateful
from tests.test_tracks import dets, line, points


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(f, i, 10 * f + 100 * i, 50 + 3 * i * f) for f in range(20) for i in range(2)]
    batch = {(r.track_id, r.frame, r.x) for r in tracking.track(dets(spark, rows), "kalman", max_missed=4).collect()}
    for k in range(4):
        dets(spark, [r for r in rows if r[0] // 5 == k]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(readers.DETECTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.track_stream(stream, "kalman", max_missed=4).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.track_id, r.frame, r.x) for r in spark.table("tracked").collect()} == batch


def test_rows_of_a_stream_are_files(spark, tmp_path):
    """What a stream appends is not held by the driver, and comes whole; a stream without rows gives none."""
    p = points(spark, (1, line(0, 9, 0, 0, 10)), (2, line(3, 8, 0, 50, 10))).select("video_id", "track_id", "frame", "x", "y")
    out = image_queries.gathered(spark, stateful.trail_stream(image_queries.in_batches(spark, p, "frame"), max_gap=12, idle_ms=None))
    assert out.inputFiles() and out.count() == 17
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema(p.schema).parquet(str(tmp_path / "none"))
    assert image_queries.gathered(spark, stateful.trail_stream(none, idle_ms=None)).count() == 0


def test_exports(spark, tmp_path):
    p = points(spark, (1, line(0, 5, 0, 0, 10)), (2, line(0, 4, 0, 50, 10)))
    sinks.export_tracks(p, str(tmp_path / "tracks"))
    assert readers.tracks_csv(spark, str(tmp_path / "tracks")).count() == 9
    sinks.export_events(p, str(tmp_path / "events"))
    assert {r.track_id for r in readers.events_csv(spark, str(tmp_path / "events")).collect()} == {1, 2}
    for name, rows in (("full", p), ("empty", p.where("false"))):
        sinks.export_svg(rows, "v", (100, 100), str(tmp_path / f"{name}.svg"))
        assert xml.dom.minidom.parse(str(tmp_path / f"{name}.svg")).getElementsByTagName("polyline").length == (2 if name == "full" else 0)
    assert json.loads(sinks.render_payload(p).first().value)["tracks_total"] == 2


def test_pairs_of_decisions_are_a_document_each(spark, tmp_path):
    """All pairs come, as rows of their own in as many files as they have tasks; the totals beside them."""
    kind = "video_id string, track_a long, track_b long, relation string, reason string, duplicate_score double"
    found = spark.createDataFrame([("v", a, b, "overlap", "overlap_close", 0.9) for a in range(1, 9) for b in range(a + 1, 9)], kind).repartition(3)
    p = points(spark, *((i, line(0, 5, 0, 10 * i, 10)) for i in range(1, 10)))
    sinks.export_decisions(grouping.dedup_decisions(p, found, "discard", 0.65), found, str(tmp_path / "csv"), str(tmp_path / "json"))
    pairs = spark.read.schema(kind).json(str(tmp_path / "json_pairs"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, found.collect())) and len(pairs.inputFiles()) == 3
    assert spark.read.json(str(tmp_path / "json")).first().asDict() == {"video_id": "v", "groups_total": 1, "tracks_discarded": 7, "tracks_merged": 0, "pairs_total": 28}
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 9


def test_a_clip_is_one_file(spark, tmp_path):
    """However many tasks hold its frames."""
    frames = spark.range(40).selectExpr("'v' as video_id", "id as frame", "1 as x", "2 as y", "id * 0.5 as v").repartition(4, "frame")
    clips = spark.range(200).selectExpr("'v' as video_id", "id % 5 as track_id", "id div 5 as frame")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    sinks.clip_table(frames, clips, str(tmp_path / "clips"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert [len(list(f.glob("*.parquet"))) for f in (tmp_path / "clips" / "video_id=v").iterdir()] == [1] * 5
    assert spark.read.parquet(str(tmp_path / "clips")).count() == 200


def test_clips_of_all_tracks(spark, monkeypatch):
    """Every track of the table has its clip, with all pixels of its frames, images broadcast or not."""
    d = "/root/testdata/sf0.001"
    p = catalog.points(spark, d)
    own = p.groupBy("track_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    at = adapters.frames(spark, d).select("frame").distinct()
    want = {r[0]: 64 * r[1] for r in own.join(at, F.col("frame").between(F.col("a") - 2, F.col("b") + 2)).groupBy("track_id").count().collect()}
    for size in (sinks.IMAGE_BYTES, 0):
        monkeypatch.setattr(sinks, "IMAGE_BYTES", size)
        assert {r.track_id: r.pixels for r in image_queries.QUERIES["track_clips"](spark, d).collect()} == want and len(want) == p.select("track_id").distinct().count()


def test_render_documents(spark, tmp_path):
    """A JSON document for each video, written as its tracks come, with the corners of the regions' contours."""
    p = points(spark, (3, line(0, 5, 0, 0, 10)), (2, line(2, 4, 0, 50, 10)))
    both = p.unionByName(p.withColumn("video_id", F.lit("w")).where("track_id = 2"))
    box = spark.createDataFrame([("v", x, y) for x in range(3, 9) for y in range(4, 7)] + [("v", 20, 20)], "video_id string, x int, y int")
    directions = spark.createDataFrame([("v", 2, "entry")], "video_id string, track_id long, direction string")
    done = sinks.export_render(both, str(tmp_path / "render"), (100, 80), directions, valid=box).collect()
    assert {(r.video_id, r.tracks) for r in done} == {("v", 2), ("w", 1)}
    v, w = (json.loads((tmp_path / "render" / f"{n}.json").read_text()) for n in ("v", "w"))
    assert (v["width"], v["height"]) == (100, 80) and [t["track_id"] for t in v["tracks"]] == [2, 3] and "entry_exit_region" not in v
    corners = [{(q["x"], q["y"]) for q in c} for c in v["valid_region"]["contours"]]
    assert corners == [{(3, 4), (8, 4), (8, 6), (3, 6)}, {(20, 20)}]
    first, second = v["tracks"]
    assert first["direction"] == "entry" and second["direction"] == "unknown" and second["point_start"] == second["points"][0] and len(second["points"]) == 5
    assert second["frame_end"] - second["frame_start"] == 4 and first["duration_sec"] == first["point_end"]["time_sec"] - first["point_start"]["time_sec"]
    assert len(w["tracks"]) == 1 and "valid_region" not in w
    assert sinks.export_render(both.where("false"), str(tmp_path / "none"), (1, 1)).count() == 0


def test_render_documents_of_a_large_video(spark, tmp_path, monkeypatch):
    """Its tracks come in several whole documents, each track once, in order, with the same head."""
    monkeypatch.setattr(sinks, "RENDER_POINTS", 12)
    p = points(spark, *((i, line(0, 5, 0, 10 * i, 10)) for i in range(1, 10)))
    done = sinks.export_render(p, str(tmp_path / "render"), (100, 80)).collect()
    docs = [json.loads(f.read_text()) for f in (tmp_path / "render").iterdir()]
    assert len(done) == len(docs) == 4 and sum(r.tracks for r in done) == 9 and (tmp_path / "render" / "v.json").exists()
    ids = [[t["track_id"] for t in d["tracks"]] for d in docs]
    assert sorted(sum(ids, [])) == list(range(1, 10)) and all(i == sorted(i) for i in ids) and max(map(len, ids)) < 9
    assert all((d["video_id"], d["width"], d["height"]) == ("v", 100, 80) for d in docs)


def test_review_regions_and_removal(spark, tmp_path):
    d = str(tmp_path)
    merges = spark.createDataFrame([("v", 1, 2, 1, "overlap")], "video_id string, track_a long, track_b long, merged_to long, reason string")
    a = spark.createDataFrame([("v", 1, True, []), ("v", 3, False, ["loiter", "static_noise"])], "video_id string, track_id long, accepted boolean, reject_reasons array<string>")
    px = spark.createDataFrame([("v", 1, 2), ("v", 1, 3)], "video_id string, x int, y int")
    sinks.export_review(merges, a, px, d)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{d}/suppressions").collect()] == [("v", "3", "loiter;static_noise")]
    assert spark.read.parquet(f"{d}/mask").count() == 2 and spark.read.json(f"{d}/summary").first().overlap == 1
    zones = spark.createDataFrame([("v", 1, 0.5)], "video_id string, zone_id long, score double")
    sinks.export_zones(zones, zones.select("video_id", "score"), d)
    sinks.extend_diagnostics(spark, d, spark.createDataFrame([("v", 7, 0.75)], "video_id string, starts_inside long, score double"))
    row = spark.read.json(f"{d}/zone_diagnostics").first()
    assert (row.video_id, row.starts_inside, row.score) == ("v", 7, 0.75) and spark.read.json(f"{d}/zones").first().score == 0.5
    sinks.export_region(px, px.groupBy("video_id", "x").count(), d)
    assert spark.read.parquet(f"{d}/region").count() == 2
    assert sinks.remove_outputs(spark, d, ["region", "profile", "nothing"]) == ["region", "profile"]
    kind = "struct<x:double,y:double>"
    events = spark.createDataFrame([("v", 1, 10, 20, [(0.0, 0.0), (1.0, 1.0), (2.0, 4.0)])], f"video_id string, event_id long, frame_start long, frame_end long, points array<{kind}>")
    sinks.export_heatmap_events(events, d)
    assert [r.frame_est for r in spark.read.option("header", True).csv(f"{d}/heatmap_tracks").orderBy("point_index").collect()] == ["10.0", "15.0", "20.0"]
