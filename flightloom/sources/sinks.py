"""Sinks: CSV, JSON and SVG exports, review tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.functions.expressions import colour, join_list
from flightloom.operators.dense import mapped
from flightloom.operators.fast_events import event_points
from flightloom.operators.pixels import label_image, outlines
from flightloom.operators.summary import KEY, merge_summary, summarise
from flightloom.sources.scratch import dropped, written
from flightloom.sources.video_files import file_system

POINT_COLUMNS = ["video_id", "track_id", "frame", "time_sec", "x", "y", "vx", "vy", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "area"]


def write_csv(rows: DataFrame, path: str, order: list[str], single: bool = True) -> None:
    """A CSV folder with a header: arrays as ';' lists, nulls empty. One file is
    for people; ``single=False`` keeps the sorted ranges apart."""
    flat = rows.select(*(join_list(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes)).orderBy(*order)
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_tracks(points: DataFrame, path: str) -> None:
    write_csv(points.select(*(c for c in POINT_COLUMNS if c in points.columns)), path, KEY + ["frame"])


def export_events(points: DataFrame, path: str) -> None:
    write_csv(summarise(points), path, KEY)


def export_assessments(assessments: DataFrame, path: str) -> None:
    write_csv(assessments, path, KEY)


def export_decisions(decisions: DataFrame, pairs: DataFrame, csv_path: str, json_path: str) -> None:
    """The audit of the duplicate search: a row a track (in sorted ranges, as a row lists its whole group), a document with
    the totals of each video, and beside it (``<json_path>_pairs``) a document a pair, as no row holds all pairs of a video.
    Both tables are read more than once: give written ones."""
    write_csv(decisions, csv_path, ["video_id", "track_id_original"], single=False)
    totals = decisions.groupBy("video_id").agg(F.count_distinct("group_id").alias("groups_total"), F.count(F.when(F.col("decision") == "discard", 1)).alias("tracks_discarded"), F.count(F.when((F.col("decision") == "merge") & (F.col("track_id_final") != F.col("track_id_original")), 1)).alias("tracks_merged"))
    totals.join(pairs.groupBy("video_id").agg(F.count("*").alias("pairs_total")), "video_id", "left").select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(json_path)
    pairs.select(F.to_json(F.struct("video_id", "track_a", "track_b", "relation", "reason", "duplicate_score")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{json_path}_pairs")


def export_fast_events(events: DataFrame, folder: str) -> None:
    write_csv(events.drop("points"), f"{folder}/fast_events", ["video_id", "event_id"])
    write_csv(event_points(events), f"{folder}/fast_tracks", ["video_id", "event_id", "point_index"])


def heatmap_tracks(events: DataFrame) -> DataFrame:
    """Points of heatmap events (points array<struct<x,y>>) with the frame that lies
    as far between the first and the last."""
    n = F.greatest(F.size("points") - 1, F.lit(1))
    p = events.select("video_id", "event_id", "frame_start", "frame_end", n.alias("_n"), F.posexplode("points").alias("point_index", "p"))
    return p.select("video_id", "event_id", "point_index", (F.col("frame_start") + (F.col("frame_end") - F.col("frame_start")) * F.col("point_index") / F.col("_n")).alias("frame_est"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def render_payload(points: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """video_id, value: a JSON document of the tracks, their points and colours."""
    t = points.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("frame", "time_sec", "x", "y", "area"))).alias("points"))
    t = t.join(directions.select(*KEY, "direction"), KEY, "left") if directions is not None else t.withColumn("direction", F.lit("unknown"))
    t = t.withColumn("color", colour(F.col("track_id")))
    doc = t.groupBy("video_id").agg(F.count("*").alias("tracks_total"), F.sort_array(F.collect_list(F.struct("track_id", "direction", "color", "points"))).alias("tracks"))
    return doc.select("video_id", F.to_json(F.struct("*")).alias("value"))


def svg_tracks(points: DataFrame, width: float = 1.0) -> DataFrame:
    """video_id, track_id, svg: a group with line, ends and label of each track."""
    n = lambda c: F.format_string("%.2f", c if not isinstance(c, str) else F.col(c))
    t = points.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y"))).alias("p"))
    t = t.withColumns({"line": F.array_join(F.transform("p", lambda q: F.concat(n(q["x"]), F.lit(","), n(q["y"]))), " "), "a": F.col("p")[0], "b": F.element_at("p", -1), "c": colour(F.col("track_id"))})
    svg = F.concat(
        F.lit('<g id="track-'), F.col("track_id").cast("string"), F.lit('"><polyline fill="none" stroke="'), F.col("c"), F.lit(f'" stroke-width="{1.5 * width:g}" points="'), F.col("line"), F.lit('"/><circle r="3" fill="'), F.col("c"), F.lit('" cx="'), n(F.col("a.x")), F.lit('" cy="'), n(F.col("a.y")),
        F.lit('"/><circle r="2" fill="'), F.col("c"), F.lit('" cx="'), n(F.col("b.x")), F.lit('" cy="'), n(F.col("b.y")), F.lit('"/><text x="'), n(F.col("b.x")), F.lit('" y="'), n(F.col("b.y")), F.lit('">'), F.col("track_id").cast("string"), F.lit("</text></g>"),
    )
    return t.select(*KEY, svg.alias("svg"))


def export_svg(points: DataFrame, video_id: str, size: tuple[int, int], path: str) -> None:
    """One video's drawing (its tracks' groups come to the driver); valid without any track."""
    groups = [r.svg for r in svg_tracks(points.where(F.col("video_id") == video_id)).orderBy("track_id").toLocalIterator()]
    body = "\n".join(groups)
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" viewBox="0 0 {size[0]} {size[1]}">\n{body}\n</svg>\n', encoding="utf-8")


def _documents(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_zones(zones: DataFrame, diagnostics: DataFrame, folder: str) -> None:
    _documents(zones, f"{folder}/zones")
    _documents(diagnostics, f"{folder}/zone_diagnostics")


def extend_diagnostics(spark: SparkSession, folder: str, more: DataFrame) -> None:
    """Adds the columns of ``more`` (a row a video) to the written diagnostics, over
    those of the same names; the old folder is replaced once the new one is whole."""
    old = spark.read.json(f"{folder}/zone_diagnostics")
    kept = [c for c in old.columns if c == "video_id" or c not in more.columns]
    _documents(old.select(*kept).join(more, "video_id", "left"), f"{folder}/zone_diagnostics.new")
    fs, path = _files(spark, folder)
    fs.delete(path(f"{folder}/zone_diagnostics"), True)
    fs.rename(path(f"{folder}/zone_diagnostics.new"), path(f"{folder}/zone_diagnostics"))


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def make_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _files(spark, folder)
    fs.mkdirs(path(folder))


def remove_outputs(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Removes the named outputs of a run (debug tables); gives those that were there."""
    fs, path = _files(spark, folder)
    return [n for n in names if fs.delete(path(f"{folder}/{n}"), True)]


def export_heatmap_events(events: DataFrame, folder: str) -> None:
    write_csv(events.drop("points"), f"{folder}/heatmap_events", ["video_id", "event_id"])
    write_csv(heatmap_tracks(events), f"{folder}/heatmap_tracks", ["video_id", "event_id", "point_index"])


def export_region(region: DataFrame, profile: DataFrame, folder: str) -> None:
    """The pixels of a region and the column profile that it was found by, as tables."""
    region.select("video_id", "x", "y").write.mode("overwrite").parquet(f"{folder}/region")
    write_csv(profile, f"{folder}/profile", ["video_id", "x"])


def export_meta(path: str, config: dict, metrics: DataFrame, outputs: dict[str, str]) -> None:
    """The run's documents, a text folder with one for each video: settings, its row of metrics, outputs."""
    shared = {"config": json.dumps(config, default=str), "outputs": json.dumps(outputs, default=str)}
    head = F.lit('{"config": ' + shared["config"] + ', "outputs": ' + shared["outputs"] + ', "metrics": ')
    metrics.select(F.concat(head, F.to_json(F.struct("*")), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def contours_json(region: DataFrame, name: str) -> DataFrame:
    """video_id and a column of a region's contours (corners of the outlines of its parts) as JSON. A group is one video's image."""

    def corners(path: list[tuple[int, int]]) -> list[dict]:
        n = len(path)
        step = [(path[(i + 1) % n][0] - path[i][0], path[(i + 1) % n][1] - path[i][1]) for i in range(n)]
        return [{"x": x, "y": y} for i, (x, y) in enumerate(path) if n < 3 or step[i] != step[i - 1]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.x.min()), int(pdf.y.min())
        image = np.zeros((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1), bool)
        image[pdf.y - y0, pdf.x - x0] = True
        found = [corners([(x + x0, y + y0) for x, y in p]) for p in outlines(label_image(image))]
        return pd.DataFrame({"video_id": pdf.video_id.iloc[:1], name: [json.dumps({"contours": found})]})

    return region.select("video_id", "x", "y").groupBy("video_id").applyInPandas(run, f"video_id string, {name} string")


#: Points of a render document; a video with more is written as several.
RENDER_POINTS = 500_000


def export_render(points: DataFrame, folder: str, size: tuple[int, int], directions: DataFrame | None = None, valid: DataFrame | None = None, entry: DataFrame | None = None) -> DataFrame:
    """Writes ``<folder>/<video>.json``: size, contours of the regions, and every track with its ends, colour, direction and
    points. A document is written as its tracks come, in their order, so a task holds a batch of tracks and
    never a video. A video of more than ``RENDER_POINTS`` points has further documents (``<video>.part-<n>.json``) with the same
    head, each of a share of its tracks. video_id, path, tracks of the documents, once they are written."""
    point = F.struct("x", "y", "frame", "time_sec")
    t = points.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("frame", point.alias("p")))).alias("s"))
    t = t.join(directions.select(*KEY, "direction"), KEY, "left") if directions is not None else t.withColumn("direction", F.lit(None).cast("string"))
    first, last = F.col("s")[0], F.element_at("s", -1)
    doc = F.struct(
        "track_id", colour(F.col("track_id")).alias("color"), first["frame"].alias("frame_start"), last["frame"].alias("frame_end"), (last["p"]["time_sec"] - first["p"]["time_sec"]).alias("duration_sec"),
        F.coalesce("direction", F.lit("unknown")).alias("direction"), first["p"].alias("point_start"), last["p"].alias("point_end"), F.col("s.p").alias("points"),
    )
    # a video without points has no row here, so none has no part
    sizes = points.groupBy("video_id").agg(F.ceil(F.count("*") / RENDER_POINTS).cast("long").alias("_parts"))
    rows = t.join(F.broadcast(sizes.withColumnRenamed("video_id", "_v")), F.col("video_id").eqNullSafe(F.col("_v"))).select("video_id", F.pmod(F.xxhash64("track_id"), "_parts").alias("part"), "track_id", F.to_json(doc).alias("value"))
    heads = sizes
    for name, region in (("valid_region", valid), ("entry_exit_region", entry)):
        heads = heads.join(contours_json(region, name), "video_id", "left") if region is not None else heads.withColumn(name, F.lit(None).cast("string"))
    part = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f', "{c}": '), F.col(c))).otherwise("")
    name = F.to_json(F.struct("video_id"), {"ignoreNullFields": "false"})
    head = F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit(f', "width": {int(size[0])}, "height": {int(size[1])}'), part("valid_region"), part("entry_exit_region"), F.lit(', "tracks": ['))
    part_of = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part")
    rows = rows.unionByName(heads.select("video_id", part_of, F.lit(None).cast("long").alias("track_id"), head.alias("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        open_now, out, done = None, None, []
        for batch in batches:
            for video, share, track, value in zip(*(batch.column(c).to_pylist() for c in ("video_id", "part", "track_id", "value"))):
                if (video, share) != open_now:
                    if out is not None:
                        out.write(b"]}")
                        out.close()
                    open_now, path = (video, share), f"{root}/{video}.part-{share}.json" if share else f"{root}/{video}.json"
                    out = system.open_output_stream(path)
                    done.append([video, path, 0])
                if track is not None:
                    out.write(b", " if done[-1][2] else b"")
                    done[-1][2] += 1
                out.write(value.encode())
        if out is not None:
            out.write(b"]}")
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["video_id", "path", "tracks"])

    # the head, without a track, sorts first
    return mapped(rows.repartition("video_id", "part").sortWithinPartitions("video_id", "part", F.asc_nulls_first("track_id")), run, "video_id string, path string, tracks long")


#: Images of all clips' frames up to so many bytes are broadcast; a task writes about so many bytes of clips.
IMAGE_BYTES, CLIP_BYTES = 32 << 20, 256 << 20


def clip_table(frames: DataFrame, clips: DataFrame, path: str) -> None:
    """Frames of each track's clip (a row a frame: its pixels as lists x, y, v), a folder a track; a task writes whole
    clips, so there are as many files as tracks. Clips hold each image as often as tracks cross it, so only their keys are dealt
    by track, and small images (they are measured) meet them there; larger ones are joined by frame before."""
    spark, key = frames.sparkSession, ["video_id", "frame"]
    pixels = F.sort_array(F.collect_list(F.struct("y", "x", "v")))
    images = written(frames.groupBy(*key).agg(pixels.alias("p")).select(*key, *(F.col(f"p.{c}").alias(c) for c in "xyv")), "images")
    clips = written(clips, "clips")
    count, size = images.agg(F.count("*"), 16 * F.sum(F.size("v"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-clips.count() * (size or 0) // max(count, 1) // CLIP_BYTES))
    small = (size or 0) <= IMAGE_BYTES
    rows = clips if small else clips.join(images, key)
    rows = rows.repartition(parts, *KEY).sortWithinPartitions(*KEY)
    rows = rows.join(F.broadcast(images), key) if small else rows
    # a clip holds an image once, so a dictionary of values is of no use
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary#v.list.element", "false").partitionBy(*KEY).parquet(path)
    dropped(images, clips)


def review_tables(merges: DataFrame, assessments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suggested merges, suppressions, summary of the merges) of a review."""
    return merges.select("video_id", "track_a", "track_b", "merged_to", "reason"), assessments.where(~F.col("accepted")).select(*KEY, "reject_reasons"), merge_summary(merges)


def export_review(merges: DataFrame, assessments: DataFrame, region: DataFrame | None, folder: str) -> None:
    """What a reviewer takes away: merge pairs, suppressions, the mask if there is one, a summary."""
    suggested, suppressed, totals = review_tables(merges, assessments)
    write_csv(suggested, f"{folder}/suggested_merges", ["video_id", "track_a", "track_b"])
    write_csv(suppressed, f"{folder}/suppressions", KEY)
    _documents(totals, f"{folder}/summary")
    if region is not None:
        region.select("video_id", "x", "y").write.mode("overwrite").parquet(f"{folder}/mask")
