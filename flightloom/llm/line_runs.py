"""Line dedup over levelled sorted runs of line hashes (operator 11), in DataFrame functions alone.

A run is a table of line keys (two 64-bit hashes, in how many documents, the largest
of these), sorted and bucketed by key, so that runs are merged and joined where they
lie. Documents come in batches. A batch's keys are merge-anti-joined with every run:
a key that a run has settled (found often enough, in a larger document than any
of the batch's) can change nothing and goes; the others become a run of level 0. A level that is
full is merged into one run of the next. Once all batches are in, keys found often
enough meet the lines once more, and every line but those of the key's largest
document goes.

Lines are never shuffled with their texts: keys and places travel, and a document's
text meets the list of its dropped lines once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import documents, drop_shuffles_early, forget, remove_path, saved, scratch_path

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a whole table (by quantiles of doc_id, largest ids first) and runs of a level before they are merged.
BATCHES, FANOUT = 6, 3
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]
RUN = "k1 long, k2 long, n long, last long"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case (other letters stay)."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and a name of the row without nulls: rows of equal id and text share it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).alias("r1"), F.xxhash64(F.col("doc_id").isNull(), text).alias("r2"))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, r1, r2, pos, k1, k2 of the lines whose key has ``min_chars`` code points or more."""
    lines = named(docs).select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return lines.select("doc_id", "r1", "r2", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))


class Runs:
    """Levels of sorted runs (k1, k2, n, last) in the shared folder.

    ``add`` takes one batch of (k1, k2, doc_id), whose documents are in no other batch; batches may
    come in any order. ``found`` has every key that lies in ``min_docs`` documents or more, with
    the largest; its counts may stop at ``min_docs``. Null ids are one document, smaller than all."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, max(2, fanout)
        self.levels: list[list[tuple[str, str]]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _put(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, f"run{level}")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) > self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)
            self._drop(full)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, path)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """The runs as one. They are read as plain files: a union of bucketed scans may be grouped
        without the exchange that it needs once Spark drops the bucketing of a scan beneath it."""
        every = self.spark.read.schema(RUN).parquet(*(path for _, path in runs))
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run has settled, with the number of its documents that hold them and the largest."""
        own = batch.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        for run in self.tables():
            settled = run.where(F.col("n") >= self.min_docs).select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("last").alias("upto"))
            no_later = F.col("last").isNull() | (F.col("last") <= F.col("upto"))
            own = own.join(settled.hint("merge"), (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & no_later, "left_anti")
        return own

    def add(self, batch: DataFrame) -> None:
        self._put(self.fresh(batch), 0)

    def found(self) -> DataFrame:
        """k1, k2, last of the keys in ``min_docs`` documents or more."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "k1 long, k2 long, last long")
        return self._merged(runs).where(F.col("n") >= self.min_docs).select(*KEY, "last")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def in_batches(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """The lines with ``batch``: 0 has the largest ids; equal ids are in one batch, null ids in the last."""
    shares = [i / batches for i in range(1, batches)]
    edges = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    below = sum((F.when(F.col("doc_id") <= e, 1).otherwise(0) for e in sorted(set(edges or []))), F.lit(0))
    return lines.withColumn("batch", F.when(F.col("doc_id").isNull(), len(set(edges or []))).otherwise(below).cast("int"))


def dropped_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """r1, r2, drops: the sorted places of the lines that go from each text."""
    gone = lines.join(found, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return gone.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text (without the lines that go), n_lines, n_dropped: one row for each row of docs.

    Texts are split at \\n (null or empty: one empty line). Lines whose key has ``min_chars`` code
    points or more and lies in ``min_docs`` documents or more stay only in the largest doc_id
    that holds it (there, all of them). Rows that share a doc_id are one document, each with its own text; null ids are
    one document, smaller than all. A text that loses all its lines is empty. Other columns are ignored."""
    drop_shuffles_early(spark)
    path = scratch_path(spark, "lines")
    in_batches(keyed_lines(docs, min_chars), docs, batches).write.partitionBy("batch").parquet(path)
    schema = "doc_id long, r1 long, r2 long, pos int, k1 long, k2 long, batch int"
    lines, runs = spark.read.schema(schema).parquet(path), Runs(spark, min_docs, fanout)
    for i in range(max(1, batches)):  # a batch without lines adds an empty run
        runs.add(lines.where(F.col("batch") == i))
    found = saved(spark, runs.found(), "found")
    drops = saved(spark, dropped_lines(lines, found), "drops")
    runs.close()
    forget(spark, found)
    remove_path(spark, path)
    both = named(docs).join(drops.hint("shuffle_hash"), ["r1", "r2"], "left").select("doc_id", "text", "drops", F.split("text", "\n", -1).alias("lines"))
    starts = F.concat(F.array(F.lit(-1)), F.col("drops"))
    ends = F.concat(F.col("drops"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1)))
    return both.select("doc_id", F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs) s),
found AS (
  SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id FROM lines WHERE length(key) >= {MIN_CHARS}) d
  GROUP BY key HAVING count(*) >= {MIN_DOCS})
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (f.key IS NOT NULL AND l.doc_id IS DISTINCT FROM f.last) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL OR l.doc_id IS NOT DISTINCT FROM f.last), '')) AS kept_sha256
FROM lines l LEFT JOIN found f ON l.key = f.key
GROUP BY l.r, l.doc_id
"""
