"""Shared pieces of the training-data operators: bounded text chunks, word
splitting in Arrow, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
CHUNK_BYTES = 2_000_000
#: Bytes of an Arrow batch between Spark and a worker (one longer row is a batch of its own).
BATCH_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session, whose executors are this
    process, gets a temporary one where it names none; a cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="flightloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table; removed when the driver ends."""
    path = f"{shared_root(spark)}/flightloom-{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have gone first; leftovers stay in the scratch folder
        pass


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the table is written to the shared folder and read again,
    so a lost executor costs no more than the tasks after this point."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Removes tables of ``saved`` that nothing will read again."""
    for table in tables:
        if path := getattr(table, "scratch", None):
            remove_path(spark, path)


def mapped(df: DataFrame, run, ddl) -> DataFrame:
    """mapInArrow with batches of bounded bytes, whatever the length of the rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, ddl)


def drop_shuffles_early(spark: SparkSession) -> None:
    """Shuffle files go when the query that made them ends, not at some later garbage collection."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches with about ``limit`` bytes of ``column`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def filled(text: pa.Array) -> pa.Array:
    """Null texts as empty ones, as a plain string array that starts at offset 0."""
    text = pc.fill_null(text, "")
    return pa.concat_arrays([text]) if text.offset else text


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (maximal runs without ASCII white space) of each text: codes into
    the vocabulary, offsets of the texts in codes, the vocabulary."""
    lists = pc.ascii_split_whitespace(filled(text))
    coded = lists.flatten().dictionary_encode()
    vocab = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(vocab, "").as_py() if len(vocab) else -1
    if empty >= 0:  # at either end of a text
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, vocab


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (lengths[i] of them) for every i, in one array."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc_mod(column: str, n: int):
    """crc32 of the column's text form, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()], schema=schema)


def kept_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, all columns, for which ``keep(chunk)`` (a mask of a batch) holds; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield chunk.filter(pa.array(keep(chunk)))

    return mapped(docs, run, docs.schema)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
