"""Length-delimited binary records of token ids, with an offset index (operator 2).

A shard is a file of frames, in ascending doc_id order:

    length   uint64 LE   bytes of the payload
    crc      uint32 LE   masked checksum of the length field
    payload  int64 doc_id, uint8 flags (1: doc_id is null), uint8 bytes per id, ids LE
    crc      uint32 LE   masked checksum of the payload

A checksum is CRC-32 rotated right by 15 bits plus 0xa282ead8 (a checksum of
data that holds checksums would otherwise be weak). Beside each shard lies its
index, with 24 bytes a frame (offset uint64, ids before the frame in the shard
uint64, ids uint32, bytes of the frame uint32), by which a reader fetches any
frame, or a shuffled order of them, without reading the shard."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import documents, mapped, out_batch, scratch_path, text_chunks
from flightloom.llm.wordbpe import encoder

_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<qBB")
_CRC = struct.Struct("<I")
INDEX_DTYPE = np.dtype([("offset", "<u8"), ("before", "<u8"), ("ids", "<u4"), ("size", "<u4")])
MASK_DELTA = 0xA282EAD8
READ_BYTES = 8_000_000
_STATS = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("record_offset", pa.int64())])


def masked_crc(data) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _PAYLOAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + _CRC.pack(masked_crc(length)) + payload + _CRC.pack(masked_crc(payload))


def parse(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, end of the frame); ValueError where a checksum does not hold."""
    length, crc = _HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != crc:
        raise ValueError(f"the length checksum at {at} does not hold")
    body = data[at + _HEAD.size : at + _HEAD.size + length]
    end = at + _HEAD.size + length + 4
    if len(body) != length or masked_crc(body) != _CRC.unpack_from(data, end - 4)[0]:
        raise ValueError(f"the payload checksum at {at} does not hold")
    doc_id, null, width = _PAYLOAD.unpack_from(body)
    return None if null else doc_id, np.frombuffer(body, f"<u{width}", offset=_PAYLOAD.size), end


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or ":/" in path else (pafs.LocalFileSystem(), path)


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    shard = context.partitionId()
    path = f"{folder}/shard-{shard:06d}-{context.taskAttemptId()}"  # a retried task never touches the files of the first
    enc, out, index, n, tokens, size = encoder(vocabulary), None, None, 0, 0, 0
    fs, where = _open(path)
    for chunk in text_chunks(batches):
        if out is None:
            out, index = fs.open_output_stream(f"{where}.rec"), fs.open_output_stream(f"{where}.idx")
        ids, offsets = enc.encode(chunk.column("text"), end_id)
        if len(ids) and int(ids.max()) >> (8 * width):
            raise ValueError(f"id {ids.max()} does not fit in {width} bytes")
        rows = np.zeros(chunk.num_rows, INDEX_DTYPE)
        parts = []
        for i, doc_id in enumerate(chunk.column("doc_id").to_pylist()):
            own = ids[offsets[i] : offsets[i + 1]]
            parts.append(data := frame(doc_id, own, width))
            rows[i] = size, tokens, len(own), len(data)
            size, tokens = size + len(data), tokens + len(own)
        out.write(b"".join(parts))
        index.write(rows.tobytes())
        n += chunk.num_rows
    if out is not None:
        out.close()
        index.close()
        yield out_batch(_STATS, shard=[shard], path=[path], records=[n], tokens=[tokens], bytes=[size])


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, width: int = 2) -> list[dict]:
    """Writes the shards and returns one dict for each (shard, path, records,
    tokens, bytes), in order; the list grows with the number of tasks only.

    One range shuffle gives every task a contiguous range of (doc_id, hash of the
    text, row), so neither one id nor one text fills a task; ties of doc_id are in that
    order, null ids come first, a null text is empty. Other columns of docs are
    ignored. ``width`` is the bytes of an id (2 or 4); an id that does not fit
    raises ValueError. No rows: no files, an empty list."""
    folder_uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    fs, where = _open(folder_uri)
    fs.create_dir(where, recursive=True)
    order = ["doc_id", "h", "n"]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    sorted_docs = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    stats = sorted_docs.transform(mapped, partial(_write, folder=folder_uri, vocabulary=vocabulary, end_id=end_id, width=width), "shard int, path string, records long, tokens long, bytes long").collect()
    return sorted((r.asDict() for r in stats), key=lambda r: r["shard"])


def read_frames(path: str, order: np.ndarray | None = None) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(frame number, doc_id, ids before it in the shard, ids) of a shard, in
    file order, or in the given order of frame numbers through the index."""
    fs, where = _open(path)
    with fs.open_input_stream(f"{where}.idx") as f:
        index = np.frombuffer(f.read(), INDEX_DTYPE)
    with fs.open_input_file(f"{where}.rec") as f:
        if order is not None:
            for i in order:
                f.seek(int(index["offset"][i]))
                doc_id, ids, _ = parse(f.read(int(index["size"][i])))
                yield int(i), doc_id, int(index["before"][i]), ids
            return
        ends = (index["offset"] + index["size"]).astype(np.int64)
        at = 0
        while at < len(index):
            base = int(index["offset"][at])
            to = max(at + 1, int(np.searchsorted(ends, base + READ_BYTES, "right")))
            data, pos = f.read(int(ends[to - 1]) - base), 0
            for i in range(at, to):
                doc_id, ids, pos = parse(data, pos)
                if len(ids) != index["ids"][i] or pos + base != ends[i]:
                    raise ValueError(f"frame {i} of {path} is not as the index says")
                yield i, doc_id, int(index["before"][i]), ids
            at = to


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows: list[tuple] = []
            for i, doc_id, before, ids in read_frames(row["path"]):
                rows.append((doc_id, row["base"] + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], i))
                if len(rows) == 5000:
                    yield out_batch(_ROWS, **dict(zip(_ROWS.names, map(list, zip(*rows)))))
                    rows = []
            if rows:
                yield out_batch(_ROWS, **dict(zip(_ROWS.names, map(list, zip(*rows)))))


def read_records(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """A row for each frame of the shards, checksums verified: doc_id, start
    (ids of all frames before it), n_tokens, ids_crc32, shard, record_offset."""
    base, rows = 0, []
    for s in shards:
        rows.append((s["shard"], s["path"], base))
        base += s["tokens"]
    todo = spark.createDataFrame(rows, "shard int, path string, base long")
    return todo.repartition(max(1, len(rows)), F.col("shard")).transform(mapped, _read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, record_offset long") if rows else spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, record_offset long")


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_records(documents(spark, sf_dir), scratch_path(spark, "records"), public_tokenizers.path("word_bpe_49k.json"))
    return read_records(spark, shards)
