"""Bounded-space online packing of documents into training windows (operator 4).

Each partition keeps a fixed number of open windows. A document's last piece
goes into the window that it fills best; where none has room, the fullest is
topped up with the piece's head and emitted. What stays open at a partition's
end is merged in groups of FAN_IN partitions by the same rule, level after
level, until one group is left; its last tokens become sequences whose lengths
are powers of two. Full windows never move again, so no document is shuffled."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import documents, mapped, saved, text_chunks
from flightloom.llm.wordbpe import encoder

WINDOW = 4096
OPEN_WINDOWS = 16
FAN_IN = 64
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])


class Packer:
    """Rows of emitted pieces gather in ``rows``; ``close`` gives those of the open windows.

    A piece is (doc_id, start, ids, doc_tokens); a sequence's id is unique by level, part and number."""

    def __init__(self, window: int, n_open: int, level: int, part: int):
        self.window, self.n_open = window, n_open
        self.next_id = (level << 56) | (part << 28)
        self.order: list[tuple[int, int]] = []  # (room, window), ascending
        self.open: dict[int, list[tuple]] = {}
        self.made, self.part, self.rows = 0, part, []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at, None, None))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self._emit([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            i = bisect_left(self.order, (len(ids), -1))
            if i < len(self.order):  # the least room that suffices
                room, w = self.order.pop(i)
                take = len(ids)
            elif len(self.order) < self.n_open:
                room, w, take = self.window, self.made, len(ids)
                self.made += 1
                self.open[w] = []
            else:  # none fits: the fullest is topped up and goes
                room, w = self.order.pop(0)
                take = room
            self.open[w].append((doc_id, start, ids[:take], total))
            start, ids, room = start + take, ids[take:], room - take
            if room:
                insort(self.order, (room, w))
            else:
                self._emit(self.open.pop(w))

    def close(self) -> None:
        """Pieces of open windows, with their ids, for the next level."""
        for pieces in self.open.values():
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids), None, total, None, None, self.part, ids.astype("<u4").tobytes()))
        self.open, self.order = {}, []

    def finish(self) -> None:
        """Pieces of the open windows, in a row, into full windows and then sequences of powers of two."""
        pieces = [p for w in self.open.values() for p in w]
        left = sum(len(p[2]) for p in pieces)
        self.open, self.order = {}, []
        current: list[tuple] = []
        while left:
            room = size = min(self.window, 1 << (left.bit_length() - 1)) if left < self.window else self.window
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                take = min(room, len(ids))
                current.append((doc_id, start, ids[:take], total))
                if take < len(ids):
                    pieces.insert(0, (doc_id, start + take, ids[take:], total))
                room -= take
            self._emit(current)
            current, left = [], left - size

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _pack_partition(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, window: int, n_open: int) -> Iterator[pa.RecordBatch]:
    packer, enc = Packer(window, n_open, 0, TaskContext.get().partitionId()), encoder(vocabulary)
    for chunk in text_chunks(batches):
        ids, offsets = enc.encode(chunk.column("text"), end_id)
        for i, doc_id in enumerate(chunk.column("doc_id").to_pylist()):
            packer.add(doc_id, 0, ids[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i]))
        # the pieces that stay open shall not hold the chunk's ids
        packer.open = {w: [(d, s, x.copy() if x.base is not None else x, t) for d, s, x, t in p] for w, p in packer.open.items()}
        yield packer.batch()
    packer.close()
    yield packer.batch()


def _merge_group(left: pa.Table, level: int, last: bool, window: int, n_open: int) -> pa.Table:
    packer = Packer(window, n_open, level, left["grp"][0].as_py())
    left = left.sort_by([("length", "descending"), *((c, "ascending") for c in ("part", "doc_id", "start", "ids"))])
    for doc_id, start, total, ids in zip(*(left[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
        packer.add(doc_id, start, np.frombuffer(ids, "<u4"), total)
    packer.finish() if last else packer.close()
    return pa.Table.from_batches([packer.batch()])


def _merger(level: int, last: bool, window: int, n_open: int):
    def merge(left: pa.Table) -> pa.Table:
        return _merge_group(left, level, last, window, n_open)

    return merge


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, n_open: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id of every row of docs lies in one piece and
    every sequence is full (or, a few at the end, a power of two), so there is
    no padding. A null text is empty and gives its end id; a null or repeated
    doc_id stays as it is; other columns of docs are ignored; no rows give none.

    The tables of a level go to the shared folder: emitted rows are small, ids
    are kept only for the windows left open (n_open for each task)."""
    found = docs.select("doc_id", "text").transform(mapped, partial(_pack_partition, vocabulary=vocabulary, end_id=end_id, window=window, n_open=n_open), _DDL)
    table = saved(spark, found, "pack")
    columns = [c for c in table.columns if c not in ("part", "ids")]
    done = table.where("sequence_id is not null").select(columns)
    level = 0
    while True:
        left = table.where("sequence_id is null")
        top = left.agg(F.max("part")).first()[0]
        if top is None:
            return done
        level += 1
        last = top < fan_in
        merge = _merger(level, last, window, n_open)
        merged = left.withColumn("grp", F.floor(F.col("part") / fan_in)).groupBy("grp").applyInArrow(merge, _DDL)
        table = saved(spark, merged, f"pack{level}")
        done = done.unionByName(table.where("sequence_id is not null").select(columns))
        if last:
            return done


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
