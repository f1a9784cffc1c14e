"""Repeated passages by anchors (operator 7).

A byte goes if a string of THRESHOLD bytes that covers it starts at a second
place too. The dealt method is prefix doubling: (position, rank pair) rows sorted at
growing offsets, reranked until unique or past the threshold. It is here, as
``doubling_starts``, and ranks every byte position in every round, which at a few hundred
bytes moved a byte of text is too dear for a corpus; the query does not run it, and what it
runs, ``repeated_starts``, is checked against it and against brute force. That is no suffix array: each string
is found through its anchor, the place in it of the GRAM-byte string with the least hash,
so equal strings have their anchors at equal distances and only anchors are grouped:
one in (THRESHOLD - GRAM) / 2 bytes. Strings that a text repeats itself
(runs of one letter, padding) are one row with a count before any shuffle.

Anchors are grouped by their GRAM bytes; unique ones are dropped. Then by all bytes of the
strings that share the anchor: what is equal there is repeated as a whole. One of each remaining
group goes on in cells of ever fewer strings, aligned at the anchor: a cell is named by its common bytes (by two strings
that end where these do), a unique name leaves the cell clean, a cell all of whose bytes recur is repeated,
others are split. Names are 64-bit hashes of bytes, never compared byte by byte, so a
wrong match takes two collisions within one group of an anchor."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import documents, drop_shuffles_early, filled, forget, mapped, out_batch, ragged, saved, text_chunks

THRESHOLD = 400
GRAM = 100
#: Bytes of the shorter strings whose repeats are counted beside: passages of some 50 words.
PASSAGE, PASSAGE_GRAM = 250, 50
#: Strings of a cell in each round of refinement; the last must be 1.
CELLS = (32, 4, 1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_KEY = ["d", "th"]
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["p"]) < n:
        for name, base in (("p", BASE), ("i", INVERSE)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _tables[name] = np.multiply.accumulate(p)
        _tables["t"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return _tables["p"], _tables["i"]


class Names:
    """64-bit names of any substrings of a run of bytes; equal strings have equal names."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(max(len(raw) + 1, 1 << 20))
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_tables["t"][raw] * power[: len(raw)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for every i where that lies within x."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(text: pa.Array, threshold: int = THRESHOLD, gram: int = GRAM) -> dict[str, np.ndarray]:
    """row, apos (anchor's place in the text), lo, hi (distances from the string's
    start to the anchor), kkey (name of the GRAM bytes), ukey (name of all bytes
    of the strings lo..hi, with lo and hi)."""
    text = filled(text)
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1).astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    sizes = np.diff(at)
    starts = ragged(np.maximum(sizes - threshold + 1, 0), at[:-1])
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "apos", "lo", "hi", "kkey", "ukey")}
    names = Names(raw)
    grams = names.of(np.arange(len(raw) - gram + 1), gram)
    select = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(select, threshold - gram + 1)
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(text)), np.maximum(sizes - threshold + 1, 0))
    head = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    tail = np.append(head[1:], len(starts)) - 1
    first, last, a, row = starts[head], starts[tail], anchor[head], row[head]
    lo, hi = a - last, a - first
    ukey = mix(names.of(first, last - first + threshold) ^ mix((lo.astype(np.uint64) << np.uint64(32)) | hi.astype(np.uint64)))
    return {"row": row, "apos": a - at[row], "lo": lo, "hi": hi, "kkey": grams[a].view(np.int64), "ukey": ukey.view(np.int64)}


_ANCHOR_DDL = "d long, th long, apos int, lo int, hi int, kkey long, ukey long, n long"
_RANGE_DDL = "d long, th long, first int, last int"
_INTS = ("apos", "lo", "hi")


def runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which ranges, in order, begin a run of ranges of one row without a gap."""
    return np.flatnonzero((np.diff(row, prepend=-1) != 0) | np.append(True, first[1:] != last[:-1] + 1)[: len(first)])


def _anchor_rows(batches: Iterator[pa.RecordBatch], threshold: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor and different strings at it of a text; n: how often
    the text has them. Where that is twice or more, all places where they start
    come as ranges lo..hi of bytes with n = 0."""
    schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), *((n, pa.int32()) for n in _INTS), ("kkey", pa.int64()), ("ukey", pa.int64()), ("n", pa.int64())])
    for chunk in text_chunks(batches, "part", 1_000_000):
        x = anchors(chunk.column("part"), threshold, gram)
        row = x.pop("row")
        if not len(row):
            continue
        x["apos"] = x["apos"] + chunk.column("base").to_numpy()[row]
        order = np.lexsort((x["ukey"], row))
        head = np.flatnonzero((np.diff(row[order], prepend=-1) != 0) | np.append(True, np.diff(x["ukey"][order]) != 0))
        n = np.diff(np.append(head, len(order)))
        first = np.minimum.reduceat(order, head)
        at = lambda i: {"d": chunk.column("d").take(pa.array(row[i])), "th": chunk.column("th").take(pa.array(row[i]))}
        yield out_batch(schema, **at(first), **{k: x[k][first].astype(np.int32) for k in _INTS}, kkey=x["kkey"][first], ukey=x["ukey"][first], n=n)
        again = np.sort(order[np.repeat(n > 1, n)])
        if len(again):
            lo, hi = (x["apos"] - x["hi"])[again], (x["apos"] - x["lo"])[again]
            head = runs(row[again], lo, hi)
            zero = np.zeros(len(head), np.int64)
            yield out_batch(schema, **at(again[head]), apos=zero.astype(np.int32), lo=lo[head].astype(np.int32), hi=hi[np.append(head[1:], len(again)) - 1].astype(np.int32), kkey=zero, ukey=zero, n=zero)


def _contexts(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor that goes on."""
    schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), *((n, pa.int32()) for n in _INTS), ("kkey", pa.int64()), ("ctx", pa.binary())])
    for chunk in text_chunks(batches):
        for d, th, text, todo in zip(*(chunk.column(n).to_pylist() for n in ("d", "th", "text", "todo"))):
            raw = text.encode()
            for a in range(0, len(todo), 2000):
                some = todo[a : a + 2000]
                own = {n: [x[n] for x in some] for n in (*_INTS, "kkey")}
                yield out_batch(schema, d=[d] * len(some), th=[th] * len(some), **own, ctx=[raw[p - h : p - lo + threshold] for p, lo, h in zip(own["apos"], own["lo"], own["hi"])])


def _pieces(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each maximal run of repeated strings, as far as they hold a string of ``threshold``."""
    schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("base", pa.int32()), ("part", pa.binary())])
    for chunk in text_chunks(batches):
        for d, th, text, ranges in zip(*(chunk.column(n).to_pylist() for n in ("d", "th", "text", "ranges"))):
            raw, spans = text.encode(), []
            for first, last in sorted((r["first"], r["last"]) for r in ranges):
                if spans and first <= spans[-1][1] + 1:
                    spans[-1][1] = max(last, spans[-1][1])
                else:
                    spans.append([first, last])
            spans = [(a, b + PASSAGE) for a, b in spans if b - a >= threshold - PASSAGE]
            yield out_batch(schema, d=[d] * len(spans), th=[th] * len(spans), base=[a for a, _ in spans], part=[raw[a:b] for a, b in spans])


_CELL_DDL = "kkey long, d long, th long, apos int, da int, c0 long, c1 long, u0 long, u1 long, u2 long"
_COMMON, _WHOLE = ["c0", "c1"], ["u0", "u1", "u2"]


def _cell_rows(batches: Iterator[pa.RecordBatch], size: int, parent: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Cells of ``size`` strings of each anchor: all, or the parts of its parents.
    c0, c1 rank the bytes that the cell's strings have in common: half a string and
    the half that ends them. u0..u2 rank all bytes of the cell (none where the
    anchor has not all of its strings)."""
    schema = pa.schema([("kkey", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("apos", pa.int32()), ("da", pa.int32()), *((c, pa.int64()) for c in (*_COMMON, *_WHOLE))])
    common, full = threshold - size + 1, threshold + size - 1
    half, third = min(-(-threshold // 2), common), -(-full // 3)
    for chunk in text_chunks(batches, "ctx", 1_000_000):
        ctx = chunk.column("ctx")
        ctx = pa.concat_arrays([ctx])
        at = np.frombuffer(ctx.buffers()[1], np.int32, len(ctx) + 1).astype(np.int64)
        names = Names(np.frombuffer(ctx.buffers()[2], np.uint8)[at[0] : at[-1]])
        at = at - at[0]
        lo, hi = (chunk.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        if parent:
            lists = chunk.column("parents")
            n = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lo)), n * (parent // size))
            da = np.repeat(lists.flatten().to_numpy().astype(np.int64), parent // size) + np.tile(np.arange(0, parent, size), int(n.sum()))
        else:
            n = hi // size - lo // size + 1
            row = np.repeat(np.arange(len(lo)), n)
            da = ragged(n, lo // size) * size
        keep = (da <= hi[row]) & (da + size > lo[row])
        row, da = row[keep], da[keep]
        start = at[row] + hi[row] - da
        whole = (da >= lo[row]) & (da + size - 1 <= hi[row])
        first = np.where(whole, start - size + 1, 0)
        ranks = [names.of(start + o, half) for o in (0, common - half)]
        ranks += [names.of(first + np.where(whole, o, 0), np.where(whole, third, 0)) for o in (0, (full - third) // 2, full - third)]
        take = pa.array(row)
        masks = [None, None, ~whole, ~whole, ~whole]
        yield pa.RecordBatch.from_arrays([*(chunk.column(c).take(take) for c in ("kkey", "d", "th", "apos")), pa.array(da.astype(np.int32)), *(pa.array(r.view(np.int64), mask=m) for r, m in zip(ranks, masks))], schema=schema)


def keyed(docs: DataFrame, names: tuple[str, str] = ("d", "th")) -> DataFrame:
    """docs with d and th (or other names), which are equal for rows of equal doc_id and text only
    (such rows are each other's repetitions, so their results are the same)."""
    return docs.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())))))


def repeated_starts(spark: SparkSession, named: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, pieces: DataFrame | None = None) -> DataFrame:
    """d, th, first, last: ranges of bytes where repeated strings of ``threshold``
    bytes start, for rows d, th, text of ``keyed``, as a written table. ``pieces`` (d, th, base, part):
    the only parts of the texts that hold such strings, if that is known."""
    drop_shuffles_early(spark)
    named = named.where(F.octet_length("text") >= threshold)
    if pieces is None:
        pieces = named.select("d", "th", F.lit(0).alias("base"), F.col("text").alias("part"))
    every = saved(spark, pieces.transform(mapped, partial(_anchor_rows, threshold=threshold, gram=gram), _ANCHOR_DDL), "anchors")
    found = [saved(spark, every.where("n = 0").select("d", "th", F.col("lo").alias("first"), F.col("hi").alias("last")), "own")]
    # round 1: the GRAM bytes at the anchor; partial counts before the shuffle, hot names are split by the join
    # (the counts are written first: only a join of two shuffles of its own is split at hot names)
    common = saved(spark, every.where("n > 0").groupBy("kkey").agg(F.sum("n").alias("n")).where("n > 1").select("kkey"), "common")
    alive = saved(spark, every.where("n > 0").join(common, "kkey", "left_semi"), "alive")
    forget(spark, every, common)
    # round 2: all bytes of the strings that share the anchor
    member = ["d", "th", "apos", "lo", "hi"]
    ranks = saved(spark, alive.groupBy("kkey", "ukey").agg(F.sum("n").alias("n"), F.min(F.struct(*member)).alias("rep")), "ranks")
    whole = alive.join(ranks.where("n > 1").select("kkey", "ukey"), ["kkey", "ukey"], "left_semi")
    found.append(saved(spark, whole.select("d", "th", (F.col("apos") - F.col("hi")).alias("first"), (F.col("apos") - F.col("lo")).alias("last")), "whole"))
    # one of each rank goes on where its first name has several ranks
    several = saved(spark, ranks.groupBy("kkey").agg(F.count("*").alias("n")).where("n > 1").select("kkey"), "several")
    open_ranks = ranks.join(several, "kkey", "left_semi").select("kkey", "rep.*")
    todo = open_ranks.groupBy(*_KEY).agg(F.collect_list(F.struct("apos", "lo", "hi", "kkey")).alias("todo"))  # as many as the text has anchors
    contexts = saved(spark, named.join(todo, _KEY).select("d", "th", "text", "todo").transform(mapped, partial(_contexts, threshold=threshold), "d long, th long, apos int, lo int, hi int, kkey long, ctx binary"), "contexts")
    forget(spark, alive, ranks, several)
    parent, active = 0, None
    for size in CELLS:
        source = contexts
        if parent:
            parts = active.groupBy("d", "th", "apos").agg(F.collect_list("da").alias("parents"))
            source = contexts.join(parts, ["d", "th", "apos"])
        cells = saved(spark, source.transform(mapped, partial(_cell_rows, size=size, parent=parent, threshold=threshold), _CELL_DDL), f"cells{size}")
        forget(spark, active)
        key = ["kkey", "da", *_COMMON]
        shared = saved(spark, cells.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), f"shared{size}")
        rest = saved(spark, cells.join(shared, key, "left_semi"), f"rest{size}")
        forget(spark, cells, shared)
        repeated = rest
        if size > 1:
            key = ["kkey", "da", *_WHOLE]
            full = saved(spark, rest.where("u0 is not null").groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "apos")).alias("rep")).where("n > 1").drop("n"), f"full{size}")
            marked = saved(spark, rest.join(full, key, "left").select("d", "th", "apos", "da", "rep"), f"marked{size}")
            repeated, parent = marked.where("rep is not null"), size
            # one of the repeated ones goes on: parts of other cells may equal parts of it
            active = marked.where(F.col("rep").isNull() | (F.col("rep") == F.struct("d", "th", "apos")))
            active.scratch = marked.scratch
        found.append(saved(spark, repeated.select("d", "th", (F.col("apos") - F.col("da") - size + 1).alias("first"), (F.col("apos") - F.col("da")).alias("last")), f"found{size}"))
        forget(spark, rest)
    forget(spark, contexts)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def gathered(ranges: DataFrame, name: str = "ranges") -> DataFrame:
    """The ranges of each text in one row: as many as a text of its length has room for."""
    return ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias(name))


def doubling_starts(spark: SparkSession, named: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """As ``repeated_starts``, by plain prefix doubling: every byte position has a
    rank, at first its eight bytes; each round sorts pairs of the ranks at a position and at
    an offset (8, 16, 32, ...), drops the unique ones and ranks the others anew by
    the least position with their pair. A few hundred bytes are moved for each byte of text."""

    def eights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("rank", pa.int64())])
        for chunk in text_chunks(batches, limit=200_000):
            for d, th, text in zip(*(chunk.column(n).to_pylist() for n in ("d", "th", "text"))):
                raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
                n = len(raw) - 7
                if n > 0:
                    rank = sum((raw[i : n + i] << np.uint64(8 * i) for i in range(8)), np.zeros(n, np.uint64))
                    yield out_batch(schema, d=[d] * n, th=[th] * n, at=np.arange(n, dtype=np.int32), rank=rank.view(np.int64))

    place, length = ["d", "th", "at"], 8
    ranked = saved(spark, named.where(F.octet_length("text") >= threshold).transform(mapped, eights, "d long, th long, at int, rank long"), "eights")
    if threshold < 2 * length:
        raise ValueError("plain doubling starts from strings of 16 bytes")
    while length < threshold:
        step = min(length, threshold - length)
        ahead = ranked.select("d", "th", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
        pairs = saved(spark, ranked.join(ahead, place), "pairs")
        classes = pairs.groupBy("rank", "then").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("least")).where("n > 1")
        again = saved(spark, pairs.join(classes, ["rank", "then"]).select(*place, "least"), "again")
        # the least position of a class, as a number of its own
        numbers = saved(spark, again.select("least").distinct().withColumn("rank", F.monotonically_increasing_id()), "numbers")
        forget(spark, ranked, pairs)
        ranked = saved(spark, again.join(numbers, "least").select(*place, "rank"), "ranked")
        forget(spark, again, numbers)
        length += step
    return ranked.select("d", "th", F.col("at").alias("first"), F.col("at").alias("last"))


def _covered(ranges: list | None, width: int) -> int:
    total, end = 0, 0
    for first, last in sorted((r["first"], r["last"]) for r in ranges or []):
        total += max(0, last + width - max(first, end))
        end = max(end, last + width)
    return total


def _cut(batches: Iterator[pa.RecordBatch], threshold: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("passage_bytes", pa.int64())]
    schema = pa.schema([*fields, ("kept", pa.binary())] if with_text else fields)
    for chunk in text_chunks(batches):
        rows = []
        for doc_id, text, ranges, passages in zip(*(chunk.column(n).to_pylist() for n in ("doc_id", "text", "ranges", "passages"))):
            raw = (text or "").encode()
            kept, gone, spans, end = [], 0, 0, 0
            for first, last in sorted((r["first"], r["last"]) for r in ranges or []):
                stop = last + threshold
                if first > end or not spans:
                    kept.append(raw[end:first])
                    spans += 1
                    gone, end = gone + stop - first, stop
                elif stop > end:
                    gone, end = gone + stop - end, stop
            kept.append(raw[end:])
            data = b"".join(kept)
            rows.append((doc_id, len(raw), gone, spans, hashlib.sha256(data).hexdigest(), _covered(passages, PASSAGE), data)[: len(schema)])
        yield out_batch(schema, **dict(zip(schema.names, map(list, zip(*rows)))))


def dedup(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, passage_bytes (bytes that a repeated string of PASSAGE bytes
    covers; 0 for a threshold that is not above PASSAGE) and, if asked for, kept (the bytes left).

    A null text is as an empty one; texts shorter than ``threshold`` keep all;
    rows with equal ids and texts repeat each other; null ids are allowed; other
    columns of docs are ignored. What is left may begin or end within a
    character: strings are of bytes."""
    named = keyed(docs.select("doc_id", "text"))
    pieces = passages = None
    if threshold > PASSAGE:  # a repeated string's parts are repeated: the shorter ones tell where to look
        passages = saved(spark, gathered(repeated_starts(spark, named, PASSAGE, PASSAGE_GRAM)), "passages")
        pieces = named.join(passages, _KEY).select("d", "th", "text", "ranges").transform(mapped, partial(_pieces, threshold=threshold), "d long, th long, base int, part binary")
    out = named.join(gathered(repeated_starts(spark, named, threshold, gram, pieces)), _KEY, "left")
    out = out.join(passages.withColumnRenamed("ranges", "passages"), _KEY, "left") if passages is not None else out.withColumn("passages", F.lit(None).cast("array<struct<first: int, last: int>>"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_bytes long" + ", kept binary" * with_text
    return out.select("doc_id", "text", "ranges", "passages").transform(mapped, partial(_cut, threshold=threshold, with_text=with_text), ddl)


def dedup_rows(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """The rows of docs, all columns, with text less its repeated bytes (a
    character that lost a byte goes) and n_chars, where there is one, as it is then."""
    ranges = gathered(repeated_starts(spark, keyed(docs.select("doc_id", "text")), threshold, gram)).select(F.col("d").alias("__d"), F.col("th").alias("__th"), F.col("ranges").alias("__ranges"))
    joined = keyed(docs, ("__kd", "__kth")).join(ranges, (F.col("__kd") == F.col("__d")) & (F.col("__kth") == F.col("__th")), "left").select(*docs.columns, "__ranges")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            marks = chunk.column("__ranges").to_pylist()
            texts = chunk.column("text").to_pylist()
            for i in (i for i, m in enumerate(marks) if m):
                raw, kept, end = texts[i].encode(), [], 0
                for first, last in sorted((r["first"], r["last"]) for r in marks[i]):
                    kept.append(raw[end : max(first, end)])
                    end = max(end, last + threshold)
                texts[i] = (b"".join(kept) + raw[end:]).decode("utf-8", "ignore")
            columns = {n: chunk.column(n) for n in names}
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                changed = pa.array([bool(m) for m in marks])
                columns["n_chars"] = pc.if_else(changed, pc.utf8_length(columns["text"]).cast(columns["n_chars"].type), columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.transform(mapped, run, docs.schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, documents(spark, sf_dir))
