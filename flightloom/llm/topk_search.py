"""Exact top-k inner products by block-at-a-time pruning (operator 3).

Vectors become whole numbers; a dimension is a term, its value the term's
weight. Candidates lie in blocks of consecutive places of an order in which
similar vectors are neighbours; a block is a forward index (its vectors) and
every term's largest and smallest weight in it. A query's bound for a block is
the sum over terms of the larger product with the two. Blocks are scored in
order of their bounds until those fall below the k-th score so far.

The work is a grid: batches of queries by segments of blocks. A first pass scores
each query against the segment that it lies in itself, which gives its k-th score
to start with. Through the grid go only ids, the least k-th score of a batch and the
largest and smallest value of each term in a batch and a segment; cells whose
bound stays below that score end there. Those left are searched by segment, whose
vectors come once for so many batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.llm.common import mapped, out_batch, saved

SCALE = 256
BLOCK = 128
SEGMENT = 4096
QUERY_BATCH = 256
#: Segments whose bounds a batch meets at once; batches that are searched in one segment at once.
PAGE, SHARE = 256, 64
PIVOTS = 128
#: Components are stored in 32 bits below the first limit, else in 64; scores are 64-bit sums.
NARROW, WIDE = 1 << 31, 1 << 62
_CELL = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<bigint>: floor(SCALE * component as double). Vectors that are
    null or hold null or non-finite components, and null ids, go."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", whole.alias("v"))


def checked(dim: int, peak: float) -> tuple[int, str]:
    """The dimensions (1 at least) and the kind of number that holds components up to ``peak``."""
    if peak >= WIDE:
        raise OverflowError(f"components up to {peak:.0f} (x {SCALE}) do not fit")
    return max(1, dim), "<i4" if peak < NARROW else "<i8"


def matrix(lists: pa.Array, dim: int, kind: str = "<f8") -> np.ndarray:
    """[vector, dim]; shorter vectors are filled with zeros."""
    offsets = lists.offsets.to_numpy()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if (sizes == dim).all():
        return values.reshape(-1, dim).astype(kind)
    out = np.zeros((len(sizes), dim), kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def dot(q: np.ndarray, d: np.ndarray, but: np.ndarray) -> np.ndarray:
    """Whole-number products: in doubles while those are exact, else in 64-bit integers, where sums may pass
    the ends of the range as long as the product itself lies within; one that does not raises OverflowError,
    except where ``but`` says that it does not count."""
    near = q.astype(np.float64) @ d.T.astype(np.float64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1] < 2**53:
        return near.astype(np.int64)
    if np.abs(np.where(but, 0.0, near)).max(initial=0) >= 2.0**63:
        raise OverflowError("an inner product does not fit in 64 bits")
    with np.errstate(over="ignore"):
        return np.einsum("ij,kj->ik", q.astype(np.int64), d.astype(np.int64))


def _orders(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("v"), dim)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        near = unit @ pivots.T if len(pivots) else np.zeros((len(x), 1))
        best = near.argmax(axis=1)
        # finer within a pivot: how near the vector is to it, in coarse steps
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array((best * 64 + np.clip((1 - near.max(axis=1)) * 32, 0, 63).astype(np.int64)).astype(np.int32))], names=["vec_id", "v", "near"])


def segments(spark: SparkSession, vectors: DataFrame, dim: int, kind: str) -> DataFrame:
    """seg, ids, data ([vector, dim] of a kind of number), high and low ([block, dim]), top and
    bottom ([dim]) of runs of SEGMENT vectors of each task, in the order of similarity."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").toArrow()["v"].combine_chunks()
    pivots = matrix(sample, dim) if len(sample) else np.zeros((0, dim))
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
    placed = vectors.transform(mapped, partial(_orders, pivots=pivots, dim=dim), f"vec_id long, v array<{'int' if kind == '<i4' else 'bigint'}>, near int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, rows, held = [], [], 0

        def made(take: int) -> pa.RecordBatch:
            nonlocal ids, rows, held, n
            every, x = np.concatenate(ids), np.concatenate(rows)
            ids, rows, held = [every[take:]], [x[take:]], held - take
            every, x = every[:take], x[:take]
            first = np.arange(0, len(x), BLOCK)
            out = pa.RecordBatch.from_pydict({"seg": [(part << 32) | n], "ids": [every.astype("<i8").tobytes()], "data": [x.tobytes()], "high": [np.maximum.reduceat(x, first).tobytes()], "low": [np.minimum.reduceat(x, first).tobytes()], "top": [x.max(axis=0).tobytes()], "bottom": [x.min(axis=0).tobytes()]}, schema=pa.schema([("seg", pa.int64()), *((c, pa.binary()) for c in ("ids", "data", "high", "low", "top", "bottom"))]))
            n += 1
            return out

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy())
                rows.append(matrix(batch.column("v"), dim, kind))
                held += batch.num_rows
            while held >= SEGMENT:
                yield made(SEGMENT)
        if held:
            yield made(held)

    ordered = placed.repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
    return saved(spark, ordered.transform(mapped, build, "seg long, ids binary, data binary, high binary, low binary, top binary, bottom binary"), "segments")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))[:k]


def below(score: int) -> float:
    """A score as a double that is not above it."""
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), -np.inf))


def block_bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No less than any score of a query in a block: the larger product of each
    term, with room for rounding where doubles are not exact."""
    q = q.astype(np.float64)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    size = np.maximum(np.abs(high), np.abs(low))
    if np.abs(q).max(initial=0) * size.max(initial=0) * q.shape[1] < 2**53:
        return bounds
    return bounds + (q.shape[1] + 4) * 2.0**-51 * (np.abs(q) @ size.T)


def search_cell(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, data: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, vector, score) of the segment's k best for each query, as far as
    they reach the query's floor, and the number of block scorings done."""
    bounds = block_bounds(q, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    found_ids, found = [np.zeros(0, np.int64) for _ in q_ids], [np.zeros(0, np.int64) for _ in q_ids]
    floor = floor.astype(np.float64).copy()
    active, scored = np.arange(len(q_ids)), 0
    for step in range(order.shape[1]):
        active = active[bounds[active, order[active, step]] >= floor[active]]
        if not len(active):
            break
        block_of = order[active, step]
        for b in np.unique(block_of):  # queries that meet in a block are scored together
            who = active[block_of == b]
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            own = ids[part]
            scores = dot(q[who], data[part], q_ids[who][:, None] == own)
            scored += len(who)
            for i, s in zip(who, scores):
                fit = np.flatnonzero((s >= floor[i]) & (own != q_ids[i]))
                if not len(fit):
                    continue
                s_all, i_all = np.concatenate([found[i], s[fit]]), np.concatenate([found_ids[i], own[fit]])
                top = best_of(s_all, i_all, k)
                found[i], found_ids[i] = s_all[top], i_all[top]
                if len(top) == k:
                    floor[i] = max(floor[i], below(int(found[i][-1])))
    return [(int(a), int(b), int(c)) for i, a in enumerate(q_ids) for b, c in zip(found_ids[i], found[i])], scored


def _numbers(raw: bytes, dim: int, kind: str) -> np.ndarray:
    """Stored components; narrow ones as doubles, which hold them and multiply faster."""
    x = np.frombuffer(raw, kind).reshape(-1, dim)
    return x.astype(np.float64) if kind == "<i4" else x


def _blocks(row: dict, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), _numbers(row["data"], dim, kind), *(_numbers(row[c], dim, kind).astype(np.float64) for c in ("high", "low"))


_QUERIES = "batch string, q_ids binary, q binary, floor binary, top binary, bottom binary, least double"


def _own(batches: Iterator[pa.RecordBatch], dim: int, kind: str, modulus: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries of each segment, in batches, with the k-th score within their own segment."""
    schema = pa.schema([("batch", pa.string()), *((c, pa.binary()) for c in ("q_ids", "q", "floor", "top", "bottom")), ("least", pa.float64())])
    for batch in batches:
        for row in batch.to_pylist():
            ids, data, high, low = _blocks(row, dim, kind)
            at = np.flatnonzero(ids % modulus == 0)
            for a in range(0, len(at), QUERY_BATCH):
                part = at[a : a + QUERY_BATCH]
                found, _ = search_cell(ids[part], data[part], np.full(len(part), -np.inf), ids, data, high, low, k)
                floor = np.full(len(part), -np.inf)
                frame = pd.DataFrame(found, columns=["q", "v", "s"])
                kth = frame.groupby("q").s.agg(["min", "size"])
                place = {i: n for n, i in enumerate(ids[part].tolist())}
                for i, (s, n) in zip(kth.index, kth.to_numpy()):
                    if n == k and (ids[part] == i).sum() == 1:
                        floor[place[i]] = below(int(s))
                q = data[part].astype(kind)
                yield out_batch(schema, batch=[f"{row['seg']}-{a}"], q_ids=[ids[part].astype("<i8").tobytes()], q=[q.tobytes()], floor=[floor.tobytes()], top=[q.max(axis=0).tobytes()], bottom=[q.min(axis=0).tobytes()], least=[float(floor.min())])


def _reach(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Cells that may hold a result: batch, seg. No product of a query and a vector
    exceeds, in a term, the largest of the four products of both ends' values."""
    schema = pa.schema([("batch", pa.string()), ("seg", pa.int64())])
    whole = lambda x: np.frombuffer(x, kind).astype(np.float64)
    for batch in batches:
        for r in batch.to_pylist():
            segs = r["page"]
            ends = [np.stack([whole(s[c]) for s in segs]) for c in ("top", "bottom")]
            four = np.stack([whole(r[c]) * e for c in ("top", "bottom") for e in ends])
            # with room for rounding where doubles are not exact
            bound = four.max(axis=0).sum(axis=1) + (four.shape[2] + 4) * 2.0**-51 * np.abs(four).max(axis=0).sum(axis=1)
            fit = [s["seg"] for s, b in zip(segs, bound) if b >= r["least"]]
            yield out_batch(schema, batch=[r["batch"]] * len(fit), seg=fit)


def _searcher(dim: int, kind: str, k: int):
    def search(cells: pa.Table, segment: pa.Table) -> pa.Table:
        found = []
        for s in segment.to_pylist():  # one
            blocks = _blocks(s, dim, kind)
            for r in cells.to_pylist():
                q_ids, q = np.frombuffer(r["q_ids"], "<i8"), _numbers(r["q"], dim, kind)
                found += search_cell(q_ids, q, np.frombuffer(r["floor"], np.float64), *blocks, k)[0]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], schema=_CELL)

    return search


def top_k(spark: SparkSession, vectors: DataFrame, modulus: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id is divisible by
    ``modulus``, the k highest inner products with all other vectors (all, if
    fewer), ties to smaller ids.

    Vectors that are null or hold null or non-finite components take no part;
    missing dimensions count as 0 (an empty vector's scores are 0). Components of 2^62 / SCALE or more,
    and a product that is met and does not fit in 64 bits, raise OverflowError. Rows
    that repeat an id are candidates each, but never of their own id; a
    repeated query id has one list. No vectors give no rows; other columns
    are ignored."""
    whole = quantised(vectors)
    dim, peak = whole.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, kind = checked(dim, peak or 0.0)
    whole = whole.withColumn("v", F.col("v").cast("array<int>")) if kind == "<i4" else whole
    segs = segments(spark, whole, dim, kind)
    queries = saved(spark, segs.transform(mapped, partial(_own, dim=dim, kind=kind, modulus=modulus, k=k), _QUERIES), "queries")
    n_pages, n_shares = -(-segs.count() // PAGE), max(1, -(-queries.count() // SHARE))
    pages = segs.select(F.pmod(F.xxhash64("seg"), F.lit(n_pages)).alias("place"), F.struct("seg", "top", "bottom").alias("s")).groupBy("place").agg(F.collect_list("s").alias("page"))  # about PAGE small rows
    spread = queries.select("batch", "top", "bottom", "least", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)).cast("array<bigint>")).alias("place"))
    cells = saved(spark, spread.join(pages, "place").select("batch", "top", "bottom", "least", "page").transform(mapped, partial(_reach, kind=kind), "batch string, seg long"), "cells")
    placed = cells.withColumn("share", F.pmod(F.xxhash64("batch"), F.lit(n_shares)))
    asked = placed.join(queries.select("batch", "q_ids", "q", "floor"), "batch")
    held = segs.select("seg", "ids", "data", "high", "low").join(placed.select("seg", "share").distinct(), "seg")
    asked, held = asked.toDF(*asked.columns), held.toDF(*held.columns)
    found = asked.groupBy("seg", "share").cogroup(held.groupBy("seg", "share")).applyInArrow(_searcher(dim, kind, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH fine AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM fine q JOIN fine d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) t
WHERE rank <= 5
"""
