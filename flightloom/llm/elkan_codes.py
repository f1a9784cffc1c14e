"""Vector codes by Elkan's Lloyd rounds (operator 12).

A vector is cut into parts; every part has a codebook of entries and goes to the nearest
one. For each part of each vector the state keeps an upper bound on the distance to its entry and
one lower bound an entry; when entries have moved, the bounds move by as much. An
entry is looked at again only if neither its lower bound nor half its distance from the own entry shows it
to be strictly farther; those looked at are compared by whole-number squared distances, ties to
the lower index, so pruning never changes a result. A round is one map over the written state,
which holds the vectors, their codes and bounds; sums of each entry's parts come out of the same
map and are added up by entry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import drop_shuffles_early, forget, mapped, saved

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a batch in memory at once (64-bit distances to all entries of a part).
ROWS = 2048
#: Bounds are distances in doubles, kept this much on the safe side.
SLACK = 1e-9
#: Whole numbers up to this size are exact in doubles.
EXACT = 1 << 52
_STATE = "vec_id long, label long, v binary, code binary, upper binary, base binary, step binary, lower binary, part int, entry int, n long, sums string"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), *((c, pa.binary()) for c in ("v", "code", "upper", "base", "step", "lower")), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.string())])
_STATE_ROW = ["vec_id", "label", "v", "code", "upper", "base", "step", "lower"]


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding as doubles, of the rows without null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    return vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: whole numbers in doubles."""
    return np.floor(x * SCALE)


def numbers(x: np.ndarray, beside: float = 0.0) -> np.ndarray:
    """Whole numbers held in doubles, as they are if squared distances of them (and of others up to
    ``beside``) are exact in doubles, else as Python's integers."""
    peak = max(float(np.abs(x).max(initial=0)), beside)
    if 4 * peak * peak * max(1, x.shape[-1]) < EXACT:
        return x
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances [vector, entry] in whole numbers."""
    if x.dtype == object or entries.dtype == object:
        return np.array([((x - e) ** 2).sum(axis=1) for e in entries], object).T.reshape(len(x), len(entries))
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def paired(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows that belong together."""
    d = x - entries
    return (d * d).sum(axis=1)


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper bounds, lower bounds of vectors that have none yet: every distance is measured."""
    d = distances(x, entries)
    code = d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=lambda i, r=r: (r[i], i)) for r in d], np.int64)
    far = root(d)
    return code, far[np.arange(len(x)), code] * (1 + SLACK), far * (1 - SLACK)


def pruned(x: np.ndarray, entries: np.ndarray, between: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from bounds that hold: (codes, upper, lower, distances measured). between: distances between
    entries, on the safe side below. An entry is left out only where it is strictly farther than the own one."""
    apart = between + np.where(np.eye(len(between), dtype=bool), np.inf, 0.0)
    rows = np.flatnonzero(upper >= apart.min(axis=1, initial=np.inf)[code] / 2)
    code, upper = code.copy(), upper.copy()
    if not len(rows):
        return code, upper, lower, 0
    own = paired(x[rows], entries[code[rows]])
    upper[rows] = root(own) * (1 + SLACK)
    lower[rows, code[rows]] = root(own) * (1 - SLACK)
    look = (lower[rows] <= upper[rows, None]) & (apart[code[rows]] / 2 <= upper[rows, None])
    at, entry = np.nonzero(look)
    if not len(at):
        return code, upper, lower, len(rows)
    d = paired(x[rows[at]], entries[entry])
    lower[rows[at], entry] = root(d) * (1 - SLACK)
    at, entry, d = np.concatenate([np.arange(len(rows)), at]), np.concatenate([code[rows], entry]), np.concatenate([own, d])
    first = np.lexsort((entry, d, at)) if d.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], d[i], entry[i])))
    first = first[np.r_[True, at[first][1:] != at[first][:-1]]]
    code[rows], upper[rows] = entry[first], root(d[first]) * (1 + SLACK)
    return code, upper, lower, len(at)


def packed(lower: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds in four bits each, cut down to steps above the least of them (that of the own entry is not kept):
    base and step (32-bit floats, cut down too), and two bounds a byte."""
    lower = np.maximum(lower, 0.0)
    lower[np.arange(len(lower)), code] = np.inf
    base = lower.min(axis=1, initial=np.inf)
    base = np.where(np.isfinite(base), base, 0.0)
    lower[np.arange(len(lower)), code] = base
    below = lambda v: np.maximum(0, np.nextafter(v.astype(np.float32), np.float32(-1)))
    base, step = below(base), below((lower.max(axis=1, initial=0) - base) / 15)
    q = np.clip(np.floor((lower - base[:, None]) / np.where(step > 0, step, 1)[:, None].astype(np.float64)), 0, 15) * (step > 0)[:, None]
    q = np.pad(q.astype(np.uint8), ((0, 0), (0, q.shape[1] % 2)))
    return base, step, q[:, ::2] << 4 | q[:, 1::2]


def unpacked(base: np.ndarray, step: np.ndarray, q: np.ndarray, entries: int) -> np.ndarray:
    both = np.stack([q >> 4, q & 15], axis=2).reshape(len(q), -1)[:, :entries]
    return (base[:, None] + both * step[:, None].astype(np.float64)) * (1 - 1e-6)


def _rows(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _binary(x: np.ndarray) -> list[bytes]:
    x = np.ascontiguousarray(x)
    return [r.tobytes() for r in x]


class Books:
    """Codebooks of all parts in one round: entries, how far each has moved since the last one, distances between them."""

    def __init__(self, entries: list[np.ndarray], before: list[np.ndarray] | None = None) -> None:
        """entries: [entry, position] of each part, whole numbers in doubles or Python's integers."""
        self.entries = entries
        self.peak = max((float(max((abs(v) for v in e.ravel()), default=0)) for e in entries), default=0.0)
        self.moved = [np.zeros(len(e)) if b is None else root(paired(exact(e), exact(b))) * (1 + SLACK) for e, b in zip(entries, before or [None] * len(entries))]

    def between(self, i: int) -> np.ndarray:
        """Distances between the entries of a part, not above the true ones."""
        e = self.entries[i].astype(np.float64)
        gaps = np.sqrt(np.maximum(0.0, np.stack([((e - r) ** 2).sum(axis=1) for r in e]))) if len(e) else np.zeros((0, 0))
        return gaps * (1 - SLACK)


def exact(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _arrays(batch: pa.RecordBatch, books: Books, v: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, vectors' parts, entries), both in the kind of numbers that is exact for them."""
    width = v.shape[1] // PARTS
    for i in range(PARTS):
        x, e = v[:, i * width : (i + 1) * width], books.entries[i]
        x = numbers(x, books.peak)
        yield i, x, exact(e) if x.dtype == object else e.astype(np.float64)


def _sums(tally: list[list[dict]], i: int, code: np.ndarray, x: np.ndarray) -> None:
    """Adds up count and componentwise sum of the parts of each entry."""
    order = np.argsort(code, kind="stable")
    used, start = np.unique(code[order], return_index=True)
    sums = np.add.reduceat(x[order] if x.dtype == object else x[order].astype(np.int64), start, axis=0) if len(used) else []
    for c, s, n in zip(used.tolist(), sums, np.diff(np.r_[start, len(code)]).tolist()):
        held = tally[i].setdefault(c, [0, [0] * x.shape[1]])
        held[0] += n
        held[1] = [a + int(b) for a, b in zip(held[1], s)]


def _step(batches: Iterator[pa.RecordBatch], books: Books, first: bool) -> Iterator[pa.RecordBatch]:
    """State rows under the round's codebooks, and, at the end of a task, rows of sums (part, entry, n, sums)."""
    tally: list[dict] = [{} for _ in range(PARTS)]
    gaps = None if first else [books.between(i) for i in range(PARTS)]
    for whole_batch in batches:
        for batch in (whole_batch.slice(a, ROWS) for a in range(0, whole_batch.num_rows, ROWS)):
            n = batch.num_rows
            v = whole(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)) if first else _rows(batch.column("v"), "<f8").reshape(n, -1)
            made = {c: [] for c in ("code", "upper", "base", "step", "lower")}
            for i, x, e in _arrays(batch, books, v):
                if first:
                    code, upper, lower = nearest(x, e)
                else:
                    k = len(e)
                    half = (k + 1) // 2
                    code = _rows(batch.column("code"), "u1", PARTS)[:, i].astype(np.int64)
                    upper = _rows(batch.column("upper"), "<f8", PARTS)[:, i] + books.moved[i][code]
                    base, step = (_rows(batch.column(c), "<f4", PARTS)[:, i] for c in ("base", "step"))
                    lower = np.maximum(unpacked(base, step, _rows(batch.column("lower"), "u1", PARTS, half)[:, i], k) - books.moved[i], 0.0)
                    code, upper, lower, _ = pruned(x, e, gaps[i], code, upper, lower)
                _sums(tally, i, code, x)
                for c, a in zip(("base", "step", "lower"), packed(lower, code)):
                    made[c].append(a)
                made["code"].append(code.astype("u1"))
                made["upper"].append(upper.astype("<f8"))
            columns = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": pa.array(_binary(v.astype("<f8")), pa.binary())}
            columns |= {c: pa.array(_binary(np.stack(a, axis=1)), pa.binary()) for c, a in made.items()}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)
    found = [(i, c, n, ",".join(map(str, s))) for i, t in enumerate(tally) for c, (n, s) in t.items()]
    if found:
        rows = dict(zip(("part", "entry", "n", "sums"), map(list, zip(*found))))
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(len(found), f.type) for f in _SCHEMA], schema=_SCHEMA)


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """One entry's counts and sums over the tasks, as Python's integers."""
    sums = [sum(c) for c in zip(*(map(int, s.split(",") if s else []) for s in rows["sums"].to_pylist()))]
    return pa.table({"part": [key[0].as_py()], "entry": [key[1].as_py()], "n": [sum(rows["n"].to_pylist())], "sums": [",".join(map(str, sums))]}, schema=pa.schema([_SCHEMA.field(c) for c in ("part", "entry", "n", "sums")]))


def means(state: DataFrame, entries: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: floor(sum / count) of each entry's parts; unused entries stay. Only
    entries (PARTS * ENTRIES at most) come to the driver."""
    rows = state.where("part is not null").select("part", "entry", "n", "sums").groupBy("part", "entry").applyInArrow(_added, "part int, entry int, n long, sums string").collect()
    out = [exact(e) for e in entries]
    for r in rows:
        out[r.part][r.entry] = [int(s) // r.n for s in (r.sums.split(",") if r.sums else [])]
    return [e if any(abs(v) >= EXACT for v in e.ravel()) else e.astype(np.float64) for e in out]


def _coded(batches: Iterator[pa.RecordBatch], books: Books, first: bool) -> Iterator[pa.RecordBatch]:
    """vec_id, label, code and error under the last codebooks."""
    for state in _step(batches, books, first):
        state = state.filter(pa.array([v is not None for v in state.column("code").to_pylist()]))
        if not state.num_rows:
            continue
        codes, v = _rows(state.column("code"), "u1", PARTS), _rows(state.column("v"), "<f8").reshape(state.num_rows, -1)
        error = [0] * state.num_rows
        for i, x, e in _arrays(state, books, v):
            error = [a + int(b) for a, b in zip(error, paired(x, e[codes[:, i]]))]
        yield pa.RecordBatch.from_arrays([state.column("vec_id"), state.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])


def checksum(entries: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for e in entries for v in e.ravel()).encode()).hexdigest()


def encode(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of each vector kept; the codebooks).

    Vectors that are null or hold null or non-finite components go. The codebooks start as the
    parts of the ENTRIES smallest vec_ids (fewer, if fewer are kept; null ids last, equal ids by their
    vectors). All kept vectors must be of one length that PARTS divides (ValueError). Components of any
    size are exact; an error beyond 64 bits raises OverflowError. No vectors give no rows and no codebooks."""
    drop_shuffles_early(spark)
    rows = kept(vectors)
    spans = [r[0] for r in rows.groupBy(F.size("embedding").alias("n")).count().limit(2).collect()]
    if not spans:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long"), []
    if len(spans) > 1 or spans[0] % PARTS:
        raise ValueError(f"vectors must have one length that {PARTS} divides, found {spans}")
    width = spans[0] // PARTS
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    first = whole(np.array([r[0] for r in start], np.float64).reshape(len(start), -1))
    entries, before, state = [first[:, i * width : (i + 1) * width] for i in range(PARTS)], None, rows
    for r in range(rounds):
        step = partial(_step, books=Books(entries, before), first=not r)
        last, state = state, saved(spark, mapped(state if not r else state.where("part is null").select(*_STATE_ROW), step, _STATE), f"round{r}")
        forget(spark, last)
        before, entries = entries, means(state, entries)
    final = partial(_coded, books=Books(entries, before), first=not rounds)
    coded = saved(spark, mapped(state.where("part is null").select(*_STATE_ROW) if rounds else state, final, "vec_id long, label long, code string, error long"), "codes")
    forget(spark, state)
    return coded, entries


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, entries = encode(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(checksum(entries)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds in SQL, all distances measured."""
    ctes = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)",
        f"cut AS (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p))",
        f"b0 AS (SELECT c.p, k.e, c.x FROM cut c JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) k USING (r))",
    ]
    near = "SELECT r, p, any_value(x) AS x, min((d, e)) AS best FROM (SELECT c.r, c.p, c.x, b.e, CAST(list_sum([(q[1] - q[2]) * (q[1] - q[2]) FOR q IN list_zip(c.x, b.x)]) AS BIGINT) AS d FROM cut c JOIN b{k} b USING (p)) m GROUP BY r, p"
    for k in range(ROUNDS):
        ctes.append(f"a{k} AS ({near.format(k=k)})")
        ctes.append(f"m{k} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS x FROM (SELECT p, best[2] AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{k}, range(1, 4096) t(j) WHERE j <= len(x) GROUP BY p, best[2], j) z GROUP BY p, e)")
        ctes.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    ctes.append(f"fin AS ({near.format(k=ROUNDS)})")
    ctes.append("coded AS (SELECT k.vec_id, k.label, string_agg(lpad(lower(hex(f.best[2])), 2, '0'), '' ORDER BY f.p) AS code, CAST(sum(f.best[1]) AS BIGINT) AS error FROM fin f JOIN kept k USING (r) GROUP BY k.r, k.vec_id, k.label)")
    ctes.append(f"total AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, total"


ORACLE = _oracle()
