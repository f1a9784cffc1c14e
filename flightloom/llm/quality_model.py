"""Quality classifier on random-indexing word vectors (operator 6).

Every hashed token has a sparse ternary index vector; a token's context vector
is the sum of the index vectors of its neighbours over the whole corpus, made
in one pass with partial sums a task (whole numbers in doubles: exact). A document pools its tokens' vectors (mean
and spread); a two-layer network in numpy, its output divided by a temperature
fitted on held-back training rows, gives the probability of good quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.bytebpe import codepoint_classes
from flightloom.llm.common import crc_mod, documents, mapped, out_batch, ragged, text_chunks, words_of

BUCKETS = 1 << 14
DIM = 64
NONZERO = 4
REACH = 2
#: Bound of the sample of labelled rows that the network is fitted on.
MAX_LABELLED = 20_000
HIDDEN = 32
EPOCHS = 60
PARTS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each text's tokens in order, offsets of the texts). Tokens
    are runs of one kind (letters, digits, others) within words; letters in
    lower case, a run of two or more capitals being preceded by a sign of its own."""
    codes, offsets, vocab = words_of(text)
    if not len(codes):
        return np.zeros(0, np.int64), offsets
    names = vocab.to_pylist()
    points = np.frombuffer(("\n" + "\n".join(names) + "\n").encode("utf-32-le"), np.uint32)
    low = np.frombuffer(("\n" + "\n".join(pc.utf8_lower(vocab).to_pylist()) + "\n").encode("utf-32-le"), np.uint32)
    if len(low) != len(points):  # a lower-case form of another length
        low = points
    kind = codepoint_classes()[points].astype(np.int8)
    kind[points == 10] = -1
    word = np.cumsum(points == 10) - 1
    start = np.flatnonzero((np.diff(kind, prepend=-2) != 0) & (kind >= 0))
    run = np.cumsum((np.diff(kind, prepend=-2) != 0) & (kind >= 0)) - 1
    at = np.flatnonzero(kind >= 0)
    h = mix((low[at].astype(np.uint64) << np.uint64(20)) + np.minimum(at - start[run[at]], 1 << 19).astype(np.uint64))
    first = np.flatnonzero(np.diff(run[at], prepend=-1))
    bucket = 1 + (mix(np.add.reduceat(h, first)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    size = np.diff(np.append(first, len(at)))
    upper = (np.add.reduceat((low[at] != points[at]).astype(np.int64), first) == size) & (size > 1)
    # capitals: bucket 0 goes before the run
    times = 1 + upper.astype(np.int64)
    spread = np.repeat(bucket, times)
    spread[np.cumsum(times)[upper] - 2] = 0
    per_word = np.bincount(np.repeat(word[start], times), minlength=len(names))
    heads = np.cumsum(per_word) - per_word
    n = per_word[codes]
    return spread[ragged(n, heads[codes])], np.concatenate([[0], np.cumsum(n)])[offsets]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places [bucket, NONZERO], signs) of the sparse ternary index vectors."""
    h = mix(np.arange(BUCKETS * NONZERO)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int8)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for chunk in text_chunks(batches):
        t, offsets = tokens(chunk.column("text"))
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for d in range(1, REACH + 1):
            a, b = t[:-d], t[d:]
            same = of[:-d] == of[d:]
            a, b = a[same], b[same]
            for x, y in ((a, b), (b, a)):
                total += np.bincount((x[:, None] * DIM + place[y]).ravel(), weights=sign[y].ravel(), minlength=BUCKETS * DIM)
    rows = total.reshape(BUCKETS, DIM)
    at = np.flatnonzero(np.abs(rows).sum(axis=1)).astype(np.int32)
    schema = pa.schema([("bucket", pa.int32()), *((f"v{i}", pa.float64()) for i in range(DIM))])
    yield out_batch(schema, bucket=at, **{f"v{i}": rows[at, i] for i in range(DIM)})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors [bucket, DIM] from all texts; the common direction
    is taken off. A task sends BUCKETS rows at most, the driver gets BUCKETS."""
    ddl = "bucket int, " + ", ".join(f"v{i} double" for i in range(DIM))
    rows = docs.where("text is not null").select("text").transform(mapped, _contexts, ddl).groupBy("bucket").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM))).toArrow()
    out = np.zeros((BUCKETS, DIM))
    if rows.num_rows:
        at = rows["bucket"].to_numpy()
        out[at] = np.stack([rows[f"v{i}"].to_numpy() for i in range(DIM)], axis=1)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
        out[at] -= out[at].mean(axis=0)
    return out.astype(np.float32)


def pooled(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """[text, 2 DIM + 3] features: mean and mean square of the token vectors,
    log of the number of tokens, share of distinct tokens, share of capitals' signs."""
    t, offsets = tokens(text)
    n_text, n = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n_text, 2 * DIM + 3), np.float32)
    if not len(t):
        return out
    of = np.repeat(np.arange(n_text), n)
    keys, times = np.unique(of * BUCKETS + t, return_counts=True)
    owner, bucket = keys // BUCKETS, keys % BUCKETS
    step = 100_000
    for a in range(0, len(keys), step):
        own = owner[a : a + step]
        v = vectors[bucket[a : a + step]]
        w = (times[a : a + step] / n[own]).astype(np.float32)[:, None]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first], :DIM] += np.add.reduceat(v * w, first, axis=0)
        out[own[first], DIM : 2 * DIM] += np.add.reduceat(v * v * w, first, axis=0)
    out[:, 2 * DIM] = np.log1p(n) / 8
    out[:, 2 * DIM + 1] = np.bincount(owner, minlength=n_text) / np.maximum(n, 1)
    out[:, 2 * DIM + 2] = np.bincount(of[t == 0], minlength=n_text) / np.maximum(n, 1)
    return out


class Network:
    """Two layers (tanh, logistic) on standardised features, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(axis=0) + 1e-4 if len(x) else np.ones(x.shape[1])
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2, self.temperature = np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1), 1.0
        train = ~held if (~held).any() else np.ones(len(x), bool)
        xs, ys = (x[train] - self.mean) / self.scale, y[train]
        if not len(xs):
            return
        share = np.clip(ys.mean(), 0.01, 0.99)
        self.b2[0] = np.log(share / (1 - share))
        theta = [self.w1, self.b1, self.w2, self.b2]
        m, v, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(xs))
            for i in range(0, len(xs), 256):
                xb, yb = xs[order[i : i + 256]], ys[order[i : i + 256]]
                h = np.tanh(xb @ self.w1 + self.b1)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - yb) / len(xb)
                dh = np.outer(d, self.w2) * (1 - h * h)
                grads = [xb.T @ dh + 1e-4 * self.w1, dh.sum(axis=0), h.T @ d + 1e-4 * self.w2, d.sum(keepdims=True)]
                t += 1
                for p, g, a, b in zip(theta, grads, m, v):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= 0.005 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        if held.any() and 0 < y[held].mean() < 1:
            z, yh = self.logits(x[held]), y[held]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, z / s) - yh * z / s) for s in grid])])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, folds: int = 3, held_fold: int = 1) -> Network:
    """The network from labelled rows whose crc32(doc_id as text) mod ``folds``
    is not ``held_fold``: a hash sample of MAX_LABELLED rows in expectation. A
    fifth of it, by hash, is kept for the temperature."""
    taught = labels.where((crc_mod("doc_id", folds) != held_fold) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS))
    n = taught.count()
    chosen = taught.where(part < int(PARTS * min(1.0, MAX_LABELLED / max(1, n)))).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(5)) == 0).limit(2 * MAX_LABELLED)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("held", pa.bool_()), ("x", pa.binary())])
        for chunk in text_chunks(batches):
            x = pooled(chunk.column("text"), shared.value)
            yield out_batch(schema, doc_id=chunk.column("doc_id"), quality=chunk.column("quality"), held=chunk.column("held"), x=[r.tobytes() for r in x])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").transform(mapped, run, "doc_id long, quality int, held boolean, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, 2 * DIM + 3).astype(float)
    return Network(x, rows["quality"].to_numpy().astype(float), rows["held"].to_numpy().astype(bool))


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, score for every row of docs; only text is an input. A null text
    scores as an empty one; equal texts get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for chunk in text_chunks(batches):
            yield out_batch(schema, doc_id=chunk.column("doc_id"), score=net.probabilities(pooled(chunk.column("text"), v).astype(float)))

    return docs.select("doc_id", "text").transform(mapped, run, "doc_id long, score double")


def op6_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = word_vectors(docs)
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vectors)
    return score(docs, vectors, network).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
