"""Non-negative positive-unlabelled learning of toxicity (operator 5).

The classifier sees confirmed toxic texts and unlabelled ones, never texts
labelled clean. With class prior p among the unlabelled, the risk is
p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]); where the second part of a batch
falls below zero, the step goes against its gradient (over-fitting of the
negative part is undone). The model, in numpy, is linear over log2(1 + times) of words and word beginnings (so
over the forms of a word, seen or not) whose rate among positive texts stands out
from that among unlabelled ones. The class prior comes from the same two samples, by the best bin: the least ratio of the
shares of unlabelled and of positive texts above a score."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.bytebpe import LETTER, codepoint_classes
from flightloom.llm.common import crc_mod, documents, forget, mapped, out_batch, ragged, saved, text_chunks, words_of

DIM = 1 << 20
#: Lengths, in letters, of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Bounds of the fitted sample: positive texts and unlabelled ones.
MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
#: A word or beginning may weigh from so many positive texts and so large a ratio on.
#: 24 is what a feature without a bearing reaches with a chance of one in a million, DIM being a million.
MIN_POSITIVE, MIN_RATIO, MAX_WORDS = 3, 24.0, 512
EPOCHS = 40
#: Small samples are gone through more often, for so many steps at least.
MIN_STEPS = 400
#: A step sees the whole sample: in a small part of it the share of positives strays from the
#: prior, so that steps turn round by chance and weights of texts with few telling words stay low.
BATCH = 20_000
#: Share of toxic texts that is assumed for a first fit, and where the samples are too small to tell.
DEFAULT_PRIOR = 0.05
RATE = 0.03
DECAY = 1e-5
PARTS = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((23, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_features(text: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashed features of each text, times of each, offsets of the texts): its lower-case letter
    runs, and the beginnings of BEGINNINGS letters of those that are as long. ``only``
    (DIM booleans): features wanted; the others are left out before words meet texts."""
    codes, offsets, vocab = words_of(text)
    n_text = len(offsets) - 1
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_text + 1, np.int64)
    joined = "\n" + "\n".join(pc.utf8_lower(vocab).to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = codepoint_classes()[points] == LETTER
    word = np.cumsum(points == 10) - 1
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    at = np.flatnonzero(letter)
    run = np.repeat(np.arange(len(start)), end - start)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed((points[at].astype(np.uint64) << np.uint64(20)) + (at - start[run]).astype(np.uint64)))])
    first = np.cumsum(end - start) - (end - start)
    whole = mixed(running[first + (end - start)] - running[first])
    runs, names = [np.arange(len(start))], [whole]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start >= k)
        runs.append(long)
        names.append(mixed(running[first[long] + k] - running[first[long]] + np.uint64(k)))
    of_word, bucket = word[start[np.concatenate(runs)]], (np.concatenate(names) % np.uint64(DIM)).astype(np.int64)
    if only is not None:
        wanted = only[bucket]
        of_word, bucket = of_word[wanted], bucket[wanted]
    bucket = bucket[np.argsort(of_word, kind="stable")]
    per_word = np.bincount(of_word, minlength=len(vocab))
    heads = np.cumsum(per_word) - per_word
    times = per_word[codes]
    of = np.repeat(np.repeat(np.arange(n_text), np.diff(offsets)), times)
    keys, counts = np.unique(of * DIM + bucket[ragged(times, heads[codes])], return_counts=True)
    of = keys // DIM
    return keys % DIM, counts, np.searchsorted(of, np.arange(n_text + 1)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("positive", pa.bool_()), ("features", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
    for chunk in text_chunks(batches):
        values, counts, offsets = word_features(chunk.column("text"))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (values, counts)]
        yield pa.RecordBatch.from_arrays([chunk.column("positive"), *lists], schema=schema)


def part_of(salt: int):
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(PARTS))


def telling_words(k_p: np.ndarray, k_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The hashed features found in MIN_POSITIVE of ``n_p`` positive texts or more, and
    so much more often there than among ``n_u`` unlabelled ones that the log-likelihood
    ratio of the two rates reaches MIN_RATIO; the MAX_WORDS most telling of them,
    ascending. k_p, k_u: texts that hold each of them."""
    if not n_p or not n_u:
        return np.zeros(0, np.int64)
    rate = (k_p + k_u) / (n_p + n_u)
    part = lambda k, n, r: k * np.log(np.maximum(k, 1e-9) / np.maximum(n * r, 1e-9)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum(n * (1 - r), 1e-9))
    ratio = np.where((k_p >= MIN_POSITIVE) & (k_p / n_p > k_u / n_u), 2 * (part(k_p, n_p, rate) + part(k_u, n_u, rate)), 0)
    return np.sort(np.argsort(-ratio, kind="stable")[: min(MAX_WORDS, int((ratio >= MIN_RATIO).sum()))])


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear score from matrices [text, feature]; its
    sigmoid is the probability of the positive class. No rows: the prior's bias."""
    rng = np.random.default_rng(seed)
    dim = positive.shape[1]
    theta = np.zeros(dim + 1)
    theta[-1] = np.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return theta[:-1], float(theta[-1])
    one = lambda x: np.concatenate([x.astype(np.float32, copy=False), np.ones((len(x), 1), np.float32)], axis=1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    xp_all, xu_all = one(positive), one(unlabelled)
    m, v, t = np.zeros(dim + 1), np.zeros(dim + 1), 0
    per_pos = max(1, min(len(xp_all), BATCH))
    for _ in range(max(epochs, -(-MIN_STEPS // -(-len(xu_all) // BATCH)))):
        u_order, p_order = rng.permutation(len(xu_all)), rng.permutation(len(xp_all))
        for i in range(0, len(xu_all), BATCH):
            xu = xu_all[u_order[i : i + BATCH]]
            xp = xp_all[np.take(p_order, np.arange(per_pos) + (i // BATCH) * per_pos, mode="wrap")]
            at = theta.astype(np.float32)
            fu, fp = (xu @ at).astype(np.float64), (xp @ at).astype(np.float64)
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            g_negative = xu.T @ sig(fu).astype(np.float32) / len(xu) - prior * (xp.T @ sig(fp).astype(np.float32)) / len(xp)
            g_positive = -prior * (xp.T @ sig(-fp).astype(np.float32)) / len(xp)
            g = g_positive + g_negative if negative >= 0 else -g_negative
            g[:-1] += DECAY * theta[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
    return theta[:-1], float(theta[-1])


def best_bin_prior(f_positive: np.ndarray, f_unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least, over scores, of the ratio of
    the two shares above it, each widened by its sampling error; so no text labelled
    clean is needed. DEFAULT_PRIOR where there are too few texts to tell."""
    n_p, n_u = len(f_positive), len(f_unlabelled)
    if n_p < 20 or n_u < 20:
        return DEFAULT_PRIOR
    edges = np.unique(f_positive)
    p = 1 - np.searchsorted(np.sort(f_positive), edges) / n_p
    u = 1 - np.searchsorted(np.sort(f_unlabelled), edges) / n_u
    p, u = p[p >= 0.1], u[p >= 0.1]
    most = (u + np.sqrt((u + 1 / n_u) / n_u)) / (p - np.sqrt(p * (1 - p) / n_p))
    best = int(np.argmin(most))
    return float(np.clip(u[best] / p[best], 0.001, 0.9))


#: A chosen word of a text: its place among the chosen ones, log2(1 + times).
HELD = np.dtype([("word", np.uint16), ("x", np.float16)])


def _chosen(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The chosen words that each text holds, as bytes of HELD."""
    schema = pa.schema([("positive", pa.bool_()), ("held", pa.binary())])
    for batch in batches:
        out = []
        for own, times in zip(batch.column("features"), batch.column("times")):
            _, at, mine = np.intersect1d(words, own.values.to_numpy(), assume_unique=True, return_indices=True)
            held = np.zeros(len(at), HELD)
            held["word"], held["x"] = at, np.log2(1 + times.values.to_numpy()[mine])
            out.append(held.tobytes())
        yield out_batch(schema, positive=batch.column("positive"), held=out)


def matrix(held: list[bytes], n_words: int) -> np.ndarray:
    """[text, word] of log2(1 + times) from bytes of HELD."""
    x = np.zeros((len(held), n_words), np.float32)
    cells = np.frombuffer(b"".join(held), HELD)
    x[np.repeat(np.arange(len(held)), [len(h) // HELD.itemsize for h in held]), cells["word"]] = cells["x"]
    return x


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5) -> tuple[np.ndarray, float, float]:
    """(weights, bias, class prior). The only labels used are the toxic ones, of rows
    whose crc32(doc_id as text) mod ``folds`` is not 0; unlabelled texts are from the
    same rows of docs, whatever their label. Both are hash samples of distinct texts, bounded in
    expectation. Features are counted in the cluster; the driver gets the counts
    of those that MIN_POSITIVE positive texts hold, and the MAX_WORDS at most that weigh
    for each sampled text."""
    spark = docs.sparkSession
    toxic = labels.where((crc_mod("doc_id", folds) != 0) & (F.col("toxic") == 1)).select("doc_id").distinct()
    n_pos, n_docs = toxic.count(), docs.count()
    own = docs.where(crc_mod("doc_id", folds) != 0).select("doc_id", "text")
    chosen = toxic.where(part_of(1) < int(PARTS * min(1.0, MAX_POSITIVE / max(1, n_pos)))).limit(2 * MAX_POSITIVE)
    pos = own.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    unl = own.where(part_of(2) < int(PARTS * min(1.0, MAX_UNLABELLED / max(1, n_docs * (folds - 1) / folds)))).withColumn("positive", F.lit(False))
    sample = pos.unionByName(unl).select("positive", "text").dropDuplicates(["positive", "text"])
    rows = saved(spark, sample.transform(mapped, _features, "positive boolean, features array<int>, times array<int>"), "features")
    n = dict(rows.groupBy("positive").count().collect())
    seen = rows.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).where(F.col("p") >= MIN_POSITIVE).toArrow()
    k_p, k_u = (np.bincount(seen["f"].to_numpy(), weights=seen[c].to_numpy(), minlength=DIM) for c in ("p", "u"))
    words = telling_words(k_p, k_u, n.get(True, 0), n.get(False, 0))
    held = rows.transform(mapped, partial(_chosen, words=words), "positive boolean, held binary").toArrow()
    forget(spark, rows)
    held = held.sort_by([("positive", "ascending"), ("held", "ascending")])  # the same order of samples in every run
    x = matrix(held["held"].to_pylist(), len(words))
    flags = held["positive"].to_numpy()
    positive, unlabelled = x[flags], x[~flags]
    rough = fit_nnpu(positive[::2], unlabelled[::2], DEFAULT_PRIOR)
    prior = best_bin_prior(*(half.astype(float) @ rough[0] for half in (positive[1::2], unlabelled[1::2])))
    own_w, b = fit_nnpu(positive, unlabelled, prior)
    w = np.zeros(DIM, np.float32)
    w[words] = own_w
    return w, b, prior


def score(docs: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    """doc_id, score for every row of docs; only text is an input. A null text
    scores as an empty one, by the bias alone. Equal texts get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast((w, b))  # DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        weighs = weights != 0
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for chunk in text_chunks(batches):
            values, counts, offsets = word_features(chunk.column("text"), weighs)
            run_sum = np.concatenate([[0.0], np.cumsum(weights[values] * np.log2(1.0 + counts))])
            f = run_sum[offsets[1:]] - run_sum[offsets[:-1]] + bias
            yield out_batch(schema, doc_id=chunk.column("doc_id"), score=1 / (1 + np.exp(-np.clip(f, -30, 30))))

    return docs.select("doc_id", "text").transform(mapped, run, "doc_id long, score double")


def op5_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    w, b, _ = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, w, b).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
