"""Language identification as multilingual mixture inference (operator 10).

Each language has a model of character trigrams of words (hashed, smoothed).
A document is a mixture: every word comes from one language, with the product
of its trigrams' probabilities as its likelihood. Expectation-maximisation
estimates the languages' shares; the set of languages is the one of the
growing sets of largest shares that maximises the penalised log-likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.bytebpe import LETTER, codepoint_classes
from flightloom.llm.common import crc_mod, documents, kept_rows, mapped, out_batch, text_chunks, words_of

BUCKETS = 1 << 16
SMOOTHING = 0.05
ITERATIONS = 12
#: Languages of one model at most: it is held by the driver and each worker, a quarter MB a language.
MAX_LANGUAGES = 1024
#: Weight of a further language, in units of log(words + 1).
PENALTY = 2.0
UNDETERMINED = "und"


def trigrams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each letter's trigram in each word, lower case; other
    characters and the word's ends are one boundary sign."""
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "\n" + "\n".join(pc.utf8_lower(vocab).to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = codepoint_classes()[points] == LETTER
    at = np.flatnonzero(letter)
    word = np.cumsum(points == 10)[at] - 1
    p = np.where(letter, points, 0).astype(np.uint64)
    mixed = (p[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p[at + 1] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64), word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.float64())])
    counts: dict[str, np.ndarray] = {}
    for chunk in text_chunks(batches):
        codes, offsets, vocab = words_of(chunk.column("text"))
        langs = chunk.column("lang").dictionary_encode()
        of = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(offsets)).astype(np.int64)
        keys, n = np.unique(of * max(1, len(vocab)) + codes, return_counts=True)  # the words that a language has
        lang_of, word_of = keys // max(1, len(vocab)), keys % max(1, len(vocab))
        bucket, word = trigrams(vocab)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            mine, times = lang_of == i, np.zeros(len(vocab))
            times[word_of[mine]] = n[mine]
            own = np.bincount(bucket, weights=times[word], minlength=BUCKETS)
            counts[lang] = counts[lang] + own if lang in counts else own
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield out_batch(schema, lang=[lang] * len(at), bucket=at.astype(np.int32), n=own[at])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]) from columns text and
    lang of all rows with a lang. Every task sends BUCKETS counts a language at most;
    more than MAX_LANGUAGES languages raise ValueError."""
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    if docs.where("lang is not null").select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: group them first")
    rows = known.transform(mapped, _count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.zeros((BUCKETS, max(1, len(langs))))
    if langs:
        at = pc.index_in(rows["lang"], value_set=pa.array(langs)).to_numpy()
        table[rows["bucket"].to_numpy(), at] = rows["n"].to_numpy()
    table += SMOOTHING
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(lik: np.ndarray, n: np.ndarray, first: np.ndarray, of: np.ndarray, share: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares [text, language], log-likelihood of each text). lik: [entry,
    language]; entries of a text lie together from ``first``; n: times of an entry."""
    total = np.add.reduceat(n, first)
    for _ in range(iterations):
        q = lik * share[of]
        q *= (n / q.sum(axis=1))[:, None]
        share = np.add.reduceat(q, first, axis=0) / total[:, None]
        share = np.maximum(share, 1e-6)
        share /= share.sum(axis=1, keepdims=True)
    return share, np.add.reduceat(n * np.log((lik * share[of]).sum(axis=1)), first)


def infer(text: pa.Array, table: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages of each text by share, -1 past the selected set; shares in
    that order; whether the text has a letter)."""
    codes, offsets, vocab = words_of(text)
    n_lang, n_text = table.shape[1], len(offsets) - 1
    order, shares, has = np.full((n_text, n_lang), -1), np.zeros((n_text, n_lang)), np.zeros(n_text, bool)
    bucket, word = trigrams(vocab)
    if not len(bucket):
        return order, shares, has
    like = np.zeros((len(vocab), n_lang), np.float32)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    like[word[heads]] = np.add.reduceat(table[bucket], heads, axis=0)
    lettered = np.zeros(len(vocab), bool)
    lettered[word[heads]] = True
    of = np.repeat(np.arange(n_text), np.diff(offsets))
    keep = lettered[codes]
    keys, n = np.unique(of[keep] * len(vocab) + codes[keep], return_counts=True)
    of, codes = keys // len(vocab), keys % len(vocab)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    texts = of[first]
    has[texts] = True
    of = np.cumsum(np.diff(of, prepend=-1) > 0) - 1
    n = n.astype(np.float32)
    ll = like[codes]
    peak = ll.max(axis=1, keepdims=True)
    lik = np.exp(ll - peak)
    lik = np.maximum(lik, np.float32(1e-30))
    words = np.add.reduceat(n, first)
    share, _ = _em(lik, n, first, of, np.full((len(first), n_lang), np.float32(1 / n_lang)), ITERATIONS)
    by_share = np.argsort(-share, axis=1, kind="stable")
    best_set = by_share.copy()
    best_share = np.take_along_axis(share, by_share, axis=1)
    size = np.ones(len(first), np.int64)
    top = by_share[:, :1]
    best = np.add.reduceat(n * np.log(np.take_along_axis(lik, top[of], axis=1)[:, 0]), first)
    chosen = np.zeros((len(first), n_lang))
    chosen[:, 0] = 1
    active = np.ones(len(first), bool)
    for k in range(2, n_lang + 1):  # the next largest share joins while that pays
        sub = np.flatnonzero(active)
        rows = active[of]
        own = np.cumsum(active)[of[rows]] - 1
        head = np.flatnonzero(np.diff(own, prepend=-1))
        cols = best_set[sub][:, :k]
        part = np.take_along_axis(lik[rows], cols[own], axis=1)
        got, value = _em(part, n[rows], head, own, np.full((len(sub), k), np.float32(1 / k)), ITERATIONS)
        value = value - (k - 1) * penalty * np.log(words[sub] + 1)
        better = value > best[sub]
        best[sub[better]], size[sub[better]] = value[better], k
        chosen[sub[better], :k] = got[better]
        active[sub[~better]] = False
        if not active.any():
            break
    again = np.argsort(-chosen, axis=1, kind="stable")
    chosen, best_set = np.take_along_axis(chosen, again, axis=1), np.take_along_axis(best_set, again, axis=1)
    best_set[np.arange(n_lang) >= size[:, None]] = -1
    order[texts] = best_set
    # shares as the full mixture has them: the first one is the score
    full = np.where(best_set >= 0, np.take_along_axis(share, np.maximum(best_set, 0), axis=1), 0)
    shares[texts] = full
    del best_share
    return order, shares, has


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, penalty: float = PENALTY) -> DataFrame:
    """All columns of docs' doc_id plus lang_pred, score, languages and shares.

    Only text is an input. A text that is null or has no letter, and every text
    where no language was learned, is ``und`` with score 0 and no languages.
    Equal texts get equal results; ties go to the first language in name order."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))  # BUCKETS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logp = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        for chunk in text_chunks(batches):
            order, shares, has = infer(chunk.column("text"), logp, penalty)
            has = has & bool(names)
            sets = [[(names[j], float(s)) for j, s in zip(o, sh) if j >= 0] if h else [] for o, sh, h in zip(order.tolist(), shares.tolist(), has.tolist())]
            yield out_batch(schema, doc_id=chunk.column("doc_id"), lang_pred=[s[0][0] if s else UNDETERMINED for s in sets], score=[min(1.0, s[0][1]) if s else 0.0 for s in sets], languages=[[x[0] for x in s] for s in sets], shares=[[x[1] for x in s] for s in sets])

    return docs.select("doc_id", "text").transform(mapped, run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def trained_on(docs: DataFrame, folds: int = 5) -> tuple[list[str], np.ndarray]:
    """The model from rows whose crc32(doc_id as text) mod ``folds`` is not 0 (null ids are held out)."""
    return learn(docs.where(crc_mod("doc_id", folds) != 0))


def keep_identified(docs: DataFrame, langs: list[str], table: np.ndarray, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, whose main language has a share of ``least`` or more (so not ``und``)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))

    def keep(chunk: pa.RecordBatch) -> np.ndarray:
        names, logp = shared.value
        _, shares, has = infer(chunk.column("text"), logp)
        return has & bool(names) & (shares.max(axis=1, initial=0) >= least)

    return kept_rows(docs, keep)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, table = trained_on(docs)
    found = identify(docs, langs, table)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "languages", "shares")
