"""Quality rules with tokeniser fertility (operator 1).

Counts of words, symbols, repeated lines and repeated 8-word windows decide
first. Then a public subword vocabulary judges the text: characters per token,
the share of byte-fallback tokens and the entropy of its tokens each must lie
in the band of the text's language (column lang, if there is one) or main
script. A text outside them is not prose in a language that the vocabulary
knows, but noise, markup or encoded data."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from flightloom.llm.bytebpe import LETTER, codepoint_classes
from flightloom.llm.common import documents, filled, kept_rows, mapped, out_batch, ragged, text_chunks, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Characters of words that a worker remembers the tokens of; beyond that it starts afresh.
CACHE_CHARS = 2_000_000
#: Main scripts by first code point; those between are ``other``. Fixed values of Unicode's blocks.
SCRIPTS = ("other", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han")
SCRIPT_RANGES = [(0x41, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2), (0x400, 0x52F, 3), (0x590, 0x5FF, 4), (0x600, 0x6FF, 5), (0x750, 0x77F, 5), (0x900, 0xDFF, 6), (0xE00, 0xE7F, 7), (0x1100, 0x11FF, 8), (0xAC00, 0xD7AF, 8), (0x3040, 0x30FF, 9), (0x3400, 0x4DBF, 10), (0x4E00, 0x9FFF, 10)]
#: (least characters a token, most, most byte share, most that the floor of the entropy asks for, in bits) of each
#: script. The floor is 0.6 log2(tokens) up to that. Telugu and scripts under ``other`` fall back to bytes for most
#: letters, so the bands of indic and other are wide; random letters of those pass.
BANDS = {
    "latin": (0.0, 6.0, 0.10, 0.0), "greek": (0.6, 8.0, 0.10, 3.5), "cyrillic": (1.25, 8.0, 0.10, 4.5), "hebrew": (0.6, 8.0, 0.15, 3.5), "arabic": (0.6, 8.0, 0.20, 3.5),
    "indic": (0.35, 8.0, 0.80, 3.5), "thai": (0.7, 8.0, 0.30, 3.5), "hangul": (0.5, 4.0, 0.35, 4.0), "kana": (0.62, 4.0, 0.48, 4.0), "han": (0.5, 4.0, 0.45, 4.5), "other": (0.25, 9.0, 0.90, 3.5),
}
#: log2 of the number of tokens at which FLOORS are given; straight lines between, 0 bits at 0.
KNOTS = (5, 6, 7, 8, 9, 10, 11, 12)
#: Least entropy in bits and least characters a token of Latin texts by language and length, just below the lowest
#: 0.5 % of the texts labelled good at sf0.1 (a cubic and a line fitted to them, less their spread at each length).
FLOORS = {
    "en": ((4.23, 4.97, 5.53, 5.97, 6.29, 6.55, 6.74, 6.84), (1.77, 1.77, 1.86, 1.96, 2.06, 2.10, 2.14, 2.15)),
    "de": ((4.39, 5.01, 5.48, 5.87, 6.15, 6.38, 6.55, 6.63), (1.78, 1.78, 1.88, 1.98, 2.08, 2.12, 2.16, 2.17)),
    "fr": ((4.21, 4.91, 5.43, 5.83, 6.10, 6.32, 6.47, 6.55), (1.51, 1.51, 1.61, 1.71, 1.82, 1.86, 1.90, 1.92)),
    "es": ((4.50, 5.04, 5.49, 5.88, 6.18, 6.44, 6.61, 6.66), (1.48, 1.49, 1.58, 1.68, 1.78, 1.82, 1.86, 1.87)),
}
#: Texts without a language of FLOORS must clear the lowest of all.
LOWEST = tuple(tuple(min(x) for x in zip(*(f[i] for f in FLOORS.values()))) for i in range(2))
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, byte_share double, entropy double, reason string"


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for a, b, s in SCRIPT_RANGES:
        table[a : b + 1] = s
    table[codepoint_classes() != LETTER] = 255
    return table


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets[1:]] - np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets[:-1]]


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in it.

    Windows meet by a 64-bit hash of their codes (of three doublings); those
    that meet are compared word by word, and if ever two differ the windows are
    named anew without hashes."""
    n_text = len(offsets) - 1
    at = ragged(np.maximum(np.diff(offsets) - window + 1, 0), offsets[:-1])
    if not len(at):
        return np.zeros(n_text, np.int64)
    of = np.repeat(np.arange(n_text), np.diff(offsets))
    h = codes.astype(np.uint64) + np.uint64(1)
    for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(a))) * np.uint64(b)
    step, length = 1, 1
    while length < window:
        step = min(length, window - length)
        ahead = np.zeros_like(h)
        ahead[: len(h) - step] = h[step:]
        h = h * np.uint64(0x9E3779B97F4A7C15 + 2 * length) + (ahead ^ (ahead >> np.uint64(31)))
        length += step
    key = h[at] ^ (of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    left, right = at[order[same]], at[order[same + 1]]
    if not all((codes[left + j] == codes[right + j]).all() for j in range(window)) or (of[left] != of[right]).any():
        rows = np.stack([of[at], *(codes[at + j] for j in range(window))], axis=1)
        _, name, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[times[name.ravel()] > 1]
    else:
        twice = np.unique(np.concatenate([left, right]))
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return sums(np.cumsum(cover)[:-1] > 0, offsets)


def repeated_lines(text: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    lists = pc.split_pattern(text, "\n")
    coded = lists.flatten().dictionary_encode()
    worded = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(text)), np.diff(offsets))
    keep = worded[codes] if len(codes) else np.zeros(0, bool)
    of, codes = of[keep], codes[keep]
    first = np.unique(of * max(1, len(worded)) + codes) // max(1, len(worded))
    return np.bincount(of, minlength=len(text)) - np.bincount(first, minlength=len(text))


class Fertility:
    """Tokens of words by a sentencepiece vocabulary, remembered by word in flat arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self.index, self.ids, self.ends, self.chars = {}, array("i"), array("q", [0]), 0

    def words(self, vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens of the words, all their tokens in a row)."""
        if self.chars > CACHE_CHARS:
            self._forget()
        index = self.index
        new = [w for w in vocab if w not in index]
        for a in range(0, len(new), 20_000):
            for w, ids in zip(new[a : a + 20_000], self.model.encode(new[a : a + 20_000], num_threads=1)):
                index[w] = len(self.ends) - 1
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
        self.chars += sum(map(len, new))
        at = np.fromiter(map(index.__getitem__, vocab), np.int64, len(vocab))
        ends, flat = np.array(self.ends), np.array(self.ids, np.int32)
        lens = ends[at + 1] - ends[at]
        return lens, flat[ragged(lens, ends[at])]

    def measure(self, codes: np.ndarray, offsets: np.ndarray, vocab: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, byte-fallback tokens, entropy of the tokens in bits) of each text."""
        n_text = len(offsets) - 1
        if not len(codes):
            return np.zeros(n_text), np.zeros(n_text), np.zeros(n_text)
        lens, flat = self.words(vocab)
        heads = np.cumsum(lens) - lens
        n_tokens = sums(lens[codes], offsets)
        byte_sums = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        per_word = byte_sums[heads + lens] - byte_sums[heads]
        n_bytes = sums(per_word[codes], offsets)
        # distinct words first: the tokens of each follow as often as the word
        of = np.repeat(np.arange(n_text), np.diff(offsets))
        keys, times = np.unique(of * len(vocab) + codes, return_counts=True)
        of, word = keys // len(vocab), keys % len(vocab)
        size = len(self.is_byte)
        key = np.repeat(of, lens[word]) * size + flat[ragged(lens[word], heads[word])]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.repeat(times, lens[word])[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.add.reduceat(weight, first).astype(float)
        of = key[first] // size
        total = np.maximum(n_tokens, 1)
        part = count / total[of]
        return n_tokens, n_bytes, np.bincount(of, weights=-part * np.log2(part), minlength=n_text)


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def main_script(codes: np.ndarray, offsets: np.ndarray, vocab: list[str]) -> np.ndarray:
    """Index of the script of most letters of each text; ties to the first, 0 without letters."""
    n = len(SCRIPTS)
    if not vocab:
        return np.zeros(len(offsets) - 1, np.int64)
    points = np.frombuffer(("\n".join(vocab) + "\n").encode("utf-32-le"), np.uint32)
    word = np.cumsum(points == 10) - (points == 10)
    kind = script_table()[points]
    own = kind != 255
    table = np.bincount(word[own] * n + kind[own], minlength=len(vocab) * n).reshape(-1, n)
    counts = np.stack([sums(table[:, s][codes], offsets) for s in range(n) if table[:, s].any() or s == 0], axis=1)
    present = np.array([s for s in range(n) if table[:, s].any() or s == 0])
    return present[np.argmax(counts, axis=1)]


def floors(script: np.ndarray, lang: list[str | None], n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least characters a token, least entropy in bits) of each text."""
    size = np.log2(np.maximum(n_tokens, 1))
    low, most = (np.array([BANDS[s][i] for s in SCRIPTS])[script] for i in (0, 3))
    bits = np.minimum(0.6 * size, most)
    own = np.array([x if x in FLOORS else "" for x in lang], object)
    latin = script == SCRIPTS.index("latin")
    for name in ("", *FLOORS):
        at = latin & (own == name)
        entropy, chars = FLOORS.get(name, LOWEST)
        bits[at] = np.interp(size[at], (0, *KNOTS), (0.0, *entropy))
        low[at] = np.interp(size[at], KNOTS, chars)
    return low, bits


def measure_chunk(doc_id: pa.Array, text: pa.Array, path: str, lang: pa.Array | None = None) -> pa.RecordBatch:
    text = filled(text)
    codes, offsets, vocab = words_of(text)
    codes = codes.astype(np.int64)
    n_words = np.diff(offsets)
    lengths = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = sums(lengths[codes], offsets)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1).astype(np.int64) if len(text) else np.zeros(1, np.int64)
    table = np.zeros(256, bool)
    table[[ord(c) for c in SYMBOLS]] = True
    repeats = repeated_words(codes, offsets)
    names = vocab.to_pylist()
    n_tokens, n_bytes, entropy = fertility(path).measure(codes, offsets, names)
    script = main_script(codes, offsets, names)
    tokens = np.maximum(n_tokens, 1)
    fertile, byte_share = word_chars / tokens, n_bytes / tokens
    base = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    low, least = floors(script, [None] * len(text) if lang is None else lang.to_pylist(), n_tokens)
    high, most = (np.array([BANDS[s][i] for s in SCRIPTS])[script] for i in (1, 2))
    reason = np.select([n_words < MIN_WORDS, base, (fertile < low) | (fertile > high), byte_share > most, entropy < least], ["few_words", "repeated_words", "chars_per_token", "byte_share", "entropy"], "")
    types = {f.name: f for f in _schema()}
    columns = {"doc_id": doc_id, "n_words": n_words, "word_chars": word_chars, "n_symbols": sums(table[raw], at), "n_dup_lines": repeated_lines(text), "n_repeat_words": repeats, "base_failed": base, "kept": reason == "", "script": np.array(SCRIPTS, object)[script], "chars_per_token": fertile, "byte_share": byte_share, "entropy": entropy, "reason": reason.astype(object)}
    return out_batch(pa.schema([types[k] for k in columns]), **columns)


def languages(chunk: pa.RecordBatch) -> pa.Array | None:
    return chunk.column("lang") if "lang" in chunk.schema.names else None


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _DDL.split(", "))])


def measure(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each row of docs: the counts, the token measures, base_failed,
    kept and the first reason against the text ('' if kept).

    A null text is as an empty one: no words, base_failed. Words are
    ``[^\\x20\\x09-\\x0D]+``. Entropy is judged against a floor that rises with the
    number of tokens. Rows are independent; of the other columns of docs only
    lang, if there, is looked at, for the band of a Latin text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            yield measure_chunk(chunk.column("doc_id"), chunk.column("text"), path, languages(chunk))

    return docs.select("doc_id", "text", *(c for c in docs.columns if c == "lang")).transform(mapped, run, _DDL)


def keep_good(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    return kept_rows(docs, lambda chunk: measure_chunk(chunk.column("doc_id"), chunk.column("text"), path, languages(chunk)).column("kept").to_numpy(zero_copy_only=False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))
