"""Word-cached encoding with a `tokenizers` vocabulary file.

A vocabulary whose pre-tokenizer drops white space encodes each word by
itself, so only words that a worker has not met reach the library, and words
of plain Latin letters and punctuation reach its model without the normalizer
(whose effect on them is lower case)."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from flightloom.llm.common import quiet_tokenizers, ragged, words_of

#: Words that a worker remembers; beyond that it starts afresh.
CACHE_WORDS = 120_000
_LETTERS = "a-zßà-öø-ÿ"
#: The vocabulary file's own pre-tokenizer pattern.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and pre[0].get("pattern", {}).get("Regex") == _SPLIT and pre[0].get("invert") is True and pre[0].get("behavior") == "Removed" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = _pack([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])
        return ids

    def _word(self, word: str) -> bytes:
        if _PLAIN.match(word) and "<|" not in word:
            lower = word.lower()
            return self._piece(lower) if lower.isalpha() else b"".join(map(self._piece, _PIECES.findall(lower)))
        return _pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts); null is empty; end_id follows each text."""
        if not self.by_word:
            lists = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in text.to_pylist()], add_special_tokens=False)]
            lists = [x + [end_id] if end_id is not None else x for x in lists]
            return np.array([i for x in lists for i in x], dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        codes, offsets, vocab = words_of(text)
        if len(self.words) > CACHE_WORDS:
            self.words, self.pieces = {}, {}
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {}
        known, found = self.words, []
        for word in vocab.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word)
            found.append(ids)
        if end_id is not None:
            found.append(_pack([end_id]))
            codes = np.insert(codes, offsets[1:], len(found) - 1)
            offsets = offsets + np.arange(len(offsets))
        if not found:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), np.uint32), np.cumsum(lens) - lens
        per_word = lens[codes]
        ids = flat[ragged(per_word, at[codes])]
        return ids, np.concatenate([[0], np.cumsum(per_word)])[offsets]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, for each worker process."""
    return WordEncoder(path)
