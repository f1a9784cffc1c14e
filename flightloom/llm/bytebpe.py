"""Byte-level BPE encoding and decoding without regular expressions (operator 8).

Pre-tokenisation: every code point has a class (letter, number, white space,
other), refined by what follows it; a small automaton over these classes says
where a match of the pattern starts. The classes' transition functions close
under composition into a small monoid, so a block's effect is one element, and
the state before every character comes from an associative scan: prefixes
within blocks for all blocks at once, then over the blocks. The slices between
boundaries are counted as distinct byte strings, merged by rank once each (and
cached), and laid out again as ids; offsets are kept for decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flightloom.llm.common import documents, filled, mapped, out_batch, ragged, text_chunks

CACHE_PIECES = 200_000
#: Pieces longer than this are merged with a heap.
LONG_PIECE = 256
BLOCK = 128
LETTER, NUMBER, OTHER, SPACE_THEN, BLANK, BLANK_LAST, QUOTE1, QUOTE2, RESET = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, TAIL1, TAIL2 = range(8)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, whether a match starts at this character)."""
    if state == TAIL2 and cls != RESET:
        return TAIL1, False
    if state == TAIL1 and cls != RESET:
        return FRESH, False
    if cls == LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if cls == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if cls in (OTHER, QUOTE1, QUOTE2):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, QUOTE1: TAIL1, QUOTE2: TAIL2}[cls], True
    if cls == SPACE_THEN:
        return AFTER_SPACE, True
    if cls == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return FRESH, True  # BLANK_LAST, RESET


@lru_cache(maxsize=1)
def automaton():
    """(element of each class, composition table, states reached [element, state], starts [state, class])."""
    generators = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = list(dict.fromkeys([tuple(range(8)), *generators]))
    number = {e: i for i, e in enumerate(elements)}
    for a in elements:  # grows while it is walked: the closure under composition
        for g in generators:
            both = tuple(g[x] for x in a)
            if both not in number:
                number[both] = len(elements)
                elements.append(both)
    compose = np.array([[number[tuple(b[x] for x in a)] for b in elements] for a in elements], dtype=np.uint16)
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([number[g] for g in generators], dtype=np.uint16), compose, np.array(elements, dtype=np.uint8), starts


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """Class of each code point as the public tokenizer library sees it: it is asked once for all
    letters and all numbers, as its Unicode version may differ from Python's."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def scan_states(cls: np.ndarray) -> np.ndarray:
    """State of the automaton before each character, by the blocked associative scan."""
    element, compose, reached, _ = automaton()
    n = len(cls)
    blocks = -(-n // BLOCK)
    own = np.zeros(blocks * BLOCK, np.uint16)
    own[:n] = element[cls]  # element 0 is the identity
    own = np.ascontiguousarray(own.reshape(blocks, BLOCK).T)
    flat, m = compose.ravel(), np.uint32(len(compose))
    prefix = np.empty_like(own)
    prefix[0] = own[0]
    for j in range(1, BLOCK):
        np.take(flat, prefix[j - 1] * m + own[j], out=prefix[j])
    entry = np.zeros(blocks, np.uint8)
    state = FRESH
    table = reached.tolist()
    for b, e in enumerate(prefix[-1].tolist()):
        entry[b] = state
        state = table[e][state]
    before = np.empty((BLOCK, blocks), np.uint8)
    before[0] = entry
    before[1:] = reached.ravel()[prefix[:-1] * np.uint32(8) + entry]
    return before.T.ravel()[:n]


def boundaries(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Whether a match starts at each code point; ``resets`` are the positions
    of the separators before the texts (each is a start of its own)."""
    kind = codepoint_classes()[points]
    kind[resets] = RESET
    cls = kind.copy()
    follow = np.append(kind[1:], np.uint8(RESET))
    blank = kind == BLANK
    last = blank & (follow != BLANK) & (follow != RESET)
    cls[last] = np.where(points[last] == 0x20, SPACE_THEN, BLANK_LAST)
    quote = np.flatnonzero((points == 0x27) & (kind == OTHER))
    if len(quote):
        one, two = (np.append(points, [0, 0])[quote + k] for k in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cls[quote[short]], cls[quote[long]] = QUOTE1, QUOTE2
    return automaton()[3].ravel()[scan_states(cls).astype(np.uint32) * np.uint32(9) + cls]


class ByteEncoder:
    """Ids of whole texts by a rank file; equal to ``Encoding.encode_ordinary`` with the same ranks and pattern."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        values = [b""] * size
        for token, rank in self.ranks.items():
            values[rank] = token
        self.sizes = np.array([len(v) for v in values], dtype=np.int64)
        self.values = np.frombuffer(b"".join(values), np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: adjacent parts merge in order of rank, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[i]: of the part that starts at i; 0 where none starts
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != to:
                continue  # one of the two parts has changed since
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (b := before[i]) >= 0 and (r := ranks.get(piece[b:to])) is not None:
                heapq.heappush(heap, (r, b, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in ids, first byte
        of each id within its text's chunk, offsets of the texts in bytes)."""
        text = filled(text)
        joined = "\n" + "\n".join(text.to_pylist()) if len(text) else ""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1).astype(np.int64)
        at = at - at[0]
        width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.cumsum(width) - width
        resets = np.searchsorted(byte_at, at[:-1] + np.arange(len(text)))
        start = boundaries(points, resets)
        cuts = byte_at[start]
        raw = joined.encode()
        edges = np.append(cuts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        is_reset = np.zeros(len(points), bool)
        is_reset[resets] = True
        own = ~is_reset[start]
        text_of_cut = np.cumsum(~own) - 1
        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        known, found = self.cache, []
        for piece in coded.dictionary.to_pylist():
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = array("I", self.merge(piece)).tobytes()
            found.append(ids)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        codes, text_of_cut = codes[own], text_of_cut[own]
        per_piece = lens[codes]
        ids = flat[ragged(per_piece, (np.cumsum(lens) - lens)[codes])]
        per_text = np.bincount(text_of_cut, weights=per_piece, minlength=len(text)).astype(np.int64)
        sizes = self.sizes[ids]
        return ids, np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64), np.cumsum(sizes) - sizes, at

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; IndexError for an id outside the vocabulary."""
        return self.values[ragged(self.sizes[ids], self.at[ids])].tobytes()


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("byte_offsets", pa.list_(pa.int32()))])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = byte_encoder(path)
    for chunk in text_chunks(batches):
        ids, offsets, _, _ = enc.encode(chunk.column("text"))
        decoded = memoryview(enc.decode(ids))
        ends = np.concatenate([[0], np.cumsum(enc.sizes[ids])])[offsets].tolist()
        raw = memoryview(ids.astype("<u4").tobytes())
        o = offsets.tolist()
        yield out_batch(
            _OUT, doc_id=chunk.column("doc_id"), n_tokens=np.diff(offsets),
            ids_sha256=[hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(o, o[1:])],
            decoded_sha256=[hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends, ends[1:])],
        )


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = byte_encoder(path)
    for chunk in text_chunks(batches):
        ids, offsets, first, at = enc.encode(chunk.column("text"))
        o = pa.array(offsets, pa.int32())
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.ListArray.from_arrays(o, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(o, pa.array((first - np.repeat(at[:-1], np.diff(offsets))).astype(np.int32)))], schema=_IDS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, byte_offsets (the first byte of each id in its text) for
    every row of docs. A null text is as an empty one (no ids); repeated rows,
    null doc_ids and other columns need no care: rows are independent."""
    return docs.select("doc_id", "text").transform(mapped, partial(_encode, path=path), "doc_id long, ids array<int>, byte_offsets array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text and the bytes decoded from them, as digests; nulls as in ``encode``."""
    return docs.select("doc_id", "text").transform(mapped, partial(_digest, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
