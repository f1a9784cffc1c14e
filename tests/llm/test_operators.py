"""Each operator against a brute-force version on small tables with nulls, empty
and long texts, repeated rows, ties and columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flightloom.llm import binary_records, bytebpe, dart_minhash, language_id, packing, quality_model, quality_rules, suffix_dedup, topk_search, toxicity
from flightloom.llm.common import text_chunks, words_of

WORDS = "the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there".split()
VOCAB = P.path("word_bpe_49k.json")


def texts(n=40, seed=1):
    rnd = random.Random(seed)
    out = [None, "", " \t\n", "one", "a b c", "é ß Ünïcode 漢字 😀 don't  we'll\n\nx", "####  $$$ <|endoftext|> 12,345.67", "word " * 3000]
    for _ in range(n):
        out.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 300))) + rnd.choice(["", "\n", ".\n same line\n same line"]))
    return out + out[10:14]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 6 else None, t, "src", "x", "y") for i, t in enumerate(texts())]
    rows += [rows[20], (3, "another text of a repeated id", "s", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, h string, ids string").repartition(3)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def encoded(text):
    from tokenizers import Tokenizer

    encoded.t = getattr(encoded, "t", None) or Tokenizer.from_file(VOCAB)
    return np.array(encoded.t.encode(text, add_special_tokens=False).ids + [2], "<u4")


def test_words_and_chunks():
    codes, offsets, vocab = words_of(pa.array([" a b", None, "", "b\x0bc d "]))
    assert [vocab[int(c)].as_py() for c in codes] == ["a", "b", "b", "c d"] and offsets.tolist() == [0, 2, 2, 2, 4]
    b = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 7 + [None]})
    assert [c.num_rows for c in text_chunks([b], limit=25)] == [2, 2, 2, 2]


def test_binary_records(spark, docs, none, tmp_path):
    shards = binary_records.write_records(docs, f"file://{tmp_path}/r", VOCAB)
    got = binary_records.read_records(spark, shards).orderBy("start").collect()
    want = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at, by = 0, Counter()
    for r in got:
        assert r.start == at
        at += r.n_tokens
        by[(r.doc_id, r.n_tokens, r.ids_crc32)] += 1
    assert by == Counter((d, len(encoded(t)), zlib.crc32(encoded(t).tobytes())) for d, t in want)
    order = np.array([2, 0, 1])
    assert [f[0] for f in binary_records.read_frames(shards[0]["path"], order)] == [2, 0, 1]
    assert binary_records.read_records(spark, binary_records.write_records(none, f"file://{tmp_path}/n", VOCAB)).count() == 0
    frame = bytearray(binary_records.frame(5, np.arange(4), 2))
    frame[-6] ^= 1
    with pytest.raises(ValueError):
        binary_records.parse(bytes(frame))


@pytest.mark.parametrize("window,n_open", [(4096, 16), (64, 3)])
def test_packing(spark, docs, none, window, n_open):
    got = packing.pack(spark, docs, VOCAB, window=window, n_open=n_open).collect()
    left = Counter((d, len(encoded(t))) for d, t in rows_of(docs))
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in left.items())
    of = {}
    for d, t in rows_of(docs):
        of.setdefault((d, len(encoded(t))), []).append(encoded(t))
    sequences = {}
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in of[(r.doc_id, r.doc_tokens)])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0
    assert packing.pack(spark, none, VOCAB).count() == 0


def test_packing_covers_every_document_over_many_levels(spark):
    """Pieces of a document neither overlap nor leave a gap; ids beyond 2^53 beside null ones stay as they are."""
    big = 9007199254740993
    rows = [(big + i if i % 3 else None, " ".join(WORDS[: 1 + (7 * i) % 40]) * (1 + i % 4)) for i in range(90)] + [(5, None), (big, "one"), (big, "one")]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    got = packing.pack(spark, many, VOCAB, window=64, n_open=3, fan_in=4).collect()
    assert len({r.sequence_id >> 56 for r in got}) >= 3  # tasks, groups of them, groups of groups
    whole = Counter()
    for d, t in rows:
        x = encoded(t or "")
        whole.update((d, len(x), i, int(v)) for i, v in enumerate(x))
    assert {r.doc_id for r in got} == {d for d, _ in rows}
    cover = Counter((r.doc_id, r.doc_tokens, i) for r in got for i in range(r.start, r.start + r.length))
    want = Counter()
    for (d, n, i, _), k in whole.items():
        want[(d, n, i)] += k
    assert cover == want
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for parts in ends.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        sizes.append(at)
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(n != 64 for n in sizes) <= 6


def test_binary_records_of_a_hot_id_and_width(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"text {i % 5}") for i in range(200)]
    hot = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = binary_records.write_records(hot, f"file://{tmp_path}/hot", VOCAB)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = binary_records.read_records(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 100 + [7] * 100 and len(shards) > 2 and max(s["records"] for s in shards) < 150
    with pytest.raises(Exception, match="does not fit in 1 bytes"):
        binary_records.write_records(hot, f"file://{tmp_path}/narrow", VOCAB, width=1)


def test_byte_bpe_of_every_code_point():
    """Boundaries as the library's, in three surroundings of every code point that UTF-8 has."""
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bytebpe.byte_encoder(path)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    for make in (lambda c: f"a{c}1 ", lambda c: f" {c}{c}'s", lambda c: f"1{c}a\n"):
        text = "".join(make(chr(c)) for c in [*range(0xD800), *range(0xE000, 0x110000)])
        parts = [text[i : i + 100_000] for i in range(0, len(text), 100_000)]
        ids, o, _, _ = enc.encode(pa.array(parts))
        for i, part in enumerate(parts):
            assert ids[o[i] : o[i + 1]].tolist() == t.encode_ordinary(part), i


def test_byte_bpe(docs, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bytebpe.byte_encoder(path)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    want = Counter()
    for d, x in rows_of(docs):
        ids = t.encode_ordinary(x)
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bytebpe.digests(docs, path).collect())) == want
    assert bytebpe.digests(none, path).count() == 0
    rnd = random.Random(2)
    parts = ["a", "b", "'", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "1", "٣", "é", "漢", "!", "　", " ", "😀", "s"]
    many = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 60))) for _ in range(800)] + ["a" * 3000, "ab" * 900]
    ids, o, first, at = enc.encode(pa.array(many))
    for i, x in enumerate(many):
        assert ids[o[i] : o[i + 1]].tolist() == t.encode_ordinary(x)
        assert enc.decode(ids[o[i] : o[i + 1]]).decode() == x
    r = bytebpe.encode(docs.where("doc_id = 5"), path).first()
    assert r.byte_offsets[0] == 0 and len(r.byte_offsets) == len(r.ids)


def test_quality_rules(docs, none):
    want = Counter()
    for d, t in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))] += 1
    got = quality_rules.measure(docs)
    assert Counter(tuple(r)[:7] for r in got.collect()) == want
    assert all(not r.kept for r in got.where("base_failed").collect()) and quality_rules.measure(none).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_rules_reject_junk_and_keep_prose():
    rnd = random.Random(5)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist()}
    path = P.path("piece_bpe_32k.model")

    def reasons(rows):
        text, lang = zip(*rows)
        return quality_rules.measure_chunk(pa.array(range(len(rows)), pa.int64()), pa.array(text), path, pa.array(lang, pa.string())).column("reason").to_pylist()

    good = [(r["text"], r["lang"]) for r in table if labels.get(r["doc_id"]) == 1]
    got = [r for r in reasons(good) if r not in ("few_words", "repeated_words")]
    assert len(got) > 40 and sum(r != "" for r in got) <= 0.02 * len(got)
    long = [x for x in good if len(x[0].split()) >= 100]
    junk = [(" ".join(w + rnd.choice(["***", "%%%", "$$$", "&&&"]) for w in t.split()), g) for t, g in long]  # symbols after each word
    junk += [(t.upper(), g) for t, g in long] + [(" | ".join(t.split()), g) for t, g in long]  # capitals, cells of a table
    letters = ["".join(rnd.choice(a) for _ in range(8)) for a in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for _ in range(200)]
    noise = [(" ".join(letters[:200]), g) for g in ("en", None)] + [(" ".join(letters[200:]), g) for g in ("en", None)]
    for a, b in ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xE01, 0xE2F), (0x430, 0x450), (0x3041, 0x3096)):  # random letters of a script
        noise.append((" ".join("".join(chr(rnd.randrange(a, b)) for _ in range(6)) for _ in range(60)), None))
    noise.append((" ".join(rnd.choice(["###", "$$$", "%%%", "***"]) for _ in range(60)), None))
    assert all(reasons(noise)) and sum(r == "" for r in reasons(junk)) <= 0.1 * len(junk)
    prose = ["The council met on Monday evening to discuss the repair of the old stone bridge, which has been closed to heavy lorries since a flood in the spring damaged two of its arches and part of the road.", "Россия является самой большой страной в мире по площади территории, и её города, реки, леса и горы привлекают людей из разных стран, которые хотят увидеть природу своими глазами.", "भारत एक विशाल देश है जहाँ अनेक भाषाएँ बोली जाती हैं और लोग मिलकर रहते हैं तथा यहाँ की नदियाँ और पर्वत बहुत सुंदर हैं"]
    assert reasons([(t, g) for t in prose for g in ("en", None)]) == [""] * 6


def test_fertility_by_the_library():
    """Characters a token, byte share and entropy as plain counts over the library's own pieces."""
    import math

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    many = [t or "" for t in texts(15, 4)] + ["naïve façade 漢字テスト ꙮ", "x" * 5000, "word " * 20_000]
    got = quality_rules.measure_chunk(pa.array(range(len(many)), pa.int64()), pa.array(many), path).to_pylist()
    for row, text in zip(got, many):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [i for w in words for i in model.encode(w)]
        counts = Counter(ids)
        n = max(1, len(ids))
        assert math.isclose(row["chars_per_token"], sum(map(len, words)) / n) and math.isclose(row["byte_share"], sum(map(model.is_byte, ids)) / n)
        assert math.isclose(row["entropy"], -sum(k / n * math.log2(k / n) for k in counts.values()), abs_tol=1e-9)
        assert not row["kept"] or not row["base_failed"]


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        codes = rng.integers(0, 3, 200).astype(np.int32)
        cuts = np.array([0, 5, 5, 120, 200])
        want = []
        for a, b in zip(cuts, cuts[1:]):
            w = codes[a:b].tolist()
            c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            want.append(len({j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}))
        assert quality_rules.repeated_words(codes, cuts).tolist() == want


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [1.0, None], 0), (1050, [float("nan")] * 8, 0), (None, [1.0] * 8, 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(spark, vectors(spark, rows).repartition(3)).collect()}
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    want = {}
    for i in range(0, 400, 50):
        s = q @ q[i]
        for r, j in enumerate([j for j in np.lexsort((np.arange(400), -s)) if j != i][:5]):
            want[(i, r + 1)] = (j, s[j])
    assert got == want
    assert topk_search.top_k(spark, vectors(spark, [])).count() == 0
    few = topk_search.top_k(spark, vectors(spark, [(0, [1.0, 2.0], 1), (7, [3.0], 1)])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 7, 256 * 256 * 3)]


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 900_000, (300, 8)))  # up to a few million: scores near 2^59, past what doubles hold
    x[:20] = x[0] + rng.integers(-2, 3, (20, 8)) / 256.0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(400, [], 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(spark, wide(spark, rows).repartition(3)).collect()}
    q = [[int(v) for v in np.floor(256 * row)] for row in x]
    want, ids = {}, list(range(300)) + [400]
    q += [[0] * 8]
    for a in [i for i, d in enumerate(ids) if d % 50 == 0]:
        scores = sorted((-sum(s * t for s, t in zip(q[a], q[b])), d) for b, d in enumerate(ids) if b != a)
        want |= {(ids[a], r + 1): (d, -s) for r, (s, d) in enumerate(scores[:5])}
    assert max(abs(s) for _, s in want.values()) > 2**58 and got == want


def test_topk_of_one_large_vector_among_small_ones(spark):
    """Only products between different vectors count: one may be large beyond 32 bits, or beyond what its own square allows."""
    for top in (1e7, 3e12):
        rows = [(0, [top, 1.0], 0), (50, [2.0, 3.0], 0), (51, [1.0, 1.0], 0), (52, [-top, 0.5], 0)] if top < 1e8 else [(0, [top, 1.0], 0), (50, [2.0, 3.0], 0), (51, [1.0, 1.0], 0)]
        whole = {i: [int(np.floor(256 * c)) for c in v] for i, v, _ in rows}
        dot = lambda a, b: sum(s * t for s, t in zip(whole[a], whole[b]))
        want = [(q, r, d, s) for q in (0, 50) for r, (s, d) in enumerate(sorted(((-dot(q, d), d) for d in whole if d != q))[:5], 1)]
        got = sorted(tuple(r) for r in topk_search.top_k(spark, wide(spark, rows).repartition(2)).collect())
        assert got == sorted((q, r, d, -s) for q, r, d, s in want)
    for bad in ([(0, [1e8] * 8, 0), (1, [1e8] * 8, 0)], [(0, [1e18], 0), (1, [1.0], 0)]):
        with pytest.raises(Exception, match="fit"):
            topk_search.top_k(spark, wide(spark, bad)).collect()


def wide(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def brute_spans(all_texts, width):
    raw = [t.encode() for t in all_texts]
    c = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if c[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        yield len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark, docs, none):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé ") for _ in range(300)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 100), (4, "a" * 150)]
    for i in range(50):
        t = ""
        for _ in range(rnd.randrange(1, 5)):
            b, at = rnd.choice(base), rnd.randrange(0, 250)
            t += b[at : at + rnd.randrange(20, 120)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(0, 30)))
        rows.append((5 + i if i else None, t))
    rows += rows[5:9]
    small = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, ranges int")
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.dedup(spark, small, threshold=40, gram=10).collect())
    assert got == sorted(brute_spans([t or "" for _, t in rows], 40))
    cut = suffix_dedup.dedup_rows(spark, small, threshold=40, gram=10)
    assert cut.columns == small.columns and cut.count() == len(rows)
    assert suffix_dedup.dedup(spark, none).count() == 0


def test_suffix_dedup_at_its_threshold(spark):
    """Planted passages around 400 bytes, periodic and very long texts, against brute force and plain doubling."""
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passages = [words(200)[:n] for n in (399, 400, 401, 520, 900)]
    rows = [words(rnd.randrange(20, 120)) + p + words(rnd.randrange(5, 80)) for p in passages for _ in range(3)]
    rows += ["a" * 3000, "ab" * 1500 + words(30), words(10) + "x" * 500, "0123456789" * 90, words(9000), "é" * 700, None, ""]
    copy = rows[0].split()
    for i in range(6):  # near copies
        copy[rnd.randrange(len(copy))] = f"edit{i}"
        rows.append(" ".join(copy))
    rows += rows[3:5]
    small = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = suffix_dedup.dedup(spark, small).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(enumerate(brute_spans([t or "" for t in rows], 400)))
    assert all(got[i][1] >= n for i, n in ((5, 400), (8, 401), (11, 520), (14, 900)))
    covered = {i: b[1] for i, b in enumerate(brute_spans([t or "" for t in rows], suffix_dedup.PASSAGE))}
    assert {r.doc_id: r.passage_bytes for r in found} == covered
    some = suffix_dedup.keyed(small.where("length(text) < 3000 or doc_id in (15, 17)"))
    starts = lambda df: {(r.d, p) for r in df.collect() for p in range(r.first, r.last + 1)}
    assert starts(suffix_dedup.doubling_starts(spark, some)) == starts(suffix_dedup.repeated_starts(spark, some))


def test_runs_of_equal_strings_are_one_row():
    batch = pa.RecordBatch.from_pydict({"d": [1, 2], "th": [0, 0], "base": pa.array([0, 0], pa.int32()), "part": ["a" * 300_000, "xy" * 40_000]})
    found = [r for b in suffix_dedup._anchor_rows(iter([batch]), 400, 100) for r in b.to_pylist()]
    assert len(found) < 10 and {(r["d"], r["lo"], r["hi"]) for r in found if r["n"] == 0} == {(1, 0, 299_600), (2, 0, 79_599)}


def grams(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_classes(spark, none):
    rnd = random.Random(3)
    rows = [(0, None), (1, None), (2, ""), (3, ""), (4, "two words"), (5, "two words"), (6, "two  words")]
    for g in range(12):
        w = [rnd.choice("abcdefghijkl") * rnd.randrange(1, 4) + str(rnd.randrange(99)) for _ in range(rnd.randrange(60, 200))]
        for _ in range(rnd.randrange(1, 7)):
            v = list(w)
            for _ in range(rnd.choice([0, 1, 2, 5, 9])):
                v[rnd.randrange(len(v))] = f"edit{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    small = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, h string").repartition(2)
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s is not None and t is not None:
                x, y = grams(s), grams(t)
                whole = sum((x | y).values())
                if s == t or (whole and sum((x & y).values()) / whole >= 0.8):
                    p, q = sorted((find(a), find(b)))
                    up[q] = p
    got = {r.doc_id: r.class_id for r in dart_minhash.near_classes(spark, small.drop("h")).collect()}
    assert got == {d: find(d) for d, _ in rows}
    kept = {r.doc_id for r in dart_minhash.keep_one(spark, small).collect()}
    assert kept == {find(d) for d, _ in rows}
    assert dart_minhash.near_classes(spark, none.select("doc_id", "text")).count() == 0


def test_near_classes_of_texts_that_share_a_passage(spark):
    """A hot bucket: texts that share most of their words but are no near copies, families
    of copies among them; classes as by brute force, with few pairs compared."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(150)], []
    for i in range(160):
        own = [word() for _ in range(35)]
        for _ in range(3 if i % 8 == 0 else 1):
            v = passage + own
            if rnd.random() < 0.5:
                v[rnd.randrange(len(v))] = word()
            rows.append(" ".join(v))
    rows += [" ".join(passage), " ".join(passage + passage[:20])]
    sets = [grams(t) for t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values()) >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    small = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = dart_minhash.near_classes(spark, small).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in range(len(rows))}
    assert all((r.n_links > 0) == (sum(find(i) == find(r.doc_id) for i in range(len(rows))) > 1) for r in got if rows.count(rows[r.doc_id]) == 1)
    parts = [(i, np.sort(np.array([hash(k) & (1 << 63) - 1 for k in s], np.uint64)), s) for i, s in enumerate(sets)]
    held = spark.createDataFrame([(i, bytearray(n.tobytes()), None, len(n)) for i, n, _ in parts], "h long, names binary, times binary, size long")
    apart = spark.createDataFrame([(i, i) for i, _, _ in parts], "h long, label long")
    pairs = {(r.a, r.b) for r in dart_minhash.bounded_pairs(spark, held, apart).collect()}
    as_sets = [set(s) for s in sets]
    alike = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(as_sets[i] & as_sets[j]) / len(as_sets[i] | as_sets[j]) >= 0.8}
    assert alike <= pairs and len(pairs) < 0.05 * len(rows) ** 2


def test_darts_estimate_weighted_similarity():
    rng, diff = np.random.default_rng(0), []
    for k in range(20):
        wa = rng.integers(1, 9, 150)
        wb = np.where(rng.random(150) < 0.7, wa, rng.integers(1, 9, 150))
        names = dart_minhash.mix(np.arange(1, 151, dtype=np.uint64) + np.uint64(1000 * k))
        s = dart_minhash.darts(np.repeat([0, 1], 150), np.tile(names, 2), np.concatenate([wa, wb]), 2, 150)
        diff.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(diff)) < 0.02 and np.std(diff) < 0.06


DATA = "/root/testdata/sf0.01"


def held_out(spark, df, column, data=DATA):
    truth = spark.read.parquet(f"{data}/{'documents' if column == 'lang' else 'labels'}.parquet").select("doc_id", column)
    return df.where("held_out").join(truth.where(f"{column} is not null"), "doc_id").collect()


def test_language_accuracy_and_edges(spark, docs, none):
    rows = held_out(spark, language_id.op10_language_mixture(spark, DATA), "lang")
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    langs, table = language_id.trained_on(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, langs, table).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[20] == "en"
    assert language_id.identify(none, langs, table).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, *language_id.learn(docs.where("false").selectExpr("doc_id", "text", "source as lang"))).collect()} == {"und"}
    assert language_id.keep_identified(docs, langs, table).columns == docs.columns


def test_mixture_by_a_plain_version(spark):
    """Shares of the full mixture and sets of languages as by loops over words."""
    all_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, table = language_id.learn(all_docs)
    rows = [r.text for r in all_docs.orderBy("doc_id").limit(12).collect()] + ["the house and der Hund est un chien", "12 34", ""]
    order, shares, has = language_id.infer(pa.array(rows), table)
    for i, text in enumerate(rows):
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text) if any(c.isalpha() for c in w)]
        assert has[i] == bool(words)
        if not words:
            continue
        lik = []
        for w in words:
            bucket, _ = language_id.trigrams(pa.array([w]))
            ll = table[bucket].astype(float).sum(axis=0)
            lik.append(np.maximum(np.exp(ll - ll.max()), 1e-30))
        lik = np.array(lik)

        def em(part):
            share = np.full(part.shape[1], 1 / part.shape[1])
            for _ in range(language_id.ITERATIONS):
                q = part * share
                share = np.maximum((q / q.sum(axis=1, keepdims=True)).mean(axis=0), 1e-6)
                share /= share.sum()
            return share, np.log(part @ share).sum()

        share, _ = em(lik)
        by = np.argsort(-share, kind="stable")
        best, size = np.log(lik[:, by[0]]).sum(), 1
        for k in range(2, len(langs) + 1):
            value = em(lik[:, by[:k]])[1] - (k - 1) * language_id.PENALTY * np.log(len(words) + 1)
            if value <= best:
                break
            best, size = value, k
        picked = [j for j in order[i] if j >= 0]
        assert set(picked) == set(by[:size]) and np.allclose([shares[i][n] for n in range(size)], share[picked], atol=1e-3)


def flipped(spark, column, modulus, held):
    """The labels of held-out rows turned round."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from pyspark.sql import functions as F

    out = F.crc32(F.col("doc_id").cast("string")) % modulus == held
    return labels, labels.withColumn(column, F.when(out, 1 - F.col(column)).otherwise(F.col(column)))


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain, turned = flipped(spark, "toxic", 5, 0)
    a, b = toxicity.learn(docs, plain), toxicity.learn(docs, turned)
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]
    # texts labelled clean are nothing to learn from: only the toxic labels count
    only = toxicity.learn(docs, plain.where("toxic = 1"))
    assert np.array_equal(a[0], only[0]) and a[1:] == only[1:]
    plain, turned = flipped(spark, "quality", 3, 1)
    vectors = quality_model.word_vectors(docs)
    x, y = quality_model.fit(docs, plain, vectors), quality_model.fit(docs, turned, vectors)
    assert np.array_equal(x.w1, y.w1) and x.temperature == y.temperature


def test_temperature_calibrates():
    """Of all temperatures tried, the one kept has the least loss on the held rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2 * quality_model.DIM + 3))
    y = (x[:, 0] + 2 * rng.normal(size=600) > 0).astype(float)
    held = np.arange(600) % 4 == 0
    net = quality_model.Network(x, y, held)
    z = net.logits(x[held])
    loss = lambda s: np.mean(np.logaddexp(0, z / s) - y[held] * z / s)
    assert net.temperature > 1 and loss(net.temperature) <= min(map(loss, (0.25, 0.5, 1, 2, 4, 8))) + 1e-9


def test_best_bin_prior():
    rng = np.random.default_rng(2)
    for share in (0.02, 0.1, 0.4):
        mixed = np.concatenate([rng.normal(3, 1, int(8000 * share)), rng.normal(0, 1, int(8000 * (1 - share)))])
        assert abs(toxicity.best_bin_prior(rng.normal(3, 1, 1000), mixed) - share) < 0.02 + 0.1 * share


def test_mixture_finds_both_languages(spark):
    all_docs = spark.read.parquet(f"{DATA}/documents.parquet")
    langs, table = language_id.trained_on(all_docs)
    a, b = (all_docs.where(f"lang = '{x}' and n_chars > 1500 and text not like '%|%'").orderBy("doc_id").first().text[:1500] for x in ("en", "fr"))
    order, shares, _ = language_id.infer(pa.array([a + " " + b, a]), table)
    assert {langs[i] for i in order[0] if i >= 0} >= {"en", "fr"} and 0.3 < shares[0][0] < 0.7 and langs[order[1][0]] == "en"


def test_quality_accuracy_and_edges(spark, docs, none):
    rows = held_out(spark, quality_model.op6_quality_network(spark, DATA), "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    v = quality_model.word_vectors(docs)
    net = quality_model.Network(np.zeros((0, 2 * quality_model.DIM + 3)), np.zeros(0), np.zeros(0, bool))
    got = quality_model.score(docs, v, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and quality_model.score(none, v, net).count() == 0


def test_toxicity_accuracy_and_edges(spark, docs, none):
    large = "/root/testdata/sf0.1"
    rows = held_out(spark, toxicity.op5_toxicity_nnpu(spark, large), "toxic", large)
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= 0.9
    other = {r.doc_id for r in spark.read.parquet(f"{large}/documents.parquet").where("lang != 'en'").select("doc_id").collect()}
    assert np.mean([r.predicted for r in rows if r.toxic == 1 and r.doc_id in other]) >= 0.85
    assert np.mean(clean) <= 0.005 and np.mean([r.score for r in rows if r.toxic == 1]) > 2 * np.mean([r.score for r in rows if r.toxic == 0])
    w, b, prior = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, w, b).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, w, b).count() == 0


def test_features_are_words_and_beginnings():
    """Equal to counting runs of letters and their beginnings one by one; a wanted few, too."""
    texts = ["Réeuxpa réeuxpa, scum! scum-of x1ab", "", None, "a\nA  abcdefghij abcd", "\t", "мир МИР 日本語日本語日"]
    named = lambda words: {int(v) for v in toxicity.word_features(pa.array([words]))[0]}
    values, counts, offsets = toxicity.word_features(pa.array(texts))
    for i, text in enumerate(texts):
        runs = re.findall(r"[^\W\d_]+", (text or "").lower())
        names = Counter((0, r) for r in runs) + Counter((k, r[:k]) for r in runs for k in toxicity.BEGINNINGS if len(r) >= k)
        own = counts[offsets[i] : offsets[i + 1]]
        assert sorted(own.tolist()) == sorted(names.values())
        assert set(values[offsets[i] : offsets[i + 1]].tolist()) == set().union(*(named(r) for r in runs))
    only = np.zeros(toxicity.DIM, bool)
    only[values[::3]] = True
    few, few_counts, few_offsets = toxicity.word_features(pa.array(texts), only)
    mask = only[values]
    assert few.tolist() == values[mask].tolist() and few_counts.tolist() == counts[mask].tolist()
    assert few_offsets.tolist() == np.concatenate([[0], np.cumsum(mask)])[offsets].tolist()


def test_nnpu_recovers_the_negatives():
    rng = np.random.default_rng(0)
    make = lambda n, p: (rng.random((n, 2)) < p).astype(np.float32)
    positive, unlabelled = make(300, [0.9, 0.1]), np.concatenate([make(300, [0.9, 0.1]), make(1700, [0.05, 0.1])])
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.15)
    assert w[0] + b > 0 > b and abs(w[1]) < w[0]
