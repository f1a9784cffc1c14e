"""Operators 11 to 13 against brute-force versions on small tables with nulls, empty and
long texts, ties, repeated rows and ids, empty tables and columns of clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from flightloom.llm import elkan_codes, line_runs, merkle_manifest
from flightloom.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def line_docs():
    rnd = random.Random(5)
    shared = [f"Line {i} that many documents hold, ÉTUDE número {i} and so on" for i in range(12)] + ["　" + "é" * 39, "x" * 40, "X" * 39, "İ" + "i" * 39]
    rows = []
    for i in range(60):
        lines = [rnd.choice(shared) for _ in range(rnd.randrange(0, 9))] + [f"own line {i} " + "word " * rnd.randrange(20) for _ in range(rnd.randrange(3))]
        rnd.shuffle(lines)
        lines = [rnd.choice(["", " ", "\t\r"]) + (s.upper() if s.isascii() and rnd.random() < 0.3 else s) + rnd.choice(["", "\x0b ", "\r"]) for s in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join([shared[0]] * 500 + ["é" * 40_000] * 3)), (None, "\n".join(shared)), (None, shared[1] + "\n" + shared[2])]
    rows += [rows[7], rows[7], (8, "\n".join(shared[:5])), (64, shared[3]), (64, shared[3] + "\n" + shared[3])]
    return rows


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda s: lower_ascii(s.strip(SPACE))
    held = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            held[key(s)].add(i)
    order = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=order) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if key(s) not in last or last[key(s)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (6, 3), (9, 2)])
def test_line_runs(spark, batches, fanout):
    rows = line_docs()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k1 string, pos int").repartition(3)
    got = Counter(tuple(r) for r in line_runs.dedup_lines(spark, docs, batches=batches, fanout=fanout).collect())
    assert got == plain_lines(rows)
    assert sum(n[3] for n in got) > 100


def test_line_runs_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_runs.dedup_lines(spark, docs).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a"), (None, "b" * 50)], "doc_id long, text string")
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in line_runs.dedup_lines(spark, nulls).collect()) == [("", 1, 0), ("a", 1, 0), ("b" * 50, 1, 0)]


def test_runs_in_any_order(spark):
    """Batches in any order give the same keys; a settled key is not added again unless a later document holds it."""
    rnd = random.Random(2)
    rows = [(k, k * 7, d) for k in range(40) for d in rnd.sample(range(100), rnd.randrange(1, 12))]
    want = {k: max(d for a, _, d in rows if a == k) for k in range(40) if sum(a == k for a, _, _ in rows) >= 5}
    for order in (range(10), reversed(range(10))):
        runs = line_runs.Runs(spark, fanout=2)
        for b in order:
            part = [r for r in rows if r[2] // 10 == b]
            runs.add(spark.createDataFrame(part + part[:3], "k1 long, k2 long, doc_id long"))
            assert all(len(level) <= 2 for level in runs.levels)
        assert {r.k1: r.last for r in runs.found().collect()} == want
        settled = spark.createDataFrame([(k, k * 7, 0) for k in want], "k1 long, k2 long, doc_id long")
        small = {r.k1 for r in runs.fresh(settled).collect()}
        in_one_run = {r.k1 for t in runs.tables() for r in t.where("n >= 5").collect()}
        assert in_one_run and small == set(want) - in_one_run
        runs.close()


def plain_merkle(rows):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def frame(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """(root, for each node the list of (place, siblings) from the bottom)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            runs = [level[i : i + 16] for i in range(0, len(level), 16)]
            for n, p in enumerate(at):
                paths[n].append((p % 16, [d for i, d in enumerate(runs[p // 16]) if i != p % 16]))
            at, level = [p // 16 for p in at], [h(*r) for r in runs]
        return level[0], paths

    leaf = lambda r: h(*(frame(v) for v in r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    root, tops = tree([sub[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(groups[s], sub[s][1]):
            whole, own = path + top, leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                own = leaf((*r[:4], lower_ascii(r[4])))
            for place, siblings in whole:
                own = h(*siblings[:place], own, *siblings[place:])
            out.append((r[0], leaf(r), sub[s][0], root, h(*(d for _, sib in whole for d in sib)), own, own == root))
    return Counter(out)


def merkle_rows():
    rnd = random.Random(3)
    rows = []
    for s, n in ((None, 1), ("", 17), ("a", 600), ("b", 16), ("é", 1), ("B", 33), ("漢", 257)):
        for _ in range(n):
            text = rnd.choice([None, "", "Some Text É", "lower only", "X" * 20_000, f"Row {rnd.random()}"])
            rows.append((rnd.choice([None, -5, rnd.randrange(1000), rnd.randrange(1 << 40)]), s, rnd.choice(["en", None, "ü"]), rnd.choice([None, 3]), text))
    rows += [(i, f"s{i:03}", "en", 0, "One") for i in range(40)]
    return rows + rows[100:110] + rows[100:105]


def test_merkle(spark):
    rows = merkle_rows()
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, idx int").repartition(5)
    got = Counter(tuple(r) for r in merkle_manifest.verified(spark, docs).collect())
    assert got == plain_merkle(rows)
    assert 50 < sum(not r[6] for r in got)  # tampering is seen


@pytest.mark.parametrize("rows", [[], [(1, "s", None, None, "Abc")], [(i, "s", None, 1, "t") for i in range(16)], [(None, None, None, None, None)] * 3])
def test_small_merkle(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(tuple(r) for r in merkle_manifest.verified(spark, docs).collect()) == (plain_merkle(rows) if rows else Counter())


def test_manifest_paths(spark):
    """The real output: paths whose folding gives the root."""
    rows = merkle_rows()[:80]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for r in merkle_manifest.manifest(spark, docs).collect():
        own = bytes.fromhex(r.leaf)
        path = tuple((p.place, bytes.fromhex("".join(p.siblings))) for p in r.path)
        assert merkle_manifest.folded(own, path).hex() == r.root


def plain_codes(rows, rounds=4):
    """rows: (vec_id, embedding, label); Python's integers throughout."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(x * 1024) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // 4
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:256]
    books = [[ints[n][p * width : (p + 1) * width] for n in order] for p in range(4)]

    def assign(p, v):
        x = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[assign(p, v)[1] for v in ints] for p in range(4)]
        for p in range(4):
            for e in range(len(books[p])):
                members = [v[p * width : (p + 1) * width] for v, c in zip(ints, at[p]) if c == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for (i, _, lab), v in zip(kept, ints):
        best = [assign(p, v) for p in range(4)]
        out.append((i, lab, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best)))
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter(out), sha


def vector_rows(n, dims, kind, seed=1):
    rng = np.random.default_rng(seed)
    v = {"spread": rng.normal(size=(n, dims)), "grid": rng.integers(-2, 3, (n, dims)) / 4.0, "huge": rng.normal(size=(n, dims)) * 10.0 ** rng.integers(-3, 6, (n, 1))}[kind]
    v = v.astype(np.float32).astype(float).tolist()
    rows = [(int(i), x, int(lab)) for i, x, lab in zip(rng.permutation(n), v, rng.integers(0, 3, n))]
    bad = [(n, None, 1), (n + 1, [float("nan")] * dims, 1), (n + 2, [float("inf")] * dims, None), (n + 3, [None] * dims, 2)]
    return rows + bad + rows[:3] + [(None, v[5], None), (None, v[6], None), (rows[0][0], v[7], 9)]


@pytest.mark.parametrize("n,dims,kind", [(700, 8, "spread"), (500, 4, "grid"), (60, 8, "spread"), (400, 8, "huge")])
def test_elkan(spark, n, dims, kind):
    rows = vector_rows(n, dims, kind)
    vectors = spark.createDataFrame([(*r, "x", b"y") for r in rows], "vec_id long, embedding array<float>, label int, code string, lower binary").repartition(4)
    coded, books = elkan_codes.encode(spark, vectors)
    want, sha = plain_codes(rows)
    assert Counter(tuple(r) for r in coded.collect()) == want and elkan_codes.checksum(books) == sha


def test_elkan_of_nothing_and_of_ragged_vectors(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    coded, books = elkan_codes.encode(spark, none)
    assert coded.count() == 0 and books == []
    empty = spark.createDataFrame([(1, [], 1), (2, [], None)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.code, r.error) for r in elkan_codes.encode(spark, empty)[0].collect()} == {(1, "00000000", 0), (2, "00000000", 0)}
    for bad in ([(1, [1.0, 2.0], 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]):
        with pytest.raises(ValueError):
            elkan_codes.encode(spark, spark.createDataFrame(bad, "vec_id long, embedding array<float>, label int"))


def test_pruning_leaves_out_and_misses_nothing():
    """Bounds that hold, moved entries: the codes are the nearest ones, and few distances are measured."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 6))
    x = (centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 6))).astype(float)
    old = centres.astype(float)
    new = old + rng.integers(-25, 25, old.shape)
    code, upper, lower = elkan_codes.nearest(x, old)
    base, step, q = elkan_codes.packed(lower.copy(), code)
    moved = elkan_codes.root(elkan_codes.paired(new, old)) * (1 + elkan_codes.SLACK)
    held = elkan_codes.unpacked(base, step, q, 64)
    true = elkan_codes.root(elkan_codes.distances(x, old))
    other = np.arange(64) != code[:, None]
    assert (held[other] <= true[other]).all()
    books = elkan_codes.Books([new])
    got, top, _, measured = elkan_codes.pruned(x, new, books.between(0), code, upper + moved[code], np.maximum(held - moved, 0))
    want = elkan_codes.distances(x, new)
    assert (got == want.argmin(axis=1)).all() and (top * top >= want.min(axis=1)).all()
    assert measured < 0.1 * want.size


@pytest.mark.parametrize("name", ["op11_line_runs", "op12_elkan_codes", "op13_merkle_manifest"])
def test_oracle(spark, name):
    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, sql = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in sql.fetchall())
