"""Merkle manifest of a dataset by supersteps (operator 13).

A row is a leaf; the leaves of a source, in the order of doc_id, are the children of
vertices of 16, these of further vertices, up to the source's subroot; subroots, in the
order of their sources, are the leaves of one more tree. Vertices are keyed (group, place
in its level). In a superstep upwards every node sends its digest to its parent; a parent
that has heard all its children hashes them and is a node of the next superstep; a
group of one node is done. In a superstep downwards every vertex has heard the path
from its parent to the root, and sends each child that path with the child's siblings before it.
Messages of a level are dealt by vertex, at most 16 to one, so no source is ever in one
task; on the way down a vertex holds its children, so leaves are reached without a message each."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.llm.common import documents, drop_shuffles_early, forget, mapped, saved, text_chunks

FAN = 16
#: Leaves for which this divides crc32(doc_id) are checked with a changed text.
TAMPER = 5
PATH = "array<struct<place:int,siblings:array<string>>>"


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def joined(digests: list[bytes]) -> bytes:
    """H of digests as hex text."""
    return digest(b"".join(digests).hex().encode())


def framed(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%b" % (len(value), value)


def nodes_at(total: int, level: int) -> int:
    """Nodes of a group at a level: ``total`` leaves at level 0; level 1 has one vertex at least."""
    for _ in range(level):
        total = -(-total // FAN)
    return total


def depth(total: int) -> int:
    """The level of a group's root; 1 for a lone leaf too, whose vertex passes it on."""
    level = 1
    while nodes_at(total, level) > 1:
        level += 1
    return level


def leaves(docs: DataFrame) -> DataFrame:
    """grp (source with a byte before it, so that null comes first), doc_id, leaf, bent: the leaf of
    the tampered row where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            ids = chunk.column("doc_id").to_pylist()
            source, lang, text = (chunk.column(c).cast(pa.binary()).to_pylist() for c in ("source", "lang", "text"))
            n_chars = chunk.column("n_chars").to_pylist()
            grp, leaf, bent = [], [], []
            for i, s, g, n, t in zip(ids, source, lang, n_chars, text):
                number = None if i is None else b"%d" % i
                head = framed(number) + framed(s) + framed(g) + framed(None if n is None else b"%d" % n)
                grp.append(b"\x00" if s is None else b"\x01" + s)
                leaf.append(digest(head, framed(t)))
                tampered = number is not None and t is not None and zlib.crc32(number) % TAMPER == 0
                bent.append(digest(head, framed(t.lower())) if tampered else None)  # of bytes: A-Z alone
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.binary()), pa.array(ids, pa.int64()), pa.array(leaf, pa.binary()), pa.array(bent, pa.binary())], names=["grp", "doc_id", "leaf", "bent"])

    whole = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("source", "lang")), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    return mapped(whole, run, "grp binary, doc_id long, leaf binary, bent binary")


def placed(spark: SparkSession, nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int, tuple[DataFrame, ...]]:
    """The nodes with idx (place in the order within grp) and total (nodes of grp), the largest total,
    and the tables behind. Rows are ranked within the ranges of a sort, then moved by the numbers before their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            ranks = []
            for g in batch.column("grp").to_pylist():
                at = at + 1 if g == last else 0
                last = g
                ranks.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], names=[*batch.schema.names, "part", "rank"])

    ddl = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    ranked = saved(spark, mapped(nodes.repartitionByRange(*order).sortWithinPartitions(*order), run, f"{ddl}, part int, rank long"), "ranked")
    counts = ranked.groupBy("grp", "part").agg(F.count("*").alias("n"))
    every = Window.partitionBy("grp")
    counts = saved(spark, counts.select("grp", "part", F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total")), "offsets")
    most = counts.agg(F.max("total")).first()[0] or 0
    return ranked.join(counts, ["grp", "part"]).withColumn("idx", F.col("rank") + F.col("before")), most, (ranked, counts)


def spot(key: tuple[bytes, int]) -> int:
    return zlib.crc32(b"%b/%d" % key)


def _complete(vertices: Iterator[tuple], level: int) -> Iterator[tuple]:
    """((group, place), (total, digest, children in order)) of vertices that have heard all their children."""
    for (group, place), heard in vertices:
        heard = sorted(heard, key=lambda m: m[1])
        total = heard[0][0]
        below = nodes_at(total, level - 1)
        if len(heard) != min(FAN, below - FAN * place):
            raise ValueError(f"vertex {place} of level {level} has heard {len(heard)} of its children")
        digests = [m[2] for m in heard]
        yield (group, place), (total, digests[0] if below == 1 else joined(digests), [m[2:] for m in heard])


def climb(nodes: RDD, most: int, parts: int) -> list[RDD]:
    """Vertices of every level, 1 first, from leaves (group, idx, total, digest, payload)."""
    messages = nodes.map(lambda n: ((n[0], n[1] // FAN), (n[2], n[1] % FAN, *n[3:])))
    levels = []
    for level in range(1, depth(most) + 1):
        vertices = messages.groupByKey(max(1, parts // FAN ** (level - 1)), spot).mapPartitions(partial(_complete, level=level), preservesPartitioning=True)
        levels.append(vertices)
        messages = vertices.filter(lambda v, level=level: nodes_at(v[1][0], level) > 1).map(lambda v: ((v[0][0], v[0][1] // FAN), (v[1][0], v[0][1] % FAN, v[1][1])))
    return levels


def roots(spark: SparkSession, levels: list[RDD]) -> RDD:
    """(group, (level, total, digest)) of the vertices that are all of their level."""
    found = [v.filter(lambda x, level=i: nodes_at(x[1][0], level) == 1).map(lambda x, level=i: (x[0][0], (level, x[1][0], x[1][1]))) for i, v in enumerate(levels, 1)]
    return spark.sparkContext.union(found)


def _told(vertex: tuple, level: int) -> Iterator[tuple]:
    """What a vertex tells its children: ((group, place), (digest, payload if any, context, path))."""
    (group, place), both = vertex
    (_, (total, _, children)), (_, (context, path)) = sorted(both, key=lambda x: x[0])
    whole = b"".join(c[0] for c in children)
    for i, child in enumerate(children):
        own = path if nodes_at(total, level - 1) == 1 else ((i, whole[: 32 * i] + whole[32 * i + 32 :]), *path)
        yield (group, FAN * place + i), (*child, context, own)


def descend(levels: list[RDD], starts: RDD) -> RDD:
    """For every leaf ((group, idx), (digest, payload, context, path)), path being (place, siblings'
    digests end to end) of each level from the leaf up. starts: (group, (level of its root, context, path above))."""
    told = None
    for level in range(len(levels), 0, -1):
        vertices = levels[level - 1]
        here = starts.filter(lambda s, level=level: s[1][0] == level).map(lambda s: ((s[0], 0), s[1][1:]))
        if told is not None:
            here = here.union(told.map(lambda m: (m[0], m[1][-2:])))
        n = vertices.getNumPartitions()
        both = vertices.mapValues(lambda v: (0, v)).union(here.partitionBy(n, spot).mapValues(lambda h: (1, h)))
        told = both.groupByKey(n, spot).flatMap(partial(_told, level=level))  # vertices stay where they are
    return told


def proofs(spark: SparkSession, docs: DataFrame) -> tuple[RDD | None, Callable[[], None]]:
    """(doc_id, leaf, bent, subroot, root, path) of every row (None if there is none), and what removes the tables behind."""
    drop_shuffles_early(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = saved(spark, leaves(docs), "leaves")  # a sort by ranges reads its input twice
    nodes, most, behind = placed(spark, hashed, ["grp", "doc_id", "leaf"])
    forget(spark, hashed)
    if not most:
        return None, lambda: forget(spark, *behind)
    levels = climb(nodes.select("grp", "idx", "total", "leaf", "doc_id", "bent").rdd.map(lambda r: (bytes(r[0]), r[1], r[2], bytes(r[3]), (r[4], r[5] and bytes(r[5])))), most, parts)
    tops = saved(spark, spark.createDataFrame(roots(spark, levels).map(lambda r: (r[0], r[1][0], r[1][1], r[1][2])), "member binary, level int, size long, leaf binary", verifySchema=False), "subroots")
    over, sources, behind_top = placed(spark, tops.withColumn("grp", F.lit(b"")), ["member"])
    crown = climb(over.select("grp", "idx", "total", "leaf", "member", "level").rdd.map(lambda r: (bytes(r[0]), r[1], r[2], bytes(r[3]), (bytes(r[4]), r[5]))), sources, parts)
    top = roots(spark, crown).map(lambda r: (r[0], (r[1][0], r[1][2], ())))
    paths = descend(crown, top).map(lambda m: (m[1][1][0], (m[1][1][1], (m[1][2], m[1][0]), m[1][3])))
    every = descend(levels, paths).map(lambda m: (m[1][1][0], m[1][0], m[1][1][1], m[1][2][1], m[1][2][0], m[1][3]))
    return every, lambda: forget(spark, *behind, tops, *behind_top)


def folded(leaf: bytes, path: tuple) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for place, siblings in path:
        leaf = joined([siblings[: 32 * place], leaf, siblings[32 * place :]])
    return leaf


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root (hex) and path (from the leaf up: its place among the children of
    its parent, the siblings' digests from left to right), for each row of docs.

    A leaf is the hash of doc_id, source, lang, n_chars and text, each framed by its length, ``-``
    for null. Rows of equal doc_id and source are ordered by leaf, null ids come first, as does the null source.
    A source with one row has its leaf as subroot; no rows give no rows; other columns are ignored."""
    every, _ = proofs(spark, docs)
    schema = f"doc_id long, leaf string, subroot string, root string, path {PATH}"
    if every is None:
        return spark.createDataFrame([], schema)
    cut = lambda raw: [raw[i : i + 32].hex() for i in range(0, len(raw), 32)]
    rows = every.map(lambda p: (p[0], p[1].hex(), p[3].hex(), p[4].hex(), [(place, cut(raw)) for place, raw in p[5]]))
    return spark.createDataFrame(rows, schema, verifySchema=False)


def verified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings, from the leaf up), folded_root (from the tampered leaf
    where TAMPER divides crc32(doc_id), else from the leaf), verified. Cases as ``manifest``; null ids are not tampered with."""
    every, _ = proofs(spark, docs)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if every is None:
        return spark.createDataFrame([], schema)

    def row(p: tuple) -> tuple:
        doc_id, leaf, bent, subroot, root, path = p
        own = folded(bent or leaf, path)
        return doc_id, leaf.hex(), subroot.hex(), root.hex(), joined([raw for _, raw in path]).hex(), own.hex(), own == root

    return spark.createDataFrame(every.map(row), schema, verifySchema=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, documents(spark, sf_dir))


def _oracle(levels: int = 7, crown: int = 4) -> str:
    """The same in SQL, for sources of up to 16^levels rows and 16^crown sources."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}))::VARCHAR || ':' || {c} END"
    text = lambda t: f"sha256({' || '.join(frame(c) for c in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', t))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, b: " + "list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"
    crc = f"xor({bits}, 4294967295::BIGINT)"
    ctes = [f"base AS (SELECT row_number() OVER () AS r, doc_id, source, {text('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % {TAMPER} = 0 THEN {text(low)} ELSE {text('text')} END AS bent FROM documents)",
            "s0 AS (SELECT r, source AS g, leaf AS d, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM base)"]

    def tree(name: str, depth: int) -> None:
        for k in range(1, depth + 1):
            below = f"{name}{k - 1}"
            ctes.append(f"{name}{k} AS (SELECT g, i // {FAN} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {below} GROUP BY g, i // {FAN})")
            ctes.append(f"{name}x{k} AS (SELECT g, i AS p, CASE WHEN n = 1 THEN NULL ELSE i % {FAN} END AS at, [x FOR x, j IN kids IF j - 1 <> i % {FAN}] AS sib FROM (SELECT g, i, n, list(d) OVER (PARTITION BY g, i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kids FROM {below}) z)")

    tree("s", levels)
    ctes.append(f"t0 AS (SELECT g AS member, 0 AS g, d, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s{levels})")
    tree("t", crown)
    steps, joins, fold, proof = [], [], "b.bent", []
    for k in range(1, levels + 1):
        joins.append(f"JOIN sx{k} a{k} ON a{k}.g IS NOT DISTINCT FROM b.source AND a{k}.p = b.i // {FAN ** (k - 1)}")
        steps.append(f"a{k}")
    joins.append("JOIN t0 m ON m.member IS NOT DISTINCT FROM b.source")
    for k in range(1, crown + 1):
        joins.append(f"JOIN tx{k} c{k} ON c{k}.p = m.i // {FAN ** (k - 1)}")
        steps.append(f"c{k}")
    folds = []
    for k, s in enumerate(steps):
        proof.append(f"CASE WHEN {s}.at IS NULL THEN '' ELSE array_to_string({s}.sib, '') END")
        folds.append(f"{s}.at AS at{k}, {s}.sib AS sib{k}")
    inner = f"SELECT b.doc_id, b.leaf, b.bent, m.d AS subroot, top.d AS root, sha256({' || '.join(proof)}) AS proof_sha256, {', '.join(folds)} FROM (SELECT base.*, s0.i FROM base JOIN s0 USING (r)) b {' '.join(joins)} CROSS JOIN t{crown} top"
    ctes.append(f"f0 AS (SELECT *, bent AS cur FROM ({inner}) q)")
    for k in range(len(steps)):
        fold = f"CASE WHEN at{k} IS NULL THEN cur ELSE sha256(array_to_string(list_concat(sib{k}[1:at{k}], [cur], sib{k}[at{k} + 1:]), '')) END"
        ctes.append(f"f{k + 1} AS (SELECT * REPLACE ({fold} AS cur) FROM f{k})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, cur AS folded_root, cur = root AS verified FROM f{len(steps)}"


ORACLE = _oracle(5, 3)
