"""Near-duplicates by DartMinHash (operator 9).

A text is a weighted set: its shingles of five words with the times each
occurs. Every shingle owns a half-line of weight, cut into regions ([0,1), [1,2),
[2,4), ...), into which hashed darts arrive at growing ranks, as many per unit of
weight and rank for everybody. A text keeps the darts that hit its weights below
a rank chosen for about K (ln K + 2) of them, and of those the earliest in each of K
coordinates. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of coordinates give the buckets.

A bucket's members are compared with its star, the member that meets most texts
in its buckets (an original rather than a copy), which joins copies at the cost
of one comparison a member. Buckets whose members then still lie in several
components may hide further links; but pairs of texts that only share a passage
are many, and none of them is made: the shingles of such texts are put in one
order, rare ones first, and two sets with a similarity of 0.8 have a shingle in
common among the first ninth of the smaller and the first fifth of the larger one,
at places that leave enough behind them. Pairs of different components that
meet this bound are all compared, so no link of a bucket between components is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import documents, drop_shuffles_early, filled, forget, mapped, out_batch, ragged, saved, text_chunks, words_of
from flightloom.llm.suffix_dedup import Names, mix

SHINGLE = 5
THRESHOLD = 0.8
#: THRESHOLD as a fraction, for bounds in whole numbers.
ABOVE, BELOW = 4, 5
BANDS, ROWS = 30, 5


def shingles(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner text, name, times) of the distinct shingles of each text, by text
    and name. A text of fewer words has one shingle of all of them; none, none."""
    codes, offsets, vocab = words_of(text)
    n = np.diff(offsets)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    vocab = filled(vocab)
    at = np.frombuffer(vocab.buffers()[1], np.int32, len(vocab) + 1).astype(np.int64)
    word = Names(np.frombuffer(vocab.buffers()[2], np.uint8)[at[0] : at[-1]]).of(at[:-1] - at[0], np.diff(at))[codes]
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    starts = ragged(np.maximum(n - size + 1, np.minimum(n, 1)), offsets[:-1])
    owner = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, np.minimum(n, 1)))
    short = n[owner] < size
    name = np.zeros(len(starts), np.uint64)
    for j in range(size):
        part = padded[starts + j]
        part[short & (j >= n[owner])] = 0
        name = mix(name ^ part) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
    order = np.argsort(name)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(n) < 65536 else owner[order], kind="stable")]
    owner, name = owner[order], name[order]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | np.append(True, name[1:] != name[:-1]))
    return owner[first], name[first], np.diff(np.append(first, len(name)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(owner: np.ndarray, name: np.ndarray, weight: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """[set, k] names of the earliest dart in each coordinate; 0 for empty sets.
    weight: whole numbers from 1 on."""
    out = np.zeros((n_sets, k), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    want = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1), 0.0)
    # the regions that each weight reaches: [0,1), [1,2), [2,4), [4,8), ...
    n_regions = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    item = np.repeat(np.arange(len(name)), n_regions)
    region = ragged(n_regions, np.zeros(len(name), np.int64))
    low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
    width = np.where(region <= 1, 1.0, 2.0 ** (region - 1))
    seed = mix(name[item] ^ mix(region.astype(np.uint64) + np.uint64(0xA5A5)))
    todo = np.flatnonzero(total > 0)
    while len(todo):
        alive = np.flatnonzero(np.isin(owner[item], todo)) if len(todo) < n_sets else np.arange(len(item))
        rank, ranks, slots, names = np.zeros(len(alive)), [], [], []
        n = 0
        while len(alive):
            h = mix(seed[alive] + np.uint64(n * 0xD1B54A32D192ED03 % 2**64))
            rank = rank - np.log(_unit(h)) / width[alive]
            inside = rank < want[owner[item[alive]]]
            alive, rank, h = alive[inside], rank[inside], h[inside]
            place = low[alive] + _unit(mix(h ^ np.uint64(0x5DEECE66D))) * width[alive]
            hit = place < weight[item[alive]]
            dart = mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
            ranks.append(rank[hit])
            slots.append(owner[item[alive[hit]]] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
            names.append(dart[hit] | np.uint64(1))
            n += 1
        ranks, slots, names = (np.concatenate(x) for x in (ranks, slots, names))
        order = np.argsort(-ranks, kind="stable")  # the last to be written is the earliest
        out.ravel()[slots[order]] = names[order]
        todo = todo[(out[todo] == 0).any(axis=1)]  # a coordinate that no dart hit: further ranks
        want[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15 + 2 * r)
    return mix(key ^ np.arange(bands, dtype=np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("name", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for chunk in text_chunks(batches):
        owner, name, times = shingles(chunk.column("text"))
        n = chunk.num_rows
        keys = band_keys(darts(owner, name, times, n, BANDS * ROWS), BANDS, ROWS).view(np.int64)
        some = np.bincount(owner, minlength=n) > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(keys[some].ravel()))
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("name"), lists], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles as names in ascending order, their times where any is above 1, and the sum of the times."""
    schema = pa.schema([("h", pa.int64()), ("names", pa.binary()), ("times", pa.binary()), ("size", pa.int64())])
    for chunk in text_chunks(batches):
        owner, name, times = shingles(chunk.column("text"))
        at = np.searchsorted(owner, np.arange(chunk.num_rows + 1))
        parts = [(name[a:b], times[a:b]) for a, b in zip(at, at[1:])]
        yield out_batch(schema, h=chunk.column("h"), names=[x.tobytes() for x, _ in parts], times=[n.astype(np.uint32).tobytes() if (n > 1).any() else None for _, n in parts], size=[int(n.sum()) for _, n in parts])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set, and one for each further time that it occurs."""
    schema = pa.schema([("h", pa.int64()), ("e", pa.int64())])
    for batch in batches:
        for h, names, times in zip(*(batch.column(c).to_pylist() for c in ("h", "names", "times"))):
            e = np.frombuffer(names, np.uint64)
            if times is not None:
                n = np.frombuffer(times, np.uint32).astype(np.int64)
                again = ragged(n, np.zeros(len(n), np.int64)).astype(np.uint64)
                e = np.where(again > 0, mix(np.repeat(e, n) + again * np.uint64(0x9E3779B97F4A7C15)), np.repeat(e, n))
            yield out_batch(schema, h=np.full(len(e), h), e=e.view(np.int64))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first elements of each set, rare ones first: those at which a pair of
    similar sets may have its first common one. ``first``: so early that the other set may be larger."""
    schema = pa.schema([("e", pa.int64()), ("h", pa.int64()), ("label", pa.int64()), ("size", pa.int64()), ("place", pa.int64()), ("first", pa.int64())])
    for batch in batches:
        for h, label, size, met in zip(*(batch.column(c).to_pylist() for c in ("h", "label", "size", "met"))):
            n, e = np.array([x["n"] for x in met]), np.array([x["e"] for x in met])
            e = e[np.lexsort((e, n))]
            place = np.arange(len(e)) + size - len(e)  # those that no other set holds come before
            e, place = e[: (keep := int((place <= size - -(-ABOVE * size // BELOW)).sum()))], place[:keep]
            own = lambda x: np.full(len(e), x)
            yield out_batch(schema, e=e.astype(np.int64), h=own(h), label=own(label), size=own(size), place=place, first=(place <= size - -(-2 * ABOVE * size // (ABOVE + BELOW))).astype(np.int64))


def similarity(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """Weighted Jaccard similarity of two sets of ascending names; 0 if both are empty."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(0, np.int64)
    ones = lambda w, x: np.ones(len(x)) if w is None else w.astype(float)
    xa, xb = ones(wa, a), ones(wb, b)
    both = np.minimum(xa[hit], xb[at[hit]]).sum()
    whole = xa.sum() + xb.sum() - both
    return float(both / whole) if whole else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    get = lambda x, kind=np.uint64: None if x is None else np.frombuffer(x, kind)
    for batch in batches:
        rows = [(r["a"], r["b"]) for r in batch.to_pylist() if similarity(get(r["na"]), get(r["ta"], np.uint32), get(r["nb"]), get(r["tb"], np.uint32)) >= THRESHOLD - 1e-12]
        yield out_batch(schema, a=[r[0] for r in rows], b=[r[1] for r in rows])


def contract(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, label (the same for all of a component) for the ends of links a, b.

    Every node points to the least of itself and its neighbours; pointers are
    followed once; what they lead to is linked in place of the nodes, until no
    link is left. A component's nodes at least halve in each round."""
    edges, labels = links, None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.least("node", F.min("other")).alias("up"))
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
        step = saved(spark, up.join(jump, "up").select("node", F.col("further").alias("label")), "step")
        if labels is None:
            labels = step
        else:
            then = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = saved(spark, labels.join(then, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        to = lambda end: step.select(F.col("node").alias(end), F.col("label").alias(f"{end}2"))
        edges = saved(spark, edges.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def bounded_pairs(spark: SparkSession, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: the pairs of sets (h, names, times, size) with different labels (h, label)
    that may be similar, by the places of a common element in an order of all elements.

    Where two sets share THRESHOLD, the first element that they have in common
    leaves, in either, as many elements from it on as their overlap needs. An
    element's sets of its main label meet only the others, not each other."""
    held = sets.join(labels, "h")
    every = saved(spark, held.select("h", "names", "times").transform(mapped, _elements, "h long, e long"), "elements")
    shared = saved(spark, every.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = every.join(shared, "e").groupBy("h").agg(F.collect_list(F.struct("n", "e")).alias("met"))  # as many as the text has shingles
    early = saved(spark, met.join(held.select("h", "label", "size"), "h").transform(mapped, _prefixes, "e long, h long, label long, size long, place long, first long"), "early")
    parts = early.groupBy("e", "label").agg(F.count("*").alias("n"), F.sum("first").alias("first"))
    mixed = saved(spark, parts.groupBy("e").agg(F.count("*").alias("kinds"), F.sum("first").alias("able"), F.max(F.struct("n", "label"))["label"].alias("main")).where("kinds > 1 and able > 0").select("e", "main"), "mixed")
    live = saved(spark, early.join(mixed, "e"), "live")
    o, r = live.where("label <> main").alias("o"), live.alias("r")
    room = F.least(F.expr("o.size - o.place"), F.expr("r.size - r.place"))
    fit = (room * (ABOVE + BELOW) >= F.expr("o.size + r.size") * ABOVE) & (F.col("o.label") != F.col("r.label"))
    once = (F.col("r.label") == F.col("r.main")) | (F.col("o.h") < F.col("r.h"))
    pairs = saved(spark, o.join(r, (F.col("o.e") == F.col("r.e")) & fit & once).select(F.least("o.h", "r.h").alias("a"), F.greatest("o.h", "r.h").alias("b")).distinct(), "bounded")
    forget(spark, every, shared, early, mixed, live)
    return pairs


def text_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """name, text_id, class_id, n_links, chosen: for each distinct text (its
    SHA-256) the least id with that text, the least id of its class, the number of
    links found from it, and whether it is the text of its class that stays when one is to."""
    drop_shuffles_early(spark)
    full = with_name(docs.select("doc_id", "text")).where("text is not null")
    signed = full.transform(mapped, _signatures, "doc_id long, name binary, bands array<long>")
    # ids of texts are given once and written, so they are short and the same for all that follows
    distinct = signed.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = saved(spark, distinct.withColumn("h", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("h", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = saved(spark, rows.join(buckets, "key"), "met")
    # an original meets more texts than its copies do: the most met member leads a bucket
    weighted = saved(spark, met.join(met.groupBy("h").agg(F.sum("n").alias("w")), "h"), "weighted")
    stars = weighted.groupBy("key").agg(F.max(F.struct("w", "h"))["h"].alias("star"))
    members = saved(spark, weighted.join(stars, "key").select("key", "h", "n", "star"), "members")
    forget(spark, met, weighted)
    chosen = nodes.join(members.select("h").distinct(), "h", "left_semi").select(F.col("h"), F.col("name").alias("of"), F.col("doc_id").alias("d"))
    with_text = full.join(chosen, (full["name"] == chosen["of"]) & full["doc_id"].eqNullSafe(chosen["d"])).select("h", "text")
    sets = saved(spark, with_text.transform(mapped, _sets, "h long, names binary, times binary, size long").dropDuplicates(["h"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda end: sets.select(F.col("h").alias(end), F.col("names").alias(f"n{end}"), F.col("times").alias(f"t{end}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "ta", "nb", "tb").transform(mapped, _verify, "a long, b long")

    pairs = saved(spark, members.where("h <> star").select(F.least("h", "star").alias("a"), F.greatest("h", "star").alias("b")).distinct(), "pairs")
    links = saved(spark, verified(pairs), "links")
    labels = linked(spark, links)
    placed = members.where("n > 2").join(labels, "h", "left").select("key", "h", F.coalesce("label", "h").alias("label"))
    split = saved(spark, placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "split")  # written first: a join of two written tables is split at hot keys
    unsettled = saved(spark, placed.join(split, "key", "left_semi").select("h", "label").distinct(), "unsettled")
    more = saved(spark, verified(bounded_pairs(spark, sets, unsettled).join(pairs, ["a", "b"], "left_anti")), "more")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = linked(spark, links)
    n_links = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("n_links"))
    own = nodes.select("h", "name", "doc_id").join(labels, "h", "left").withColumn("label", F.coalesce("label", "h"))
    first = own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name"))["name"].alias("first"))
    return own.join(first, "label").join(n_links, "h", "left").select("name", F.col("doc_id").alias("text_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("name") == F.col("first")).alias("chosen"))


def linked(spark: SparkSession, links: DataFrame) -> DataFrame:
    """h, label of the components of links."""
    return spark.createDataFrame([], "h long, label long") if links.isEmpty() else contract(spark, links).withColumnRenamed("node", "h")


def with_name(docs: DataFrame, column: str = "name") -> DataFrame:
    return docs.withColumn(column, F.unhex(F.sha2("text", 256)))


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), text_id (the least
    doc_id with the same text), n_links (verified links of the text to other
    texts; pairs already connected are not compared) for every row of docs.

    Classes are the components of links between texts whose weighted Jaccard
    similarity of five-word shingles (64-bit names) is THRESHOLD or more; equal
    texts are one node (of their SHA-256). A null text and a text without words are
    linked to no different one; empty texts are equal to each other, null ones to
    none (their ids are their own). A null id is a class's only where no other is
    there. Repeated ids are told apart by their texts. Columns of docs but
    doc_id and text are ignored; no rows give none."""
    classes = text_classes(spark, docs).drop("chosen")
    null = F.col("name").isNull()
    return with_name(docs.select("doc_id", "text")).select("doc_id", "name").join(classes, "name", "left").select("doc_id", F.when(null, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(null, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of one document for each class; rows with a null text stay."""
    name, kept = "__text_name", text_classes(spark, docs).where("chosen").select(F.col("name").alias("__of"), F.col("text_id").alias("__id"))
    named = with_name(docs, name)
    one = named.join(kept, (F.col(name) == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([name])
    return one.unionByName(named.where("text is null")).drop(name)


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, documents(spark, sf_dir))
