import re

import corpus_pipeline
import pytest

from flightloom.llm import dart_minhash, language_id, quality_rules, suffix_dedup
from flightloom.llm.common import saved

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against its rule applied to its input by plain code."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, saved(spark, stage(spark, docs, DATA), name)
        rows = docs.collect()
        now = {r.doc_id: r for r in rows}
        assert docs.columns == columns and len(now) == len(rows) and set(now) <= set(before)
        if name == "language_id":
            langs, table = language_id.trained_on(was)
            want = {r.doc_id for r in language_id.identify(was, langs, table).collect() if r.shares and max(r.shares) >= 0.4}
        elif name == "quality_rules":
            want = {r.doc_id for r in quality_rules.measure(was).where("kept").collect()}
        elif name == "near_dedup":
            want = {r.class_id for r in dart_minhash.near_classes(spark, was).collect()}
        else:
            want = set(before)
            texts = {d: r.text.encode() for d, r in before.items()}
            seen: dict[bytes, int] = {}
            width = suffix_dedup.PASSAGE
            for raw in texts.values():
                for i in range(len(raw) - width + 1):
                    seen[raw[i : i + width]] = seen.get(raw[i : i + width], 0) + 1
            for d, raw in texts.items():
                gone = bytearray(len(raw))
                for i in range(len(raw) - width + 1):
                    if seen[raw[i : i + width]] > 1:
                        gone[i : i + width] = b"\x01" * width
                kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
                assert now[d].text == kept and now[d].n_chars == (len(kept) if any(gone) else before[d].n_chars)
        assert set(now) == want
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == set(before)


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "s", 0), (None, "", None, None, None), (1, None, "en", "s", 0)]])
def test_stages_of_nothing_and_of_nulls(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0  # a text without letters has no language
        docs = spark.createDataFrame([], KIND)


def test_stages_of_repeated_rows(spark):
    good = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' and n_chars > 900").orderBy("doc_id").limit(30).collect()]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, int(r.n_chars)) for r in good * 2] + [(None, r.text, r.lang, None, None) for r in good[:3]], KIND)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, DATA), name)
    rows = docs.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(re.search(r"\w", r.text) for r in rows)
