"""Every catalogue query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from flightloom.plans import queries as catalog

DATA = "/root/testdata/sf0.001"
#: Queries that the smallest tables give no rows.
EMPTY_AT_SMALLEST: set[str] = set()


def plain(v):
    """A value to sort rows by: six digits of a number."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(a, b):
    """Equal values; numbers to nine digits, so that no rounding of a text lies between sums in another order."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v)
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if number(a) and number(b) else plain(a) == plain(b)


def by_text(rows):
    """Rows in an order that the last digit of a number has no part in."""
    coarse = lambda v: plain(v) if not isinstance(v, float) else plain(round(v, 3))
    return sorted(rows, key=lambda r: (tuple(coarse(v) for v in r), tuple(plain(v) for v in r)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, duck, name):
    df, sql = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = by_text(tuple(r[c] for c in columns) for r in df.collect())
    at = [sql.columns.index(c) for c in columns]
    want = by_text(tuple(r[i] for i in at) for r in sql.fetchall())
    assert got or name in EMPTY_AT_SMALLEST
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))] == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    """What SQL does not say is run all the same, and gives rows."""
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_otsu_thresholds_of_every_frame(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 230
    vectors = np.concatenate([rng.normal(-0.3, 0.1, (n, 32)), rng.normal(0.3, 0.1, (n, 32))], axis=1)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))

    def threshold(v):
        level = np.clip(np.rint(v * 200 + 128), 0, 255)
        best = (-1.0, 0)
        for t in range(256):
            low, high = level[level <= t], level[level > t]
            if len(low) and len(high):
                between = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                best = (between, t) if between > best[0] * (1 + 1e-9) else best
        return min(255, max(1, best[1] - 4))

    got = {r.frame: r.threshold for r in catalog.QUERIES["otsu_thresholds"](spark, str(tmp_path)).collect()}
    assert got == {i: threshold(v) for i, v in enumerate(vectors)}
