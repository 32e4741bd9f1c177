"""The queries against DuckDB on the smallest stored tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no stored tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    told = duck.sql(entry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in told.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_similar_pairs_of_all_sources(spark, tmp_path):
    """The query against brute force: near copies in several sources, and across sources."""
    base = [" ".join(f"word{k}x{i}" for i in range(30)) for k in range(4)]
    docs = [(n, f"src{n % 3}" if n % 4 else None, base[n // 3 % 4] + f" tail{n % 2}") for n in range(36)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    held = [(n, s or "", shingles(t)) for n, s, t in docs]
    want = {(s, a, b) for a, s, x in held for b, z, y in held if a < b and s == z and len(x & y) >= 0.7 * len(x | y)}
    got = {(r["source"], r["a"], r["b"]) for r in entry.queries()["shingle_jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and len({s for s, _, _ in want}) == 4
