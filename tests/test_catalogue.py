"""Driver contract: entry() and a sample of catalogue queries against DuckDB."""

import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["city_mart", "fact_listings", "clean_listings", "target_encoding",
          "dashboard_kpis", "analysis_type_stats", "city_map", "market_alerts",
          "price_histogram", "classification_metrics"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem").split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "volume_annonces" in df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    ours = collections.Counter(tuple(_norm(x) for x in r) for r in df.collect())
    theirs = collections.Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
