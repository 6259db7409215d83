"""Every registered media query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from mediaframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "embeddings events lineitem documents part".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*'}')")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall()) and got


def test_the_two_forms_of_resampling_agree(spark):
    a, b = (catalog.queries()[n](spark, SF) for n in ("resample_rows", "resample_signal"))
    assert {(r.stream_id, r.k): r.v for r in a.collect()} == pytest.approx({(r.stream_id, r.k): r.v for r in b.collect()}, abs=1e-5)


def test_entry(spark):
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 500
