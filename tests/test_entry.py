"""Every query with SQL against DuckDB, the contract of the entry module."""

import collections
import datetime
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402


def same(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(same(x) for x in v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def views(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, data):
    df = entry.queries()["p1_found"](spark, data)
    assert df.columns == ["ref_table", "ref_key", "ref_field", "target_key", "reason"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, views, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(same(r[c]) for c in cols) for r in df.collect())
    r = views.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(same(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want
