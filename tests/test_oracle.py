"""Every query that SQL can express gives the rows that DuckDB gives on the same tables."""

import os

import pytest

from tidewatch import plans

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


MORE = os.environ.get("TEST_MORE_DIR", "/root/testdata/sf0.01")


def views(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def sql():
    return views(DATA)


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) + 0.0 if type(v).__name__ in ("float", "Decimal") else v


def compare(spark, sql, name, data, digits=True):
    df = plans.queries()[name](spark, data)
    want = sql.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at, shown = [want.columns.index(c) for c in columns], plain if digits else lambda v: v
    ordered = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert ordered([tuple(shown(r[c]) for c in columns) for r in df.collect()]) == ordered([tuple(shown(r[i]) for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, sql, name):
    compare(spark, sql, name, DATA)


@pytest.mark.parametrize("name", ["anomaly_scores", "whole_ledger", "hunted_deviation"])
def test_same_digits_on_more_rows(spark, name):
    """Scores that are sums of doubles: more rows, and no rounding before the comparison."""
    compare(spark, views(MORE), name, MORE, digits=False)
