"""Driver contract and every query against its DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from quayside.plans.compare import compare
from quayside.plans.registry import load_all
from quayside.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["invoice_id", "anomaly_type", "billed_usd"]
    assert df.count() >= 0


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query_vs_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    cur = duck.execute(sql)
    ok, detail = compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
    assert ok, detail
