"""All rules of a table in one pass, as a query and while the table is written."""

import os
import tempfile

import pytest

from quayside.operators import quality as Q

ROWS = [(1, "x", 0.0), (None, "y", -1.0), (3, "z", None), (None, None, -2.0), (3, "z", 5.0)]
SCHEMA = "a long, b string, c double"


def rules():
    return [Q.not_null("a"), Q.one_of("b", ["x", "y"]), Q.at_least("c", 0)]


def found(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("low,high,off", [(1, None, 0), (5, 5, 0), (7, None, 2), (1, 4, 1), (0, 0, 5)])
def test_both_outcomes(spark, low, high, off):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    want = [("t", "row count", 5, off, off == 0), ("t", "a not null", 5, 2, False), ("t", "b allowed", 5, 2, False),
            ("t", "c at least 0", 5, 2, False)]
    assert found(Q.profile(df, "t", rules(), low, high)) == want
    path = os.path.join(tempfile.mkdtemp(prefix="checked-"), "t")
    assert found(Q.write_checked(df, path, "t", rules(), low, high)) == want
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))


def test_an_empty_table_lacks_rows_only(spark):
    df = spark.createDataFrame([], SCHEMA)
    want = [("t", "row count", 0, 1, False), ("t", "a not null", 0, 0, True), ("t", "b allowed", 0, 0, True),
            ("t", "c at least 0", 0, 0, True)]
    assert found(Q.profile(df, "t", rules())) == want
    path = os.path.join(tempfile.mkdtemp(prefix="checked-"), "t")
    assert found(Q.write_checked(df, path, "t", rules())) == want


def test_the_table_is_read_once(spark, tables):
    df = Q.profile(tables.orders, "orders", [Q.not_null("o_orderkey"), Q.at_least("o_totalprice", 0)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "o_comment" not in plan
    # rows are computed once while they are written
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    path = os.path.join(tempfile.mkdtemp(prefix="checked-"), "t")
    slow = spark.createDataFrame(ROWS, SCHEMA).mapInPandas(count, SCHEMA)
    Q.write_checked(slow, path, "t", rules()).collect()
    assert seen.value == len(ROWS)


@pytest.mark.parametrize("baseline", ["trailing", "frozen"])
def test_every_drift_level_fires_for_some_crane(tables, baseline):
    from quayside.operators import operations as O
    from quayside.sources import adapters as A
    got = {(r.crane_id, r.level) for r in O.drift_levels(
        A.drifting_telemetry(tables), baseline=baseline, frozen_before="2024-01-08").collect()}
    assert {x for _, x in got} >= {"Watch", "Stop", "Inspect-temperature"}
    assert ("QC2", "Inspect") in got or baseline == "trailing"
    assert not {c for c, _ in got} & {"QC0", "QC4"}
