"""Files of several schema versions are read as one table."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.sources import versions as V


def kind(ddl):
    return T.StructType.fromDDL(f"c {ddl}").fields[0].dataType


@pytest.mark.parametrize("a,b,want", [
    ("int", "bigint", "bigint"), ("tinyint", "smallint", "smallint"), ("float", "double", "double"), ("int", "double", "double"),
    ("date", "timestamp_ntz", "timestamp_ntz"), ("decimal(10,2)", "decimal(9,4)", "decimal(12,4)"),
    ("int", "decimal(5,2)", "decimal(12,2)"), ("bigint", "decimal(12,2)", "decimal(22,2)"), ("string", "string", "string"),
    ("array<int>", "array<bigint>", "array<bigint>"), ("struct<a:int>", "struct<a:bigint,b:string>", "struct<a:bigint,b:string>"),
    ("map<string,int>", "map<string,bigint>", "map<string,bigint>")])
def test_widening(spark, a, b, want):
    assert V.widest(kind(a), kind(b)).simpleString() == want == V.widest(kind(b), kind(a)).simpleString()


@pytest.mark.parametrize("a,b", [("bigint", "double"), ("string", "int"), ("date", "int"), ("decimal(38,0)", "decimal(38,10)"),
                                 ("array<int>", "int"), ("float", "bigint"), ("boolean", "int")])
def test_lossy_types_raise(spark, a, b):
    with pytest.raises(ValueError, match="column x: no common type"):
        V.widest(kind(a), kind(b), "x")


def test_equal_to_a_union_written_by_hand(spark):
    folder = tempfile.mkdtemp(prefix="versions-")
    old = spark.range(50).select(F.col("id").cast("int").alias("id"), F.col("id").cast("int").alias("n"),
                                 F.lit(dt.date(2026, 1, 1)).alias("at"), F.struct(F.lit(1).alias("x")).alias("s"))
    mid = spark.range(50, 80).select("id", (F.col("id") * 10 ** 12).alias("n"), F.lit("m").alias("tag"))
    new = spark.range(80, 99).select(
        "id", F.expr("cast(id + 0.25 as decimal(12,2))").alias("n"), F.when(F.col("id") % 2 == 0, "t").alias("tag"),
        F.lit(dt.datetime(2026, 2, 1, 3)).cast("timestamp_ntz").alias("at"),
        F.struct(F.col("id").alias("x"), F.lit("y").alias("y")).alias("s"))
    for i, df in enumerate((old, mid, new)):
        df.write.parquet(os.path.join(folder, f"v{i}"))
    mid.limit(0).write.parquet(os.path.join(folder, "none"))
    got = V.read_versions(spark, folder)
    assert got.schema.simpleString() == ("struct<at:timestamp_ntz,id:bigint,n:decimal(22,2),"
                                         "s:struct<x:bigint,y:string>,tag:string>")
    wide = dict(got.dtypes)

    def by_hand(df):
        s = F.struct(F.col("s.x").cast("bigint").alias("x"),
                     (F.col("s.y") if "y" in df.schema["s"].dataType.names else F.lit(None).cast("string")).alias("y")) \
            if "s" in df.columns else F.lit(None).cast(wide["s"])
        return df.select(*[(F.col(c).cast(wide[c]) if c in df.columns else F.lit(None).cast(wide[c])).alias(c)
                           for c in ("at", "id", "n", "tag")], s.alias("s")).select(*got.columns)

    want = by_hand(old).union(by_hand(mid)).union(by_hand(new))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 99
    plan = got.filter("id = 85").select("n")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,85)" in plan and plan.count("FileScan") == 1
    assert [r.n for r in got.filter("id = 7").select(F.col("n").cast("double").alias("n")).collect()] == [7.0]


def test_columns_that_differ_in_case(spark):
    with pytest.raises(ValueError, match="case only"):
        V.merged([T.StructType.fromDDL("a int"), T.StructType.fromDDL("A int")])


def test_a_folder_without_files(spark):
    assert V.read_versions(spark, tempfile.mkdtemp(prefix="versions-")).collect() == []
