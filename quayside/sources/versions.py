"""S13 on stored files: one read of Parquet files whose schemas differ by version.

Columns that a file lacks are NULL in its rows.  A type may grow from version to version
(narrow to wide integers, float to double, integers to double or decimal, date to
timestamp, decimals to more digits, inside structs and arrays too); the read takes the
widest and Spark's scan widens each file's values, so there is a single scan, with
pruning and filters pushed down.  Types that cannot be widened without loss raise.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits that the values of an integer type need (fixed values of the type sizes).
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}
INTEGERS = list(DIGITS)


def widest(a: T.DataType, b: T.DataType, where: str = "") -> T.DataType:
    """The narrower of all types that hold both without loss; ValueError if there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged([a, b], where)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType, f"{where}[]"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, widest(a.valueType, b.valueType, f"{where}{{}}"))
    x, y = a.simpleString(), b.simpleString()
    if x in INTEGERS and y in INTEGERS:
        return max((a, b), key=lambda t: INTEGERS.index(t.simpleString()))
    names = {x, y}
    if names == {"float", "double"} or ("double" in names and names & set(INTEGERS[:3])):
        return T.DoubleType()
    if names == {"date", "timestamp_ntz"}:
        return T.TimestampNTZType()
    sizes = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (DIGITS[n], 0)
             for t, n in ((a, x), (b, y)) if isinstance(t, T.DecimalType) or n in DIGITS]
    if len(sizes) == 2:
        whole, scale = max(s[0] for s in sizes), max(s[1] for s in sizes)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    raise ValueError(f"column {where}: no common type for {x} and {y}")


def merged(schemas: list[T.StructType], where: str = "") -> T.StructType:
    """All columns of the schemas, first seen first, each with its widest type and nullable.
    Names that differ in case only raise."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            name = f"{where}.{f.name}" if where else f.name
            types[f.name] = widest(types[f.name], f.dataType, name) if f.name in types else f.dataType
    if len({n.lower() for n in types}) < len(types):
        raise ValueError(f"column names differ in case only: {sorted(types)}")
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def _schema_of(path: str) -> str:
    """JSON of a file's Spark schema, from its footer."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_schema

    store, name = fs.FileSystem.from_uri(path)
    found = pq.read_schema(name, filesystem=store)
    own = (found.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    return own.decode() if own else from_arrow_schema(found.remove_metadata()).json()


def file_schemas(spark: SparkSession, *paths: str) -> list[T.StructType]:
    """The different schemas of the Parquet files in ``paths``, most frequent last.  Footers are
    read in tasks; only different schemas, of which there is one a version, are collected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.parquet").load(list(paths)).select("path")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"schema": [_schema_of(p) for p in pdf["path"]]})

    found = files.mapInPandas(footers, "schema string").groupBy("schema").agg(F.count(F.lit(1)).alias("files"))
    return [T.StructType.fromJson(json.loads(r["schema"])) for r in found.orderBy("files", "schema").collect()]


def read_versions(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of all Parquet files in ``paths``, under the merged schema.  Columns are in
    order of name, as versions have none.  No file: an empty DataFrame without columns."""
    schema = merged(file_schemas(spark, *paths))
    schema = T.StructType(sorted(schema.fields, key=lambda f: f.name))
    if not schema.fields:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
