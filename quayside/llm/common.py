"""Shared pieces of the pipeline operators: word pattern, stored tables, files."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Separators between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"

#: Texts differ in length by orders of magnitude: Arrow batches are bounded by bytes.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # operators work in steps with stored tables between them: a step's shuffle files are
    # of no use once its table is written
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    """Settings that every operator of this subpackage counts on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, v in BATCH_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, fixes
    row order and ids, and outlives lost executors."""
    path = f"{folder}/{name}" if folder else shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, folder: str | None = None) -> DataFrame:
    """Like ``stored``, in buckets of ``key``: later joins on it do not shuffle this side.
    The catalog's entry is dropped at once; the files stay."""
    spark = df.sparkSession
    entry = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(partitions(spark), key).option("compression", "zstd") \
        .option("path", f"{folder}/{name}" if folder else shared_folder(spark, name)).saveAsTable(entry)
    table_ = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return table_


@contextmanager
def temporary(spark: SparkSession, name: str):
    """A folder for tables that one step alone needs; it is gone after the step, so the
    step's result must be stored elsewhere before."""
    folder = shared_folder(spark, name)
    yield folder
    fs, path = open_fs(folder)
    fs.delete_dir_contents(path, missing_dir_ok=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text as an array; none for NULL."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    return found


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; NULL ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0).cast("long"))


def open_fs(uri: str):
    """(file system, path) of a folder or file named by URI or absolute path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)
