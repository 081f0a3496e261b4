"""Base-table scan (S2): one parquet dataset per table.

Pruning and pushdown are left to Catalyst: every operator selects only the
columns it needs, so the scan's ``ReadSchema`` stays narrow and equality /
range filters show up as ``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``Tables(spark, d).orders`` reads ``d/orders.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def view(self, name: str, build, shared: bool = False) -> DataFrame:
        """Memoised adapter view: built once per query; ``shared`` views
        (read by several branches of one plan) are also materialised."""
        if name not in self._views:
            df = build()
            self._views[name] = materialize(df) if shared else df
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = load(self.spark, self.sf_dir, name)
        return self._cache[name]


SPREAD_CONF = "quayside.spread.tasks"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out before CPU-heavy per-row work (chunking, embedding, parsing) into as
    many tasks as the setting ``quayside.spread.tasks`` says: a text table stored in few
    large row groups scans as few partitions.  0 leaves the scan's partitions as they are,
    which is right for tables of many files; the default is two tasks per core."""
    tasks = int(df.sparkSession.conf.get(SPREAD_CONF, "-1"))
    if tasks < 0:
        tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if tasks else df


MATERIALIZE_CONF = "quayside.materialize"


def materialize(df: DataFrame) -> DataFrame:
    """Compute a DataFrame that several branches of one plan reuse only once.

    ``quayside.materialize`` selects how: ``checkpoint`` writes it to the
    shared ``spark.checkpoint.dir`` (cuts lineage, survives executor loss),
    ``cache`` keeps it in executor memory/disk (recomputed from lineage if an
    executor is lost), ``none`` leaves the plan as is.
    """
    mode = df.sparkSession.conf.get(MATERIALIZE_CONF, "none")
    if mode == "checkpoint":
        return df.checkpoint(eager=True)
    if mode == "cache":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
