"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (all timestamps are instants
# stored in UTC), ANSI semantics (casts of '' and overflows raise instead of
# silently producing NULL), adaptive execution for runtime re-planning
# (coalescing, skew splitting, size-checked broadcast of shuffled stages).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # text UDFs move whole documents: bound Arrow batches by bytes, not only rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "quayside",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the project defaults.

    ``master`` is only set for local runs; on a cluster the launcher
    supplies it.  ``shuffle_partitions`` should be sized so one shuffle
    partition stays around 128-256 MB at the target scale.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in conf.items():
        if not k.startswith(("spark.driver.", "spark.ui.")):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a reused session
                pass
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``quayside`` importable in the Python workers of a local session
    (pandas UDFs and ``mapInPandas`` functions are pickled by reference to
    their module): zip the package's sources once per SparkContext and
    ``addPyFile`` it.  On a cluster the package is shipped at submit time
    (``--py-files quayside.zip`` or installed on the executors) instead."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_quayside_shipped", False) or not sc.master.startswith("local"):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="quayside-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    sc._quayside_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone.
    Only when it is unset (local tests) a scratch folder is created.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="quayside-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
