"""Query watchlist and tuning (D17, D19, D20, O2): measured plans ranked,
before/after benefit, and a layout advisor in place of index advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXEC_TIME, pg_substring


def exec_ms(plan_text: str = "plan_text"):
    """execution time parsed from a plan text; NULL when absent."""
    return pg_substring(plan_text, EXEC_TIME).cast("double")


def rank_watchlist(log: DataFrame, top: int = 3) -> DataFrame:
    """D17 + O2: per watched query, runs and mean/max time parsed from the
    plan text; the ``top`` slowest by mean are flagged.  The top-k is a
    TakeOrderedAndProject over the aggregated rows joined back, so no
    global single-partition window is needed."""
    m = log.withColumn("_ms", exec_ms())
    agg = m.groupBy("label").agg(F.count(F.lit(1)).alias("runs"),
                                 F.round(F.avg("_ms"), 3).alias("avg_ms"),
                                 F.max("_ms").alias("max_ms"))
    worst = agg.orderBy(F.desc("avg_ms"), "label").limit(top).select(
        "label", F.lit(True).alias("_w"))
    return agg.join(worst, "label", "left").select(
        "label", "runs", "avg_ms", "max_ms", F.coalesce("_w", F.lit(False)).alias("is_worst"))


def tuning_benefit(before: DataFrame, after: DataFrame) -> DataFrame:
    """D19 + F21: mean time before and after a change, and the improvement
    in percent (one decimal; NULL when the before time is 0)."""
    b = before.groupBy("label").agg(F.round(F.avg("ms"), 3).alias("before_ms"))
    a = after.groupBy("label").agg(F.round(F.avg("ms"), 3).alias("after_ms"))
    j = b.join(a, "label", "inner")
    pct = F.when(F.col("before_ms") > 0, F.round(
        (F.col("before_ms") - F.col("after_ms")) / F.col("before_ms") * 100, 1))
    return j.select("label", "before_ms", "after_ms", pct.alias("improvement_pct"))


def layout_advice(fact: DataFrame, filter_cols: list[str]) -> DataFrame:
    """For each column the watched queries filter on, its approximate
    distinct count (HLL, one pass, partial aggregation) and the expected
    selectivity of an equality filter; the most selective column is the
    suggested partition/sort key.  One row per column."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_rows")] + [F.approx_count_distinct(c, 0.02).alias(c) for c in filter_cols]
    row = fact.agg(*aggs).select("_rows", F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("approx_distinct")) for c in filter_cols]).alias("s"))
    most = F.array_max(F.transform("s", lambda x: x["approx_distinct"]))
    best = F.array_min(F.transform(F.filter("s", lambda x: x["approx_distinct"] == most), lambda x: x["column_name"]))
    return row.select("_rows", best.alias("_best"), F.explode("s").alias("s")).select(
        "s.column_name", "s.approx_distinct", F.col("_rows").alias("rows"),
        (F.lit(1.0) / F.col("s.approx_distinct")).alias("eq_selectivity"),
        F.when(F.col("s.column_name") == F.col("_best"), "sort and bucket by this column").otherwise("keep")
        .alias("advice"))


def rewrite_clustered(fact: DataFrame, column: str, out_path: str, files: int) -> None:
    """D20 approve step: write a copy range-clustered on the advised column,
    so min/max statistics let equality filters skip files."""
    (fact.repartitionByRange(files, column).sortWithinPartitions(column)
     .write.mode("overwrite").parquet(out_path))


def compare_layouts(spark, before_path: str, after_path: str, column: str, value) -> DataFrame:
    """D20 after approval: what an equality filter has to read on the old and on the
    clustered copy, if files without the value are skipped.  One row per layout: files
    with a match of all files, and the rows in them."""
    parts = []
    for name, path in (("before", before_path), ("after", after_path)):
        files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(column) == F.lit(value)).alias("hits"))
        hit = F.col("hits") > 0
        parts.append(files.agg(
            F.lit(name).alias("layout"), F.count_if(hit).alias("files_read"), F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("rows_read"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias("rows_found")))
    return parts[0].unionByName(parts[1])
