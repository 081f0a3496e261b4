"""Generic relational operators: lookups, recency filters, grouped counts,
spines, keyed inserts and updates, deterministic ids, schema evolution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ts_lit(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def point_lookup(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter; shows up as ``EqualTo`` in the scan's PushedFilters."""
    return df.filter(F.col(col) == F.lit(value))


def recent(df: DataFrame, ts_col: str, as_of: str, days: int) -> DataFrame:
    """Rows in the ``days`` before ``as_of`` (exclusive lower bound).
    ``now()`` becomes an explicit ``as_of`` so results are repeatable."""
    return df.filter(F.col(ts_col) > ts_lit(as_of) - F.make_dt_interval(F.lit(days)))


def group_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """A1: count per key, largest first, key as tie-break."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)


def exclude_window(df: DataFrame, ts_col: str, day: str, h_from: int, h_to: int) -> DataFrame:
    """Drop rows on ``day`` whose hour lies in [h_from, h_to] (both inclusive)."""
    inside = (F.to_date(F.col(ts_col)) == F.lit(day).cast("date")) & \
        F.hour(F.col(ts_col)).between(h_from, h_to)
    return df.filter(~inside)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: list[str],
                     order: list | None = None) -> DataFrame:
    """S8 ``ON CONFLICT DO NOTHING``: rows of ``batch`` to append.  In-batch
    duplicates keep the first row by ``order`` (column names, ascending, or
    ``(name, ascending)`` pairs; descending only for numeric columns; by
    default all non-key columns ascending), and keys already in ``target``
    are dropped with a left-anti join.  The pick is a grouped ``min_by``,
    aggregated partially before the shuffle, so a key with a huge number of
    copies never sits in one sort."""
    spec = [(o, True) if isinstance(o, str) else tuple(o)
            for o in (order or [c for c in batch.columns if c not in key])]
    rank = F.struct(*[(F.col(c) if asc else -F.col(c)).alias(f"_o{i}")
                      for i, (c, asc) in enumerate(spec)])
    row = F.struct(*[c for c in batch.columns if c not in key])
    first = batch.groupBy(*key).agg(F.min_by(row, rank).alias("_r")).select(*key, "_r.*")
    return first.select(*batch.columns).join(target.select(*key), key, "left_anti")


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """``INSERT ... WHERE NOT EXISTS (SELECT 1 FROM target)``: the seed
    rows when the target has no rows at all, else nothing.  The existence
    test is a one-row aggregate (``limit 1`` on the target), not a count."""
    probe = target.select(F.lit(1).alias("_one")).limit(1)
    return seed.join(probe, how="left_anti", on=F.lit(True))


def apply_updates(base: DataFrame, changes: DataFrame, key: list[str],
                  cols: list[str]) -> DataFrame:
    """S10 ``UPDATE ... SET ... WHERE``: a new snapshot where rows matched in
    ``changes`` take the changed values of ``cols``; other rows are kept.
    ``changes`` must be unique on ``key``."""
    ch = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols],
                        F.lit(True).alias("_hit"))
    j = base.join(ch, key, "left")
    out = j
    for c in cols:
        newc = F.when(F.col("_hit"), F.col(f"_new_{c}"))
        out = out.withColumn(c, newc.otherwise(F.col(c)) if c in base.columns else newc)
    return out.drop("_hit", *[f"_new_{c}" for c in cols])


def evolve_schema(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """S13 ``ADD COLUMN IF NOT EXISTS``: add missing columns as typed NULLs."""
    out = df
    for f in wanted.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def _local_index(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = 0
    for pdf in batches:
        n = len(pdf)
        pdf = pdf.assign(_local=range(seen, seen + n))
        seen += n
        yield pdf


def assign_ids(df: DataFrame, order_cols: list[str], start: int = 0,
               name: str = "id", partitions: int | None = None) -> DataFrame:
    """Dense, deterministic ids ``start+1, start+2, ...`` in the order of
    ``order_cols`` (which must be unique), without funnelling all rows into
    one task.  Rows are range-partitioned and sorted; every partition numbers
    its own rows (Arrow batches, no shuffle); partition sizes become offsets
    through a tiny prefix sum joined back by partition id.  The numbered rows are
    checkpointed, so rows and sizes come from one sampling of the range bounds."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    s = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    s = s.withColumn("_part", F.spark_partition_id())
    schema = T.StructType(s.schema.fields + [T.StructField("_local", T.LongType(), False)])
    numbered = s.mapInPandas(_local_index, schema).checkpoint()
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_off"))
    out = numbered.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.lit(start) + F.col("_off") + F.col("_local") + 1) \
        .drop("_part", "_local", "_off")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One ``count(*)`` row per table, stacked with UNION ALL."""
    parts = [df.select(F.lit(name).alias("table_name"),
                       F.lit(1).alias("_one")).groupBy("table_name")
             .agg(F.count("_one").alias("row_count")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows_to_json(df: DataFrame) -> DataFrame:
    """The whole (bounded) result as one JSON array of row objects,
    NULL fields kept, ``[]`` when empty, plus its length.  Only for results
    already bounded by a limit: it builds one row."""
    packed = df.select(F.struct(*df.columns).alias("r")).agg(F.collect_list("r").alias("rows"))
    js = F.to_json(F.col("rows"), {"ignoreNullFields": "false"})
    return packed.select(js.alias("result_json"),
                         F.json_array_length(js).alias("row_count"))


def time_spine(df: DataFrame, key: str, ts_col: str, step_hours: int) -> DataFrame:
    """S5 + J7: per key, every ``step_hours`` from its first to its last
    reading, end inclusive (``explode(sequence(...))``)."""
    g = df.groupBy(key).agg(F.min(ts_col).alias("t0"), F.max(ts_col).alias("t1"))
    seq = F.sequence(F.col("t0"), F.col("t1"), F.make_dt_interval(F.lit(0), F.lit(step_hours)))
    return g.select(key, F.explode(seq).alias("slot_ts"))


def int_spine(df: DataFrame, key: str, n_col: str) -> DataFrame:
    """``generate_series(1, n)`` per row."""
    return df.select(key, F.explode(F.sequence(F.lit(1), F.col(n_col))).alias("g"))
