"""Join building blocks shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (session
    zone is UTC, so the NTZ value is read as a UTC instant)."""
    return F.unix_micros(ts.cast("timestamp"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str],
              left_ts: str, right_ts: str, width_micros: int,
              extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` plus ``|right_ts - left_ts| < width``.

    The time axis is cut into buckets of ``width``; the left side is copied
    into its own and both neighbouring buckets, and the bucket joins as one
    more equi key.  A key with many rows spread over time is therefore split
    over many join partitions instead of comparing every pair of its rows,
    and only rows at most two buckets apart are ever compared.  Columns of
    the two sides must not collide (alias them first).
    """
    lb = F.floor(epoch_micros(F.col(left_ts)) / F.lit(width_micros)).cast("bigint")
    rb = F.floor(epoch_micros(F.col(right_ts)) / F.lit(width_micros)).cast("bigint")
    l2 = left.withColumn("_band", F.explode(F.array(lb - 1, lb, lb + 1)))
    r2 = right.withColumn("_band_r", rb)
    lk = [f"_lk_{k}" for k in keys]
    for k, a in zip(keys, lk):
        l2 = l2.withColumnRenamed(k, a) if k in l2.columns else l2
    cond = [F.col(a) == F.col(k) for a, k in zip(lk, keys)]
    cond.append(F.col("_band") == F.col("_band_r"))
    lm, rm = epoch_micros(F.col(left_ts)), epoch_micros(F.col(right_ts))
    cond.append(F.abs(rm - lm) < F.lit(width_micros))
    if extra is not None:
        cond.append(extra)
    c = cond[0]
    for x in cond[1:]:
        c = c & x
    return l2.join(r2, c, how).drop("_band", "_band_r", *lk)


def first_in_window(rows: DataFrame, keys: list[str], ts: str, value: str,
                    width_micros: int) -> DataFrame:
    """For every instant of a key (``keys``, ``_at`` in microseconds) that has a row with a
    larger ``value``: ``_first``, the smallest ``value`` of the key's rows less than
    ``width`` away, found without pairs.

    Rows of one instant become one row before the shuffle.  Time is cut into bands of
    ``width``: what is less than ``width`` away from an instant at offset o of its band is
    the whole band, the next band up to o and the band before from o on (both without o
    itself).  So each instant goes to its own band as data and to both neighbours as a
    probe, and one running minimum in each direction of time answers all three.  The
    work grows with n log n of the instants of a key and band, however dense they are.
    Rows with a NULL key, time or value take no part.
    """
    known = F.col(ts).isNotNull() & F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    instants = rows.filter(known).groupBy(*keys, epoch_micros(F.col(ts)).alias("_at")).agg(
        F.min(value).alias("_v"), F.max(value).alias("_largest"))
    offset = F.pmod(F.col("_at"), F.lit(width_micros))
    start = F.col("_at") - offset
    none = F.lit(None).cast(dict(instants.dtypes)["_v"])

    def seen(side: int, v: Column, largest: Column) -> Column:
        return F.struct((start + side * width_micros).alias("band"), F.lit(side).alias("side"),
                        v.alias("v"), largest.alias("_largest"))

    events = instants.select(*keys, "_at", offset.alias("_offset"), F.inline(F.array(
        seen(-1, none, none), seen(0, F.col("_v"), F.col("_largest")), seen(1, none, none))))
    band = Window.partitionBy(*keys, "band")
    probes_first = F.col("side") == 0
    so_far = (Window.unboundedPreceding, Window.currentRow)
    before = F.min("v").over(band.orderBy("_offset", probes_first).rowsBetween(*so_far))
    behind = F.min("v").over(band.orderBy(F.desc("_offset"), probes_first).rowsBetween(*so_far))
    near = F.when(F.col("side") == 0, F.least(before, behind)).when(F.col("side") == 1, before).otherwise(behind)
    return events.select(*keys, "_at", near.alias("_near"), "_largest").groupBy(*keys, "_at").agg(
        F.min("_near").alias("_first"), F.max("_largest").alias("_largest")) \
        .filter(F.col("_first") < F.col("_largest")).drop("_largest")
