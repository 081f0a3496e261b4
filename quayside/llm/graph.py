"""Joins that no key can overload, and connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SALTS = 16


def join_stored(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join many rows per key (``left``) with one row per key (``right``).  The right side
    is stored first: both sides then come from an exchange of their own, and adaptive
    execution can split the rows of a frequent key over tasks."""
    return left.join(stored(right, "join-side"), key, how)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join many rows per key (``left``) with one row per key (``right``): the left rows of
    a key are dealt over ``salts`` by the column ``spread``, the right row goes to each."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: label is the smallest node that
    can be reached.  Alternates large-star and small-star steps (each node passes its
    smallest neighbour on) on stored edge tables until nothing changes."""

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())

    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .filter("u <> v").distinct(), name)
    before = state(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = salted_join(both.filter("v > u"), smallest, "u", "v") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").filter("v <> m") \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
