"""Operators as pipeline stages: each takes documents and returns documents.

Rows get a number of their own first (their place in the stored table), so that NULL or
repeated ids need no care: a decision always concerns one row.  The numbers are the same
each time the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import host_rules, line_join, signature_trees, spaced_seeds


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    name = fresh_name(docs, "_row")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def without(docs: DataFrame, rows: DataFrame, number: str) -> DataFrame:
    """``docs`` less the numbered ``rows``, with the columns it had."""
    return docs.join(rows.select(F.col(rows.columns[0]).alias(number)).distinct(), number,
                     "left_anti").drop(number)


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    rows, number = numbered(docs)
    return without(rows, host_rules.judge(rows, doc_id=number).filter(~F.col("kept")).select("doc_id"), number)


def drop_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that repeat an earlier line (of the table's rows in
    order); a document goes if it loses every line with a word."""
    rows, number = numbered(docs)
    lost = fresh_name(rows, "_lost")
    cuts = line_join.cut_lines(rows, doc_id=number).select(
        F.col("doc").alias(number), F.struct("dropped", "some_left").alias(lost))
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{lost}.dropped"))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = rows.join(cuts, number, "left").filter(F.col(lost).isNull() | F.col(f"{lost}.some_left")) \
        .withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def one_of_each_group(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Of each group of documents linked by similar n-grams, that with the smallest id."""
    rows, number = numbered(docs)
    groups = signature_trees.similar_groups(rows, size, num, den, doc_id=number).select(
        F.col("doc_id").alias("r"), F.col("component_id").alias("g"))
    ids = rows.select(F.col(number).alias("r"), F.col("doc_id").alias("i"))
    first = groups.join(ids, "r").groupBy("g").agg(
        F.min(F.struct(F.col("i").isNull().alias("x"), "i", "r")).alias("first"))
    stays = first.select(F.col("first.r").alias("r"))
    return without(rows, groups.select("r").join(stays, "r", "left_anti"), number)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows, number = numbered(docs)
    return without(rows, spaced_seeds.contaminated(rows, benchmark, doc_id=number).select("doc_id"), number)
