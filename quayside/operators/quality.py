"""Data-quality checks: the schema's constraints as jobs (Q1-Q5, A10).

Each check returns a small DataFrame of findings; the work (grouping,
anti-joins, null counting) runs distributed with map-side partial
aggregation, so only findings travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def check_pk(df: DataFrame, key: list[str], table: str) -> DataFrame:
    """Q1: key values that occur more than once, with their multiplicity."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return g.select(F.lit(table).alias("table_name"),
                    F.to_json(F.struct(*key)).alias("key_value"), "copies")


def check_fk(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str],
             table: str) -> DataFrame:
    """Q2: child rows whose foreign key has no parent (NULL keys are exempt,
    as in SQL)."""
    c = child.select(*fk).dropna()
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(pk, fk)])
    orphans = c.join(p, fk, "left_anti")
    g = orphans.groupBy(*fk).agg(F.count(F.lit(1)).alias("rows"))
    return g.select(F.lit(table).alias("table_name"),
                    F.to_json(F.struct(*fk)).alias("key_value"), "rows")


def check_nulls(df: DataFrame, not_null: list[str], table: str) -> DataFrame:
    """Q3: NULL count of every NOT NULL column, one pass over the table."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows"))
        for c in not_null]))
    return agg.select(stacked.alias("s")).select(
        F.lit(table).alias("table_name"), "s.column_name", "s.null_rows")


def check_domain(df: DataFrame, col: str, allowed: list, table: str) -> DataFrame:
    """Q4: values outside the allowed set (NULLs excluded), with counts."""
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))
    g = bad.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    return g.select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                    F.col(col).cast("string").alias("bad_value"), "rows")


def check_counts(counts: DataFrame, bounds: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Q5/A10: row count of each table against a [low, high] expectation."""
    spark = counts.sparkSession
    b = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in bounds.items()],
                              "table_name string, min_rows long, max_rows long")
    j = counts.join(F.broadcast(b), "table_name", "inner")
    ok = (F.col("row_count") >= F.col("min_rows")) & \
        (F.col("max_rows").isNull() | (F.col("row_count") <= F.col("max_rows")))
    return j.select("table_name", "row_count", "min_rows", "max_rows", ok.alias("ok"))


def not_null(col: str) -> tuple[str, Column]:
    """Rule for ``profile``: rows with a NULL fail."""
    return f"{col} not null", F.col(col).isNull()


def one_of(col: str, allowed: list) -> tuple[str, Column]:
    """Rows with another value fail; NULL passes, as in SQL."""
    return f"{col} allowed", ~F.col(col).isin(*allowed)


def at_least(col: str, low) -> tuple[str, Column]:
    """Rows below ``low`` fail; NULL passes."""
    return f"{col} at least {low}", F.col(col) < F.lit(low)


def _measures(rules: list[tuple[str, Column]]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(bad).alias(f"r{i}") for i, (_, bad) in enumerate(rules)]]


def _findings(measured: DataFrame, table: str, rules: list[tuple[str, Column]], low: int, high: int | None) -> DataFrame:
    """Measures (one row) to a row per rule and one for the number of rows."""
    off = F.greatest(F.lit(low) - F.col("n"), F.col("n") - F.lit(high), F.lit(0)).cast("long")
    rows = [F.struct(F.lit("row count").alias("check_name"), off.alias("failed_rows"))]
    rows += [F.struct(F.lit(name).alias("check_name"), F.col(f"r{i}").cast("long").alias("failed_rows"))
             for i, (name, _) in enumerate(rules)]
    return measured.select("n", F.explode(F.array(*rows)).alias("x")).select(
        F.lit(table).alias("table_name"), "x.check_name", F.col("n").cast("long").alias("checked_rows"),
        "x.failed_rows", (F.col("x.failed_rows") == 0).alias("ok"))


def profile(df: DataFrame, table: str, rules: list[tuple[str, Column]], low: int = 1,
            high: int | None = None) -> DataFrame:
    """Q3-Q5 and A10 in one pass: (table_name, check_name, checked_rows, failed_rows, ok) per rule
    and for the number of rows, whose ``failed_rows`` are those missing from ``low`` or
    beyond ``high``.  One aggregate, combined in each task before its one row travels; an
    empty table fails on its number of rows only."""
    return _findings(df.agg(*_measures(rules)), table, rules, low, high)


def write_checked(df: DataFrame, path: str, table: str, rules: list[tuple[str, Column]], low: int = 1,
                  high: int | None = None) -> DataFrame:
    """Write ``df`` to ``path`` and return the findings of ``profile``, gathered while it is
    written: the rows are read and computed once."""
    seen = Observation()
    df.observe(seen, *_measures(rules)).write.parquet(path)
    values = seen.get
    fields = ["n", *[f"r{i}" for i in range(len(rules))]]
    row = df.sparkSession.createDataFrame([tuple(values[f] for f in fields)], ", ".join(f"{f} long" for f in fields))
    return _findings(row, table, rules, low, high)
