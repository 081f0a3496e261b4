"""Functions that SQL statements can call: scalar checks and masks, and the
anomaly scan as a table function.

They are SQL functions of the session (``CREATE TEMPORARY FUNCTION ... RETURN``), so
Catalyst inlines their bodies: no Python, filters and columns reach the scans as with the
DataFrame functions whose twins they are.  Bodies are written here from the same fixed
values; tests compare both forms, NULLs included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import billing as B
from ..operators.joins import MICROS_PER_DAY
from . import text as X


#: A semicolon at the end of a statement.
END = r";\s*$"


def _quoted(pattern: str) -> str:
    """A raw SQL string; the patterns hold no double quote."""
    return f'r"{pattern}"'


def _stars(part: str) -> str:
    return f"concat(left({part}, 1), repeat('*', greatest(length({part}) - 1, 0)))"


def _redaction() -> str:
    body = "body"
    for _, pattern in X.REDACT_PATTERNS:
        body = f"regexp_replace({body}, {_quoted(pattern)}, '{X.REDACTED}')"
    return body


def scalar_functions() -> dict[str, tuple[str, str]]:
    """name -> (signature and return type, body)."""
    first, second, local = "split_part(name, ' ', 1)", "split_part(name, ' ', 2)", "split_part(email, '@', 1)"
    return {
        "mask_customer_contact": (
            "(name STRING, email STRING) RETURNS STRING",
            f"concat({_stars(first)}, ' ', {_stars(second)}, '  <', {_stars(local)}, '@', split_part(email, '@', 2), '>')"),
        "is_safe_select": (
            "(statement STRING) RETURNS BOOLEAN",
            f"NOT contains(statement, ';') AND statement RLIKE {_quoted(X.SAFE_START)} "
            f"AND NOT statement RLIKE {_quoted(X.FORBIDDEN)}"),
        "is_index_ddl": ("(statement STRING) RETURNS BOOLEAN", f"statement RLIKE {_quoted(X.DDL_GUARD)}"),
        "extract_ddl": (
            "(reply STRING) RETURNS STRING",
            f"coalesce(nullif(regexp_extract(reply, {_quoted(X.DDL_EXTRACT)}, 1), ''), trim(reply))"),
        "clean_sql": (
            "(reply STRING) RETURNS STRING",
            f"regexp_replace(trim(regexp_replace(trim(reply), {_quoted(X.FENCE)}, '')), {_quoted(END)}, '')"),
        "redact_pii": ("(body STRING) RETURNS STRING", _redaction()),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the scalar functions in the session; their names."""
    functions = scalar_functions()
    for name, (signature, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    return list(functions)


def register_anomaly_scan(spark: SparkSession, billing: DataFrame, tariffs: DataFrame,
                          filed: DataFrame | None, name: str = "anomaly_scan") -> None:
    """Create the table function ``name(most_rows)`` over the given tables: the rows of
    ``billing_anomaly_scan`` with that limit, in any order.  The session gets the views
    ``<name>_invoices`` and ``<name>_findings``."""
    invoices, findings = f"{name}_invoices", f"{name}_findings"
    billing.select(*B.DUP_KEYS, "invoice_id", "created_ts").createOrReplaceTempView(invoices)
    B.findings(billing, tariffs, filed).createOrReplaceTempView(findings)
    shown = ["invoice_id", "anomaly_type", "amount_cents", "expected_cents", "variance_cents",
             "terminal_id", "tariff_code", "customer_name"]
    types = dict(billing.dtypes)
    out = (f"invoice_id {types['invoice_id']}, anomaly_type STRING, billed_usd DOUBLE, expected_usd DOUBLE, "
           f"variance_usd DOUBLE, terminal_id {types['terminal_id']}, tariff_code {types['tariff_code']}, "
           f"customer_name {types['customer_name']}")
    order = "ORDER BY variance_cents DESC, invoice_id, anomaly_type"
    apart = ("abs(unix_micros(CAST(b.created_ts AS TIMESTAMP)) - unix_micros(CAST(t.created_ts AS TIMESTAMP)))")
    twin = f"(b.invoice_id < t.invoice_id AND {apart} < {B.DUP_WINDOW_DAYS * MICROS_PER_DAY})"
    same_key = " AND ".join(f"b.{k} <=> t.{k}" for k in B.DUP_KEYS)
    listed = ", ".join(f"t.{c}" for c in shown)
    dollars = ", ".join(f"CAST({c}_cents AS DOUBLE) / 100 AS {n}_usd" for c, n in (
        ("amount", "billed"), ("expected", "expected"), ("variance", "variance")))
    # the place of a row becomes a top-k, as no rows are grouped before it
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(most_rows INT) RETURNS TABLE({out}) RETURN
WITH top AS (
  SELECT * FROM (SELECT f.*, row_number() OVER ({order}) AS place FROM {findings} f) WHERE place <= most_rows),
counted AS (
  SELECT /*+ BROADCAST(t) */ {listed}, count_if{twin} AS twins
  FROM {invoices} b JOIN top t ON {same_key} AND ({twin} OR b.invoice_id = t.invoice_id)
  GROUP BY {listed}),
repeated AS (
  SELECT c.*, explode(sequence(1L, CASE WHEN anomaly_type = 'duplicate_charge' THEN twins ELSE 1L END)) AS copy
  FROM counted c),
numbered AS (SELECT r.*, row_number() OVER ({order}) AS place FROM repeated r)
SELECT invoice_id, anomaly_type, {dollars}, terminal_id, tariff_code, customer_name
FROM numbered WHERE place <= most_rows""")
