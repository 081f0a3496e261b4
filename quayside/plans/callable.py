"""Queries in SQL text that call the functions of ``functions.catalog``.  Each
has the SQL twin of the DataFrame query of the same rows."""

from __future__ import annotations

from ..functions import catalog as C
from . import governance
from .billing import _base
from .registry import REGISTRY, query


@query("sql_anomaly_scan", REGISTRY["billing_anomaly_scan"].oracle)
def sql_anomaly_scan(t):
    """D3 as a table function: what a user of SQL calls."""
    C.register_anomaly_scan(t.spark, *_base(t))
    return t.spark.sql("SELECT * FROM anomaly_scan(10)")


@query("sql_mask_contact", REGISTRY["mask_contact"].oracle)
def sql_mask_contact(t):
    """D12 called from SQL, over every customer and part."""
    C.register_functions(t.spark)
    t.customer.createOrReplaceTempView("contact_customers")
    t.part.createOrReplaceTempView("contact_parts")
    return t.spark.sql("""
SELECT 'customer' AS source, c_custkey AS id,
       mask_customer_contact(c_name, lower(replace(c_name, '#', '.')) || '@example.com') AS masked
FROM contact_customers
UNION ALL
SELECT 'part', p_partkey, mask_customer_contact(p_name, lower(replace(p_name, ' ', '.')) || '@parts.example')
FROM contact_parts""")


@query("sql_statement_checks", REGISTRY["statement_checks"].oracle)
def sql_statement_checks(t):
    """G1, P9, P10, D18, F4, F5 called from SQL, over statements of every form."""
    C.register_functions(t.spark)
    governance.raw_statements(t).createOrReplaceTempView("raw_statements")
    return t.spark.sql("""
SELECT id, clean_sql(raw) AS clean, is_safe_select(clean_sql(raw)) AS is_safe,
       is_index_ddl(extract_ddl(raw)) OR extract_ddl(raw) <> trim(raw) AS has_ddl,
       extract_ddl(raw) AS ddl, is_index_ddl(extract_ddl(raw)) AS is_index_ddl
FROM raw_statements""")


@query("sql_redact_pii", REGISTRY["redact_pii"].oracle)
def sql_redact_pii(t):
    """D14 (patterns) called from SQL, over whole texts."""
    C.register_functions(t.spark)
    t.documents.select("doc_id", "text").createOrReplaceTempView("texts_to_redact")
    return t.spark.sql("SELECT doc_id, redact_pii(text) AS redacted FROM texts_to_redact")
