"""Data-quality queries (Q1-Q5, A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import relational as R
from ..sources import adapters as A
from ..sources.tables import TABLES
from .registry import query
from .views_sql import with_views

PKS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
       "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"),
       ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
       ("orders", "o_custkey", "customer", "c_custkey"),
       ("customer", "c_nationkey", "nation", "n_nationkey"),
       ("labels", "doc_id", "documents", "doc_id"),
       # broken on purpose: not every document carries a label, not every part has a document
       ("documents", "doc_id", "labels", "doc_id"),
       ("part", "p_partkey", "documents", "doc_id")]
NOT_NULL = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                       "o_orderdate", "o_orderpriority"],
            "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                         "l_quantity", "l_shipdate"],
            "events": ["event_id", "ts", "user_id", "event_type", "value"]}
# Allowed values of the enum-like columns.
DOMAINS = [("orders", "o_orderstatus", ["F", "O", "P"]),
           ("orders", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM",
                                          "4-NOT SPECIFIED", "5-LOW"]),
           ("events", "event_type", ["view", "click", "purchase", "signup", "error"]),
           ("labels", "quality", [0, 1]),
           ("conversations", "role", ["system", "user", "assistant"]),
           # broken on purpose: events that are no container move, documents in other languages
           ("events", "event_type", ["view", "click", "purchase", "signup"]),
           ("documents", "lang", ["en", "de"])]
# Row-count expectations: fixed dimensions exactly, the rest at least one row.
BOUNDS = {n: (1, None) for n in TABLES}
BOUNDS.update({"region": (5, 5), "nation": (25, 25)})


def _key_str(cols, alias=""):
    return "concat_ws('|', " + ", ".join(f"CAST({alias}{c} AS VARCHAR)" for c in cols) + ")"


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_pk", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, {_key_str(k)} AS key_value, count(*) AS copies "
    f"FROM {tb} GROUP BY {', '.join(k)} HAVING count(*) > 1" for tb, k in PKS.items()))
def dq_pk(t):
    """Q1: primary-key duplicates (lineitem's (orderkey, linenumber) has many)."""
    parts = []
    for tb, k in PKS.items():
        r = Q.check_pk(getattr(t, tb), k, tb)
        parts.append(r.withColumn("key_value", F.concat_ws(
            "|", *[F.get_json_object("key_value", f"$.{c}") for c in k])))
    return _union(parts)


@query("dq_fk", " UNION ALL ".join(
    f"SELECT '{c}' AS table_name, CAST({fk} AS VARCHAR) AS key_value, count(*) AS rows "
    f"FROM {c} WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pk} = {c}.{fk}) "
    f"GROUP BY {fk}" for c, fk, p, pk in FKS))
def dq_fk(t):
    """Q2: orphan foreign keys per relationship."""
    parts = []
    for c, fk, p, pk in FKS:
        r = Q.check_fk(getattr(t, c), [fk], getattr(t, p), [pk], c)
        parts.append(r.withColumn("key_value", F.get_json_object("key_value", f"$.{fk}")))
    return _union(parts)


@query("dq_nulls", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_rows FROM {tb}"
    for tb, cols in NOT_NULL.items() for c in cols))
def dq_nulls(t):
    """Q3: NULLs in NOT NULL columns, one pass per table."""
    return _union([Q.check_nulls(getattr(t, tb), cols, tb) for tb, cols in NOT_NULL.items()])


def _dom_sql(tb, c, allowed):
    vals = ", ".join(repr(v) if isinstance(v, str) else str(v) for v in allowed)
    return (f"SELECT '{tb}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS bad_value, "
            f"count(*) AS rows FROM {tb} WHERE {c} IS NOT NULL AND {c} NOT IN ({vals}) GROUP BY {c}")


@query("dq_domain", " UNION ALL ".join(_dom_sql(*d) for d in DOMAINS))
def dq_domain(t):
    """Q4: values outside the allowed sets."""
    return _union([Q.check_domain(getattr(t, tb), c, allowed, tb) for tb, c, allowed in DOMAINS])


@query("dq_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST({BOUNDS[n][0]} AS BIGINT) AS min_rows, "
    f"CAST({BOUNDS[n][1] if BOUNDS[n][1] is not None else 'NULL'} AS BIGINT) AS max_rows, "
    f"count(*) >= {BOUNDS[n][0]}" + (f" AND count(*) <= {BOUNDS[n][1]}" if BOUNDS[n][1] else "") +
    f" AS ok FROM {n}" for n in TABLES))
def dq_row_counts(t):
    """Q5 + A10: every table's row count against its expectation."""
    counts = R.table_counts({n: getattr(t, n) for n in TABLES})
    return Q.check_counts(counts, BOUNDS)


# table, (rule, column, argument), least and most rows.  Some rules are broken on purpose: undisputed
# invoices have no reason, small charges exist, moves have more types, and there are 25 nations.
PROFILE = [
    ("orders", [("null", "o_orderkey", None), ("null", "o_orderdate", None), ("in", "o_orderstatus", ["F", "O", "P"]),
                ("low", "o_totalprice", 0)], 1, None),
    ("billing_events", [("null", "invoice_id", None), ("null", "dispute_reason", None),
                        ("in", "tariff_code", ["1-URGENT", "2-HIGH"]), ("low", "amount_cents", 5000000)], 1, None),
    ("events", [("null", "ts", None), ("in", "event_type", ["view", "click", "purchase", "signup"]),
                ("low", "value", 0)], 1, None),
    ("region", [("null", "r_name", None)], 5, 5),
    ("nation", [("null", "n_name", None)], 1, 20),
    ("supplier", [("null", "s_name", None)], 1000000000, None),
]


def _profile_sql(table, rules, low, high):
    failing = {"null": lambda c, a: f"{c} IS NULL", "in": lambda c, a: f"{c} NOT IN ({', '.join(repr(v) for v in a)})",
               "low": lambda c, a: f"{c} < {a}"}
    label = {"null": "{} not null", "in": "{} allowed", "low": "{} at least {}"}
    rows = [("row count", f"greatest({low} - count(*), " + (f"count(*) - {high}, " if high is not None else "") + "0)")]
    rows += [(label[r].format(c, a), f"count(*) FILTER (WHERE {failing[r](c, a)})") for r, c, a in rules]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, count(*) AS checked_rows, "
        f"CAST({n} AS BIGINT) AS failed_rows, {n} = 0 AS ok FROM {table}" for name, n in rows)


@query("dq_profile", with_views(" UNION ALL ".join(_profile_sql(*p) for p in PROFILE), "billing_events"))
def dq_profile(t):
    """Q3-Q5 and A10 with both outcomes: all rules of a table in one pass over it."""
    rule = {"null": lambda c, a: Q.not_null(c), "in": Q.one_of, "low": Q.at_least}
    source = {"billing_events": lambda: A.billing_events(t)}
    return _union([Q.profile(source.get(name, lambda n=name: getattr(t, n))(), name,
                             [rule[r](c, a) for r, c, a in rules], low, high)
                   for name, rules, low, high in PROFILE])
