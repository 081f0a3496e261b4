"""Relational base queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import billing as B
from ..operators import relational as R
from ..sources import adapters as A
from ..session import ensure_checkpoint_dir
from ..sources.tables import TABLES
from ..sources.versions import read_versions
from .billing import dup_arm, rate_arm
from .registry import query
from .views_sql import with_views

AS_OF = "2024-01-31"          # events span 2024-01-01 .. 2024-01-30
MOVE_COLS = "move_id, terminal_id, container_id, move_type, event_ts, crane_id, is_rehandle"


@query("point_lookup", with_views(f"SELECT {MOVE_COLS} FROM container_moves WHERE container_id = 8",
                                  "container_moves"))
def point_lookup(t):
    """Container lookup by id (equality pushed to the parquet scan)."""
    return R.point_lookup(A.container_moves(t), "container_id", 8)


@query("recent_activity", with_views(f"""
SELECT {MOVE_COLS} FROM container_moves
WHERE terminal_id = 1 AND event_ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
ORDER BY event_ts DESC, move_id""", "container_moves"))
def recent_activity(t):
    """One terminal's moves in the last 7 days, newest first."""
    m = R.point_lookup(A.container_moves(t), "terminal_id", 1)
    return R.recent(m, "event_ts", AS_OF, 7).orderBy(F.desc("event_ts"), "move_id")


@query("group_count_recent", with_views(f"""
SELECT crane_id, count(*) AS n FROM container_moves
WHERE is_rehandle AND event_ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
GROUP BY crane_id ORDER BY n DESC, crane_id""", "container_moves"))
def group_count_recent(t):
    """P3 + A1: rehandles per crane in the last 30 days, most first."""
    m = A.container_moves(t).filter(F.col("is_rehandle"))
    return R.group_count(R.recent(m, "event_ts", AS_OF, 30), "crane_id")


@query("exclude_window", with_views("""
SELECT txn_id, gate_in_ts, turn_time_minutes FROM gate_transactions
WHERE NOT (CAST(gate_in_ts AS DATE) = DATE '2024-01-14' AND hour(gate_in_ts) BETWEEN 13 AND 18)""",
                                   "gate_transactions"))
def exclude_window(t):
    """Gate transactions outside 13:00-18:59 on 2024-01-14."""
    g = A.gate_transactions(t).select("txn_id", "gate_in_ts", "turn_time_minutes")
    return R.exclude_window(g, "gate_in_ts", "2024-01-14", 13, 18)


@query("ilike_filter", "SELECT doc_id, lang, source FROM documents WHERE lang ILIKE 'EN'")
def ilike_filter(t):
    """Case-insensitive match."""
    return t.documents.select("doc_id", "lang", "source").filter(F.col("lang").ilike("EN"))


@query("latest_log", """
SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def latest_log(t):
    """O3: latest 20 log rows (TakeOrderedAndProject)."""
    return t.events.select("event_id", "ts", "event_type") \
        .orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def table_counts(t):
    """A5 + U2: count(*) of every table, stacked."""
    return R.table_counts({n: getattr(t, n) for n in TABLES})


@query("known_files_semi", """
SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def known_files_semi(t):
    """Documents already known (labelled in an earlier pass): left semi join."""
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id",
                                                        "left_semi")


@query("new_files_anti", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def new_files_anti(t):
    """Documents not yet known: left anti join."""
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id",
                                                        "left_anti")


@query("time_spine", with_views("""
SELECT crane_id, unnest(generate_series(t0, t1, INTERVAL 4 HOUR)) AS slot_ts
FROM (SELECT crane_id, min(ts) AS t0, max(ts) AS t1 FROM crane_telemetry GROUP BY crane_id) g""",
                               "crane_telemetry"))
def time_spine(t):
    """S5 + J7: a 4-hour spine per crane from its first to its last reading."""
    return R.time_spine(A.crane_telemetry(t), "crane_id", "ts", 4)


@query("int_spine", with_views("""
SELECT call_id, unnest(generate_series(1, n_lines)) AS g FROM berth_calls""", "berth_calls"))
def int_spine(t):
    """generate_series(1, n) per berth call, n = its line count."""
    return R.int_spine(A.berth_calls(t), "call_id", "n_lines")


@query("unnest_array", """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
       unnest(embedding) AS value FROM embeddings""")
def unnest_array(t):
    """Array column to rows with position."""
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "value"))


# The reference's background-invoice pick list (move type,
# tariff code, rate), chosen per row by g % 5 with a 1-based subscript.
PICKS = [("discharge", "STD-IMP", 480.00), ("load", "STD-EXP", 540.00),
         ("yard_shift", "REHANDLE", 90.00), ("discharge", "WGT-ADJ", 310.00),
         ("discharge", "DMG-HDL", 275.00)]


def _list_sql(i):
    vals = [repr(p[i]) if isinstance(p[i], str) else f"CAST({p[i]} AS DOUBLE)" for p in PICKS]
    return "[" + ", ".join(vals) + "]"


@query("cyclic_pick", f"""
SELECT o_orderkey, {_list_sql(0)}[1 + CAST(o_orderkey % 5 AS INTEGER)] AS move_type,
       {_list_sql(1)}[1 + CAST(o_orderkey % 5 AS INTEGER)] AS tariff_code,
       {_list_sql(2)}[1 + CAST(o_orderkey % 5 AS INTEGER)] AS rate_usd
FROM orders""")
def cyclic_pick(t):
    """Per-row pick from a fixed list by ``1 + g % n`` (element_at, 1-based)."""
    idx = (F.col("o_orderkey") % len(PICKS)).cast("int") + 1
    arr = [F.array(*[F.lit(p[i]) for p in PICKS]) for i in range(3)]
    return t.orders.select("o_orderkey",
                           F.element_at(arr[0], idx).alias("move_type"),
                           F.element_at(arr[1], idx).alias("tariff_code"),
                           F.element_at(arr[2], idx).cast("double").alias("rate_usd"))


# Event type -> move type mapping used as an inline VALUES relation.
EVENT_MOVES = [("view", "discharge"), ("click", "load"), ("purchase", "yard_shift"),
               ("signup", "gate_in"), ("error", "rehandle")]


@query("inline_values", "SELECT v.move_type, count(*) AS n FROM events e JOIN (VALUES " +
       ", ".join(f"('{a}', '{b}')" for a, b in EVENT_MOVES) +
       ") AS v(event_type, move_type) ON v.event_type = e.event_type GROUP BY v.move_type")
def inline_values(t):
    """S3: an inline VALUES relation joined to the event table."""
    v = t.spark.createDataFrame(EVENT_MOVES, "event_type string, move_type string")
    j = t.events.select("event_type").join(F.broadcast(v), "event_type")
    return j.groupBy("move_type").agg(F.count(F.lit(1)).alias("n"))


@query("status_snapshot", with_views("""
SELECT (SELECT count(*) FROM billing_events) AS invoices,
       (SELECT count(*) FROM billing_events WHERE dispute_flag) AS open_disputes,
       (SELECT count(*) FROM container_moves) AS moves,
       (SELECT count(*) FROM container_moves WHERE is_rehandle) AS rehandles""",
                                    "billing_events", "container_moves"))
def status_snapshot(t):
    """J9 + D25: four counts (two filtered) in one row, as scalar subqueries."""
    be = A.billing_events(t).agg(F.count(F.lit(1)).alias("invoices"),
                                 F.count_if("dispute_flag").alias("open_disputes"))
    m = A.container_moves(t).agg(F.count(F.lit(1)).alias("moves"),
                                 F.count_if("is_rehandle").alias("rehandles"))
    return be.crossJoin(m).select("invoices", "open_disputes", "moves", "rehandles")


def _unfiltered_batch(t):
    be = A.billing_events(t)
    tr = A.tariff_rates(be)
    return be, tr, B.anomaly_union(be, tr, None)


@query("insert_if_absent", with_views(f"""
SELECT invoice_id, anomaly_type, variance_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY anomaly_type, variance_usd DESC) AS rn
  FROM ({rate_arm('undisputed')} UNION ALL {dup_arm('undisputed')}) u) d
WHERE rn = 1 AND invoice_id NOT IN (SELECT invoice_id FROM filed_recommendations)""",
                                     "billing_events", "tariff_rates", "filed_recommendations", "undisputed"))
def insert_if_absent(t):
    """S8 + T7: file new findings, skipping keys already on file (in-batch
    dedup by key, then left anti join against the target)."""
    be, tr, batch = _unfiltered_batch(t)
    batch = batch.select("invoice_id", "anomaly_type", "variance_usd")
    filed = A.filed_recommendations(be)
    return R.insert_if_absent(filed, batch, ["invoice_id"],
                              order=[("anomaly_type", True), ("variance_usd", False)])


@query("seed_if_empty", with_views("""
SELECT 'empty' AS target, terminal_id, tariff_code, rate_cents FROM tariff_rates
WHERE NOT EXISTS (SELECT 1 FROM billing_events WHERE created_ts > TIMESTAMP '2100-01-01')
UNION ALL
SELECT 'filled', terminal_id, tariff_code, rate_cents FROM tariff_rates
WHERE NOT EXISTS (SELECT 1 FROM billing_events)""", "billing_events", "tariff_rates"))
def seed_if_empty(t):
    """The tariff rates seed an empty ledger (no invoice lies in the future) and
    leave a filled one alone."""
    be = A.billing_events(t)
    empty = be.filter(F.col("created_ts") > F.lit("2100-01-01").cast("timestamp_ntz"))
    return R.seed_if_empty(empty, A.tariff_rates(be).select(F.lit("empty").alias("target"), "*")).unionByName(
        R.seed_if_empty(be, A.tariff_rates(be).select(F.lit("filled").alias("target"), "*")))


@query("padded_ids", """
SELECT o_orderkey, 'WO-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS work_order,
       'QC-' || lpad(CAST(o_orderkey % 6 + 1 AS VARCHAR), 2, '0') AS crane FROM orders""")
def padded_ids(t):
    """zero-padded identifiers built from numeric keys."""
    def padded(prefix, c, n):
        return F.concat(F.lit(prefix), F.lpad(c.cast("string"), n, "0"))
    key = F.col("o_orderkey")
    return t.orders.select("o_orderkey", padded("WO-", key, 8).alias("work_order"),
                           padded("QC-", key % 6 + 1, 2).alias("crane"))


@query("assign_ids", with_views("""
SELECT invoice_id, (SELECT max(rec_id) FROM filed_recommendations)
       + row_number() OVER (ORDER BY invoice_id) AS id
FROM (SELECT DISTINCT invoice_id FROM billing_events be
      WHERE NOT EXISTS (SELECT 1 FROM filed_recommendations f WHERE f.invoice_id = be.invoice_id)) n""",
                               "billing_events", "filed_recommendations"))
def assign_ids(t):
    """Dense ids continuing after the largest filed id, in invoice order."""
    be = A.billing_events(t)
    filed = A.filed_recommendations(be)
    new = be.select("invoice_id").join(filed.select("invoice_id"), "invoice_id",
                                       "left_anti").distinct()
    start = filed.agg(F.coalesce(F.max("rec_id"), F.lit(0)).alias("_start"))   # one row
    ids = R.assign_ids(new, ["invoice_id"], start=0)
    return ids.crossJoin(start).select("invoice_id", (F.col("id") + F.col("_start")).alias("id"))


BILLING_EXTRA = T.StructType([
    T.StructField("dispute_category", T.StringType()),
    T.StructField("dispute_risk", T.StringType()),
    T.StructField("dispute_risk_rationale", T.StringType()),
    T.StructField("corrected_usd", T.DoubleType()),
    T.StructField("correction_status", T.StringType()),
])


@query("open_queue", with_views("""
SELECT invoice_id, CAST(amount_cents AS DOUBLE) / 100 AS amount_usd, dispute_reason,
       CAST(NULL AS DOUBLE) AS corrected_usd
FROM billing_triage WHERE dispute_flag AND dispute_category IS NULL""", "billing_triage"))
def open_queue(t):
    """P4 + S13: evolve the schema (add missing columns as typed NULLs), then the work
    queue = flagged disputes with no category yet."""
    be = R.evolve_schema(A.billing_triage(t), BILLING_EXTRA)
    q = be.filter(F.col("dispute_flag") & F.col("dispute_category").isNull())
    return q.select("invoice_id", A.usd("amount_cents").alias("amount_usd"), "dispute_reason", "corrected_usd")


@query("merged_versions", """
SELECT o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS DOUBLE) / CASE WHEN o_orderkey % 3 = 2 THEN 100 ELSE 1 END AS amount,
       CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status,
       CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS priority
FROM orders""")
def merged_versions(t):
    """S13 on files: orders stored in three versions (int, long and decimal amounts; a column
    more each time) and read back as one table."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100)
    first = [key.cast("int").alias("order_id"), cents.cast("int").alias("amount")]
    second = [key.alias("order_id"), cents.cast("bigint").alias("amount"), F.col("o_orderstatus").alias("status")]
    third = [key.alias("order_id"), (cents.cast("decimal(20,0)") / 100).cast("decimal(12,2)").alias("amount"),
             F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")]
    for version, columns in enumerate((first, second, third)):
        t.orders.filter(key % 3 == version).select(*columns).write.parquet(f"{folder}/v{version}")
    return read_versions(t.spark, folder).select(
        "order_id", F.col("amount").cast("double").alias("amount"), "status", "priority")
