"""Watchlist and tuning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import watchlist as W
from ..session import ensure_checkpoint_dir
from ..sources import adapters as A
from .registry import query


LAYOUT_FILES = 16

QUERY_LOG_SQL = """
SELECT event_id AS run_id, ts AS run_ts, event_type AS label,
       'Seq Scan on container_moves (actual rows=' || CAST(user_id AS VARCHAR) || ')' || chr(10)
       || 'Execution Time: ' || printf('%.2f', value) || ' ms' AS plan_text
FROM events"""
EXEC = "CAST(nullif(regexp_extract(plan_text, 'Execution Time:\\s*([0-9.]+) ms', 1), '') AS DOUBLE)"


def query_log(t):
    """Query-log table: one measured run per event; the watched query is the
    event type, its plan text carries the measured time."""
    return t.events.select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"),
        F.col("event_type").alias("label"),
        F.concat(F.lit("Seq Scan on container_moves (actual rows="),
                 F.col("user_id").cast("string"), F.lit(")\nExecution Time: "),
                 F.format_string("%.2f", F.col("value")), F.lit(" ms")).alias("plan_text"))


@query("watchlist_ranked", f"""
WITH ql AS ({QUERY_LOG_SQL}),
agg AS (SELECT label, count(*) AS runs, round(avg({EXEC}), 3) AS avg_ms, max({EXEC}) AS max_ms
        FROM ql GROUP BY label)
SELECT label, runs, avg_ms, max_ms,
       label IN (SELECT label FROM agg ORDER BY avg_ms DESC, label LIMIT 3) AS is_worst
FROM agg""")
def watchlist_ranked(t):
    """D17 + O2 + F6: watched queries ranked by measured time, worst 3 flagged."""
    return W.rank_watchlist(query_log(t), top=3)


@query("tuning_benefit", f"""
WITH ql AS ({QUERY_LOG_SQL}),
b AS (SELECT label, round(avg({EXEC}), 3) AS before_ms FROM ql WHERE run_ts < TIMESTAMP '2024-01-15' GROUP BY label),
a AS (SELECT label, round(avg({EXEC}), 3) AS after_ms FROM ql WHERE run_ts >= TIMESTAMP '2024-01-15' GROUP BY label)
SELECT b.label, before_ms, after_ms,
       CASE WHEN before_ms > 0 THEN round((before_ms - after_ms) / before_ms * 100, 1) END AS improvement_pct
FROM b JOIN a ON a.label = b.label""")
def tuning_benefit(t):
    """D19 + F21: mean time before / after the change date, improvement %."""
    q = query_log(t).withColumn("ms", W.exec_ms())
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return W.tuning_benefit(q.filter(F.col("run_ts") < cut), q.filter(F.col("run_ts") >= cut))


@query("layout_advice")
def layout_advice(t):
    """Distinct counts (HLL) and selectivity of the watched filter columns."""
    return W.layout_advice(A.container_moves(t), ["container_id", "terminal_id", "crane_id",
                                                  "move_type"])


@query("layout_compare")
def layout_compare(t):
    """D20, approve step: a copy clustered by the advised column, and what the same filter
    reads on the moves as they come and on the copy."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/layout-{uuid.uuid4().hex}"
    moves = A.container_moves(t).select("move_id", "container_id", "event_ts")
    moves.repartition(LAYOUT_FILES).write.parquet(f"{folder}/before")
    W.rewrite_clustered(moves, "container_id", f"{folder}/after", LAYOUT_FILES)
    return W.compare_layouts(t.spark, f"{folder}/before", f"{folder}/after", "container_id", 8)



