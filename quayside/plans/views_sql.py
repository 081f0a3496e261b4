"""DuckDB twins of ``quayside.sources.adapters``.

The oracle SQL of a query is ``with_views(body, names...)``: the adapter views
it needs become CTEs in dependency order in front of the body.
"""

from __future__ import annotations

from ..sources.adapters import (BERTHS, CRANES, DISPUTE_TEXT, DRIFT_FROM, DRIFT_HEAT, DRIFT_RISE, DRIFT_SPIKES,
                                EARLIER_RATIONALE, ETD_DAYS, FILED_BEFORE, LOST_REVIEWS, SPIKE_EVERY,
                                TERMINAL_BUCKET)

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
DISPUTE = "CASE o.o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in DISPUTE_TEXT) + " END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "billing_events": ((), f"""
    SELECT o.o_orderkey AS invoice_id, c.c_nationkey AS terminal_id,
           o.o_custkey AS container_id, c.c_mktsegment AS move_type,
           o.o_orderpriority AS tariff_code,
           CAST(round(o.o_totalprice * 100) AS BIGINT) AS amount_cents,
           c.c_name AS customer_name,
           lower(replace(c.c_name, '#', '.')) || '@example.com' AS customer_email,
           o.o_orderstatus = 'P' AS dispute_flag,
           CASE WHEN o.o_orderstatus = 'P' THEN {DISPUTE}
                || ' (container ' || CAST(o.o_custkey AS VARCHAR) || ')' END AS dispute_reason,
           o.o_orderstatus AS order_status,
           o.o_orderdate AS created_ts
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""),
    "tariff_rates": (("billing_events",), """
    SELECT terminal_id, tariff_code,
           CAST((2 * sum(amount_cents) + count(*)) // (2 * count(*)) AS BIGINT) AS rate_cents
    FROM billing_events GROUP BY terminal_id, tariff_code"""),
    "filed_recommendations": (("billing_events",), f"""
    SELECT invoice_id AS rec_id, invoice_id, 'pending' AS status,
           created_ts + INTERVAL 1 DAY AS detected_at
    FROM billing_events WHERE created_ts < TIMESTAMP '{FILED_BEFORE}'"""),
    "undisputed": (("billing_events",), "SELECT * FROM billing_events WHERE NOT dispute_flag"),
    "new_undisputed": (("undisputed", "filed_recommendations"), """
    SELECT u.* FROM undisputed u LEFT JOIN filed_recommendations f USING (invoice_id)
    WHERE f.invoice_id IS NULL"""),
    "billing_triage": (("billing_events",), f"""
    SELECT *, CASE WHEN known THEN 'Other' END AS dispute_category,
           CASE WHEN known THEN 'Low' END AS dispute_risk,
           CASE WHEN known THEN '{EARLIER_RATIONALE}' END AS dispute_risk_rationale
    FROM (SELECT *, dispute_flag AND created_ts < TIMESTAMP '{FILED_BEFORE}' AS known FROM billing_events) k"""),
    "review_actions": (("billing_events",), f"""
    SELECT rec_id, action, reviewer, action_ts, rec_id * 10 + seq AS action_id FROM (
      SELECT invoice_id AS rec_id,
             CASE WHEN order_status = 'F' THEN 'approve' ELSE 'reject' END AS action,
             'reviewer-' || CAST(terminal_id AS VARCHAR) AS reviewer,
             created_ts + INTERVAL 2 DAY AS action_ts, 1 AS seq
      FROM billing_events
      WHERE created_ts < TIMESTAMP '{FILED_BEFORE}' AND order_status IN ('F', 'O')
      UNION ALL
      SELECT invoice_id, CASE WHEN order_status = 'F' THEN 'reject' ELSE 'approve' END,
             'reviewer-late', created_ts + INTERVAL 3 DAY, 2
      FROM billing_events
      WHERE created_ts < TIMESTAMP '{FILED_BEFORE}' AND tariff_code = '1-URGENT'
      UNION ALL
      SELECT -invoice_id, 'approve', 'reviewer-lost', created_ts + INTERVAL 4 DAY, -3
      FROM billing_events
      WHERE created_ts < TIMESTAMP '{FILED_BEFORE}' AND container_id % {LOST_REVIEWS} = 0) a"""),
    "container_moves": ((), f"""
    SELECT event_id AS move_id, CAST(floor({K} / {TERMINAL_BUCKET}) AS INTEGER) AS terminal_id,
           user_id AS container_id, event_type AS move_type, ts AS event_ts,
           'QC' || CAST({K} % {CRANES} AS VARCHAR) AS crane_id, event_type = 'error' AS is_rehandle
    FROM events"""),
    "gate_transactions": ((), f"""
    SELECT event_id AS txn_id, CAST(floor({K} / {TERMINAL_BUCKET}) AS INTEGER) AS terminal_id,
           user_id AS truck_id, ts AS gate_in_ts, value AS turn_time_minutes,
           event_type AS move_type
    FROM events"""),
    "crane_telemetry": ((), f"""
    SELECT event_id AS reading_id, 'QC' || CAST(user_id % {CRANES} AS VARCHAR) AS crane_id, ts,
           value AS vibration_g, CAST(40 AS DOUBLE) + CAST({K} AS DOUBLE) / 10 AS temperature_c
    FROM events"""),
    "drifting_telemetry": ((), f"""
    SELECT event_id AS reading_id, 'QC' || CAST(user_id % {CRANES} AS VARCHAR) AS crane_id, ts,
           (0.36 + value / 100000) * CASE
               WHEN user_id % {CRANES} = {DRIFT_SPIKES} AND event_id % {SPIKE_EVERY} = 0 THEN 5
               {' '.join(f"WHEN user_id % {CRANES} = {c} AND ts >= TIMESTAMP '{DRIFT_FROM}' THEN {f}"
                         for c, f in DRIFT_RISE.items())} ELSE 1 END AS vibration_g,
           50 + value / 1000 + CASE WHEN user_id % {CRANES} = {DRIFT_HEAT} AND ts >= TIMESTAMP '{DRIFT_FROM}'
                                    THEN 12 ELSE 0 END AS temperature_c
    FROM events"""),
    "berth_calls": ((), f"""
    SELECT l_orderkey AS call_id, 'B' || CAST(l_orderkey % {BERTHS} AS VARCHAR) AS berth_id,
           min(l_shipdate) AS actual_arrival,
           min(l_shipdate) + INTERVAL {ETD_DAYS} DAY AS etd,
           max(l_shipdate) AS actual_departure,
           sum(l_quantity) AS moves, count(*) AS n_lines
    FROM lineitem GROUP BY l_orderkey"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``body`` with the adapter views (and extra CTEs) it uses."""
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(names)]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in extra]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":          # merge the body's own CTE list
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
