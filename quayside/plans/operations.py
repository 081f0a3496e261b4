"""Operational questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import operations as O
from ..operators import retrieval as RT
from ..sources import adapters as A
from .documents import EMB_SQL
from ..sources.tables import spread
from .registry import query
from .views_sql import with_views

DAY, H0, H1 = "2024-01-14", 13, 18


@query("window_vs_baseline", with_views(f"""
SELECT terminal_id, window_avg, baseline_avg,
       CASE WHEN baseline_avg > 0 THEN round((window_avg - baseline_avg) / baseline_avg * 100, 1) END AS pct_change
FROM (SELECT terminal_id,
             round(avg(turn_time_minutes) FILTER (WHERE CAST(gate_in_ts AS DATE) = DATE '{DAY}'
                   AND hour(gate_in_ts) BETWEEN {H0} AND {H1}), 3) AS window_avg,
             round(avg(turn_time_minutes) FILTER (WHERE NOT (CAST(gate_in_ts AS DATE) = DATE '{DAY}'
                   AND hour(gate_in_ts) BETWEEN {H0} AND {H1})), 3) AS baseline_avg
      FROM gate_transactions GROUP BY terminal_id) g""", "gate_transactions"))
def window_vs_baseline(t):
    """Turn time in the incident window vs baseline, per terminal."""
    return O.window_vs_baseline(A.gate_transactions(t), DAY, H0, H1)


@query("rehandle_spike", with_views(f"""
WITH r AS (SELECT CAST(event_ts AS DATE) AS d, CAST(hour(event_ts) AS INTEGER) AS hour
           FROM container_moves WHERE is_rehandle),
per AS (SELECT d, hour, count(*) AS n FROM r GROUP BY d, hour),
days AS (SELECT count(DISTINCT d) AS other_days FROM r WHERE d <> DATE '{DAY}'),
g AS (SELECT hour, CAST(sum(CASE WHEN d = DATE '{DAY}' THEN n ELSE 0 END) AS BIGINT) AS window_count,
             sum(CASE WHEN d <> DATE '{DAY}' THEN n ELSE 0 END) AS other FROM per GROUP BY hour)
SELECT hour, window_count, round(other / other_days, 3) AS other_days_avg,
       CASE WHEN round(other / other_days, 3) > 0 THEN round(window_count / round(other / other_days, 3), 3) END AS ratio
FROM g, days""", "container_moves"))
def rehandle_spike(t):
    """Rehandles per hour on the incident day vs the same hour on other days."""
    return O.rehandle_spike(A.container_moves(t), DAY)


@query("plan_overrun", with_views("""
SELECT call_id, berth_id, round((epoch_us(actual_departure) - epoch_us(etd)) / 3600000000, 2) AS overrun_hours
FROM berth_calls ORDER BY overrun_hours DESC, call_id""", "berth_calls"))
def plan_overrun(t):
    """Hours each call overran its planned departure, worst first."""
    return O.overrun_hours(A.berth_calls(t)).select("call_id", "berth_id", "overrun_hours") \
        .orderBy(F.desc("overrun_hours"), "call_id")


@query("repeat_overrun", with_views("""
SELECT call_id, berth_id, actual_arrival, overrun_hours,
       row_number() OVER (PARTITION BY berth_id, date_trunc('month', actual_arrival)
                          ORDER BY actual_arrival, call_id) - 1 AS earlier_overruns
FROM (SELECT *, round((epoch_us(actual_departure) - epoch_us(etd)) / 3600000000, 2) AS overrun_hours
      FROM berth_calls) c WHERE overrun_hours > 0""", "berth_calls"))
def repeat_overrun(t):
    """Earlier overrunning calls on the same berth in the same month."""
    return O.repeat_overrun(A.berth_calls(t))


@query("vs_fleet", with_views("""
SELECT crane_id, round(s / n, 3) AS crane_avg, round(f, 3) AS fleet_avg, round((s / n) / f, 3) AS ratio
FROM (SELECT crane_id, sum(vibration_g) AS s, count(*) AS n FROM crane_telemetry GROUP BY crane_id) c,
     (SELECT avg(vibration_g) AS f FROM crane_telemetry) fl""", "crane_telemetry"))
def vs_fleet(t):
    """One crane against the fleet."""
    return O.vs_fleet(A.crane_telemetry(t))


@query("disputed_revenue", with_views("""
SELECT CAST(sum(amount_cents) AS DOUBLE) / 100 AS disputed_usd, count(*) AS disputes,
       (SELECT invoice_id FROM billing_events WHERE dispute_flag
        ORDER BY amount_cents DESC, invoice_id LIMIT 1) AS top_invoice_id,
       CAST(max(amount_cents) AS DOUBLE) / 100 AS top_amount_usd
FROM billing_events WHERE dispute_flag""", "billing_events"))
def disputed_revenue(t):
    """Disputed revenue total and the riskiest invoice."""
    return O.disputed_revenue(A.billing_events(t))


@query("berth_productivity", with_views("""
SELECT berth_id, CAST(actual_arrival AS DATE) AS day, count(*) AS calls,
       round(avg(moves / greatest((epoch_us(actual_departure) - epoch_us(actual_arrival)) / 3600000000, 1.0)), 3)
         AS avg_moves_per_hr
FROM berth_calls GROUP BY berth_id, CAST(actual_arrival AS DATE)""", "berth_calls"))
def berth_productivity(t):
    """Moves per hour per call, averaged by berth and day."""
    return O.berth_productivity(A.berth_calls(t))


def _drift_sql(base: str, view: str = "crane_telemetry") -> str:
    levels = [(n, f"vibration_g > base * {r}", h) for n, r, h in O.LEVELS]
    levels.append(("Inspect-temperature", f"temperature_c > tbase + {O.TEMP_RISE_C}", O.TEMP_HOURS))
    lv = " UNION ALL ".join(
        f"SELECT crane_id, reading_id, ts, us, '{n}' AS level, coalesce({c}, false) AS hit, {h} AS hours FROM b"
        for n, c, h in levels)
    return with_views(f"""
WITH t AS (SELECT crane_id, reading_id, ts, vibration_g, temperature_c, epoch_us(ts) AS us FROM {view}),
b AS ({base}),
lv AS ({lv}),
g AS (SELECT *, row_number() OVER (PARTITION BY crane_id, level ORDER BY us, reading_id)
              - row_number() OVER (PARTITION BY crane_id, level, hit ORDER BY us, reading_id) AS grp FROM lv),
r AS (SELECT *, min(us) OVER (PARTITION BY crane_id, level, grp) AS start FROM g WHERE hit)
SELECT crane_id, level, min(ts) AS first_fire_ts FROM r
WHERE hours = 0 OR us - start > hours * 3600000000 GROUP BY crane_id, level""", view)


TRAILING = """SELECT *, avg(vibration_g) OVER w AS base, avg(temperature_c) OVER w AS tbase FROM t
WINDOW w AS (PARTITION BY crane_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)"""
FROZEN = """SELECT t.*, f.base, f.tbase FROM t LEFT JOIN (
  SELECT crane_id, avg(vibration_g) AS base, avg(temperature_c) AS tbase FROM t
  WHERE ts < TIMESTAMP '2024-01-08' GROUP BY crane_id) f ON f.crane_id = t.crane_id"""


@query("drift_levels", _drift_sql(TRAILING))
def drift_levels(t):
    """First firing time of each vibration / temperature level per crane,
    against a trailing 7-day baseline."""
    return O.drift_levels(A.crane_telemetry(t), baseline="trailing", baseline_days=7)


@query("drift_levels_frozen", _drift_sql(FROZEN))
def drift_levels_frozen(t):
    """N5 against a baseline frozen before 2024-01-08."""
    return O.drift_levels(A.crane_telemetry(t), baseline="frozen", frozen_before="2024-01-08")


@query("drift_levels_staged", _drift_sql(TRAILING, "drifting_telemetry"))
def drift_levels_staged(t):
    """N5 over cranes that drift in different ways: every level fires for some and not for others."""
    return O.drift_levels(A.drifting_telemetry(t), baseline="trailing", baseline_days=7)


@query("drift_levels_staged_frozen", _drift_sql(FROZEN, "drifting_telemetry"))
def drift_levels_staged_frozen(t):
    """As ``drift_levels_staged``, against a baseline frozen before 2024-01-08."""
    return O.drift_levels(A.drifting_telemetry(t), baseline="frozen", frozen_before="2024-01-08")


@query("similar_orders", "WITH " + """
d_emb AS (""" + EMB_SQL.format(key="doc_id, source", text="text", src="documents") + """),
q_emb AS (""" + EMB_SQL.format(key="item_id", text="text", src="benchmark") + """),
fam AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS number, count(*) OVER () AS n
        FROM (SELECT DISTINCT coalesce(source, '') AS family FROM documents) u),
s AS (SELECT q.item_id AS query_id, f.family, d.doc_id AS id,
             round(list_dot_product(q.embedding, d.embedding)
                   / (sqrt(list_dot_product(q.embedding, q.embedding))
                      * sqrt(list_dot_product(d.embedding, d.embedding))), 12) AS sim
      FROM q_emb q JOIN fam f ON f.number = ((q.item_id % f.n) + f.n) % f.n JOIN d_emb d ON coalesce(d.source, '') = f.family
      WHERE q.embedding IS NOT NULL AND d.embedding IS NOT NULL)
SELECT query_id, id, sim, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM s) r
WHERE rank <= 3""")
def similar_orders(t):
    """For each question, the 3 most similar whole documents of the question's own
    fault family.  Families are the sources that the documents have (none counts as ''),
    in order of their names; questions are dealt over all of them by id."""
    family = F.coalesce(F.col("source"), F.lit(""))
    d = spread(t.documents.select(F.col("doc_id").alias("id"), "text", family.alias("family")))
    corpus = RT.embed(d, ["id"], "text", keep=["family"])
    # one row per family
    names = t.documents.select(family.alias("family")).distinct()
    numbered = names.select("family", (F.row_number().over(Window.orderBy("family")) - 1).alias("number")) \
        .crossJoin(F.broadcast(names.agg(F.count(F.lit(1)).alias("n"))))
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text") \
        .join(numbered, F.expr("number = pmod(query_id, n)")).select("query_id", "text", "family")
    return RT.topk(corpus, RT.embed(q, ["query_id"], "text", keep=["family"]), k=3,
                   family=("family", "family"))
