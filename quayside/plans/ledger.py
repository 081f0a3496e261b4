"""Ledger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import billing as B
from ..operators import ledger as L
from ..operators import model as M
from ..operators import relational as R
from ..session import ensure_checkpoint_dir
from ..sources import adapters as A
from .billing import DIAG, FIRSTS, _base, dup_arm, rate_arm
from .registry import REGISTRY, query
from .relational import BILLING_EXTRA
from .views_sql import with_views

VIEWS = ("billing_events", "tariff_rates", "filed_recommendations", "review_actions")

RECS = """
SELECT f.rec_id, f.invoice_id, f.status, f.detected_at,
       CASE WHEN fi.first_id < be.invoice_id THEN 'duplicate_charge' ELSE 'rate_deviation' END AS anomaly_type,
       CAST(be.amount_cents AS DOUBLE) / 100 AS billed_usd,
       CAST(CASE WHEN fi.first_id < be.invoice_id THEN 0 ELSE tr.rate_cents END AS DOUBLE) / 100 AS expected_usd,
       CAST(CASE WHEN fi.first_id < be.invoice_id THEN be.amount_cents
                 ELSE be.amount_cents - tr.rate_cents END AS DOUBLE) / 100 AS variance_usd
FROM filed_recommendations f
JOIN billing_events be ON be.invoice_id = f.invoice_id
JOIN firsts fi ON fi.terminal_id = be.terminal_id AND fi.container_id = be.container_id
 AND fi.move_type = be.move_type AND fi.tariff_code = be.tariff_code
LEFT JOIN tariff_rates tr ON tr.terminal_id = be.terminal_id AND tr.tariff_code = be.tariff_code"""

FIRST_ACTIONS = """
SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY rec_id ORDER BY action_ts, action_id) AS rn
               FROM review_actions a) x WHERE rn = 1"""

STATE = """
SELECT r.rec_id, r.invoice_id, r.anomaly_type, r.billed_usd, r.expected_usd, r.variance_usd,
       CASE fa.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE r.status END AS status,
       fa.reviewer AS reviewed_by, fa.action_ts AS resolved_at, r.detected_at
FROM recs r LEFT JOIN fa ON fa.rec_id = r.rec_id"""

CTES = (("firsts", FIRSTS), ("recs", RECS), ("fa", FIRST_ACTIONS), ("state", STATE))


def recs(t):
    be, tr, filed = _base(t)
    filed = filed.withColumn("anomaly_type", F.lit("filed"))
    d = B.diagnose(filed, be, tr, keep=["rec_id", "status", "detected_at"])
    return d.drop("scan_type")


def state(t):
    return L.fold_ledger(recs(t), A.review_actions(A.billing_events(t)))


@query("review_ledger", with_views("""
SELECT rec_id, invoice_id, anomaly_type, status, reviewed_by, resolved_at FROM state""",
                                  *VIEWS, extra=CTES))
def review_ledger(t):
    """L1 + D7: current state of every filed recommendation."""
    return state(t).select("rec_id", "invoice_id", "anomaly_type", "status", "reviewed_by",
                           "resolved_at")


@query("ledger_violations", with_views("""
SELECT a.action_id, a.rec_id, a.action, a.reviewer, a.action_ts,
       CASE WHEN r.rec_id IS NULL THEN 'unknown_id' ELSE 'not_pending' END AS reason
FROM review_actions a LEFT JOIN recs r ON r.rec_id = a.rec_id
LEFT JOIN fa ON fa.rec_id = a.rec_id
WHERE r.rec_id IS NULL OR a.action_id <> fa.action_id""", *VIEWS, extra=CTES))
def ledger_violations(t):
    """L1: actions that did not apply (unknown id, or no longer pending)."""
    return L.violations(recs(t), A.review_actions(A.billing_events(t)))


@query("tuning_violations", with_views("""
SELECT a.action_id, a.rec_id, a.action, a.reviewer, a.action_ts,
       CASE WHEN r.rec_id IS NULL THEN 'unknown_id' ELSE 'not_pending' END AS reason
FROM review_actions a LEFT JOIN recs r ON r.rec_id = a.rec_id
LEFT JOIN fa ON fa.rec_id = a.rec_id
WHERE r.rec_id IS NULL OR (a.action_id <> fa.action_id AND a.action <> 'reject')""", *VIEWS, extra=CTES))
def tuning_violations(t):
    """D19, review half: an approval of a settled tuning item is an error, a rejection of
    one passes in silence."""
    return L.violations(recs(t), A.review_actions(A.billing_events(t)), silent_reject=True)


@query("leakage_total", with_views("""
SELECT round(coalesce(sum(variance_usd), 0), 2) AS signed_total_usd,
       round(coalesce(sum(abs(variance_usd)), 0), 2) AS abs_total_usd,
       count(*) AS approved
FROM state WHERE status = 'approved'""", *VIEWS, extra=CTES))
def leakage_total(t):
    """D8 + A6: signed and absolute totals of approved benefits."""
    return L.leakage(state(t))


@query("apply_updates", with_views("""
SELECT be.invoice_id, CAST(be.amount_cents AS DOUBLE) / 100 AS amount_usd,
       CASE WHEN s.invoice_id IS NOT NULL THEN
            CASE WHEN s.anomaly_type = 'duplicate_charge' THEN CAST(0 AS DOUBLE) ELSE s.expected_usd END
       END AS corrected_usd,
       CASE WHEN s.invoice_id IS NOT NULL THEN
            CASE WHEN s.anomaly_type = 'duplicate_charge' THEN 'voided_duplicate' ELSE 'corrected' END
       END AS correction_status
FROM billing_events be LEFT JOIN (SELECT * FROM state WHERE status = 'approved') s
  ON s.invoice_id = be.invoice_id""", *VIEWS, extra=CTES))
def apply_updates(t):
    """S10 + D6: billing snapshot with approved corrections applied; the
    billed amount itself is never overwritten."""
    be = R.evolve_schema(A.billing_events(t), BILLING_EXTRA)
    ch = L.corrections(state(t))
    out = R.apply_updates(be, ch, ["invoice_id"], ["corrected_usd", "correction_status"])
    return out.select("invoice_id", A.usd("amount_cents").alias("amount_usd"),
                      "corrected_usd", "correction_status")


AUDIT = f"""
SELECT detected_at AS called_at, 'diagnose' AS function_name, 'rules' AS model_name,
       CAST(invoice_id AS VARCHAR) AS subject_id, action AS input_summary,
       '{{"diagnosis": "{M.RuleBackend.DIAGNOSIS}", "recommended_action": "' || action || '"}}' AS output_summary
FROM (SELECT s.*, CASE WHEN s.anomaly_type = 'duplicate_charge' THEN
              printf('{B.ACTION_VOID}',
                     CAST(s.invoice_id AS VARCHAR), CAST(fi.first_id AS VARCHAR), printf('%.2f', s.billed_usd))
            WHEN s.variance_usd > 0 THEN
              printf('{B.ACTION_OVER}',
                     printf('%.2f', s.variance_usd), be.tariff_code, printf('%.2f', s.expected_usd), printf('%.2f', s.expected_usd))
            ELSE
              printf('{B.ACTION_UNDER}',
                     printf('%.2f', abs(s.variance_usd)), be.tariff_code, printf('%.2f', s.expected_usd), printf('%.2f', s.expected_usd))
       END AS action
      FROM state s JOIN billing_events be ON be.invoice_id = s.invoice_id
      JOIN firsts fi ON fi.terminal_id = be.terminal_id AND fi.container_id = be.container_id
       AND fi.move_type = be.move_type AND fi.tariff_code = be.tariff_code) d
UNION ALL
SELECT fa.action_ts, CASE WHEN fa.action = 'approve' THEN 'approve' ELSE 'reject' END,
       'system', CAST(r.invoice_id AS VARCHAR),
       CASE WHEN fa.action = 'approve' THEN printf('{L.AUDIT_APPROVE_IN}',
                 printf('%.2f', r.billed_usd), printf('%.2f', r.expected_usd), fa.reviewer)
            ELSE printf('{L.AUDIT_REJECT_IN}', fa.reviewer) END,
       CASE WHEN fa.action = 'approve' THEN printf('{L.AUDIT_APPROVE_OUT}', printf('%.2f', r.variance_usd))
            ELSE '{L.AUDIT_REJECT_OUT}' END
FROM fa JOIN recs r ON r.rec_id = fa.rec_id"""


@query("audit_log", with_views(AUDIT, *VIEWS, extra=CTES))
def audit_log(t):
    """One audit row per diagnosis and per applied review."""
    return L.audit_rows(state(t))


@query("open_disputes", with_views("""
SELECT invoice_id, CAST(amount_cents AS DOUBLE) / 100 AS amount_usd, customer_name, dispute_reason
FROM billing_events WHERE dispute_flag ORDER BY amount_cents DESC, invoice_id""", "billing_events"))
def open_disputes(t):
    """Open disputes, largest first."""
    be = A.billing_events(t).filter(F.col("dispute_flag"))
    return be.orderBy(F.desc("amount_cents"), "invoice_id").select(
        "invoice_id", A.usd("amount_cents").alias("amount_usd"), "customer_name", "dispute_reason")


@query("scan_with_status", with_views(f"""
SELECT u.invoice_id, u.anomaly_type, u.variance_usd, s.status
FROM ({rate_arm('undisputed')} UNION ALL {dup_arm('undisputed')}) u
LEFT JOIN state s ON s.invoice_id = u.invoice_id""", *VIEWS, "undisputed", extra=CTES))
def scan_with_status(t):
    """Every finding (filed or not) with its ledger status: one left join
    instead of one lookup per row."""
    be, tr, _ = _base(t)
    u = B.anomaly_union(be, tr, None)
    return u.select("invoice_id", "anomaly_type", "variance_usd").join(
        state(t).select("invoice_id", "status"), "invoice_id", "left")


def diagnosis_prompts(t):
    be, tr, filed = _base(t)
    d = B.diagnose(B.findings(be, tr, filed), be, tr)
    prompt = F.concat_ws(
        "\n", F.lit("Review this invoice anomaly."),
        F.concat(F.lit("Invoice: "), F.col("invoice_id").cast("string")),
        F.concat(F.lit("Anomaly type: "), F.col("anomaly_type")),
        F.concat(F.lit("Mechanical recommendation: "), F.col("recommended_action")))
    return d.select("invoice_id", "anomaly_type", "billed_usd", "expected_usd", "variance_usd",
                    "recommended_action", prompt.alias("prompt"))


@query("model_batch", with_views(f"""
SELECT invoice_id, anomaly_type, billed_usd, expected_usd, variance_usd,
       '{M.RuleBackend.DIAGNOSIS}' AS diagnosis, recommended_action, 'pending' AS status,
       CAST(NULL AS VARCHAR) AS model_error
FROM ({DIAG}) d""", "billing_events", "tariff_rates", "filed_recommendations",
                                "new_undisputed", extra=(("firsts", FIRSTS),)))
def model_batch(t):
    """T13 + D5: one batched model stage over every diagnosis prompt, reply
    parsed (fence stripped, JSON), mechanical action as the fallback."""
    return _diagnosed(M.run_model(diagnosis_prompts(t), "prompt"))


def _diagnosed(replies):
    parsed = M.parse_reply("reply", "diagnosis string, recommended_action string")
    return replies.select(
        "invoice_id", "anomaly_type", "billed_usd", "expected_usd", "variance_usd",
        F.coalesce(parsed.getField("diagnosis"), F.col("recommended_action")).alias("diagnosis"),
        F.coalesce(parsed.getField("recommended_action"),
                   F.col("recommended_action")).alias("recommended_action"),
        F.lit("pending").alias("status"), "model_error")


@query("model_batch_cached", REGISTRY["model_batch"].oracle)
def model_batch_cached(t):
    """T13 with a store of replies: equal prompts are asked once, known ones not at all."""
    cache = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/replies-{uuid.uuid4().hex}"
    return _diagnosed(M.run_model_cached(diagnosis_prompts(t), cache, "prompt"))
