"""Review ledger (L1, D6-D8, D15, S10): recommendations are immutable rows,
review actions are appended, and the current state is derived.

State machine: pending -> approved | rejected.  Only the first action of a
recommendation by (action_ts, action_id) applies; every later action is a
violation ("not pending"), as is an action on an unknown id.  For the
tuning ledger a reject on a non-pending row is a silent no-op instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import RuleBackend

_FIRST = "first_action"

# Audit summaries of a review (reference wording).
AUDIT_APPROVE_IN = "billed $%s vs. expected $%s (reviewer: %s)"
AUDIT_APPROVE_OUT = "approved -- $%s benefit realized"
AUDIT_REJECT_IN = "human reviewer %s rejected the recommendation"
AUDIT_REJECT_OUT = "no change made to billing_events"


def first_actions(actions: DataFrame) -> DataFrame:
    """The applying action per recommendation: min over (ts, id).  A grouped
    min aggregates partially before the shuffle, so a recommendation with a
    huge number of actions still costs one row per map task."""
    packed = F.struct("action_ts", "action_id", "action", "reviewer")
    return actions.groupBy("rec_id").agg(F.min(packed).alias(_FIRST))


def fold_ledger(recs: DataFrame, actions: DataFrame) -> DataFrame:
    """Current state per recommendation: status, reviewer, resolved time.
    Actions on unknown ids fall away in the left join (they are violations)."""
    first = first_actions(actions)
    j = recs.join(first, "rec_id", "left")
    a = F.col(f"{_FIRST}.action")
    status = F.when(a == "approve", "approved").when(a == "reject", "rejected") \
        .otherwise(F.col("status"))
    return j.select(*[c for c in recs.columns if c != "status"], status.alias("status"),
                    F.col(f"{_FIRST}.reviewer").alias("reviewed_by"),
                    F.col(f"{_FIRST}.action_ts").alias("resolved_at"))


def violations(recs: DataFrame, actions: DataFrame, silent_reject: bool = False) -> DataFrame:
    """Actions that did not apply: unknown id, or the row was no longer pending."""
    known = actions.join(recs.select("rec_id", F.lit(True).alias("_known")), "rec_id", "left")
    first = first_actions(actions).select("rec_id", F.col(f"{_FIRST}.action_id").alias("_first"))
    j = known.join(first, "rec_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown_id") \
        .when(F.col("action_id") != F.col("_first"), "not_pending")
    out = j.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    if silent_reject:
        out = out.filter(~((F.col("reason") == "not_pending") & (F.col("action") == "reject")))
    return out.select("action_id", "rec_id", "action", "reviewer", "action_ts", "reason")


def corrections(state: DataFrame) -> DataFrame:
    """Per approved recommendation, the billing update it implies:
    duplicates are voided (corrected 0), others corrected to the expected
    amount; the benefit is the signed variance."""
    ap = state.filter(F.col("status") == "approved")
    dup = F.col("anomaly_type") == "duplicate_charge"
    return ap.select(
        "invoice_id",
        F.when(dup, F.lit(0.0)).otherwise(F.col("expected_usd")).alias("corrected_usd"),
        F.when(dup, "voided_duplicate").otherwise("corrected").alias("correction_status"),
        F.col("variance_usd").alias("benefit_usd"))


def leakage(state: DataFrame) -> DataFrame:
    """D8 + A6: total caught = sum of signed benefits of approved rows
    (recovered under-billing lowers it), zero when none; also the absolute sum."""
    ap = state.filter(F.col("status") == "approved")
    return ap.agg(
        F.round(F.coalesce(F.sum("variance_usd"), F.lit(0.0)), 2).alias("signed_total_usd"),
        F.round(F.coalesce(F.sum(F.abs("variance_usd")), F.lit(0.0)), 2).alias("abs_total_usd"),
        F.count(F.lit(1)).alias("approved"))


def diagnosis_reply(action: str = "recommended_action") -> Column:
    """The raw reply of the rule backend to a diagnosis prompt, as the model stage gets it."""
    head = f'{{"diagnosis": "{RuleBackend.DIAGNOSIS}", "recommended_action": "'
    return F.concat(F.lit(head), F.col(action), F.lit('"}'))


def audit_rows(state: DataFrame) -> DataFrame:
    """One audit row per diagnosis (model call) and per applied review.
    Both come from one pass over the folded state (status, reviewer,
    resolution time): each recommendation yields its diagnosis row and, when
    reviewed, its review row, through ``explode``."""
    ap = F.col("status") == "approved"
    money = lambda c: F.format_string("%.2f", F.col(c))
    subject = F.col("invoice_id").cast("string")
    diag = F.struct(
        F.col("detected_at").alias("called_at"), F.lit("diagnose").alias("function_name"),
        F.lit("rules").alias("model_name"), subject.alias("subject_id"),
        F.col("recommended_action").alias("input_summary"), diagnosis_reply().alias("output_summary"))
    review = F.struct(
        F.col("resolved_at").alias("called_at"),
        F.when(ap, "approve").otherwise("reject").alias("function_name"),
        F.lit("system").alias("model_name"), subject.alias("subject_id"),
        F.when(ap, F.format_string(AUDIT_APPROVE_IN, money("billed_usd"), money("expected_usd"),
                                   F.col("reviewed_by")))
        .otherwise(F.format_string(AUDIT_REJECT_IN, F.col("reviewed_by"))).alias("input_summary"),
        F.when(ap, F.format_string(AUDIT_APPROVE_OUT, money("variance_usd")))
        .otherwise(F.lit(AUDIT_REJECT_OUT)).alias("output_summary"))
    rows = F.when(F.col("status") != "pending", F.array(diag, review)).otherwise(F.array(diag))
    return state.select(F.explode(rows).alias("a")).select("a.*")
