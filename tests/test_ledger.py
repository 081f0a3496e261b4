import datetime as dt

from quayside.operators import ledger as L

RECS = "rec_id long, invoice_id string, status string"
ACTS = "rec_id long, action string, reviewer string, action_ts timestamp_ntz, action_id long"
T = dt.datetime(2026, 1, 1)


def _run(spark, acts, silent=False):
    recs = spark.createDataFrame([(1, "A", "pending"), (2, "B", "pending")], RECS)
    a = spark.createDataFrame(acts, ACTS)
    state = {r.rec_id: (r.status, r.reviewed_by) for r in L.fold_ledger(recs, a).collect()}
    viol = sorted((r.action_id, r.reason) for r in L.violations(recs, a, silent).collect())
    return state, viol


def test_approve_then_reject(spark):
    state, viol = _run(spark, [(1, "approve", "x", T, 1), (1, "reject", "y", T + dt.timedelta(1), 2)])
    assert state[1] == ("approved", "x") and state[2] == ("pending", None)
    assert viol == [(2, "not_pending")]


def test_reject_then_approve(spark):
    state, viol = _run(spark, [(1, "reject", "x", T, 1), (1, "approve", "y", T + dt.timedelta(1), 2)])
    assert state[1] == ("rejected", "x") and viol == [(2, "not_pending")]


def test_unknown_id(spark):
    state, viol = _run(spark, [(9, "approve", "x", T, 1)])
    assert viol == [(1, "unknown_id")] and state[1] == ("pending", None)


def test_two_reviewers_first_by_time_then_id(spark):
    state, viol = _run(spark, [(2, "reject", "late", T, 7), (2, "approve", "early", T, 3)])
    assert state[2] == ("approved", "early") and viol == [(7, "not_pending")]


def test_silent_reject_for_tuning_ledger(spark):
    _, viol = _run(spark, [(1, "approve", "x", T, 1), (1, "reject", "y", T + dt.timedelta(1), 2)],
                   silent=True)
    assert viol == []
