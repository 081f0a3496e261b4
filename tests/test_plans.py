"""Physical-plan properties the design relies on at scale."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    return lambda name: qs[name](spark, SF)


def test_point_lookup_pushes_equality_and_prunes(q):
    p = q("point_lookup")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,8)" in p
    assert "value" not in p.split("ReadSchema:")[1].split("\n")[0]   # unused column not read


def test_flagship_topk_without_full_sort(q):
    p = plan(q("billing_anomaly_scan"))
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name", ["duplicate_pairs", "duplicate_charge"])
def test_band_join_is_an_equi_join(q, name):
    p = plan(q(name))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "_band" in p


@pytest.mark.parametrize("name", ["billing_anomaly_scan", "diagnose_anomalies", "model_batch"])
def test_twins_are_found_without_a_pair_join(q, name):
    p = plan(q(name))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "_band" not in p and "Window" in p


@pytest.mark.parametrize("name", ["vector_topk", "rag_prompt", "similar_orders"])
def test_topk_has_no_pair_explosion(q, name):
    p = plan(q(name))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "MapInPandas" in p


@pytest.mark.parametrize("name", ["earliest_match", "duplicate_evidence", "review_ledger",
                                  "insert_if_absent", "dq_pk"])
def test_grouped_operators_use_partial_aggregation_not_key_windows(q, name):
    p = plan(q(name))
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p
    assert "Window [row_number()" not in p


@pytest.mark.parametrize("name,most", [("billing_anomaly_scan", 5), ("diagnose_anomalies", 5)])
def test_the_fact_is_scanned_once_per_role(q, name, most):
    """New invoices, the filed set, the tariffs and the instants of the twins; the scan counts
    the twins of its first rows in a fifth role, the diagnosis looks for first invoices."""
    df = q(name)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert 0 < final.count("orders.parquet") <= most
