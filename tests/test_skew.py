"""One key holding a third of the rows: results stay exact and the work is split."""

import datetime as dt

from pyspark.sql import functions as F

from quayside.operators import billing as B
from quayside.operators import relational as R

SCHEMA = ("invoice_id long, terminal_id string, container_id string, move_type string, "
          "tariff_code string, amount_cents long, customer_name string, dispute_flag boolean, "
          "created_ts timestamp_ntz")


def hot_billing(spark, n=3000):
    t0 = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        cont = "HOT" if hot else f"C{i % 500}"
        rows.append((i, "T", cont, "m", "X", 100 + i % 7, "c", False,
                     t0 + dt.timedelta(hours=7 * i if hot else 13 * i)))
    return spark.createDataFrame(rows, SCHEMA)


def test_band_join_exact_and_split_under_hot_key(spark):
    b = hot_billing(spark)
    pairs = B.duplicate_pairs(b).select("first_invoice_id", "invoice_id")
    got = sorted(tuple(r) for r in pairs.collect())
    rows = b.collect()
    by = {}
    for r in rows:
        by.setdefault((r.terminal_id, r.container_id, r.move_type, r.tariff_code), []).append(r)
    exp = sorted((a.invoice_id, c.invoice_id) for g in by.values() for a in g for c in g
                 if a.invoice_id < c.invoice_id and abs((c.created_ts - a.created_ts).total_seconds())
                 < 14 * 86400)
    assert got == exp and len(got) > 0
    # the hot key is cut into many (key, 14-day band) join groups
    hot = b.filter(F.col("container_id") == "HOT")
    bands = hot.select(F.floor(F.unix_micros(F.col("created_ts").cast("timestamp")) /
                               F.lit(14 * 86_400_000_000)).alias("band")).distinct().count()
    assert bands > 50


def test_grouped_ops_exact_under_hot_key(spark):
    b = hot_billing(spark)
    tw = {r.invoice_id: r.twin_invoice_id for r in B.earliest_twin(b).collect()}
    assert tw[0] is None and tw[3] == 0 and tw[2997] == 0 and tw[2999] == 499
    batch = b.select(F.col("container_id").alias("k"), "invoice_id", "amount_cents")
    target = batch.limit(0)
    first = {r.k: r.invoice_id for r in
             R.insert_if_absent(target, batch, ["k"], order=[("amount_cents", False),
                                                            ("invoice_id", True)]).collect()}
    hot_rows = [r for r in batch.collect() if r.k == "HOT"]
    best = sorted(hot_rows, key=lambda r: (-r.amount_cents, r.invoice_id))[0]
    assert first["HOT"] == best.invoice_id


def test_key_dense_in_one_band(spark):
    """Four hundred equal charges inside one window: every pair is a duplicate once, and
    an invoice with many twins still has one rate deviation."""
    import datetime as dt

    from quayside.operators import billing as B
    t0, n = dt.datetime(2026, 1, 1), 400
    rows = [(i, 1, 7, "load", "STD", 100_000 if i else 900_000, "c", False, t0 + dt.timedelta(minutes=i)) for i in range(n)]
    be = spark.createDataFrame(rows, "invoice_id long, terminal_id long, container_id long, move_type string, "
                                     "tariff_code string, amount_cents long, customer_name string, "
                                     "dispute_flag boolean, created_ts timestamp_ntz")
    tariffs = spark.createDataFrame([(1, "STD", 20_000)], "terminal_id long, tariff_code string, rate_cents long")
    got = {r.anomaly_type: r.n for r in B.anomaly_union(be, tariffs, None).groupBy("anomaly_type")
           .agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {"duplicate_charge": n * (n - 1) // 2, "rate_deviation": n}


def dense(spark, n):
    """One key with ``n`` charges of one day, each at an instant of its own, ids in no order of time."""
    return spark.range(n).select(
        F.col("id").alias("invoice_id"), F.lit("T").alias("terminal_id"), F.lit("HOT").alias("container_id"),
        F.lit("load").alias("move_type"), F.lit("STD").alias("tariff_code"),
        (F.lit(100_000) + F.col("id")).alias("amount_cents"), F.lit("c").alias("customer_name"),
        F.lit(False).alias("dispute_flag"),
        F.timestamp_micros(F.lit(1_767_225_600_000_000) + (F.col("id") * 7919 % n) * 800_000)
        .cast("timestamp_ntz").alias("created_ts"))


def test_a_hundred_thousand_twins_of_one_day(spark):
    """Five billion pairs that are never built: the scan and the diagnosis finish."""
    n = 100_000
    be = dense(spark, n)
    tariffs = spark.createDataFrame([("T", "STD", 20_000)], "terminal_id string, tariff_code string, rate_cents long")
    filed = spark.createDataFrame([], "invoice_id long")
    found = B.findings(be, tariffs, None)
    assert {r["anomaly_type"]: r["count"] for r in found.groupBy("anomaly_type").count().collect()} == {
        "duplicate_charge": n - 1, "rate_deviation": n}
    # the dearest invoice has 99,999 earlier twins: its row fills the list
    top = B.billing_anomaly_scan(be, tariffs, filed).collect()
    assert [(r.invoice_id, r.anomaly_type) for r in top] == [(n - 1, "duplicate_charge")] * 10
    diagnosed = B.diagnose(found, be, tariffs).groupBy("anomaly_type", "twin_invoice_id").count().collect()
    assert {(r.anomaly_type, r.twin_invoice_id, r["count"]) for r in diagnosed} == {
        ("duplicate_charge", 0, 2 * (n - 1)), ("rate_deviation", None, 1)}
