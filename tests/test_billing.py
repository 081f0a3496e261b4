"""Billing scan goldens (the reference's deterministic seed) and threshold edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.operators import billing as B
from quayside.operators import ledger as L

SCHEMA = ("invoice_id string, terminal_id string, container_id string, move_type string, "
          "tariff_code string, amount_cents long, customer_name string, customer_email string, "
          "dispute_flag boolean, created_ts timestamp_ntz")
UTC4 = dt.timedelta(hours=4)


def ts(s):  # '+04' wall clock to UTC
    return dt.datetime.fromisoformat(s) - UTC4


# Seed rows of the reference (7 base, 6 planted), tariffs and the background
# pick lists; values are the reference's.
CUSTOMERS = [("Desert Star Logistics LLC", "youssef.haddad@desertstarlogistics.example"),
             ("Continental Freight Partners", "meilin.tan@continentalfreight.example"),
             ("Al Noor Shipping Agency", "sara.idris@alnoorshipping.example"),
             ("TransGlobal Cargo", "diego.fernandez@transglobalcargo.example"),
             ("Meridian Ocean Traders", "amara.okafor@meridianocean.example")]
MOVES = [("discharge", "STD-IMP", 48000), ("load", "STD-EXP", 54000),
         ("yard_shift", "REHANDLE", 9000), ("discharge", "WGT-ADJ", 31000),
         ("discharge", "DMG-HDL", 27500)]
TARIFFS = [("JEA", "DEM-STD", 62000), ("JEA", "STD-EXP", 54000), ("JEA", "STD-IMP", 48000),
           ("JEA", "WGT-ADJ", 31000), ("JEA", "DMG-HDL", 27500), ("JEA", "REHANDLE", 9000)]
SEED = [
    ("INV-88214", "CONTJEA0001", "discharge", "DEM-STD", 410000, 0, True, "2026-07-17 10:12"),
    ("INV-88215", "CONTJEA0002", "load", "STD-EXP", 62000, 1, True, "2026-07-17 11:40"),
    ("INV-88216", "CONTJEA0003", "discharge", "WGT-ADJ", 31000, 2, True, "2026-07-18 09:05"),
    ("INV-88217", "CONTJEA0004", "discharge", "DMG-HDL", 27500, 3, True, "2026-07-18 14:22"),
    ("INV-88220", "CONTJEA0005", "load", "STD-EXP", 54000, 0, False, "2026-07-19 08:00"),
    ("INV-88221", "CONTJEA0006", "discharge", "STD-IMP", 48000, 1, False, "2026-07-19 09:30"),
    ("INV-88222", "CONTJEA0007", "yard_shift", "REHANDLE", 9000, 2, False, "2026-07-19 12:15"),
    ("INV-89100", "CONTJEA2001", "discharge", "DEM-STD", 89000, 4, False, "2026-06-10 10:00"),
    ("INV-89101", "CONTJEA2002", "load", "STD-EXP", 54000, 3, False, "2026-06-18 09:00"),
    ("INV-89102", "CONTJEA2002", "load", "STD-EXP", 54000, 3, False, "2026-06-19 09:00"),
    ("INV-89103", "CONTJEA2003", "discharge", "STD-IMP", 34000, 2, False, "2026-06-25 14:00"),
    ("INV-89104", "CONTJEA2004", "discharge", "WGT-ADJ", 50500, 0, False, "2026-07-02 11:00"),
    ("INV-89105", "CONTJEA2005", "yard_shift", "REHANDLE", 18000, 1, False, "2026-07-10 16:00"),
]


def seed_rows():
    rows = []
    for inv, cont, mv, tc, cents, cust, disp, t in SEED:
        n, e = CUSTOMERS[cust]
        rows.append((inv, "JEA", cont, mv, tc, cents, n, e, disp, ts(t)))
    t0 = ts("2026-05-01 08:00")
    for g in range(1, 56):
        mv, tc, cents = MOVES[g % 5]
        n, e = CUSTOMERS[g % 5]
        rows.append((f"INV-{89000 + g}", "JEA", f"CONTJEA{1000 + g:04d}", mv, tc, cents, n, e,
                     False, t0 + g * dt.timedelta(hours=30)))
    return rows


@pytest.fixture(scope="module")
def seed(spark):
    billing = spark.createDataFrame(seed_rows(), SCHEMA)
    tariffs = spark.createDataFrame(TARIFFS, "terminal_id string, tariff_code string, rate_cents long")
    filed = spark.createDataFrame([], "invoice_id string")
    return billing, tariffs, filed


def test_seed_totals(seed):
    billing = seed[0]
    r = billing.agg(F.count("*").alias("n"), F.sum("amount_cents").alias("s")).first()
    assert (r.n, r.s) == (68, 2805500)
    d = billing.filter("dispute_flag").agg(F.count("*"), F.sum("amount_cents")).first()
    assert tuple(d) == (4, 530500)


def test_scan_golden(seed):
    rows = B.billing_anomaly_scan(*seed).collect()
    got = [(r.invoice_id, r.anomaly_type, r.billed_usd, r.expected_usd, r.variance_usd) for r in rows]
    assert got == [
        ("INV-89102", "duplicate_charge", 540.0, 0.0, 540.0),
        ("INV-89100", "rate_deviation", 890.0, 620.0, 270.0),
        ("INV-89104", "rate_deviation", 505.0, 310.0, 195.0),
        ("INV-89103", "rate_deviation", 340.0, 480.0, 140.0),
        ("INV-89105", "rate_deviation", 180.0, 90.0, 90.0),
    ]


def test_diagnose_and_approve_all(spark, seed):
    billing, tariffs, filed = seed
    scan = B.billing_anomaly_scan(billing, tariffs, filed)
    d = B.diagnose(scan, billing, tariffs)
    signed = {r.invoice_id: (r.anomaly_type, r.variance_usd, r.twin_invoice_id) for r in d.collect()}
    assert signed["INV-89103"] == ("rate_deviation", -140.0, None)
    assert signed["INV-89102"] == ("duplicate_charge", 540.0, "INV-89101")
    recs = d.select(F.col("invoice_id").alias("rec_id"), "invoice_id", "anomaly_type", "billed_usd",
                    "expected_usd", "variance_usd", F.lit("pending").alias("status"))
    acts = recs.select("rec_id", F.lit("approve").alias("action"), F.lit("amara").alias("reviewer"),
                       F.lit(dt.datetime(2026, 8, 1)).cast("timestamp_ntz").alias("action_ts"),
                       F.monotonically_increasing_id().alias("action_id"))
    state = L.fold_ledger(recs, acts)
    tot = L.leakage(state).first()
    assert (tot.signed_total_usd, tot.abs_total_usd, tot.approved) == (955.0, 1235.0, 5)
    corr = {r.invoice_id: (r.corrected_usd, r.correction_status)
            for r in L.corrections(state).collect()}
    assert corr["INV-89102"] == (0.0, "voided_duplicate")
    assert corr["INV-89103"] == (480.0, "corrected")
    # a second scan after filing finds nothing new
    again = B.billing_anomaly_scan(billing, tariffs, recs.select("invoice_id"))
    assert again.count() == 0


def _one(spark, rate_cents, billed_cents):
    b = spark.createDataFrame([("I1", "T", "C", "m", "X", billed_cents, "n", "e", False,
                                dt.datetime(2026, 1, 1))], SCHEMA)
    t = spark.createDataFrame([("T", "X", rate_cents)], "terminal_id string, tariff_code string, rate_cents long")
    return B.rate_deviation(b, t, spark.createDataFrame([], "invoice_id string")).count()


def test_rate_threshold_edges(spark):
    assert _one(spark, 10000, 15000) == 0        # 50.00 off a 100 rate: not flagged
    assert _one(spark, 10000, 15001) == 1        # 50.01: flagged
    assert _one(spark, 62000, 71300) == 0        # 93.00 off 620 (15 %): not flagged
    assert _one(spark, 62000, 71301) == 1


def _dups(spark, times):
    rows = [(f"I{i}", "T", "C", "m", "X", 100, "n", "e", False, t) for i, t in enumerate(times)]
    b = spark.createDataFrame(rows, SCHEMA)
    return sorted(r.invoice_id for r in
                  B.duplicate_charge(b, spark.createDataFrame([], "invoice_id string")).collect())


def test_duplicate_window_edges(spark):
    t0 = dt.datetime(2026, 1, 1)
    assert _dups(spark, [t0, t0 + dt.timedelta(days=14)]) == []
    assert _dups(spark, [t0, t0 + dt.timedelta(days=14) - dt.timedelta(seconds=1)]) == ["I1"]
    # three copies within 14 days: b once, c twice (no dedup)
    assert _dups(spark, [t0, t0 + dt.timedelta(days=1), t0 + dt.timedelta(days=2)]) == ["I1", "I2", "I2"]
    # earlier id later in time still pairs (the bound is symmetric)
    assert _dups(spark, [t0 + dt.timedelta(days=3), t0]) == ["I1"]


def test_band_join_matches_plain_join(spark, tables):
    from quayside.sources import adapters as A
    be = A.billing_events(tables)
    band = B.duplicate_pairs(be, within_days=400).select("first_invoice_id", "invoice_id")
    b1 = be.select(*B.DUP_KEYS, F.col("invoice_id").alias("first_invoice_id"),
                   F.col("created_ts").alias("t1"))
    plain = b1.join(be, B.DUP_KEYS).filter(
        (F.col("first_invoice_id") < F.col("invoice_id")) &
        (F.abs(F.unix_micros(F.col("created_ts").cast("timestamp")) -
               F.unix_micros(F.col("t1").cast("timestamp"))) < 400 * 86_400_000_000)
    ).select("first_invoice_id", "invoice_id")
    assert sorted(band.collect()) == sorted(plain.collect())
    assert band.count() > 0


def _random_billing(spark, seed, n=300):
    """Few keys, instants on and around the bounds of bands and of the window, repeated
    instants, NULL keys and times, times before 1970."""
    import random
    rng = random.Random(seed)
    base = dt.datetime(1969, 12, 20)
    rows = []
    for i in range(n):
        step = dt.timedelta(days=rng.choice([0, 7, 14, 14, 28, rng.randrange(60)]),
                            microseconds=rng.choice([0, 0, -1, 1, rng.randrange(10 ** 9)]))
        rows.append((f"I{i:03}", rng.choice(["T", "T", "U", None]), rng.choice(["C", "D"]), "m", "X",
                     rng.choice([100, 90_000, 50_000]), "n", "e", rng.random() < 0.2,
                     rng.choice([base + step] * 9 + [None])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


def _near_earlier(rows, r, days=14):
    return [x[0] for x in rows if None not in (*r[1:5], r[9], *x[1:5], x[9]) and x[1:5] == r[1:5]
            and x[0] < r[0] and abs(x[9] - r[9]) < dt.timedelta(days=days)]


@pytest.mark.parametrize("seed_no", [1, 2, 3])
def test_findings_by_brute_force(spark, seed_no):
    rows, billing = _random_billing(spark, seed_no)
    tariffs = spark.createDataFrame([("T", "X", 40_000)], "terminal_id string, tariff_code string, rate_cents long")
    filed = spark.createDataFrame([("I007",), ("I100",)], "invoice_id string")
    expected, listed = set(), []
    for r in rows:
        if r[8] or r[0] in ("I007", "I100"):
            continue
        twins = _near_earlier(rows, r)
        if twins:
            expected.add((r[0], "duplicate_charge", min(twins)))
            listed += [(-r[5] / 100, r[0], "duplicate_charge")] * len(twins)
        if r[1] == "T" and abs(r[5] - 40_000) > 6000:
            expected.add((r[0], "rate_deviation", None))
            listed.append((-abs(r[5] - 40_000) / 100, r[0], "rate_deviation"))
    found = B.findings(billing, tariffs, filed).select("invoice_id", "anomaly_type", "twin").collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    for limit in (1, 10, 60):
        top = B.billing_anomaly_scan(billing, tariffs, filed, limit=limit).collect()
        assert [(-r.variance_usd, r.invoice_id, r.anomaly_type) for r in top] == sorted(listed)[:limit]


def test_findings_of_nothing(spark):
    billing = spark.createDataFrame([], SCHEMA)
    tariffs = spark.createDataFrame([], "terminal_id string, tariff_code string, rate_cents long")
    assert B.findings(billing, tariffs, None).collect() == []
    assert B.billing_anomaly_scan(billing, tariffs, None).collect() == []
