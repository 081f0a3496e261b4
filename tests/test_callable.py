"""Functions called from SQL equal the DataFrame functions, NULLs and odd texts included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.functions import catalog as C
from quayside.functions import text as X
from quayside.operators import billing as B

TEXTS = [None, "", " ", "select 1", "SELECT 1;", "with a as (select 1) select * from a", "with a as (select 1) drop x",
         "select created_at from t", "select 1 -- do it", "insert into t values (1)", "```sql\nselect 1;\n```",
         "```json\n{}\n```", "Use this: CREATE UNIQUE INDEX i ON t(x); and more", "create index i on t(x)",
         "CREATE TABLE x", "mail a.b@c.io or +44 20 7946 0958, pay $1,200.50 or 15 %", "call (020) 7946 0958",
         "192.168.0.1 and 5551234567 and 555-123-4567", "€ 12 £3 50%", "a\\d 'quoted' \"double\" {x}", "ünï çödé 日本"]


def test_scalar_functions_equal_their_dataframe_twins(spark):
    assert C.register_functions(spark) == list(C.scalar_functions())
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    twins = {"is_safe_select": X.is_safe_select, "is_index_ddl": X.is_index_ddl, "extract_ddl": X.extract_ddl,
             "clean_sql": X.clean_sql, "redact_pii": X.redact}
    assert {*twins, "mask_customer_contact"} == set(C.scalar_functions())
    for name, twin in twins.items():
        got = df.select("i", F.expr(f"{name}(x)").alias("v")).collect()
        want = df.select("i", twin("x").alias("v")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), name
    names = [(n, e) for n in (None, "", "Ann", "Ann Lee", "Ann  Lee", "Ann Lee Roe", "Ö \n x")
             for e in (None, "", "ann", "ann@x.io", "a@b@c", "@x")]
    df = spark.createDataFrame(names, "n string, e string")
    got = df.select(F.expr("mask_customer_contact(n, e)").alias("v")).collect()
    assert got == df.select(X.mask_contact("n", "e").alias("v")).collect()


def test_calls_are_inlined(spark, tables):
    C.register_functions(spark)
    tables.customer.createOrReplaceTempView("inlined_customers")
    plan = spark.sql("SELECT mask_customer_contact(c_name, c_name) AS m FROM inlined_customers WHERE c_custkey = 5") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,5)" in plan and "Python" not in plan


@pytest.mark.parametrize("limit", [0, 1, 10, 500])
def test_anomaly_scan_from_sql(spark, tables, limit):
    from quayside.plans.billing import _base
    be, rates, filed = _base(tables)
    C.register_anomaly_scan(spark, be, rates, filed)
    got = spark.sql(f"SELECT * FROM anomaly_scan({limit})")
    want = B.billing_anomaly_scan(be, rates, filed, limit=limit) if limit else None
    assert got.count() == limit
    if want is not None:
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_anomaly_scan_repeats_a_duplicate_per_twin(spark):
    t0 = dt.datetime(2026, 1, 1)
    be = spark.createDataFrame([(i, 1, 7, "load", "STD", 100_000 + i, "c", False, t0 + dt.timedelta(hours=i))
                                for i in range(5)],
                               "invoice_id long, terminal_id long, container_id long, move_type string, tariff_code "
                               "string, amount_cents long, customer_name string, dispute_flag boolean, "
                               "created_ts timestamp_ntz")
    rates = spark.createDataFrame([(1, "STD", 100_000)], "terminal_id long, tariff_code string, rate_cents long")
    C.register_anomaly_scan(spark, be, rates, None, name="small_scan")
    ids = [r.invoice_id for r in spark.sql("SELECT * FROM small_scan(8) ORDER BY variance_usd DESC").collect()]
    assert ids == [4, 4, 4, 4, 3, 3, 3, 2]
    joined = spark.sql("SELECT count(*) FROM small_scan(100) s JOIN small_scan_invoices USING (invoice_id)").first()
    assert joined[0] == 10
