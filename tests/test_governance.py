import pytest

from quayside.functions import text as X


def _eval(spark, expr_fn, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr_fn(df)).collect()]


def test_mask_contact(spark):
    rows = [("Desert Star Logistics LLC", "youssef.haddad@desertstarlogistics.example"),
            ("Mono", "a@b.example"), ("A B", "noat"), (None, "x@y"), ("N", None)]
    got = _eval(spark, lambda d: X.mask_contact("n", "e"), rows, "n string, e string")
    assert got == ["D***** S***  <y*************@desertstarlogistics.example>",
                   "M***   <a@b.example>", "A B  <n***@>", None, None]


ACCEPT = ["select 1", "WITH a AS (select 1) SELECT * FROM a",
          "WITH a AS (\n  select 1\n)\nSELECT *\nFROM a", "select update_ts from t",
          "select pg_sleep_for(1)"]
REJECT = ["select 1; drop table x", "delete from x", "explain select 1", "(select 1)",
          " selectx 1", "select * from t where n='please update'"]


def test_safe_select(spark):
    got = _eval(spark, lambda d: X.is_safe_select("s"), [(s,) for s in ACCEPT + REJECT], "s string")
    assert got == [True] * len(ACCEPT) + [False] * len(REJECT)


def test_ddl_extract_and_guard(spark):
    rows = [("Sure:\n```sql\nCREATE INDEX idx_c ON container_moves (container_id);\n```",),
            ("  create unique index u on t(a);",), ("no ddl here  ",)]
    df = spark.createDataFrame(rows, "r string")
    got = df.select(X.extract_ddl("r").alias("d"), X.is_index_ddl("r").alias("g")).collect()
    assert got[0].d == "CREATE INDEX idx_c ON container_moves (container_id);" and not got[0].g
    assert got[1].d == "create unique index u on t(a);" and got[1].g
    assert got[2].d == "no ddl here" and not got[2].g


def test_clean_sql(spark):
    got = _eval(spark, lambda d: X.clean_sql("s"), [("```sql\nselect 1;\n```",), ("select 2 ;  ",)],
                "s string")
    assert got == ["select 1", "select 2 "]     # the space before ";" stays, as in the reference


def test_pg_substring_null_on_no_match(spark):
    got = _eval(spark, lambda d: X.pg_substring("p", X.EXEC_TIME),
                [("Planning\nExecution Time: 12.5 ms",), ("nothing",)], "p string")
    assert got == ["12.5", None]


@pytest.mark.parametrize("text,expected", [
    ("mail me at jo.doe@corp.example now", "mail me at [REDACTED] now"),
    ("call +1 555-010-9999 today", "call [REDACTED] today"),
    ("we paid $1,250.00 and 15% off", "we paid [REDACTED] and [REDACTED] off"),
    ("at +1 (293) 555-9179, or (293) 555 9179", "at [REDACTED], or [REDACTED]"),
    ("card 4467920212765298 from 141.168.246.231", "card 4467920212765298 from 141.168.246.231"),
    ("nothing to hide", "nothing to hide"),
])
def test_redact(spark, text, expected):
    assert _eval(spark, lambda d: X.redact("t"), [(text,)], "t string") == [expected]


def test_triage_rules(spark):
    from quayside.operators import governance as G
    rows = [("demurrage past free time", 100), ("billed twice", 20_000_000), ("VGM mismatch", 40_000_000),
            ("dented door", 1), ("why?", 1)]
    df = spark.createDataFrame(rows, "dispute_reason string, amount_cents long")
    got = [(r.dispute_category, r.dispute_risk) for r in G.triage(df).collect()]
    assert got == [("Demurrage Dispute", "Low"), ("Duplicate Charge", "Medium"),
                   ("Weighbridge Discrepancy", "High"), ("Damage Claim", "Low"), ("Other", "Low")]
    assert {c for c, _ in got} <= set(G.CATEGORIES)


def _guarded(spark, statements):
    from quayside.operators import governance as G
    df = spark.createDataFrame([(i, f"k{i}", i / 2) for i in range(3000)], "id long, k string, v double")
    results, log = G.run_guarded(spark, statements, {"tiny_view": df.select("id", "v")})
    return results, {r.question: r for r in log.collect()}


def test_guarded_runner_returns_every_row(spark):
    results, log = _guarded(spark, [
        ("sum", "```sql\nSELECT sum(v) AS s FROM tiny_view;\n```"), ("all", "SELECT id FROM tiny_view"),
        ("none", "SELECT id FROM tiny_view WHERE id < 0")])
    rows = results.collect()
    assert [r.row_json for r in rows if r.question == "sum"] == ['{"s":2249250.0}']
    assert {r.row_json for r in rows if r.question == "all"} == {f'{{"id":{i}}}' for i in range(3000)}
    assert {q: (r.status, r.row_count) for q, r in log.items()} == {
        "sum": ("ok", 1), "all": ("ok", 3000), "none": ("ok", 0)}


@pytest.mark.parametrize("sql", [
    "DROP TABLE tiny_view", "SELECT 1; SELECT 2", "SELECT k FROM tiny_view", "SELECT * FROM customer_view",
    "SELECT c_name FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
    "SELECT * FROM `parquet`.`file:///root/testdata/sf0.001/customer.parquet`",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT * FROM global_temp.shared_view", "WITH x AS (SELECT 1) SELECT c_name FROM customer_view"])
def test_guarded_runner_is_a_boundary(spark, tables, sql):
    tables.customer.createOrReplaceTempView("customer_view")
    tables.customer.createOrReplaceGlobalTempView("shared_view")
    results, log = _guarded(spark, [("q", sql)])
    assert results.count() == 0 and log["q"].status.startswith(("rejected", "error")) and log["q"].row_count is None


@pytest.mark.parametrize("sql", [
    "SELECT (SELECT max(c_name) FROM default.secret_names) AS m FROM tiny_view",
    "SELECT id FROM tiny_view WHERE EXISTS(SELECT 1 FROM default.secret_names)",
    "SELECT id FROM tiny_view t WHERE EXISTS(SELECT 1 FROM default.secret_names s WHERE s.c_name = CAST(t.id AS STRING))",
    "SELECT id FROM tiny_view WHERE v IN (SELECT length(c_name) FROM default.secret_names)",
    "SELECT id FROM tiny_view WHERE v > (SELECT min(length(c_name)) FROM spark_catalog.default.secret_names)",
    "WITH s AS (SELECT c_name FROM default.secret_names) SELECT t.id, (SELECT first(c_name) FROM s) FROM tiny_view t",
    "SELECT id FROM tiny_view UNION ALL SELECT length(c_name) FROM default.secret_names",
    "SELECT id, (SELECT (SELECT max(c_name) FROM default.secret_names) FROM tiny_view LIMIT 1) FROM tiny_view",
    "SELECT t.id, l.c_name FROM tiny_view t, LATERAL (SELECT c_name FROM default.secret_names) l",
    "SELECT id, CASE WHEN id < 0 THEN (SELECT max(c_name) FROM default.secret_names) END FROM tiny_view",
    "SELECT c_name FROM default.secret_names", "SELECT max(c_name) FROM secret_names"])
def test_no_subquery_reads_beyond_the_views(spark, sql):
    spark.createDataFrame([("Jane Doe",)], "c_name string").write.mode("overwrite").saveAsTable("default.secret_names")
    try:
        results, log = _guarded(spark, [("q", sql), ("fine", "SELECT (SELECT max(id) FROM tiny_view) AS m")])
        assert [r.row_json for r in results.collect()] == ['{"m":2999}']
        assert log["q"].status.startswith(("rejected", "error")) and log["q"].row_count is None
        assert (log["fine"].status, log["fine"].row_count) == ("ok", 1)
    finally:
        spark.sql("DROP TABLE default.secret_names")


def test_a_statement_that_fails_costs_only_itself(spark):
    results, log = _guarded(spark, [
        ("bad", "SELECT 1 div (id - id) AS y FROM tiny_view"), ("good", "SELECT count(*) AS n FROM tiny_view"),
        ("own", "SELECT 1 AS one"), ("range", "SELECT sum(id) AS s FROM range(5)")])
    assert sorted((r.question, r.row_json) for r in results.collect()) == [
        ("good", '{"n":3000}'), ("own", '{"one":1}'), ("range", '{"s":10}')]
    assert log["bad"].status.startswith("error") and log["bad"].row_count is None
    assert [log[q].row_count for q in ("good", "own", "range")] == [1, 1, 1]


def test_triage_keeps_earlier_classes_and_logs_replies(spark):
    import datetime as dt
    import json

    from quayside.operators import governance as G
    cols = ("invoice_id long, dispute_flag boolean, dispute_reason string, amount_cents long, created_ts timestamp_ntz, "
            "dispute_category string, dispute_risk string, dispute_risk_rationale string")
    day = dt.datetime(2026, 1, 1)
    be = spark.createDataFrame([
        (1, True, "billed twice", 40_000_000, day, None, None, None),
        (2, True, "billed twice", 1, day, "Other", "Low", "by hand"),
        (3, False, None, 1, day, None, None, None)], cols)
    new = G.triage(G.triage_queue(be))
    assert [r.invoice_id for r in new.collect()] == [1]
    after = {r.invoice_id: (r.dispute_category, r.dispute_risk) for r in G.triage_write_back(be, new).collect()}
    assert after == {1: ("Duplicate Charge", "High"), 2: ("Other", "Low"), 3: (None, None)}
    row = G.triage_audit(new).first()
    assert row.subject_id == "1" and json.loads(row.output_summary)["category"] == "Duplicate Charge"


def test_names_are_redacted_and_one_bad_prompt_costs_one_row(spark):
    from quayside.operators import governance as G
    from quayside.operators import model as M
    df = spark.createDataFrame([(1, "Ann Lee and Bo wrote", ["Ann Lee", "Bo"]), (2, "nobody", []), (3, None, ["Bo"])],
                               "id long, text string, names array<string>")
    got = {r.id: r.redacted for r in G.redact_names(df, "text", "names").collect()}
    assert got == {1: "[REDACTED] and [REDACTED] wrote", 2: "nobody", 3: None}

    class Fragile(M.RuleBackend):
        def _one(self, p):
            if p == "bad":
                raise ValueError("no answer")
            return super()._one(p)

    rows = M.run_model(spark.createDataFrame([("good",), ("bad",), ("fine",)], "prompt string").coalesce(1),
                       backend=Fragile).collect()
    assert [(r.reply is None, r.model_error) for r in rows] == [
        (False, None), (True, "ValueError: no answer"), (False, None)]


def test_small_text_helpers(spark):
    df = spark.createDataFrame([("a, b ,c", "1b2c3d4e-5f60-7182", None)], "l string, sid string, n string")
    r = df.select(X.split_list("l").alias("parts"), X.short_id("sid").alias("short"),
                  X.pg_text("n").alias("txt")).first()
    assert list(r.parts) == ["a", "b", "c"] and r.short == "1b2c3d4e" and r.txt == ""
