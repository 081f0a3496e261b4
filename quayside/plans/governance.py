"""Governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import billing as B
from ..operators import governance as G
from ..operators import names as N
from ..operators import relational as R
from ..sources import adapters as A
from .billing import BASE, DUP_ARM, RATE_ARM, _base
from ..sources.tables import spread
from .registry import query, set_oracle
from .views_sql import with_views

def _star(x):
    """First character, then one star per further character."""
    return f"(substr({x}, 1, 1) || rpad('', CAST(greatest(length({x}), 1) - 1 AS INTEGER), '*'))"


def _mask_sql(n, e):
    """The rule in words: two words of the name and the part before the @ keep their
    first letter; missing parts are empty; NULL gives NULL."""
    def word(k):
        return f"coalesce(string_split({n}, ' ')[{k}], '')"
    local = f"string_split({e}, '@')[1]"
    shown = f"concat_ws('', {_star(word(1))}, ' ', {_star(word(2))}, '  <', {_star(local)}, '@', " \
            f"string_split({e}, '@')[2], '>')"
    return f"CASE WHEN {n} IS NOT NULL AND {e} IS NOT NULL THEN {shown} END"


@query("mask_contact", f"""
SELECT 'customer' AS source, c_custkey AS id,
       {_mask_sql('c_name', "lower(replace(c_name, '#', '.')) || '@example.com'")} AS masked
FROM customer
UNION ALL
SELECT 'part', p_partkey, {_mask_sql('p_name', "lower(replace(p_name, ' ', '.')) || '@parts.example'")}
FROM part""")
def mask_contact(t):
    """D12 + F1-F3: deterministic contact masking as one native expression."""
    c = t.customer.select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"),
        X.mask_contact("c_name", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
                                          F.lit("@example.com"))).alias("masked"))
    p = t.part.select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("id"),
        X.mask_contact("p_name", F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("."))),
                                          F.lit("@parts.example"))).alias("masked"))
    return c.unionByName(p)


def triaged(t):
    """Billing with the triage of all open disputes written back."""
    be = A.billing_triage(t)
    return G.triage_write_back(be, G.triage(G.triage_queue(be)))


@query("masked_view", None)
def masked_view(t):
    """D13 + S11 + P12: the masked billing view (PII columns dropped)."""
    v = G.masked_view(triaged(t))
    v.createOrReplaceTempView("billing_events_masked")
    return t.spark.table("billing_events_masked")


@query("restricted_view", None)
def restricted_view(t):
    """The allow-listed billing columns of disputed invoices."""
    be = triaged(t).withColumn("amount_usd", A.usd("amount_cents"))
    G.restricted_view(t.spark, be, "billing_restricted", G.BILLING_ALLOW)
    return t.spark.sql("SELECT * FROM billing_restricted WHERE dispute_flag")


@query("redact_pii", f"SELECT doc_id, {X.redact_sql('text')} AS redacted FROM documents")
def redact_pii(t):
    """Pattern redaction of e-mails, phones, money and percentages over
    whole document texts (names: ``redact_names``)."""
    return spread(t.documents.select("doc_id", "text")).select(
        "doc_id", X.redact("text").alias("redacted"))


def _triage_sql(text, amount):
    cases = " ".join(f"WHEN regexp_matches({text}, '{pat}') THEN '{cat}'"
                     for cat, pat in G.TRIAGE_RULES)
    cat = f"CASE {cases} ELSE 'Other' END"
    risk = (f"CASE WHEN {amount} >= {G.HIGH_CENTS} THEN 'High' "
            f"WHEN {amount} >= {G.MEDIUM_CENTS} THEN 'Medium' ELSE 'Low' END")
    return cat, risk


_CAT, _RISK = _triage_sql("dispute_reason", "amount_cents")


TRIAGED = f"""
SELECT * EXCLUDE (dispute_category, dispute_risk, dispute_risk_rationale, c, r),
       coalesce(dispute_category, c) AS dispute_category, coalesce(dispute_risk, r) AS dispute_risk,
       coalesce(dispute_risk_rationale, 'Rule triage: ' || c || ' from the dispute text, ' || lower(r)
                || ' risk by amount.') AS dispute_risk_rationale,
       c IS NOT NULL AS is_new
FROM (SELECT *, CASE WHEN open THEN {_CAT} END AS c, CASE WHEN open THEN {_RISK} END AS r
      FROM (SELECT *, dispute_flag AND dispute_category IS NULL AS open FROM billing_triage) q) x"""


def with_triage(body):
    return with_views(body, "billing_triage", extra=(("triaged", TRIAGED),))


_COLS = ", ".join(c if c != "amount_usd" else "CAST(amount_cents AS DOUBLE) / 100 AS amount_usd"
                  for c in G.BILLING_ALLOW)
set_oracle("masked_view", with_triage(f"""
SELECT invoice_id, terminal_id, container_id, move_type, tariff_code,
       CAST(amount_cents AS DOUBLE) / 100 AS amount_usd,
       {_mask_sql('customer_name', 'customer_email')} AS customer_contact_masked,
       dispute_flag, dispute_category, dispute_risk, dispute_risk_rationale, created_ts
FROM triaged"""))
set_oracle("restricted_view", with_triage(f"SELECT {_COLS} FROM triaged WHERE dispute_flag"))


@query("dispute_triage", with_triage("""
SELECT invoice_id, dispute_category, dispute_risk, dispute_risk_rationale FROM triaged WHERE is_new"""))
def dispute_triage(t):
    """D11 + P4: every flagged, unclassified dispute gets category, risk and rationale."""
    return G.triage(G.triage_queue(A.billing_triage(t))).select("invoice_id", *G.TRIAGE_COLS)


@query("triage_write_back", with_triage("""
SELECT invoice_id, dispute_flag, dispute_category, dispute_risk, dispute_risk_rationale FROM triaged"""))
def triage_write_back(t):
    """The whole billing snapshot after triage; earlier classifications stay."""
    return triaged(t).select("invoice_id", "dispute_flag", *G.TRIAGE_COLS)


@query("triage_audit", with_triage("""
SELECT created_ts AS called_at, 'classify_dispute' AS function_name, 'rules' AS model_name,
       CAST(invoice_id AS VARCHAR) AS subject_id, dispute_reason AS input_summary,
       '{"category":"' || dispute_category || '","risk":"' || dispute_risk || '","rationale":"'
         || dispute_risk_rationale || '"}' AS output_summary
FROM triaged WHERE is_new"""))
def triage_audit(t):
    """The audit row of every classified dispute, with the whole reply."""
    return G.triage_audit(G.triage(G.triage_queue(A.billing_triage(t))))


@query("redact_names", with_views("""
SELECT invoice_id, replace('Dispute of ' || customer_name || ': ' || dispute_reason, customer_name, '[REDACTED]')
       AS redacted, CAST(NULL AS VARCHAR) AS model_error
FROM billing_events WHERE dispute_flag""", "billing_events"))
def redact_names(t):
    """Customer names taken out of dispute texts through the model interface."""
    be = A.billing_events(t).filter("dispute_flag")
    texts = be.select("invoice_id", F.array("customer_name").alias("names"), F.concat(
        F.lit("Dispute of "), F.col("customer_name"), F.lit(": "), F.col("dispute_reason")).alias("text"))
    return G.redact_names(texts, "text", "names").select("invoice_id", "redacted", "model_error")


# Complaints: disputes that name their customer in several ways, or nobody, and the part
# that the order's number picks; (condition on invoice_id, text) pairs of both engines.
COMPLAINTS = """
SELECT b.invoice_id, b.created_ts, CASE b.invoice_id % 4
    WHEN 0 THEN concat('Complaint of ', b.customer_name, ': ', b.dispute_reason, ', paid $', CAST(b.invoice_id AS STRING), '.')
    WHEN 1 THEN concat(upper(replace(b.customer_name, '#', ' / ')), ', for a ', p.p_name, ' (', b.dispute_reason, ')')
    WHEN 2 THEN concat(b.dispute_reason, ' - no name, call +1 555-010-', CAST(1000 + b.invoice_id % 9000 AS STRING))
    END AS complaint
FROM billing b JOIN part p ON p.p_partkey = b.container_id WHERE b.dispute_flag"""

_COMPLAINTS = COMPLAINTS.replace("AS STRING", "AS VARCHAR").replace("billing b", "billing_events b")
# Every window of as many words as some name has, joined with all names; a piece of the text
# is shown as the mark if a name begins there and none that began earlier reaches it.
_UNNAMED = """
WITH known AS (
  SELECT DISTINCT lower(array_to_string(regexp_extract_all(n, '[\\p{L}\\p{N}]+'), ' ')) AS name
  FROM (SELECT c_name AS n FROM customer UNION ALL SELECT p_name FROM part) a),
lens AS (SELECT DISTINCT len(string_split(name, ' ')) AS k FROM known WHERE name <> ''),
texts AS (SELECT DISTINCT complaint AS t, regexp_extract_all(complaint, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS ps
          FROM complaints WHERE complaint IS NOT NULL),
pieces AS (SELECT t, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM texts),
runs AS (SELECT t, i, k, ps[i:i + 2 * k - 2] AS run FROM texts, lens, unnest(range(1, len(ps) + 1)) u(i)
         WHERE i + 2 * k - 2 <= len(ps) AND regexp_matches(ps[i], '^[\\p{L}\\p{N}]')),
spans AS (SELECT t, i AS a, i + 2 * k - 2 AS b FROM runs
          WHERE lower(array_to_string(regexp_extract_all(array_to_string(run, ''), '[\\p{L}\\p{N}]+'), ' '))
                IN (SELECT name FROM known)),
shown AS (SELECT p.t, p.i, any_value(p.p) AS p, coalesce(bool_or(s.a = p.i), false) AS starts,
                 coalesce(bool_or(s.a < p.i), false) AS inside
          FROM pieces p LEFT JOIN spans s ON s.t = p.t AND p.i BETWEEN s.a AND s.b GROUP BY p.t, p.i),
unnamed AS (SELECT t, string_agg(CASE WHEN inside THEN '' WHEN starts THEN '[REDACTED]' ELSE p END, '' ORDER BY i) AS redacted,
                   CAST(count(*) FILTER (WHERE starts AND NOT inside) AS INTEGER) AS n_names
            FROM shown GROUP BY t)
"""


def _with_complaints(body):
    return with_views(body, "billing_events", extra=(("complaints", _COMPLAINTS), ("unnamed", f"{_UNNAMED} SELECT * FROM unnamed")))


def complaints(t):
    return t.spark.sql(COMPLAINTS.replace("billing b", "{billing} b").replace("JOIN part", "JOIN {part}"),
                       billing=A.billing_events(t), part=t.part)


def all_names(t):
    return t.customer.select(F.col("c_name").alias("name")).union(t.part.select("p_name"))


@query("redact_known_names", _with_complaints("""
SELECT c.invoice_id, u.redacted, u.n_names FROM complaints c LEFT JOIN unnamed u ON u.t = c.complaint"""))
def redact_known_names(t):
    """All names of customers and parts, found in complaints that come without a list."""
    return N.redact_known_names(complaints(t), "complaint", all_names(t), "name") \
        .select("invoice_id", "redacted", "n_names")


@query("redaction_audit", _with_complaints(f"""
SELECT c.created_ts AS called_at, 'redact_free_text' AS function_name, 'rules' AS model_name,
       CAST(c.invoice_id AS VARCHAR) AS subject_id, c.complaint AS input_summary,
       {X.redact_sql('u.redacted')} AS output_summary
FROM complaints c LEFT JOIN unnamed u ON u.t = c.complaint"""))
def redaction_audit(t):
    """An audit row for each redaction call, with whole input and output."""
    return N.redaction_audit(complaints(t), "complaint", all_names(t), "name", "invoice_id", "created_ts")


_FORBID = "|".join(X.FORBIDDEN_WORDS)


@query("safe_select_guard", f"""
SELECT conv_id, turn,
       NOT regexp_matches(text, ';')
       AND regexp_matches(text, '(?is)^\\s*(with\\b.*\\)\\s*)?select\\b')
       AND NOT regexp_matches(text, '(?i)\\b({_FORBID})\\b') AS is_safe
FROM conversations""")
def safe_select_guard(t):
    """G1 + P9: the read-only guard over a column of text (all conversation turns)."""
    return t.conversations.select("conv_id", "turn", X.is_safe_select("text").alias("is_safe"))


@query("extract_ddl", """
SELECT conv_id, turn,
       nullif(regexp_extract(text, '(?i)(CREATE\\s+(?:UNIQUE\\s+)?INDEX\\b[^;]*;)', 1), '') AS ddl,
       regexp_matches(text, '(?i)^\\s*CREATE\\s+(UNIQUE\\s+)?INDEX\\b') AS is_index_ddl
FROM conversations""")
def extract_ddl(t):
    """D18 + P10 + F6: first CREATE INDEX statement in each reply (NULL when
    none) and the DDL guard on the reply itself."""
    c = t.conversations
    return c.select("conv_id", "turn", X.pg_substring("text", X.DDL_EXTRACT).alias("ddl"),
                    X.is_index_ddl("text").alias("is_index_ddl"))


# Statements over the order keys: each form that the guard must accept or refuse, fenced
# and unfenced, and DDL in several places.
FORMS = ["SELECT * FROM invoices WHERE id = #", "WITH b AS (SELECT # AS n)\nSELECT n FROM b",
         "SELECT #; DROP TABLE invoices", "delete from invoices where id = #",
         "```sql\nSELECT # AS n;\n```", "Sure:\n```sql\nCREATE INDEX idx_# ON moves (container_id);\n```",
         "create unique index u_# on moves (id);", "EXPLAIN SELECT #", "  no statement for #  "]


def raw_statements(t):
    """(id, raw): one statement of some form per order."""
    forms = F.array(*[F.lit(f) for f in FORMS])
    key = F.col("o_orderkey")
    return t.orders.select(key.alias("id"), F.replace(
        F.element_at(forms, (key % len(FORMS)).cast("int") + 1), F.lit("#"), key.cast("string")).alias("raw"))


@query("statement_checks", rf"""
WITH s AS (SELECT o_orderkey AS id, replace([{', '.join("'" + f.replace(chr(10), "' || chr(10) || '") + "'" for f in FORMS)}]
             [1 + CAST(o_orderkey % {len(FORMS)} AS INTEGER)], '#', CAST(o_orderkey AS VARCHAR)) AS raw FROM orders),
c AS (SELECT id, raw, regexp_replace(trim(regexp_replace(trim(raw), '(?i)^```(json|sql)?\s*|\s*```$', '', 'g')),
                                     ';\s*$', '') AS clean FROM s),
d AS (SELECT *, nullif(regexp_extract(raw, '(?i)(CREATE\s+(?:UNIQUE\s+)?INDEX\b[^;]*;)', 1), '') AS found FROM c)
SELECT id, clean, NOT contains(clean, ';') AND regexp_matches(clean, '(?is)^\s*(with\b.*\)\s*)?select\b')
       AND NOT regexp_matches(clean, '(?i)\b({_FORBID})\b') AS is_safe,
       found IS NOT NULL AS has_ddl, coalesce(found, trim(raw)) AS ddl,
       regexp_matches(coalesce(found, trim(raw)), '(?i)^\s*CREATE\s+(UNIQUE\s+)?INDEX\b') AS is_index_ddl
FROM d""")
def statement_checks(t):
    """Cleaning, guard and DDL extraction over statements of
    every form (fenced, stacked, read-only, DDL, none)."""
    s = raw_statements(t)
    ddl = X.extract_ddl("raw")
    return s.select("id", X.clean_sql("raw").alias("clean"), X.is_safe_select(X.clean_sql("raw")).alias("is_safe"),
                    X.pg_substring("raw", X.DDL_EXTRACT).isNotNull().alias("has_ddl"), ddl.alias("ddl"),
                    X.is_index_ddl(ddl).alias("is_index_ddl"))


GLOSSARY = """
SELECT g.tariff_code AS term,
       'tariff billed on ' || CAST(g.n AS VARCHAR) || ' invoices, mean charge '
         || CAST((2 * g.s + g.n) // (2 * g.n) AS VARCHAR) || ' cents' AS definition,
       CASE WHEN r.hi * 10 > r.lo * 11 THEN 'terminal rates range from ' || CAST(r.lo AS VARCHAR)
            || ' to ' || CAST(r.hi AS VARCHAR) || ' cents' END AS note
FROM (SELECT tariff_code, count(*) AS n, sum(amount_cents) AS s FROM billing_events GROUP BY tariff_code) g
JOIN (SELECT tariff_code, min(rate_cents) AS lo, max(rate_cents) AS hi FROM tariff_rates
      GROUP BY tariff_code) r ON r.tariff_code = g.tariff_code"""


@query("glossary_text", with_views(f"""
SELECT string_agg('- ' || term || ': ' || definition || coalesce('  (Note: ' || note || ')', ''),
                  chr(10) ORDER BY term) AS glossary
FROM ({GLOSSARY}) g""", "billing_events", "tariff_rates"))
def glossary_text(t):
    """D21 + A7: the glossary block of a prompt, one term per tariff code with
    its usage and a terminal-variance note, aggregated from the billing fact
    (the glossary itself is bounded by the number of tariff codes)."""
    be = A.billing_events(t)
    g = be.groupBy("tariff_code").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("s"))
    r = A.tariff_rates(be).groupBy("tariff_code").agg(F.min("rate_cents").alias("lo"),
                                                      F.max("rate_cents").alias("hi"))
    terms = g.join(r, "tariff_code").select(
        F.col("tariff_code").alias("term"),
        F.concat(F.lit("tariff billed on "), F.col("n").cast("string"), F.lit(" invoices, mean charge "),
                 F.expr("(2 * s + n) div (2 * n)").cast("string"), F.lit(" cents")).alias("definition"),
        F.when(F.col("hi") * 10 > F.col("lo") * 11,
               F.concat(F.lit("terminal rates range from "), F.col("lo").cast("string"),
                        F.lit(" to "), F.col("hi").cast("string"), F.lit(" cents"))).alias("note"))
    return G.glossary_text(terms)


@query("activity_trace", """
SELECT conv_id, turn, role, left(text, 90) AS query FROM conversations
WHERE role LIKE 'assist%' ORDER BY conv_id, turn""")
def activity_trace(t):
    """D23 + P5: entries with a prefix, text cut to 90 characters, ordered."""
    return G.activity_trace(t.conversations, "role", "assist", "text", ["conv_id", "turn"])


@query("rows_to_json", with_views(f"""
SELECT row_number() OVER (ORDER BY variance_usd DESC, invoice_id, anomaly_type) AS place,
       '{{"invoice_id":' || invoice_id || ',"anomaly_type":"' || anomaly_type || '","tariff_code":"' || tariff_code
       || '","customer_name":"' || customer_name || '"}}' AS row_json, 10 AS row_count
FROM (SELECT * FROM ({RATE_ARM} UNION ALL {DUP_ARM}) u
      ORDER BY variance_usd DESC, invoice_id, anomaly_type LIMIT 10) x""", *BASE))
def rows_to_json(t):
    """A8 + A9: the (bounded, top-10) scan result as one JSON array and its length, then
    read back element by element."""
    scan = B.billing_anomaly_scan(*_base(t)).select("invoice_id", "anomaly_type", "tariff_code", "customer_name")
    packed = R.rows_to_json(scan)
    item = "struct<invoice_id:bigint,anomaly_type:string,tariff_code:string,customer_name:string>"
    return packed.select(F.posexplode(F.from_json("result_json", f"array<{item}>")).alias("place", "r"), "row_count") \
        .select((F.col("place") + 1).cast("long").alias("place"), F.to_json("r").alias("row_json"), "row_count")


# Columns that generated SQL may see, table by table (fixed values).
VISIBLE = {
    "terminals": ["terminal_id", "terminal_name", "region_id"],
    "gate_transactions": ["txn_id", "terminal_id", "truck_id", "gate_in_ts", "turn_time_minutes", "move_type"],
    "berth_calls": ["call_id", "berth_id", "actual_arrival", "etd", "actual_departure", "moves"],
    "container_moves": ["move_id", "terminal_id", "container_id", "move_type", "event_ts", "crane_id", "is_rehandle"],
    "crane_telemetry": ["reading_id", "crane_id", "ts", "vibration_g", "temperature_c"],
    "work_orders": ["work_order_id", "family", "language", "n_chars"],
    "billing_events": G.BILLING_ALLOW,
}


def visible_tables(t):
    """The seven tables of the text-to-SQL step with their listed columns."""
    frames = {
        "terminals": t.nation.select(F.col("n_nationkey").alias("terminal_id"), F.col("n_name").alias("terminal_name"),
                                     F.col("n_regionkey").alias("region_id")),
        "gate_transactions": A.gate_transactions(t), "berth_calls": A.berth_calls(t),
        "container_moves": A.container_moves(t), "crane_telemetry": A.crane_telemetry(t),
        "work_orders": t.documents.select(F.col("doc_id").alias("work_order_id"), F.col("source").alias("family"),
                                          F.col("lang").alias("language"), "n_chars"),
        "billing_events": triaged(t).withColumn("amount_usd", A.usd("amount_cents")),
    }
    return {name: df.select(*VISIBLE[name]) for name, df in frames.items()}


# Statements for the guarded runner: reads of every table, one of them fenced with a
# trailing ';', and statements that must be refused or fail.
GUARDED = [
    ("disputes by tariff", "SELECT tariff_code, count(*) AS n FROM billing_events WHERE dispute_flag "
                           "GROUP BY tariff_code"),
    ("all invoices", "```sql\nSELECT invoice_id, dispute_category FROM billing_events;\n```"),
    ("volume", "WITH m AS (SELECT * FROM container_moves) SELECT count(*) AS n FROM m"),
    ("gates and names", "SELECT t.terminal_name, count(*) AS n FROM gate_transactions g JOIN terminals t "
                        "ON t.terminal_id = g.terminal_id GROUP BY t.terminal_name"),
    ("calls", "SELECT berth_id, count(*) AS n FROM berth_calls GROUP BY berth_id"),
    ("readings", "SELECT crane_id, count(*) AS n FROM crane_telemetry GROUP BY crane_id"),
    ("orders by family", "SELECT family, count(*) AS n FROM work_orders GROUP BY family"),
    ("nothing", "SELECT invoice_id FROM billing_events WHERE invoice_id < 0"),
    ("drop it", "SELECT 1; DROP TABLE billing_events"),
    ("delete", "DELETE FROM billing_events"),
    ("explain", "EXPLAIN SELECT 1"),
    ("hidden column", "SELECT customer_name FROM billing_events"),
    ("other table", "SELECT c_name FROM customer"),
    ("file", "SELECT c_name FROM parquet.`/root/testdata/sf0.001/customer.parquet`"),
    ("machine", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')"),
]


def _json_sql(*cols):
    """Row object of (name, SQL text of the JSON value) pairs."""
    inner = " || ',' || ".join(f"'\"{n}\":' || {v}" for n, v in cols)
    return "'{' || " + inner + " || '}'"


def _quoted(c):
    return f"coalesce('\"' || {c} || '\"', 'null')"


_RESULTS = " UNION ALL ".join(f"SELECT '{q}' AS question, {js} AS row_json FROM ({body}) x" for q, js, body in [
    ("disputes by tariff", _json_sql(("tariff_code", _quoted("tariff_code")), ("n", "n")),
     "SELECT tariff_code, count(*) AS n FROM triaged WHERE dispute_flag GROUP BY tariff_code"),
    ("all invoices", _json_sql(("invoice_id", "invoice_id"), ("dispute_category", _quoted("dispute_category"))),
     "SELECT * FROM triaged"),
    ("volume", _json_sql(("n", "n")), "SELECT count(*) AS n FROM events"),
    ("gates and names", _json_sql(("terminal_name", _quoted("n_name")), ("n", "n")),
     "SELECT n_name, count(*) AS n FROM gate_transactions g JOIN nation ON n_nationkey = g.terminal_id GROUP BY n_name"),
    ("calls", _json_sql(("berth_id", _quoted("berth_id")), ("n", "n")),
     "SELECT berth_id, count(*) AS n FROM berth_calls GROUP BY berth_id"),
    ("readings", _json_sql(("crane_id", _quoted("crane_id")), ("n", "n")),
     "SELECT crane_id, count(*) AS n FROM crane_telemetry GROUP BY crane_id"),
    ("orders by family", _json_sql(("family", _quoted("source")), ("n", "n")),
     "SELECT source, count(*) AS n FROM documents GROUP BY source"),
])
_STATUS = {"drop it": "rejected: not a plain SELECT", "delete": "rejected: not a plain SELECT",
           "explain": "rejected: not a plain SELECT", "hidden column": "error: AnalysisException",
           "other table": "error: AnalysisException", "file": "error: AnalysisException",
           "machine": "rejected: reaches beyond the views"}
_GUARD_VIEWS = ("billing_triage", "gate_transactions", "berth_calls", "crane_telemetry")


_SNAPSHOTS: dict[tuple[str, str], G.StoredViews] = {}


def snapshot(t) -> G.StoredViews:
    """The views of these tables, stored once per application."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = G.store_views(t.spark, visible_tables(t))
    return _SNAPSHOTS[key]


@query("guarded_sql", with_views(_RESULTS, *_GUARD_VIEWS, extra=(("triaged", TRIAGED),)))
def guarded_sql(t):
    """Clean -> guard -> run in a session of restricted views -> one JSON row per
    result row, of any number."""
    return G.run_guarded(t.spark, GUARDED, snapshot(t))[0]


@query("guarded_log", with_views(
    "SELECT s.question, s.status, CASE WHEN s.status = 'ok' THEN coalesce(c.n, 0) END AS row_count FROM (VALUES "
    + ", ".join(f"('{q}', '{_STATUS.get(q, 'ok')}')" for q, _ in GUARDED)
    + f") s(question, status) LEFT JOIN (SELECT question, count(*) AS n FROM ({_RESULTS}) u GROUP BY question) c "
      "ON c.question = s.question", *_GUARD_VIEWS, extra=(("triaged", TRIAGED),)))
def guarded_log(t):
    """The log of the same run: every statement with its fate and its row count."""
    return G.run_guarded(t.spark, GUARDED, snapshot(t))[1].drop("generated_sql")


@query("triage_model")
def triage_model(t):
    """D11, learned backend: tokenizer -> hashing TF -> logistic regression
    fitted on the labelled documents (toxic flag), then applied to every
    document.  Training and scoring are distributed ML jobs."""
    from pyspark.ml.functions import vector_to_array

    labelled = t.documents.select("doc_id", "text").join(
        t.labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    model = G.triage_model(labelled, text_col="text", label_col="label")
    scored = model.transform(spread(t.documents.select("doc_id", "text")))
    return scored.select("doc_id", F.col("prediction").cast("int").alias("predicted_toxic"),
                         F.round(vector_to_array("probability")[1], 6).alias("p_toxic"))
