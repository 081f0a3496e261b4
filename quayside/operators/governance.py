"""Governance: masking, restricted views, redaction, dispute triage,
glossary text, activity trace and the guarded SQL runner (D11-D14, D21-D23,
P12, P13, G1)."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..session import ensure_checkpoint_dir
from ..sources.adapters import usd
from .model import RuleBackend, parse_reply, run_model
from .relational import apply_updates

# Triage categories and risk levels of the reference, and our
# rule backend's keyword chain (first match wins) and amount bands.
CATEGORIES = ["Demurrage Dispute", "Duplicate Charge", "Weighbridge Discrepancy",
              "Damage Claim", "Other"]
TRIAGE_RULES = [
    ("Demurrage Dispute", r"(?i)demurrage|free time|storage|detention"),
    ("Duplicate Charge", r"(?i)duplicate|twice|double"),
    ("Weighbridge Discrepancy", r"(?i)weigh|vgm|scale"),
    ("Damage Claim", r"(?i)damage|dent|broken|scratch"),
]
HIGH_CENTS = 30_000_000      # 300,000.00 USD and above
MEDIUM_CENTS = 10_000_000    # 100,000.00 USD and above

# Columns of billing_events that ad-hoc SQL may see (no customer name or
# e-mail, no corrections), as listed to the SQL generator in the reference.
BILLING_ALLOW = ["invoice_id", "terminal_id", "container_id", "move_type", "tariff_code",
                 "amount_usd", "dispute_flag", "dispute_reason", "dispute_category",
                 "dispute_risk", "created_ts"]


def masked_view(billing: DataFrame) -> DataFrame:
    """Billing without PII columns, contact masked, triage columns shown."""
    return billing.select(
        "invoice_id", "terminal_id", "container_id", "move_type", "tariff_code",
        usd("amount_cents").alias("amount_usd"),
        X.mask_contact("customer_name", "customer_email").alias("customer_contact_masked"),
        "dispute_flag", "dispute_category", "dispute_risk", "dispute_risk_rationale", "created_ts")


def restricted_view(spark: SparkSession, df: DataFrame, name: str, allow: list[str]) -> DataFrame:
    """An allow-list of columns under ``name``.  As a boundary for foreign SQL use
    :func:`run_guarded`, whose session holds nothing but such views."""
    v = df.select(*allow)
    v.createOrReplaceTempView(name)
    return spark.table(name)


TRIAGE_COLS = ["dispute_category", "dispute_risk", "dispute_risk_rationale"]


def triage_queue(billing: DataFrame) -> DataFrame:
    """Flagged disputes that no run has classified yet."""
    return billing.filter(F.col("dispute_flag") & F.col("dispute_category").isNull())


def triage_write_back(billing: DataFrame, triaged: DataFrame) -> DataFrame:
    """The billing snapshot with the new classifications; earlier ones stay."""
    return apply_updates(billing, triaged, ["invoice_id"], TRIAGE_COLS)


def triage_audit(triaged: DataFrame) -> DataFrame:
    """One audit row per classified dispute; the output is the whole reply."""
    reply = F.to_json(F.struct(F.col("dispute_category").alias("category"),
                               F.col("dispute_risk").alias("risk"),
                               F.col("dispute_risk_rationale").alias("rationale")))
    return triaged.select(
        F.col("created_ts").alias("called_at"), F.lit("classify_dispute").alias("function_name"),
        F.lit("rules").alias("model_name"), F.col("invoice_id").cast("string").alias("subject_id"),
        F.col("dispute_reason").alias("input_summary"), reply.alias("output_summary"))


def redact_names(df: DataFrame, text_col: str, names_col: str, out_col: str = "redacted") -> DataFrame:
    """D14, names: each text with its list of names goes through the model interface
    (T13); a failing prompt leaves NULL and its error."""
    prompt = F.concat(F.lit(RuleBackend.REDACT), F.to_json(F.col(names_col)), F.lit("\n"), F.col(text_col))
    done = run_model(df.withColumn("prompt", prompt), "prompt")
    return done.withColumn(out_col, parse_reply("reply", "reply string").getField("reply")) \
        .drop("prompt", "reply")


def triage_category(text: Column) -> Column:
    out = None
    for cat, pat in TRIAGE_RULES:
        out = F.when(text.rlike(pat), cat) if out is None else out.when(text.rlike(pat), cat)
    return out.otherwise("Other")


def triage_risk(amount_cents: Column) -> Column:
    return F.when(amount_cents >= HIGH_CENTS, "High") \
        .when(amount_cents >= MEDIUM_CENTS, "Medium").otherwise("Low")


def triage(queue: DataFrame, text_col: str = "dispute_reason",
           amount_col: str = "amount_cents") -> DataFrame:
    """D11, rule backend: category by keyword chain, risk by amount band,
    and a one-sentence rationale.  Native expressions, one pass."""
    cat = triage_category(F.col(text_col))
    risk = triage_risk(F.col(amount_col))
    return queue.drop(*TRIAGE_COLS).select(
        "*", cat.alias("dispute_category"), risk.alias("dispute_risk"),
        F.concat(F.lit("Rule triage: "), cat, F.lit(" from the dispute text, "),
                 F.lower(risk), F.lit(" risk by amount.")).alias("dispute_risk_rationale"))


def triage_model(labelled: DataFrame, text_col: str = "text", label_col: str = "label",
                 num_features: int = 1 << 14, max_iter: int = 10):
    """D11, learned backend: tokenizer -> hashing TF -> logistic regression,
    fitted on a labelled text table.  Returns the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"\W+")
    tf = HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=max_iter)
    return Pipeline(stages=[tok, tf, lr]).fit(labelled)


def glossary_text(glossary: DataFrame) -> DataFrame:
    """D21 + A7: ``- term: definition`` lines (plus ``  (Note: ...)`` when a
    note exists) joined by newlines in term order.  The glossary is a small
    dimension; one row comes out."""
    line = F.concat(F.lit("- "), F.col("term"), F.lit(": "), F.col("definition"),
                    F.coalesce(F.concat(F.lit("  (Note: "), F.col("note"), F.lit(")")), F.lit("")))
    return glossary.select(F.col("term"), line.alias("line")).agg(
        F.expr("string_agg(line, '\\n') WITHIN GROUP (ORDER BY term)").alias("glossary"))


def activity_trace(log: DataFrame, prefix_col: str, prefix: str, text_col: str,
                   order: list[str], width: int = 90) -> DataFrame:
    """D23 + P5: entries whose ``prefix_col`` starts with ``prefix``, the text
    cut to ``width`` characters, in ``order``."""
    f = log.filter(F.col(prefix_col).startswith(prefix))
    return f.select(*order, prefix_col, F.left(F.col(text_col), F.lit(width)).alias("query"))\
        .orderBy(*order)


# Functions that reach beyond the data, and name spaces beyond the session's views.
OUTSIDE = r"(?i)\b(reflect|java_method|try_reflect|input_file_name|global_temp|read_files)\b"
GUARD_CONF = {"spark.sql.runSQLOnFiles": "false", "spark.sql.session.timeZone": "UTC",
              "spark.sql.ansi.enabled": "true",
              # explained plans must show whole locations, however many there are
              "spark.sql.maxMetadataStringLength": "100000", "spark.sql.maxPlanStringLength": str(1 << 28)}
#: Leaves of a plan that read nothing but what the statement itself spells out.
OWN_ROWS = ("Scan OneRowRelation", "LocalTableScan", "Range")


@dataclass
class StoredViews:
    """A snapshot of the views that statements may name: folder and schemas."""
    folder: str
    schemas: dict[str, StructType]


def store_views(spark: SparkSession, views: dict[str, DataFrame]) -> StoredViews:
    """Write the views, with their listed columns only, to the shared folder: the hidden
    columns are not even in the files that statements read.  One snapshot serves any
    number of runs."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/views-{uuid.uuid4().hex}"
    for name, df in views.items():
        df.write.parquet(f"{folder}/{name}")
    return StoredViews(folder, {n: df.schema for n, df in views.items()})


def guarded_session(spark: SparkSession, views: StoredViews) -> SparkSession:
    """A session of its own that has only ``views``, with SQL on files off."""
    own = spark.newSession()
    for k, v in GUARD_CONF.items():
        own.conf.set(k, v)
    for name, schema in views.schemas.items():
        own.read.schema(schema).parquet(f"{views.folder}/{name}").createOrReplaceTempView(name)
    return own


def foreign_reads(explained: str, views: StoredViews) -> list[str]:
    """Leaves of a plan, as ``EXPLAIN FORMATTED`` shows it with all its subqueries, that
    read anything but files of the views.  A text without any leaf counts as one."""
    marker = f"/{views.folder.rstrip('/').rpartition('/')[2]}/"
    leaves, foreign = 0, []
    for block in re.split(r"\n\s*\n", explained):
        head = re.match(r"\(\d+\) ([^\n]*)", block.strip())
        if not head or not re.match(r"\w*Scan\b|\w*Scan |Range\b", head[1]):
            continue
        leaves += 1
        if head[1].startswith(OWN_ROWS):
            continue
        place = re.search(r"^Location: \S+ \[([^\],]*)", block, re.M)
        if not head[1].startswith("Scan parquet") or not place or marker not in place[1]:
            foreign.append(head[1].strip())
    return foreign if leaves else ["no plan"]


def run_guarded(spark: SparkSession, statements: list[tuple[str, str]],
                views: dict[str, DataFrame] | StoredViews) -> tuple[DataFrame, DataFrame]:
    """For each (question, raw SQL): clean (fence, trailing ';'), guard, and run in a
    session that holds only ``views``.  Returns (results, log).

    results: (question, row_json), every row of every accepted statement, however many;
    they stay distributed.  log: (question, generated_sql, status, row_count) for every
    statement, refused ones included.  A statement is refused if the guard rejects it, if
    it names a function that reaches beyond the data, if it cannot be resolved against
    the views, or if its plan, subqueries included, reads anything but the views.  Each
    accepted statement runs once, to stored rows, which are counted; one that fails is
    logged as an error and costs the others nothing.  The loop runs over the statements;
    only their texts, plans and counts are on the driver."""
    cleaned = spark.createDataFrame(statements, "question string, raw_sql string").select(
        "question", X.clean_sql("raw_sql").alias("sql"),
        X.is_safe_select(X.clean_sql("raw_sql")).alias("safe"),
        X.clean_sql("raw_sql").rlike(OUTSIDE).alias("outside"))
    views = views if isinstance(views, StoredViews) else store_views(spark, views)
    own = guarded_session(spark, views)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    schema = "question string, row_json string"
    notes, paths = [], []
    for k, r in enumerate(cleaned.collect()):  # one row per statement
        status, count = "ok", None
        if not r["safe"]:
            status = "rejected: not a plain SELECT"
        elif r["outside"]:
            status = "rejected: reaches beyond the views"
        else:
            try:
                res = own.sql(r["sql"])
                if foreign_reads(own.sql(f"EXPLAIN FORMATTED {r['sql']}").first()[0], views):
                    status = "rejected: reads beyond the views"
                else:
                    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in res.columns]), {"ignoreNullFields": "false"})
                    res.select(F.lit(r["question"]).alias("question"), row.alias("row_json")) \
                        .write.parquet(f"{folder}/{k}")
                    count = own.read.schema(schema).parquet(f"{folder}/{k}").count()
                    paths.append(f"{folder}/{k}")
            except Exception as e:  # noqa: BLE001 - errors of analysis and of running are logged
                status = f"error: {type(e).__name__}"
        notes.append((r["question"], r["sql"], status, count))
    results = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return results, spark.createDataFrame(
        notes, "question string, generated_sql string, status string, row_count long")
