"""Billing anomaly scan and diagnosis.

All money is in integer cents; dollar columns are derived at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import usd
from .joins import MICROS_PER_DAY, band_join, epoch_micros, first_in_window

# Fixed values of the scan rules (reference semantics):
#   rate deviation when |billed - rate| > greatest(50 USD, 15 % of rate), strict;
#   duplicates are rows equal on terminal, container, move type and tariff code
#   whose created times are less than 14 days apart; the later invoice id is the
#   duplicate; the scan keeps the 10 largest variances.
#   the mechanical recommendation sentences of the diagnosis step.
ACTION_VOID = "Void %s as a duplicate of %s and credit the customer $%s."
ACTION_OVER = "Overbilled by $%s vs. the standard %s rate ($%s) -- issue a credit down to $%s."
ACTION_UNDER = ("Underbilled by $%s vs. the standard %s rate ($%s) -- recover the shortfall, "
                "correcting the invoice to $%s.")
ABS_FLOOR_CENTS = 5000
REL_PCT = 15
DUP_WINDOW_DAYS = 14
SCAN_LIMIT = 10
DUP_KEYS = ["terminal_id", "container_id", "move_type", "tariff_code"]

SCAN_COLS = ["invoice_id", "anomaly_type", "billed_usd", "expected_usd", "variance_usd",
             "terminal_id", "tariff_code", "customer_name"]


def deviation_condition(billed: str = "amount_cents", rate: str = "rate_cents",
                        abs_floor_cents: int = ABS_FLOOR_CENTS, rel_pct: int = REL_PCT):
    """|billed - rate| > greatest(floor, rate * pct / 100), exact in cents."""
    diff = F.abs(F.col(billed) - F.col(rate))
    return diff * 100 > F.greatest(F.lit(abs_floor_cents * 100), F.col(rate) * rel_pct)


def tariff_join(billing: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Inner equi-join fact x dimension on (terminal_id, tariff_code).
    Rows without a tariff drop out, as in the reference."""
    return billing.join(tariffs, ["terminal_id", "tariff_code"], "inner")


def not_filed(billing: DataFrame, filed: DataFrame | None) -> DataFrame:
    """Invoices without a recommendation on file (all, if no set is given)."""
    return billing if filed is None else billing.join(filed.select("invoice_id"), "invoice_id", "left_anti")


def rate_deviation(billing: DataFrame, tariffs: DataFrame, filed: DataFrame | None,
                   abs_floor_cents: int = ABS_FLOOR_CENTS, rel_pct: int = REL_PCT) -> DataFrame:
    """Undisputed invoices off their tariff by more than the threshold and
    not already filed.  Variance is absolute."""
    b = billing.filter(~F.col("dispute_flag")).select(
        "invoice_id", "terminal_id", "tariff_code", "amount_cents", "customer_name")
    j = tariff_join(b, tariffs.select("terminal_id", "tariff_code", "rate_cents"))
    j = j.filter(deviation_condition(abs_floor_cents=abs_floor_cents, rel_pct=rel_pct))
    j = not_filed(j, filed)
    return j.select(
        "invoice_id", F.lit("rate_deviation").alias("anomaly_type"),
        usd("amount_cents").alias("billed_usd"), usd("rate_cents").alias("expected_usd"),
        usd(F.abs(F.col("amount_cents") - F.col("rate_cents"))).alias("variance_usd"),
        "terminal_id", "tariff_code", "customer_name")


def duplicate_pairs(billing: DataFrame, within_days: int = DUP_WINDOW_DAYS) -> DataFrame:
    """(earlier, later) invoice pairs equal on the four keys, earlier
    invoice id smaller, created less than ``within_days`` apart (strict)."""
    return duplicate_pairs_from(billing, billing, within_days)


def duplicate_charge(billing: DataFrame, filed: DataFrame | None,
                     within_days: int = DUP_WINDOW_DAYS) -> DataFrame:
    """One row per (earlier twin, later invoice) pair; only the later
    row's dispute flag is tested; expected 0, variance = full amount."""
    later = not_filed(billing.filter(~F.col("dispute_flag")), filed)
    p = duplicate_pairs_from(billing, later, within_days)
    return p.select(
        "invoice_id", F.lit("duplicate_charge").alias("anomaly_type"),
        usd("amount_cents").alias("billed_usd"), F.lit(0.0).alias("expected_usd"),
        usd("amount_cents").alias("variance_usd"),
        "terminal_id", "tariff_code", "customer_name")


def duplicate_pairs_from(earlier: DataFrame, later: DataFrame,
                         within_days: int = DUP_WINDOW_DAYS) -> DataFrame:
    """Band join of candidate earlier twins against candidate later invoices."""
    b1 = earlier.select(*DUP_KEYS, F.col("invoice_id").alias("first_invoice_id"),
                        F.col("created_ts").alias("first_ts"))
    b2 = later.select(*DUP_KEYS, "invoice_id", "amount_cents", "customer_name", "created_ts")
    return band_join(b1, b2, DUP_KEYS, "first_ts", "created_ts",
                     within_days * MICROS_PER_DAY,
                     extra=F.col("first_invoice_id") < F.col("invoice_id"))


def anomalies_wide(billing: DataFrame, tariffs: DataFrame, filed: DataFrame | None,
                   abs_floor_cents: int = ABS_FLOOR_CENTS, rel_pct: int = REL_PCT,
                   within_days: int = DUP_WINDOW_DAYS) -> DataFrame:
    """Both arms in one pass: new undisputed invoices get their rate (left join) and their
    earlier twins (band join that keeps every invoice), and each resulting row yields a
    rate deviation, a duplicate, both or nothing.  An invoice with several twins repeats
    its rate deviation, so rows are made distinct per twin; only anomalies are shuffled.
    Readers of the fact: new invoices, the filed set, the tariffs and the earlier twins."""
    new = not_filed(billing.filter(~F.col("dispute_flag")), filed).select(
        *DUP_KEYS, "invoice_id", "amount_cents", "customer_name", "created_ts")
    rated = new.join(tariffs.select("terminal_id", "tariff_code", "rate_cents"),
                     ["terminal_id", "tariff_code"], "left")
    earlier = billing.select(*DUP_KEYS, F.col("invoice_id").alias("first_invoice_id"),
                             F.col("created_ts").alias("first_ts"))
    pairs = band_join(earlier, rated, DUP_KEYS, "first_ts", "created_ts",
                      within_days * MICROS_PER_DAY, how="right",
                      extra=F.col("first_invoice_id") < F.col("invoice_id"))
    id_type = dict(billing.dtypes)["invoice_id"]
    arm = "struct<anomaly_type:string,expected_cents:bigint,variance_cents:bigint,twin:" + id_type + ">"
    off = F.abs(F.col("amount_cents") - F.col("rate_cents"))
    rate = F.struct(F.lit("rate_deviation"), F.col("rate_cents").cast("bigint"), off.cast("bigint"),
                    F.lit(None).cast(id_type)).cast(arm)
    dup = F.struct(F.lit("duplicate_charge"), F.lit(0).cast("bigint"), F.col("amount_cents").cast("bigint"),
                   F.col("first_invoice_id")).cast(arm)
    arms = F.array_compact(F.array(
        F.when(deviation_condition(abs_floor_cents=abs_floor_cents, rel_pct=rel_pct), rate),
        F.when(F.col("first_invoice_id").isNotNull(), dup)))
    keep = [*DUP_KEYS, "invoice_id", "amount_cents", "rate_cents", "customer_name"]
    return pairs.select(*keep, F.explode(arms).alias("a")).select(*keep, "a.*").distinct()


def anomaly_union(billing: DataFrame, tariffs: DataFrame, filed: DataFrame | None,
                  abs_floor_cents: int = ABS_FLOOR_CENTS, rel_pct: int = REL_PCT,
                  within_days: int = DUP_WINDOW_DAYS) -> DataFrame:
    """The rows of both arms, one per deviation and one per (twin, invoice) pair."""
    return anomalies_wide(billing, tariffs, filed, abs_floor_cents, rel_pct, within_days).select(
        "invoice_id", "anomaly_type", usd("amount_cents").alias("billed_usd"),
        usd("expected_cents").alias("expected_usd"), usd("variance_cents").alias("variance_usd"),
        "terminal_id", "tariff_code", "customer_name")


def findings(billing: DataFrame, tariffs: DataFrame, filed: DataFrame | None,
             abs_floor_cents: int = ABS_FLOOR_CENTS, rel_pct: int = REL_PCT,
             within_days: int = DUP_WINDOW_DAYS) -> DataFrame:
    """The anomalies of both arms, each once: as ``anomalies_wide``, but a duplicate is one
    row however many earlier twins it has (``twin`` is the smallest), and no pairs are
    built: an invoice has an earlier twin if the smallest id of its key inside the time
    window is smaller than its own."""
    width = within_days * MICROS_PER_DAY
    new = not_filed(billing.filter(~F.col("dispute_flag")), filed).select(
        *DUP_KEYS, "invoice_id", "amount_cents", "customer_name", "created_ts")
    rated = new.join(tariffs.select("terminal_id", "tariff_code", "rate_cents"),
                     ["terminal_id", "tariff_code"], "left").withColumn("_at", epoch_micros(F.col("created_ts")))
    firsts = first_in_window(billing, DUP_KEYS, "created_ts", "invoice_id", width)
    # few instants have a twin that comes first: what is left of them is small
    met = rated.join(firsts, [*DUP_KEYS, "_at"], "left")
    arm = "struct<anomaly_type:string,expected_cents:bigint,variance_cents:bigint,twin:" \
        + dict(billing.dtypes)["invoice_id"] + ">"
    off = F.abs(F.col("amount_cents") - F.col("rate_cents"))
    none = F.lit(None).cast(dict(billing.dtypes)["invoice_id"])
    rate = F.struct(F.lit("rate_deviation"), F.col("rate_cents").cast("bigint"), off.cast("bigint"), none).cast(arm)
    dup = F.struct(F.lit("duplicate_charge"), F.lit(0).cast("bigint"), F.col("amount_cents").cast("bigint"),
                   F.col("_first")).cast(arm)
    arms = F.array_compact(F.array(
        F.when(deviation_condition(abs_floor_cents=abs_floor_cents, rel_pct=rel_pct), rate),
        F.when(F.col("_first") < F.col("invoice_id"), dup)))
    keep = [*DUP_KEYS, "invoice_id", "amount_cents", "rate_cents", "customer_name", "created_ts"]
    return met.select(*keep, F.explode(arms).alias("a")).select(*keep, "a.*")


def billing_anomaly_scan(billing: DataFrame, tariffs: DataFrame, filed: DataFrame,
                         limit: int = SCAN_LIMIT, within_days: int = DUP_WINDOW_DAYS, **kw) -> DataFrame:
    """D3: both arms, ranked by variance, one row per deviation and per earlier twin of a
    duplicate.  The reference orders by variance only; invoice id and type make the top-k
    total and deterministic.  Rows of one duplicate are equal, so the first ``limit``
    findings hold all that can be shown: earlier twins are counted for these alone, and
    each duplicate is repeated as often, at most ``limit`` times.  No pairs are built."""
    order = [F.desc("variance_cents"), F.asc("invoice_id"), F.asc("anomaly_type")]
    top = findings(billing, tariffs, filed, within_days=within_days, **kw).orderBy(*order).limit(limit)
    # at most ``limit`` rows meet the fact: their own invoice, and the earlier twins
    shown = ["invoice_id", "anomaly_type", "amount_cents", "expected_cents", "variance_cents",
             "terminal_id", "tariff_code", "customer_name"]
    fact = billing.select(*[F.col(k).alias(f"_k_{k}") for k in DUP_KEYS],
                          F.col("invoice_id").alias("_id"), F.col("created_ts").alias("_ts"))
    same_key = F.lit(True)
    for k in DUP_KEYS:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    apart = F.abs(epoch_micros(F.col("created_ts")) - epoch_micros(F.col("_ts")))
    is_twin = (F.col("_id") < F.col("invoice_id")) & (apart < within_days * MICROS_PER_DAY)
    counted = fact.join(F.broadcast(top), same_key & (is_twin | (F.col("_id") == F.col("invoice_id")))) \
        .groupBy(*shown).agg(F.count_if(is_twin).alias("_twins"))
    times = F.when(F.col("anomaly_type") == "duplicate_charge",
                   F.least(F.col("_twins"), F.lit(limit))).otherwise(1).cast("int")
    rows = counted.select(
        "invoice_id", "anomaly_type", usd("amount_cents").alias("billed_usd"),
        usd("expected_cents").alias("expected_usd"), usd("variance_cents").alias("variance_usd"),
        "terminal_id", "tariff_code", "customer_name",
        F.explode(F.array_repeat(F.lit(True), times)).alias("_once")).drop("_once")
    return rows.orderBy(F.desc("variance_usd"), F.asc("invoice_id"), F.asc("anomaly_type")).limit(limit)


def earliest_twin(billing: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """J10 made deterministic: for every invoice, the smallest invoice id among
    its twins on the four keys (no time bound), when smaller than its own.
    A grouped min (partially aggregated before the shuffle, so a hot key costs
    one row per map task) joined back on the keys: no pairs are built.
    ``carry`` columns of the earliest twin come along as ``twin_<col>``."""
    carry = carry or []
    first = F.min(F.struct("invoice_id", *carry)).alias("_first")
    firsts = billing.groupBy(*DUP_KEYS).agg(first)
    j = billing.join(firsts, DUP_KEYS, "inner")
    earlier = F.col("_first.invoice_id") < F.col("invoice_id")
    out = j.withColumn("twin_invoice_id", F.when(earlier, F.col("_first.invoice_id")))
    for c in carry:
        out = out.withColumn(f"twin_{c}", F.when(earlier, F.col(f"_first.{c}")))
    return out.drop("_first")


def diagnose(anomalies: DataFrame, billing: DataFrame, tariffs: DataFrame,
             keep: list[str] | None = None) -> DataFrame:
    """Re-diagnose each scanned invoice.  Duplicate when any earlier twin
    exists (no time bound); else rate deviation with a signed variance.  The
    action sentence follows the sign.  Rows with no tariff keep a NULL
    expected amount and are flagged ``rejected_reason`` (the reference's
    NOT NULL insert would fail on them).  ``keep`` columns of ``anomalies``
    are passed through; anomalies that carry keys, amount and rate (``findings``)
    are not looked up in the fact again."""
    keep = keep or []
    facts = [*DUP_KEYS, "amount_cents", "rate_cents"]
    carried = set(facts) <= set(anomalies.columns)
    inv = anomalies.select("invoice_id", F.col("anomaly_type").alias("scan_type"), *keep,
                           *(facts if carried else [])).distinct()
    if not carried:
        # narrow to the scanned invoices first, then look up their keys' first invoice:
        # the keys join is as large as the anomaly set, not the fact
        inv = inv.join(billing.select(*DUP_KEYS, "invoice_id", "amount_cents"), "invoice_id").join(
            tariffs.select("terminal_id", "tariff_code", "rate_cents"), ["terminal_id", "tariff_code"], "left")
    firsts = billing.groupBy(*DUP_KEYS).agg(F.min("invoice_id").alias("_first"))
    j = inv.join(firsts, DUP_KEYS).withColumn(
        "twin_invoice_id", F.when(F.col("_first") < F.col("invoice_id"), F.col("_first")))
    dup = F.col("twin_invoice_id").isNotNull()
    expected = F.when(dup, F.lit(0)).otherwise(F.col("rate_cents"))
    variance = F.when(dup, F.col("amount_cents")).otherwise(
        F.col("amount_cents") - F.col("rate_cents"))
    j = j.withColumn("expected_cents", expected).withColumn("variance_cents", variance)
    money = lambda c: F.format_string("%.2f", usd(c))
    action = (
        F.when(dup, F.format_string(ACTION_VOID,
                                    F.col("invoice_id").cast("string"),
                                    F.col("twin_invoice_id").cast("string"), money("amount_cents")))
        .when(F.col("variance_cents") > 0, F.format_string(
            ACTION_OVER,
            money("variance_cents"), F.col("tariff_code"), money("rate_cents"), money("rate_cents")))
        .when(F.col("rate_cents").isNotNull(), F.format_string(
            ACTION_UNDER,
            money(F.abs(F.col("variance_cents"))), F.col("tariff_code"),
            money("rate_cents"), money("rate_cents"))))
    return j.select(
        "invoice_id", "scan_type", *keep,
        F.when(dup, "duplicate_charge").otherwise("rate_deviation").alias("anomaly_type"),
        "twin_invoice_id",
        usd("amount_cents").alias("billed_usd"), usd("expected_cents").alias("expected_usd"),
        usd("variance_cents").alias("variance_usd"),
        action.alias("recommended_action"),
        F.when(F.col("expected_cents").isNull(), "no_tariff").alias("rejected_reason"))


def rate_evidence(billing: DataFrame, tariffs: DataFrame,
                  abs_floor_cents: int = ABS_FLOOR_CENTS, rel_pct: int = REL_PCT) -> DataFrame:
    """For every invoice with a tariff: billed, standard, threshold,
    direction and percent off (one decimal, NULL when the rate is 0)."""
    j = tariff_join(billing.select("invoice_id", "terminal_id", "tariff_code", "amount_cents"),
                    tariffs)
    thr = F.greatest(F.lit(abs_floor_cents * 100), F.col("rate_cents") * rel_pct)
    diff = F.col("amount_cents") - F.col("rate_cents")
    return j.select(
        "invoice_id", "terminal_id", "tariff_code",
        usd("amount_cents").alias("billed_usd"), usd("rate_cents").alias("standard_usd"),
        (thr / F.lit(10000.0)).alias("threshold_usd"),
        F.when(diff > 0, "over").when(diff < 0, "under").otherwise("equal").alias("direction"),
        F.when(F.col("rate_cents") > 0,
               F.round(diff.cast("double") * 100 / F.col("rate_cents"), 1)).alias("pct_off"),
        deviation_condition(abs_floor_cents=abs_floor_cents, rel_pct=rel_pct).alias("flagged"))


def duplicate_evidence(billing: DataFrame) -> DataFrame:
    """Every invoice that has an earlier twin (J3, no time bound), shown
    next to that earliest twin with whole days apart (floor of |dt|).  The
    twin's amount and time travel through the grouped min, so no join on the
    (possibly hot) twin id is needed."""
    t = earliest_twin(billing.select(*DUP_KEYS, "invoice_id", "amount_cents", "created_ts"),
                      carry=["amount_cents", "created_ts"])
    later = t.filter(F.col("twin_invoice_id").isNotNull())
    secs = F.abs(F.unix_micros(F.col("created_ts").cast("timestamp")) -
                 F.unix_micros(F.col("twin_created_ts").cast("timestamp")))
    return later.select(
        "invoice_id", "twin_invoice_id", *DUP_KEYS,
        usd("amount_cents").alias("billed_usd"), usd("twin_amount_cents").alias("twin_billed_usd"),
        F.floor(secs / F.lit(86_400_000_000)).cast("bigint").alias("days_apart"))
