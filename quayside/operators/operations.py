"""Operational questions (N1-N9) over the adapter views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import MICROS_PER_DAY, epoch_micros

MICROS_PER_HOUR = 3_600_000_000

# The vibration response levels (ratio to baseline, hours the
# ratio must hold; 0 = a single reading) and the temperature rise level.
LEVELS = [("Watch", 1.5, 24), ("Inspect", 2.0, 48), ("Stop", 3.0, 0)]
TEMP_RISE_C, TEMP_HOURS = 8.0, 12


def in_window(ts, day: str, h_from: int, h_to: int):
    return (F.to_date(ts) == F.lit(day).cast("date")) & F.hour(ts).between(h_from, h_to)


def window_vs_baseline(gate: DataFrame, day: str, h_from: int, h_to: int) -> DataFrame:
    """Mean turn time inside an incident window vs all other times, per
    terminal, and the change in percent (conditional averages, one pass)."""
    w = in_window(F.col("gate_in_ts"), day, h_from, h_to)
    g = gate.groupBy("terminal_id").agg(
        F.round(F.avg(F.when(w, F.col("turn_time_minutes"))), 3).alias("window_avg"),
        F.round(F.avg(F.when(~w, F.col("turn_time_minutes"))), 3).alias("baseline_avg"))
    pct = F.when(F.col("baseline_avg") > 0, F.round(
        (F.col("window_avg") - F.col("baseline_avg")) / F.col("baseline_avg") * 100, 1))
    return g.withColumn("pct_change", pct)


def rehandle_spike(moves: DataFrame, day: str) -> DataFrame:
    """Rehandles per hour of ``day`` vs the mean for that hour on other days."""
    r = moves.filter(F.col("is_rehandle")).select(
        F.to_date("event_ts").alias("d"), F.hour("event_ts").alias("hour"))
    per = r.groupBy("d", "hour").agg(F.count(F.lit(1)).alias("n"))
    on = F.col("d") == F.lit(day).cast("date")
    days = r.filter(~on).agg(F.countDistinct("d").alias("other_days"))
    g = per.groupBy("hour").agg(F.sum(F.when(on, F.col("n")).otherwise(0)).alias("window_count"),
                                F.sum(F.when(~on, F.col("n")).otherwise(0)).alias("_other"))
    j = g.crossJoin(days)
    avg_other = F.round(F.col("_other") / F.col("other_days"), 3)
    return j.select("hour", "window_count", avg_other.alias("other_days_avg"),
                    F.when(avg_other > 0, F.round(F.col("window_count") / avg_other, 3))
                    .alias("ratio"))


def overrun_hours(calls: DataFrame) -> DataFrame:
    """Hours each call left after its planned departure (NULL while not departed)."""
    h = (epoch_micros(F.col("actual_departure")) - epoch_micros(F.col("etd"))) / MICROS_PER_HOUR
    return calls.withColumn("overrun_hours", F.round(h, 2))


def repeat_overrun(calls: DataFrame) -> DataFrame:
    """For each overrunning call, how many earlier overrunning calls the
    same berth had in the same month.  Running counts are taken per
    (berth, day) and offset by a prefix sum over the month's daily totals,
    so no (berth, month) group has to sit in one task."""
    o = overrun_hours(calls).filter(F.col("overrun_hours") > 0).select(
        "call_id", "berth_id", "actual_arrival", "overrun_hours",
        F.date_trunc("month", "actual_arrival").alias("month"),
        F.to_date("actual_arrival").alias("day"))
    w_day = Window.partitionBy("berth_id", "day").orderBy("actual_arrival", "call_id")
    local = o.withColumn("_in_day", F.row_number().over(w_day) - 1)
    daily = o.groupBy("berth_id", "month", "day").agg(F.count(F.lit(1)).alias("_n"))
    w_m = Window.partitionBy("berth_id", "month").orderBy("day") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = daily.select("berth_id", "day",
                        F.coalesce(F.sum("_n").over(w_m), F.lit(0)).alias("_before"))
    j = local.join(offs, ["berth_id", "day"])
    return j.select("call_id", "berth_id", "actual_arrival", "overrun_hours",
                    (F.col("_before") + F.col("_in_day")).alias("earlier_overruns"))


def vs_fleet(telemetry: DataFrame) -> DataFrame:
    """Each crane's mean vibration against the fleet mean."""
    per = telemetry.groupBy("crane_id").agg(F.sum("vibration_g").alias("_s"),
                                            F.count(F.lit(1)).alias("_n"))
    fleet = per.agg((F.sum("_s") / F.sum("_n")).alias("fleet_avg"))
    j = per.crossJoin(fleet)
    ca = F.col("_s") / F.col("_n")
    return j.select("crane_id", F.round(ca, 3).alias("crane_avg"),
                    F.round(F.col("fleet_avg"), 3).alias("fleet_avg"),
                    F.round(ca / F.col("fleet_avg"), 3).alias("ratio"))


def disputed_revenue(billing: DataFrame) -> DataFrame:
    """Disputed total and the riskiest (largest) disputed invoice."""
    d = billing.filter(F.col("dispute_flag"))
    top = F.max(F.struct(F.col("amount_cents"), (-F.col("invoice_id")).alias("_neg")))
    return d.agg(F.sum("amount_cents").alias("_s"), F.count(F.lit(1)).alias("disputes"),
                 top.alias("_t")).select(
        (F.col("_s") / F.lit(100.0)).alias("disputed_usd"), "disputes",
        (-F.col("_t._neg")).alias("top_invoice_id"),
        (F.col("_t.amount_cents") / F.lit(100.0)).alias("top_amount_usd"))


def berth_productivity(calls: DataFrame) -> DataFrame:
    """Moves per hour per call, averaged by berth and arrival day."""
    hours = (epoch_micros(F.col("actual_departure")) -
             epoch_micros(F.col("actual_arrival"))) / MICROS_PER_HOUR
    p = calls.select("berth_id", F.to_date("actual_arrival").alias("day"),
                     (F.col("moves") / F.greatest(hours, F.lit(1.0))).alias("_p"))
    return p.groupBy("berth_id", "day").agg(F.count(F.lit(1)).alias("calls"),
                                            F.round(F.avg("_p"), 3).alias("avg_moves_per_hr"))


def trailing_baseline(readings: DataFrame, days: int) -> DataFrame:
    """Mean vibration and temperature of each crane over [t - days, t), per reading, as
    ``_base`` and ``_tbase``.

    The sum is that of the whole days in between, plus the part of the reading's own day
    before it, less the part of the first day before t - days.  Whole days come from daily
    totals; the two parts are running sums inside one (crane, day), into which the readings
    of ``days`` days earlier are copied with their time moved on.  So no group is larger
    than two days of one crane.  Sums are exact decimals."""
    shift = days * MICROS_PER_DAY
    dec = "decimal(30,6)"
    own = readings.select("*", F.floor(F.col("_us") / MICROS_PER_DAY).alias("_day"), F.lit(True).alias("_own"),
                          F.col("vibration_g").cast(dec).alias("_v"), F.col("temperature_c").cast(dec).alias("_t"))
    old = own.withColumns({"_us": F.col("_us") + shift, "_day": F.col("_day") + days, "_own": F.lit(False)})
    before = Window.partitionBy("crane_id", "_day").orderBy("_us") \
        .rangeBetween(Window.unboundedPreceding, -1)
    sign = F.when(F.col("_own"), 1).otherwise(-1)
    parts = own.unionByName(old).select(
        "*", *[F.coalesce(F.sum(F.col(c) * sign).over(before), F.lit(0)).alias(f"{c}_sum") for c in ("_v", "_t")],
        *[F.coalesce(F.sum(F.when(F.col(c).isNotNull(), sign)).over(before), F.lit(0)).alias(f"{c}_n")
          for c in ("_v", "_t")]).filter("_own")
    between = Window.partitionBy("crane_id").orderBy("_day").rangeBetween(-days, -1)   # rows are days
    daily = own.groupBy("crane_id", "_day").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_day") for c in ("_v", "_t")],
        *[F.count(c).alias(f"{c}_dayn") for c in ("_v", "_t")])
    whole = daily.select("crane_id", "_day", *[
        F.coalesce(F.sum(f"{c}_{k}").over(between), F.lit(0)).alias(f"{c}_{k}") for c in ("_v", "_t") for k in ("day", "dayn")])
    j = parts.join(whole, ["crane_id", "_day"])

    def mean(c):
        n = F.col(f"{c}_n") + F.col(f"{c}_dayn")
        return F.when(n > 0, (F.col(f"{c}_sum") + F.col(f"{c}_day")).cast("double") / n)

    return j.select(*readings.columns, "_day", mean("_v").alias("_base"), mean("_t").alias("_tbase"))


def drift_levels(telemetry: DataFrame, baseline: str = "trailing", baseline_days: int = 7,
                 frozen_before: str | None = None) -> DataFrame:
    """First time each response level fires per crane.

    Baseline ``trailing``: mean vibration over the ``baseline_days`` before
    each reading (current reading excluded); ``frozen``: mean of the readings
    before ``frozen_before``.  A level fires at the first reading that closes a
    run of consecutive readings, all strictly above the level, spanning more
    than the level's hours; the single-reading level fires on the first reading
    above it.  Runs are found inside each (crane, day); a run that is open at the
    end of a day is carried into the next one through a table of days."""
    tm = telemetry.select("crane_id", "reading_id", "ts", "vibration_g", "temperature_c") \
        .withColumn("_us", epoch_micros(F.col("ts")))
    if baseline == "trailing":
        tm = trailing_baseline(tm, baseline_days)
    else:
        cut = F.lit(frozen_before).cast("timestamp_ntz")
        b = telemetry.filter(F.col("ts") < cut).groupBy("crane_id").agg(
            F.avg("vibration_g").alias("_base"), F.avg("temperature_c").alias("_tbase"))
        tm = tm.join(b, "crane_id", "left").withColumn("_day", F.floor(F.col("_us") / MICROS_PER_DAY))
    checks = [(name, F.col("vibration_g") > F.col("_base") * ratio, hours)
              for name, ratio, hours in LEVELS]
    checks.append(("Inspect-temperature",
                   F.col("temperature_c") > F.col("_tbase") + TEMP_RISE_C, TEMP_HOURS))
    # one bit per level, so a reading stays one narrow row
    hits = sum((F.when(c, 1 << i).otherwise(0) for i, (_, c, _) in enumerate(checks)), F.lit(0))
    order = Window.partitionBy("crane_id", "_day").orderBy("_us", "reading_id")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = tm.select("crane_id", "_day", "reading_id", "ts", "_us", hits.alias("_hits"))
    if baseline == "frozen":
        # the join with the baseline has put all readings of a crane into one task
        x = x.repartition("crane_id", "_day")
    x = x.withColumn("_new", F.col("_hits").bitwiseAND(F.bitwise_not(F.lag("_hits", 1, 0).over(order))))

    def has(bits: str, i: int) -> Column:
        return F.col(bits).bitwiseAND(1 << i) != 0

    levels = range(len(checks))
    missed = F.bit_or(F.bitwise_not("_hits"))
    # a run starts at a hit after a miss, or at the first reading of the day
    x = x.select("crane_id", "_day", "reading_id", "ts", "_us", "_hits", missed.over(sofar).alias("_missed"), *[
        F.last(F.when(has("_new", i), F.col("_us")), ignorenulls=True).over(sofar).alias(f"_start{i}") for i in levels])
    end = F.max(F.struct("_us", "reading_id", "_hits", *[f"_start{i}" for i in levels]))
    days = x.groupBy("crane_id", "_day").agg(missed.alias("_missed"), F.min("_us").alias("_first"), end.alias("_end")) \
        .select("crane_id", "_day", "_missed", "_first", *[
            F.when(F.col("_end._hits").bitwiseAND(1 << i) != 0, F.col(f"_end._start{i}")).alias(f"_tail{i}") for i in levels])
    by_day = Window.partitionBy("crane_id").orderBy("_day")                             # rows are days
    # the run that each day leaves open: its own after a miss, that of its first reading
    # if the day before left none, else the one that it was given (NULL here)
    after_miss = F.coalesce(F.lag("_missed").over(by_day), F.lit(-1))
    opened = days.select("crane_id", "_day", *[
        F.when(has("_missed", i), F.struct(F.col(f"_tail{i}").alias("us")))
        .when((after_miss.bitwiseAND(1 << i) != 0) & F.lag(f"_tail{i}").over(by_day).isNull(),
              F.struct(F.col("_first").alias("us"))).alias(f"_open{i}") for i in levels])
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    carried = opened.select("crane_id", "_day", *[
        F.last(f"_open{i}", ignorenulls=True).over(earlier)["us"].alias(f"_carry{i}") for i in levels])
    j = x.filter("_hits <> 0").join(carried, ["crane_id", "_day"])

    def fires(i: int) -> Column:
        # "for more than N hours"; a single reading (N = 0) fires at once
        own = F.col(f"_start{i}")
        start = F.when(has("_missed", i), own).otherwise(F.coalesce(F.col(f"_carry{i}"), own))
        span = checks[i][2] * MICROS_PER_HOUR
        return has("_hits", i) & ((F.col("_us") - start > span) if span else F.lit(True))

    firsts = j.groupBy("crane_id").agg(*[F.min(F.when(fires(i), F.col("ts"))).alias(f"_ts{i}") for i in levels])
    return firsts.select("crane_id", F.explode(F.array(*[
        F.struct(F.lit(checks[i][0]).alias("level"), F.col(f"_ts{i}").alias("first_fire_ts")) for i in levels])).alias("_l")) \
        .select("crane_id", "_l.*").filter(F.col("first_fire_ts").isNotNull())
