"""Operational-question goldens from the reference's berth-call seed rows."""

import datetime as dt
import re

from quayside.operators import operations as O

UTC4 = dt.timedelta(hours=4)


def ts(s):
    return None if s is None else dt.datetime.fromisoformat(s) - UTC4


# Seed berth calls of the reference: vessel, berth, etd, actual arrival, actual departure.
CALLS = [
    (1, "Neptune Voyager", "berth_2", "2026-07-14 12:00", "2026-07-14 05:10", "2026-07-14 18:00"),
    (2, "Silver Horizon", "berth_1", "2026-07-14 15:00", "2026-07-14 07:05", "2026-07-14 15:20"),
    (3, "Camden Reach", "berth_2", "2026-07-16 02:00", "2026-07-15 18:05", None),
    (4, "Aurora", "berth_2", "2026-07-15 22:00", None, None),
    (5, "Aurora", "berth_3", "2026-07-16 12:00", "2026-07-16 04:00", "2026-07-16 12:40"),
    (6, "Ionian Star", "berth_1", "2026-07-16 14:00", "2026-07-16 06:30", "2026-07-16 14:10"),
]


def test_plan_overrun_golden(spark):
    rows = [(i, v, b, ts(e), ts(a), ts(d)) for i, v, b, e, a, d in CALLS]
    df = spark.createDataFrame(rows, "call_id long, vessel string, berth_id string, etd timestamp_ntz, "
                                     "actual_arrival timestamp_ntz, actual_departure timestamp_ntz")
    got = {r.call_id: r.overrun_hours for r in O.overrun_hours(df).collect()}
    assert got == {1: 6.0, 2: 0.33, 3: None, 4: None, 5: 0.67, 6: 0.17}


def test_repeat_overrun_counts_earlier_calls_same_berth_month(spark):
    u = dt.datetime.fromisoformat          # UTC instants
    rows = [(1, "B1", u("2026-07-01 00:00"), u("2026-07-02 00:00"), u("2026-07-01 00:00")),
            (2, "B1", u("2026-07-05 00:00"), u("2026-07-06 00:00"), u("2026-07-05 00:00")),
            (3, "B1", u("2026-07-05 06:00"), u("2026-07-06 06:00"), u("2026-07-05 06:00")),
            (4, "B1", u("2026-08-01 00:00"), u("2026-08-02 00:00"), u("2026-08-01 00:00")),
            (5, "B2", u("2026-07-09 00:00"), u("2026-07-10 00:00"), u("2026-07-09 00:00"))]
    df = spark.createDataFrame(rows, "call_id long, berth_id string, actual_arrival timestamp_ntz, "
                                     "actual_departure timestamp_ntz, etd timestamp_ntz")
    got = {r.call_id: r.earlier_overruns for r in O.repeat_overrun(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}


def test_frozen_drift_deals_a_crane_out_by_day(spark):
    """Runs against a frozen baseline by plain search; no task gets all readings of a crane,
    and a reading stays one row for all levels."""
    import random
    rng, t0, rows = random.Random(8), dt.datetime(2024, 1, 1), []
    for crane in range(6):
        t, v = t0, 0.36
        for i in range(300):
            t += dt.timedelta(hours=rng.choice([0, 1, 2, 7, 30]))
            v = rng.choice([0.36, 0.6, 0.9, 1.5]) if rng.random() < 0.1 else v
            rows.append((f"QC{crane}", crane * 1000 + i, t, None if rng.random() < 0.03 else v, 50.0 + 12 * (v > 0.5)))
    rows += [(None, 1, t0, 9.0, 99.0), ("QC1", 9999, None, 9.0, 99.0), ("QC9", 1, t0 + dt.timedelta(days=90), 9.0, 99.0)]
    df = spark.createDataFrame(rows, "crane_id string, reading_id long, ts timestamp_ntz, vibration_g double, temperature_c double")
    want, cut = set(), t0 + dt.timedelta(days=7)
    for crane in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == crane and r[2]), key=lambda r: (r[2], r[1]))
        for name, ratio, span in [*O.LEVELS, ("Inspect-temperature", None, O.TEMP_HOURS)]:
            past = [r[3] if ratio else r[4] for r in own if r[2] < cut]
            past = [x for x in past if x is not None]
            base, start = (sum(past) / len(past) if past else None), None
            for _, _, t, v, temp in own:
                x = v if ratio else temp
                hit = base is not None and x is not None and x > (base * ratio if ratio else base + O.TEMP_RISE_C)
                start = (start or t) if hit else None
                if hit and (span == 0 or t - start > dt.timedelta(hours=span)):
                    want.add((crane, name, t))
                    break
    got = O.drift_levels(df, baseline="frozen", frozen_before="2024-01-08")
    assert {(r.crane_id, r.level, r.first_fire_ts) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert re.search(r"hashpartitioning\(crane_id#\d+, _day#\d+L?, 8\), REPARTITION_BY_COL", plan)
