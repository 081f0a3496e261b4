import datetime as dt
import os
import tempfile

from quayside.streaming.drift import drift_stream

SCHEMA = ("crane_id string, reading_id long, ts timestamp_ntz, vibration_g double, "
          "temperature_c double")


def _run_stream(spark, df, name, slices=4):
    """Feed ``df`` as ``slices`` time-ordered files, one micro-batch each."""
    import time
    from pyspark.sql import functions as F
    d = tempfile.mkdtemp(prefix="telemetry-")
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / slices
    for i in range(slices):
        a, b = lo + step * i, (lo + step * (i + 1) if i < slices - 1 else hi + dt.timedelta(seconds=1))
        part = df.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
        part.coalesce(1).write.parquet(os.path.join(d, "in", f"s{i:03d}"))
        time.sleep(0.05)                      # distinct file modification times
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        os.path.join(d, "in", "*"))
    q = (drift_stream(src).writeStream.format("memory").queryName(name)
         .outputMode("append").option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    return {(r.crane_id, r.level, r.first_fire_ts) for r in spark.sql(f"SELECT * FROM {name}").collect()}


def test_drift_stream_fires_levels(spark):
    t0 = dt.datetime(2026, 6, 1)
    rows, rid = [], 0
    for h in range(24 * 10):                       # 10 days hourly, steady then drifting
        t = t0 + dt.timedelta(hours=h)
        v = 0.36 if h < 24 * 7 else 0.36 * 1.8
        rows += [("QC3", rid, t, v, 55.0), ("QC1", rid + 1, t, 0.35, 55.0)]
        rid += 2
    rows.append(("QC1", rid, t0 + dt.timedelta(days=9, minutes=30), 2.0, 55.0))  # single spike > 3x
    got = {(c, lvl) for c, lvl, _ in _run_stream(spark, spark.createDataFrame(rows, SCHEMA), "drift_a")}
    assert ("QC3", "Watch") in got
    assert ("QC1", "Stop") in got
    assert not any(c == "QC1" and lvl == "Watch" for c, lvl in got)


def test_drift_stream_passes_over_missing_values(spark):
    from quayside.operators import operations as O
    t0 = dt.datetime(2026, 6, 1)
    rows = [("QC1", h, t0 + dt.timedelta(hours=h), None if h == 10 else (3.6 if h == 70 else 0.36), 55.0)
            for h in range(72)]
    df = spark.createDataFrame(rows, SCHEMA)
    batch = {(r.crane_id, r.level, r.first_fire_ts) for r in O.drift_levels(df).collect()}
    assert _run_stream(spark, df, "drift_c") == batch == {("QC1", "Stop", t0 + dt.timedelta(hours=70))}


def test_drift_stream_fires_once_across_a_pause(spark):
    t0 = dt.datetime(2026, 6, 1)
    hours = [*range(24), *range(24 * 30, 24 * 31)]           # a day, a month of silence, a day
    rows = [("QC1", h, t0 + dt.timedelta(hours=h), 3.6 if h % 24 == 20 else 0.36, 55.0) for h in hours]
    rows += [("QC2", 10_000 + h, t0 + dt.timedelta(hours=h), 0.36, 55.0) for h in range(24 * 31)]
    got = _run_stream(spark, spark.createDataFrame(rows, SCHEMA), "drift_d", slices=8)
    assert {x for x in got if x[0] == "QC1"} == {("QC1", "Stop", t0 + dt.timedelta(hours=20))}


def test_drift_runs_cross_days(spark):
    """Runs over midnight, over several days and over days without readings."""
    import random

    from quayside.operators import operations as O
    rng = random.Random(4)
    t0, rows = dt.datetime(2026, 6, 1), []
    for crane in range(8):
        t, v = t0, 0.36
        for i in range(200):
            t += dt.timedelta(hours=rng.choice([1, 2, 5, 30]))
            v = rng.choice([0.36, 0.6, 0.9]) if rng.random() < 0.15 else v
            rows.append((f"QC{crane}", crane * 1000 + i, t, None if rng.random() < 0.05 else v, 50 + 12 * (v > 0.5)))
    levels = [(n, r, h) for n, r, h in O.LEVELS]
    want = set()
    for crane in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == crane]
        for name, ratio, span in levels + [("Inspect-temperature", None, O.TEMP_HOURS)]:
            start = None
            for _, _, t, v, temp in own:
                past = [(r[3], r[4]) for r in own if t - dt.timedelta(days=7) <= r[2] < t]
                xs = [p[0] for p in past if p[0] is not None] if ratio else [p[1] for p in past]
                base = sum(xs) / len(xs) if xs else None
                x = v if ratio else temp
                hit = base is not None and x is not None and x > (base * ratio if ratio else base + O.TEMP_RISE_C)
                start = (start or t) if hit else None
                if hit and (span == 0 or t - start > dt.timedelta(hours=span)):
                    want.add((crane, name, t))
                    break
    df = spark.createDataFrame([(c, i, t, v, float(p)) for c, i, t, v, p in rows], SCHEMA)
    assert {(r.crane_id, r.level, r.first_fire_ts) for r in O.drift_levels(df).collect()} == want and want


def test_drift_stream_equals_batch(spark, tables):
    """In-order stream over the adapter telemetry == the batch job."""
    from quayside.operators import operations as O
    from quayside.sources import adapters as A
    tel = A.crane_telemetry(tables).select("crane_id", "reading_id", "ts", "vibration_g",
                                           "temperature_c")
    batch = {(r.crane_id, r.level, r.first_fire_ts) for r in O.drift_levels(tel).collect()}
    stream = _run_stream(spark, tel, "drift_b")
    assert stream == batch and len(batch) > 0


def test_ledger_stream_matches_batch_fold(spark):
    from quayside.operators import ledger as L
    from quayside.streaming.ledger import ledger_stream
    d = tempfile.mkdtemp(prefix="actions-")
    t = dt.datetime(2026, 1, 1)
    acts = [(1, "approve", "a", t, 1), (1, "reject", "b", t + dt.timedelta(days=1), 2),
            (2, "reject", "c", t, 3), (9, "approve", "d", t, 4),
            (2, "approve", "e", t + dt.timedelta(days=2), 5), (3, "approve", "f", t, 6)]
    schema = "rec_id long, action string, reviewer string, action_ts timestamp, action_id long"
    # two files: the later actions arrive in a second micro-batch
    spark.createDataFrame(acts[:3], schema).coalesce(1).write.parquet(os.path.join(d, "a", "1"))
    recs = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending")],
                                 "rec_id long, status string")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        os.path.join(d, "a", "*"))
    q = (ledger_stream(src, recs).writeStream.format("memory").queryName("ledger_out")
         .outputMode("append").option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame(acts[3:], schema).coalesce(1).write.parquet(os.path.join(d, "a", "2"))
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM ledger_out").collect()
    final = {}
    for r in sorted(out, key=lambda r: (r.action_ts, r.action_id)):
        if r.outcome == "applied":
            final[r.rec_id] = r.status
    bad = sorted((r.action_id, r.outcome.split(":")[1]) for r in out if r.outcome != "applied")
    a = spark.createDataFrame(acts, schema)
    batch_state = {r.rec_id: r.status for r in L.fold_ledger(recs, a).collect()
                   if r.status != "pending"}
    batch_viol = sorted((r.action_id, r.reason) for r in L.violations(recs, a).collect())
    assert final == batch_state == {1: "approved", 2: "rejected", 3: "approved"}
    assert bad == batch_viol == [(2, "not_pending"), (4, "unknown_id"), (5, "not_pending")]
