"""N5 as a streaming job: crane telemetry drift with event-time state.

Readings arrive as a stream (``ts`` with a watermark).  Per crane, an
``applyInPandasWithState`` operator keeps the readings of the last
``baseline_days`` days (numpy arrays, stored as bytes: bounded by one
sensor's sample rate x the window) and, per level, the start of the current
run above it.  For in-order data this reproduces the batch job
``operators.operations.drift_levels`` exactly: baseline = mean of the
readings in [t - days, t), runs of consecutive readings strictly above the
level, firing when a run lasts more than the level's hours (a single
reading for the 3x level).  Each level is emitted once per crane, the first
time it fires.  Readings later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.operations import LEVELS, TEMP_HOURS, TEMP_RISE_C

OUT_SCHEMA = "crane_id string, level string, first_fire_ts timestamp_ntz"
STATE_SCHEMA = "readings binary, runs string, fired string"
UNIT = 1_000_000                       # readings are kept in millionths, so sums are exact
MISSING = np.iinfo(np.int64).min       # a reading without a value
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _levels():
    return [(n, "v", r, 0.0, h) for n, r, h in LEVELS] + \
        [("Inspect-temperature", "t", 1.0, TEMP_RISE_C, TEMP_HOURS)]


def _micro_units(x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    known = ~np.isnan(x)
    return np.where(known, np.round(np.where(known, x, 0) * UNIT), MISSING).astype(np.int64)


def drift_stream(readings: DataFrame, baseline_days: int = 7,
                 watermark: str = "2 hours") -> DataFrame:
    """readings: streaming (crane_id, reading_id, ts timestamp_ntz,
    vibration_g double, temperature_c double)."""
    levels = _levels()
    window = baseline_days * DAY_US

    def step(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            old, runs, fired = (np.frombuffer(state.get[0], np.int64).reshape(3, -1),
                                json.loads(state.get[1]), set(json.loads(state.get[2])))
        else:
            old, runs, fired = np.empty((3, 0), np.int64), {}, set()
        if state.hasTimedOut:
            # the readings are past the window; what has fired must not fire again
            state.update((b"", "{}", json.dumps(sorted(fired))))
            return
        pdf = pd.concat(list(pdfs))
        us = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        order = np.lexsort((pdf["reading_id"].to_numpy(), us))
        us, stamps = us[order], pdf["ts"].to_numpy()[order]
        new = np.stack([us, *(_micro_units(pdf[c].to_numpy()[order]) for c in ("vibration_g", "temperature_c"))])
        seen = np.concatenate([old, new], axis=1)
        # readings that arrive late but inside the watermark are put in their place
        seen = seen[:, np.argsort(seen[0], kind="stable")]
        first, last = (np.searchsorted(seen[0], x, "left") for x in (us - window, us))
        hits = {}
        for row, (values, kind) in enumerate((("vibration_g", "v"), ("temperature_c", "t")), start=1):
            known = seen[row] != MISSING
            total = np.concatenate([[0], np.cumsum(np.where(known, seen[row], 0))])
            count = np.concatenate([[0], np.cumsum(known)])
            n = count[last] - count[first]
            base = (total[last] - total[first]) / UNIT / np.maximum(n, 1)
            x = pdf[values].to_numpy(np.float64)[order]
            for name, of, ratio, rise, span in levels:
                if of == kind:
                    with np.errstate(invalid="ignore"):
                        hits[name] = (n > 0) & (x > base * ratio + rise), span
        out = []
        for name, (hit, span) in hits.items():
            miss = np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            start = np.where(miss >= 0, us[np.minimum(miss + 1, len(us) - 1)], runs.get(name, us[0]))
            closes = np.flatnonzero(hit & ((span == 0) | (us - start > span * HOUR_US)))
            if name not in fired and len(closes):
                fired.add(name)
                out.append((key[0], name, stamps[closes[0]]))
            runs.pop(name, None)
            if hit[-1]:
                runs[name] = int(start[-1])
        seen = seen[:, seen[0] >= seen[0, -1] - window]
        state.update((np.ascontiguousarray(seen).tobytes(), json.dumps(runs), json.dumps(sorted(fired))))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + baseline_days * 86_400_000)
        if out:
            yield pd.DataFrame(out, columns=["crane_id", "level", "first_fire_ts"])

    # watermarks need TIMESTAMP; the session zone is UTC, so the cast keeps the instant
    timed = readings.withColumn("_event_time", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("_event_time", watermark).groupBy("crane_id")
            .applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))
