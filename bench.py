"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to a ``noop`` sink (full execution, no collect).  A warm-up
pass on the smallest scale factor loads the JVM code paths and Python
workers first, so the timed pass measures the queries, not start-up.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quayside.plans.registry import load_all  # noqa: E402
from quayside.session import get_spark  # noqa: E402
from quayside.sources.tables import Tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
ONLY = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
# Warm-up set: one query per code path (joins, windows, folds, Arrow UDFs,
# mapInPandas, ML) so the timed pass does not pay JIT and worker start-up.
WARM = ["billing_anomaly_scan", "review_ledger", "chunk_documents", "embed_chunks",
        "vector_topk", "rag_prompt", "html_text", "model_batch", "drift_levels",
        "repeat_overrun", "assign_ids", "dq_pk", "triage_model"]


def sf_of(path: str):
    base = os.path.basename(os.path.normpath(path))
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return base


def run(spark, q, d):
    df = q.build(Tables(spark, d))
    df.write.format("noop").mode("overwrite").save()


def main():
    extra = {"spark.sql.files.maxPartitionBytes": str(64 << 20)}
    for kv in os.environ.get("BENCH_CONF", "").split(","):
        if "=" in kv:
            k, v = kv.split("=", 1)
            extra[k] = v
    spark = get_spark(f"local[{CPUS}]", app="quayside-bench",
                      shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", max(8, int(CPUS) * 2))),
                      extra=extra)
    reg = load_all()
    names = [n for n in reg if not ONLY or n in ONLY]
    if os.path.isdir(WARM_DIR):
        for n in [w for w in WARM if w in reg]:
            try:
                run(spark, reg[n], WARM_DIR)
            except Exception:  # noqa: BLE001
                pass
    times, errors = {}, {}
    for n in names:
        t0 = time.time()
        try:
            run(spark, reg[n], SF_DIR)
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf_of(SF_DIR), "cpus": int(CPUS),
           "n_queries": len(times)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
