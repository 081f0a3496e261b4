"""Run registered queries on Spark and their DuckDB oracle side by side.

usage: python scripts/check_oracle.py [sf_dir] [name ...]
Prints one line per query: rows (spark/oracle), schema match, value match.
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quayside.plans.compare import norm  # noqa: E402
from quayside.plans.registry import load_all  # noqa: E402
from quayside.session import get_spark  # noqa: E402
from quayside.sources.tables import TABLES, Tables  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    reg = load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for tname in TABLES:
        con.execute(f"CREATE VIEW {tname} AS SELECT * FROM read_parquet('{sf}/{tname}.parquet')")
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.build(Tables(spark, sf))
            cols = df.columns
            srows = [tuple(norm(x) for x in r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.oracle is None:
            print(f"ROWS {name}: spark={len(srows)} ({ts:.2f}s) no oracle")
            continue
        try:
            cur = con.execute(q.oracle)
            ocols = [d[0] for d in cur.description]
            orows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        schema_ok = sorted(cols) == sorted(ocols)
        if schema_ok:
            idx = [ocols.index(c) for c in cols]
            orows = [tuple(r[i] for i in idx) for r in orows]
        same = schema_ok and Counter(srows) == Counter(orows)
        tag = "OK  " if same else "FAIL"
        bad += 0 if same else 1
        print(f"{tag} {name}: rows spark={len(srows)} oracle={len(orows)} "
              f"schema={'ok' if schema_ok else (cols, ocols)} ({ts:.2f}s)")
        if not same and schema_ok:
            a, b = Counter(srows), Counter(orows)
            print("   spark-only:", list((a - b).items())[:3])
            print("   oracle-only:", list((b - a).items())[:3])
    print(f"bad={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
