"""Order-insensitive result comparison used by the oracle checks and tests."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def compare(spark_cols, spark_rows, oracle_cols, oracle_rows):
    """Return (same, detail) for two results, columns matched by name."""
    if sorted(spark_cols) != sorted(oracle_cols):
        return False, f"columns differ: {spark_cols} vs {oracle_cols}"
    idx = [oracle_cols.index(c) for c in spark_cols]
    a = Counter(tuple(norm(x) for x in r) for r in spark_rows)
    b = Counter(tuple(norm(r[i]) for i in idx) for r in oracle_rows)
    if a == b:
        return True, ""
    return False, f"spark-only {list((a - b).items())[:2]} oracle-only {list((b - a).items())[:2]}"
