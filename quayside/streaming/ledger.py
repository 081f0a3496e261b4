"""L1 as a streaming job: the review ledger folded per recommendation.

Review actions arrive as a stream.  ``applyInPandasWithState`` keyed by
``rec_id`` keeps one small state per recommendation (its status, the
applying action and its time).  The first action of a pending
recommendation moves it to approved / rejected and is emitted as a state
change; every later action is emitted as a violation, as in the batch fold.
Actions of one micro-batch are applied in (action_ts, action_id) order.
An action on an id with no filed recommendation is a violation too: the
filed ids are a static side joined in before the stateful step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT_SCHEMA = ("rec_id long, action_id long, action string, reviewer string, "
              "action_ts timestamp, status string, outcome string")
STATE_SCHEMA = "status string, action_id long"


def ledger_stream(actions: DataFrame, recs: DataFrame) -> DataFrame:
    """actions: streaming (rec_id, action, reviewer, action_ts, action_id);
    recs: static (rec_id, ...) of filed recommendations (all pending)."""
    known = recs.select("rec_id", F.lit(True).alias("known"))
    a = actions.join(known, "rec_id", "left")

    def fold(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, applied = state.get if state.exists else ("pending", None)
        pdf = pd.concat(list(pdfs)).sort_values(["action_ts", "action_id"])
        out = []
        for r in pdf.itertuples(index=False):
            if r.known is not True:
                outcome = "violation:unknown_id"
            elif status == "pending":
                status = "approved" if r.action == "approve" else "rejected"
                applied = int(r.action_id)
                outcome = "applied"
            else:
                outcome = "violation:not_pending"
            out.append((int(key[0]), int(r.action_id), r.action, r.reviewer, r.action_ts,
                        status if r.known is True else None, outcome))
        if out[0][5] is not None:
            state.update((status, applied))
        yield pd.DataFrame(out, columns=["rec_id", "action_id", "action", "reviewer",
                                         "action_ts", "status", "outcome"])

    return a.groupBy("rec_id").applyInPandasWithState(
        fold, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
