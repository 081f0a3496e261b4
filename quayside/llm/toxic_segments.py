"""Toxic passages as maximum-scoring segments of token log-odds (op12).

Each word has a log-odds ratio between toxic and other labelled documents, under a
Dirichlet prior in proportion to its share of the whole corpus, drawn towards zero by
its standard error.  Less a small constant, so that ordinary text scores below zero,
these are the scores of a text's tokens; one scan, linear in the tokens, finds all
maximal segments of positive score (none can be lengthened or cut to score more).

The best segment of a text of n ordinary tokens exceeds S with probability
1 - exp(-K n exp(-lambda S)): lambda and K are fitted to the labelled documents that
are not toxic.  A text's evidence is the smallest such probability of its best one,
two, ... ``SUMMED`` segments together (sum statistics), as -ln P, and a logistic curve
over the evidence gives the score.  The labelled documents are split in two halves, and
the segments for both fits come from the log-odds of the other half.

At most ``SAMPLE`` labelled documents are used, those with the smallest hash of their
id; the prior counts all documents.  Words are counted in ``BUCKETS`` hash buckets.

Defined results: a NULL or empty text has no segment; NULL ids carry no label; a document
labelled more than once counts with its highest label, labels other than 0 and 1 are
passed over; rows that share an id all count; without both labels in both halves the
score is the share of label 1 (0.5 without labels) and no passage is found; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, prepare
from .text_arrays import FOLD, PUNCTUATION, pack, rows_of_words, unpack

FOLDS, HELD_OUT = 5, 0
SAMPLE = 30_000
BUCKETS, SLICES, TREE = 1 << 18, 16, 256
#: Weight of the prior in tokens, standard errors taken off, and what each token costs.
PRIOR, ERRORS, COST = 1000.0, 1.0, 0.3
#: Segments that the sum statistic adds up, at most; expected number by chance below
#: which a segment is reported as a passage.
SUMMED, CHANCE = 8, 0.05
#: Rows of the table of counts: toxic and other in each half, and all documents.
ALL = 4

PASSAGE = "array<struct<start:int,n_tokens:int,score:double,expected:double>>"
RESULT = f"doc_id long, held_out boolean, score double, predicted int, n_passages int, passages {PASSAGE}"


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def token_counts(docs: DataFrame) -> np.ndarray:
    """Counts per bucket (5 x BUCKETS) of ``docs`` (t, row): ``row`` names the count that a
    document's tokens add to besides that of all.  Arrays are added on the executors, in
    two steps, so that no task gets those of all others."""
    width = BUCKETS // SLICES

    def count(batches):
        import pyarrow as pa
        sums = np.zeros((ALL + 1, BUCKETS), np.int64)
        for batch in batches:
            which = batch.column(1).to_numpy(zero_copy_only=False)
            for at, hashes, counts in rows_of_words(batch.column(0), PUNCTUATION, FOLD):
                place = buckets(hashes)
                sums[ALL] += np.bincount(place, minlength=BUCKETS)
                of = np.repeat(which[at:at + len(counts)], counts)
                for row in range(ALL):
                    if (of == row).any():
                        sums[row] += np.bincount(place[of == row], minlength=BUCKETS)
        if sums.any():
            part = TaskContext.get().partitionId() % TREE
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()),
                 pa.array([pack({"n": sums[:, k * width:(k + 1) * width].reshape(-1)})
                           for k in range(SLICES)], pa.binary())], names=["slice", "part", "counts"])

    def add(key, pdf):
        import pandas as pd
        total = sum(unpack(x)["n"] for x in pdf["counts"])
        return pd.DataFrame({"slice": [key[0]], "part": [0], "counts": [pack({"n": total})]})

    schema, out = "slice int, part int, counts binary", np.zeros((ALL + 1, BUCKETS))
    added = docs.select("t", "row").mapInArrow(count, schema).groupBy("slice", "part").applyInPandas(add, schema) \
        .groupBy("slice").applyInPandas(add, schema)
    for row in added.collect():
        out[:, row["slice"] * width:(row["slice"] + 1) * width] = \
            unpack(bytes(row["counts"]))["n"].reshape(ALL + 1, width)
    return out


def token_scores(toxic: np.ndarray, other: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Score of each bucket's words: log-odds ratio less its errors and the cost."""
    prior = PRIOR * (every + 1) / (every + 1).sum()
    odds = [np.log((c + prior) / (c.sum() + PRIOR - c - prior)) for c in (toxic, other)]
    error = np.sqrt(1 / (toxic + prior) + 1 / (other + prior))
    delta = odds[0] - odds[1]
    return (np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0) - COST).astype(np.float32)


def maximal_segments(before, after, first, last):
    """All maximal segments over the positive runs of one text, from left to right:
    (sum, first, last) each.  ``before`` and ``after``: sums of scores up to each run's
    begin and end.  Linear time: each candidate links to the nearest one on its left
    whose begin lies lower."""
    found = []  # (low, high, first, last, link)
    for low, high, a, b in zip(before, after, first, last):
        link = len(found) - 1
        while True:
            while link >= 0 and found[link][0] >= low:
                link = found[link][4]
            if link < 0 or found[link][1] >= high:
                break
            low, a = found[link][0], found[link][2]
            del found[link:]
            link = len(found) - 1
        found.append((low, high, a, b, link))
    return [(high - low, a, b) for low, high, a, b, _ in found]


def segments(array, scores: np.ndarray, half=None):
    """(row, number of tokens, maximal segments) of each text.  ``scores``: one table, or
    one per half, of which ``half`` says which scores a row."""
    for at, hashes, counts in rows_of_words(array, PUNCTUATION, FOLD):
        place, ends = buckets(hashes), np.cumsum(counts)
        value = scores[place] if half is None else scores[np.repeat(half[at:at + len(counts)], counts), place]
        begins = ends - counts
        sums = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
        up = value > 0
        new = up.copy()
        new[1:] &= ~up[:-1]
        starting = begins[(counts > 0)]
        new[starting] = up[starting]
        first = np.flatnonzero(new)
        close = up.copy()
        close[:-1] &= ~up[1:]
        ending = ends[(counts > 0)] - 1
        close[ending] = up[ending]
        last = np.flatnonzero(close)
        cut = np.searchsorted(first, np.append(begins, len(value)))
        low, high = sums[first].tolist(), sums[last + 1].tolist()
        first, last = first.tolist(), last.tolist()
        for k in range(len(counts)):
            a, b, o = cut[k], cut[k + 1], int(begins[k])
            some = maximal_segments(low[a:b], high[a:b], first[a:b], last[a:b]) if a < b else []
            yield at + k, int(counts[k]), [(s, x - o, y - x + 1) for s, x, y in some]


def fit_extremes(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, K) by maximum likelihood from the best segment scores of ordinary texts;
    0 stands for no segment."""
    n = np.maximum(n, 1).astype(float)
    some = best > 0
    if not some.any():
        return 1.0, 0.5 / n.sum()

    def k(rate):
        return some.sum() / ((n[some] * np.exp(-rate * best[some])).sum() + n[~some].sum())

    def slope(rate):
        return (1 / rate - best[some] + best[some] * k(rate) * n[some] * np.exp(-rate * best[some])).sum()

    low, high = 0.02, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, float(k(low))


def evidence(n: int, found: list[float], rate: float, k: float) -> float:
    """-ln of the smallest probability of the best one, two, ... segments together."""
    if not found:
        return 0.0
    room = np.log(k * max(n, 1))
    t = np.cumsum([rate * s - room for s in sorted(found, reverse=True)[:SUMMED]])
    e = np.exp(np.clip(-t[0], -700, 30))
    out = -np.log(-np.expm1(-e)) if e > 1e-12 else t[0]
    for r in range(2, len(t) + 1):
        if t[r - 1] > r:
            factorials = np.log(np.arange(1, r + 1)).sum() + np.log(np.arange(1, r)).sum()
            out = max(out, t[r - 1] - (r - 1) * np.log(t[r - 1]) + factorials)
    return float(out)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic regression of y on x (Newton's method)."""
    design, w = np.stack([np.ones(len(x)), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - ridge * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(w[0]), float(w[1])


def sampled(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labelled documents that are learned from, SAMPLE at most."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
            .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
            .filter(F.pmod(id_crc(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT)
            .groupBy("doc_id").agg(F.max("y").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))


def calibration(known: DataFrame, tables: np.ndarray):
    """Tokens, segment scores (SUMMED at most) and label of each labelled document."""
    share = known.sparkSession.sparkContext.broadcast(tables)

    def describe(batches):
        import pyarrow as pa
        for batch in batches:
            row = batch.column(1).to_numpy(zero_copy_only=False)
            out = [(n, sorted((s for s, _, _ in some), reverse=True)[:SUMMED], int(1 - row[k] % 2))
                   for k, n, some in segments(batch.column(0), share.value, 1 - row // 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.float64()), pa.int32()))],
                names=["n", "found", "y"]) if out else pa.RecordBatch.from_pydict(
                {"n": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.float64())), "y": pa.array([], pa.int32())})

    # rows that share an id all count, so the number is bounded again
    return known.select("t", "row").mapInArrow(describe, "n long, found array<double>, y int").limit(2 * SAMPLE).collect()


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages and the
    passages (first token, number of tokens, score, number expected by chance)."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"),
                        (F.pmod(id_crc(F.col(doc_id)), F.lit(FOLDS)) == HELD_OUT).alias("held_out"))
    # toxic 0, other 1, and two more in the second half; SAMPLE bounds what is broadcast
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    known = F.broadcast(sampled(labels).withColumn("row", 2 * half + 1 - F.col("y")).drop("y"))
    counts = token_counts(plain.join(known, "doc_id", "left").select("t", F.coalesce("row", F.lit(-1)).alias("row")))
    has = counts[:ALL].sum(1) > 0
    model, share = None, 0.5
    if has.all():
        tables = np.stack([token_scores(*counts[2 * k:2 * k + 2], counts[ALL]) for k in (0, 1)])
        rows = calibration(plain.join(known, "doc_id"), tables)
        n, y = (np.array([r[c] for r in rows], float) for c in ("n", "y"))
        best = np.array([max(r["found"], default=0.0) for r in rows])
        rate, k = fit_extremes(n[y == 0], best[y == 0])
        x = np.array([evidence(r["n"], r["found"], rate, k) for r in rows])
        scores = token_scores(counts[0] + counts[2], counts[1] + counts[3], counts[ALL])
        model = (scores, rate, k, *fit_curve(x, y))
    elif has.any():
        share = float(sampled(labels).agg(F.avg("y")).first()[0])
    given = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        import pyarrow as pa
        model = given.value
        for batch in batches:
            out = [(share, []) for _ in range(batch.num_rows)]
            if model is not None:
                scores, rate, k, base, slope = model
                for row, n, some in segments(batch.column(2), scores):
                    x = evidence(n, [s for s, _, _ in some], rate, k)
                    likely = 1 / (1 + np.exp(-min(max(base + slope * x, -30.0), 30.0)))
                    chance = [k * max(n, 1) * np.exp(-rate * s) for s, _, _ in some]
                    out[row] = (likely, [{"start": a, "n_tokens": m, "score": s, "expected": float(e)}
                                         for (s, a, m), e in zip(some, chance) if e < CHANCE])
            score = np.array([o[0] for o in out], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                 pa.array([len(o[1]) for o in out], pa.int32()),
                 pa.array([o[1] for o in out], pa.list_(pa.struct(
                     [("start", pa.int32()), ("n_tokens", pa.int32()), ("score", pa.float64()),
                      ("expected", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"])

    return plain.select("doc_id", "held_out", "t").mapInArrow(judge, RESULT)
