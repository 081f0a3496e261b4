"""Quality classifier: a factorisation machine (op10).

Features of a text are its hashed words (share of each bucket, length 1 per text) and
a few statistics of its structure, with the stored number of characters as metadata.
The machine adds a weight per feature and the product of low-rank vectors for each
pair of features; by the identity  sum_{i<j} <v_i, v_j> x_i x_j =
1/2 (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2)  a text is scored in time linear in its
features.  It is fitted on the driver on a sample of at most ``SAMPLE`` labelled
documents outside the held-out fold, those with the smallest hash of their id.

Defined results: a NULL or empty text has no words and is scored by its statistics;
NULL ids belong to training but carry no label; a document labelled more than once
counts with its lowest label, labels other than 0 and 1 are passed over; without both
labels the score is the share of label 1 (0.5 without labels); rows count one by one;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, prepare
from .text_arrays import KEEP, LINE_FEED, chunks, hashed_words, raw_rows

FOLDS, HELD_OUT = 3, 1
#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 6000
WORD_BUCKETS = 1 << 13
RANK = 4
EPOCHS, BATCH, RATE, DECAY = 12, 250, 0.02, 1e-4

STATISTICS = ("words", "word_length", "symbols", "upper", "digits", "marks", "lines",
              "line_repeats", "distinct_words", "long_words", "n_chars")


def byte_class(test) -> np.ndarray:
    return np.array([b < 128 and test(chr(b)) for b in range(256)])


SYMBOL = byte_class(lambda c: c in "#*$%&|<>")
UPPER = byte_class(str.isupper)
DIGIT = byte_class(str.isdigit)
MARK = byte_class(lambda c: c in ".,;:!?")
CONTINUED = np.array([0x80 <= b < 0xC0 for b in range(256)])


def distinct_per_row(row: np.ndarray, key: np.ndarray):
    """(row, key, count) of distinct pairs, in row order."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(first)
    return r[at], k[at], np.diff(np.append(at, len(r)))


def features(array, n_chars: np.ndarray):
    """Yield (first row, word buckets, values, entries per row, statistics) for runs of
    an Arrow array of texts."""
    data, bounds = raw_rows(array)
    for at, to in chunks(bounds):
        part, own = data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        n = to - at
        words, counts = hashed_words(part, own)
        lines, line_counts = hashed_words(part, own, LINE_FEED, KEEP)
        row = np.repeat(np.arange(n), counts)
        bucket_row, bucket, times = distinct_per_row(row, (words % np.uint64(WORD_BUCKETS)).astype(np.int64))
        weight = 1 + np.log(times)
        norm = np.sqrt(np.bincount(bucket_row, weight ** 2, n))
        value = weight / norm[bucket_row] if len(bucket_row) else weight
        distinct = np.bincount(distinct_per_row(row, words)[0], minlength=n)
        line_row = np.repeat(np.arange(n), line_counts)
        distinct_lines = np.bincount(distinct_per_row(line_row, lines)[0], minlength=n)

        def total(mask):
            sums = np.concatenate([[0], np.cumsum(mask[part])])
            return sums[own[1:]] - sums[own[:-1]]

        length = np.diff(own) - total(CONTINUED)
        some, chars = np.maximum(counts, 1), np.maximum(length, 1)
        stats = np.stack([
            np.log1p(counts), length / some, np.sqrt(total(SYMBOL) / chars),
            np.sqrt(total(UPPER) / chars), np.sqrt(total(DIGIT) / chars),
            np.sqrt(total(MARK) / chars), np.sqrt(line_counts / some),
            1 - distinct_lines / np.maximum(line_counts, 1), distinct / some,
            (length > 12 * some).astype(float), np.log1p(np.maximum(n_chars[at:to], 0))], 1)
        yield at, bucket, value, np.bincount(bucket_row, minlength=n), stats


class Machine:
    """Weights of a factorisation machine: buckets first, then the statistics."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = WORD_BUCKETS + len(STATISTICS)
        self.bias, self.linear = 0.0, np.zeros(n)
        self.factors = rng.normal(0, 0.05, (n, RANK))
        self.mean, self.spread = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def entries(self, bucket, value, sizes, stats):
        """All features of each row as one list: index, value, row."""
        n = len(sizes)
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4)
        index = np.concatenate([bucket, np.tile(WORD_BUCKETS + np.arange(len(STATISTICS)), n)])
        x = np.concatenate([value, scaled.reshape(-1)])
        row = np.concatenate([np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), len(STATISTICS))])
        return index, x, row

    def margins(self, index, x, row, n):
        """Scores before the logistic function, and the sums sum_i v_i x_i."""
        v = self.factors[index] * x[:, None]
        sums = np.stack([np.bincount(row, v[:, f], n) for f in range(RANK)], 1)
        squares = np.bincount(row, (v ** 2).sum(1), n)
        out = self.bias + np.bincount(row, self.linear[index] * x, n)
        return out + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def score(self, bucket, value, sizes, stats):
        index, x, row = self.entries(bucket, value, sizes, stats)
        margin, _ = self.margins(index, x, row, len(sizes))
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))

    def fit(self, rows: list, label: np.ndarray, seed: int = 5) -> "Machine":
        """Adam over small batches; rows: (bucket, value, statistics) per document."""
        stats = np.stack([r[2] for r in rows])
        self.mean, self.spread = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        self.bias = float(np.log(label.mean() / (1 - label.mean())))
        rng = np.random.default_rng(seed)
        state = [np.zeros((len(self.linear), RANK + 1)) for _ in range(2)]
        step, bias_state = 0, [0.0, 0.0]
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                sizes = np.array([len(rows[i][0]) for i in some])
                index, x, row = self.entries(np.concatenate([rows[i][0] for i in some]),
                                             np.concatenate([rows[i][1] for i in some]), sizes, stats[some])
                margin, sums = self.margins(index, x, row, len(some))
                slope = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label[some]
                by = slope[row] * x
                gradient = np.empty_like(state[0])
                gradient[:, 0] = np.bincount(index, by, len(self.linear))
                for f in range(RANK):
                    gradient[:, 1 + f] = np.bincount(
                        index, by * (sums[row, f] - self.factors[index, f] * x), len(self.linear))
                gradient /= len(some)
                both = np.column_stack([self.linear, self.factors])
                gradient += DECAY * both
                step += 1
                g0 = slope.mean()
                bias_state = [0.9 * bias_state[0] + 0.1 * g0, 0.999 * bias_state[1] + 0.001 * g0 ** 2]
                state = [0.9 * state[0] + 0.1 * gradient, 0.999 * state[1] + 0.001 * gradient ** 2]
                fix = [1 - 0.9 ** step, 1 - 0.999 ** step]
                both -= RATE * (state[0] / fix[0]) / (np.sqrt(state[1] / fix[1]) + 1e-8)
                self.bias -= RATE * (bias_state[0] / fix[0]) / (np.sqrt(bias_state[1] / fix[1]) + 1e-8)
                self.linear, self.factors = both[:, 0].copy(), both[:, 1:].copy()
        return self


def sample_rows(docs: DataFrame, labels: DataFrame) -> tuple[list, np.ndarray]:
    """Features and labels of the sample."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("quality").cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
             .filter(F.pmod(id_crc(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT)
             .groupBy("doc_id").agg(F.min("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))

    def describe(batches):
        import pyarrow as pa
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False)
            chars = batch.column(1).to_numpy(zero_copy_only=False)
            for at, bucket, value, sizes, stats in features(batch.column(0), chars):
                cut = np.cumsum(sizes)[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.astype(np.int16).tobytes() for x in np.split(bucket, cut)], pa.binary()),
                    pa.array([x.astype(np.float32).tobytes() for x in np.split(value, cut)], pa.binary()),
                    pa.array([x.tobytes() for x in stats], pa.binary()),
                    pa.array(label[at:at + len(sizes)].astype(np.int32))],
                    names=["bucket", "value", "stats", "y"])

    found = (docs.join(known, "doc_id").select("t", "n", "y")
             .mapInArrow(describe, "bucket binary, value binary, stats binary, y int"))
    # rows that share an id all count, so the number is bounded again
    rows = found.limit(SAMPLE).collect()
    return [(np.frombuffer(r["bucket"], np.int16).astype(np.int64),
             np.frombuffer(r["value"], np.float32).astype(np.float64),
             np.frombuffer(r["stats"], np.float64)) for r in rows], np.array([r["y"] for r in rows], float)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                   text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"),
                        F.coalesce(F.col(n_chars).cast("double"), F.lit(0.0)).alias("n"),
                        (F.pmod(id_crc(F.col(doc_id)), F.lit(FOLDS)) == HELD_OUT).alias("held_out"))
    rows, label = sample_rows(plain, labels)
    share = float(label.mean()) if len(label) else 0.5
    machine = Machine().fit(rows, label) if len(label) and 0 < share < 1 else None

    def predict(batches):
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            score = np.full(n, share)
            if machine:
                chars = batch.column(3).to_numpy(zero_copy_only=False)
                for at, bucket, value, sizes, stats in features(batch.column(2), chars):
                    score[at:at + len(sizes)] = machine.score(bucket, value, sizes, stats)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return plain.select("doc_id", "held_out", "t", "n").mapInArrow(
        predict, "doc_id long, held_out boolean, score double, predicted int")
