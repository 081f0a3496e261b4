"""Language identification with error-correcting output codes (op7).

Every language has a codeword; for each bit a binary classifier over hashed byte
trigrams tells the languages with a 1 from those with a 0.  Decoding sums, over the
bits, the logistic loss of the classifier's margin against the codeword, weighted by
how well the bit's two sides differ, and takes the codeword with the least loss.  A
text whose two best codewords lie close together is flagged as ambiguous.

The classifiers are multinomial models fitted on trigram counts per language, which
cover every training document: tasks add up counts of a fixed number of buckets, and
slices of these are summed, so the driver gets languages x buckets numbers.

Defined results: a text that is NULL or has no letter is ``und`` with score 0 (as is
every text if nothing could be learned); documents without a language or of the held
out fold teach nothing; NULL ids belong to training; rows count one by one; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, prepare
from .text_arrays import chunks, pack, raw_rows, unpack

FOLDS, HELD_OUT = 4, 2
BUCKETS = 1 << 14
SLICES = 16
#: Number of languages up to which every two-sided split is a bit of the code.
EXHAUSTIVE = 5
#: Gap between the losses of the best two codewords below which a text is ambiguous.
AMBIGUOUS_GAP = 0.5
UNDETERMINED = "und"

#: ASCII bytes that are not letters count as blanks.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)

PREDICTION = "lang_pred string, score double, runner_up string, ambiguous boolean"


def trigram_buckets(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at every byte; ``BUCKETS`` where a row has no three bytes
    left or the trigram is blank."""
    x = LETTERS[data].astype(np.uint32)
    out = np.full(len(x), BUCKETS, np.int64)
    if len(x) >= 3:
        code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        place = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
        out[:-2] = np.where(code == 0x202020, BUCKETS, place)
        for back in (1, 2):
            ends = bounds[1:] - back
            out[ends[(ends >= 0)]] = BUCKETS
    return out


def language_counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Trigram counts (languages x buckets) over rows of (text, language number)."""
    n, width = len(languages), BUCKETS // SLICES

    def count(batches):
        import pyarrow as pa
        sums = np.zeros((n, BUCKETS + 1), np.int64)
        for batch in batches:
            data, bounds = raw_rows(batch.column(0))
            which = batch.column(1).to_numpy(zero_copy_only=False)
            for at, to in chunks(bounds):
                part, own = data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
                place = trigram_buckets(part, own)
                of = np.repeat(which[at:to].astype(np.int64), np.diff(own))
                sums += np.bincount(of * (BUCKETS + 1) + place,
                                    minlength=sums.size).reshape(sums.shape)
        if sums.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()),
                 pa.array([pack({"n": sums[:, k * width:(k + 1) * width].reshape(-1)})
                           for k in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(key, pdf):
        import pandas as pd
        total = sum(unpack(x)["n"] for x in pdf["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [pack({"n": total})]})

    schema = "slice int, counts binary"
    out = np.zeros((n, BUCKETS))
    for row in docs.mapInArrow(count, schema).groupBy("slice").applyInPandas(add, schema).collect():
        out[:, row["slice"] * width:(row["slice"] + 1) * width] = \
            unpack(bytes(row["counts"]))["n"].reshape(n, width)
    return out


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Codewords (n x bits of +1 and -1): all two-sided splits of few languages, else
    random ones, of several draws that with the largest least distance."""
    if n <= EXHAUSTIVE:
        bits = [[1 if i == 0 or split >> (i - 1) & 1 else -1 for i in range(n)]
                for split in range((1 << max(n - 1, 0)) - 1)]
        return np.array(bits, np.int64).T.reshape(n, len(bits))
    rng = np.random.default_rng(seed)
    width, best, least = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) // 2
        np.fill_diagonal(apart, code.shape[1])
        if apart.min() > least:
            best, least = code, apart.min()
    return best


def fit_bits(counts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds per bucket and bit (with a last row of 0), and the weight of each bit."""
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    odds, weight = np.zeros((BUCKETS + 1, code.shape[1]), np.float32), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        odds[:-1, b] = np.log(one / zero)
        weight[b] = ((one - zero) * np.log(one / zero)).sum()
    return odds, weight / max(weight.sum(), 1e-12)


def decode(margins: np.ndarray, code: np.ndarray, weight: np.ndarray):
    """(order of the codewords, their losses, probability of the best) per text."""
    loss = np.stack([(np.logaddexp(0, -margins * word) * weight).sum(1) for word in code], 1)
    order = np.argsort(loss, 1, kind="stable")
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * 2)
    return order, loss, 1 / odds.sum(1)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, runner_up, ambiguous."""
    spark = docs.sparkSession
    prepare(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                        F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"),
                        F.col(lang).cast("string").alias("l"),
                        (F.pmod(id_crc(F.col(doc_id)), F.lit(FOLDS)) == HELD_OUT).alias("held_out"))
    teaching = plain.filter(~F.col("held_out") & F.col("l").isNotNull())
    # one row per language, whatever the number of documents
    languages = sorted(r["l"] for r in teaching.select("l").distinct().collect())
    if len(languages) > 1:
        number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
        code = codewords(len(languages))
        odds, weight = fit_bits(language_counts(
            teaching.select("t", F.element_at(number, F.col("l"))), languages), code)

    def predict(batches):
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names, scores = [UNDETERMINED] * n, np.zeros(n)
            second, ambiguous = [None] * n, np.zeros(n, bool)
            letters = batch.column(3).to_numpy(zero_copy_only=False)
            if len(languages) == 1:
                names = [languages[0] if x else UNDETERMINED for x in letters]
                scores = letters.astype(float)
            elif languages:
                data, bounds = raw_rows(batch.column(2))
                sums, grams = np.zeros((n, code.shape[1])), np.zeros(n)
                for at, to in chunks(bounds):
                    part, own = data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
                    place = trigram_buckets(part, own)
                    full = np.flatnonzero(np.diff(own)) + at
                    if len(full):
                        starts = own[:-1][np.diff(own) > 0]
                        sums[full] = np.add.reduceat(odds[place], starts, axis=0)
                        grams[full] = np.add.reduceat((place < BUCKETS).astype(np.int64), starts)
                margins = sums / np.sqrt(np.maximum(grams, 1))[:, None]
                order, loss, likely = decode(margins, code, weight)
                gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss.min(1)
                for i in np.flatnonzero(letters):
                    names[i], second[i] = languages[order[i, 0]], languages[order[i, 1]]
                    scores[i], ambiguous[i] = likely[i], gap[i] < AMBIGUOUS_GAP
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(second, pa.string()),
                 pa.array(ambiguous, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])

    return plain.select("doc_id", "held_out", "t", F.col("t").rlike(r"\p{L}")).mapInArrow(
        predict, f"doc_id long, held_out boolean, {PREDICTION}")
