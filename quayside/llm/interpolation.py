"""Word language model by deleted interpolation (op5).

P(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1), the weights a2, a1, a0
taken from the bucket of the context's frequency c(v) (by powers of two) and learned
by expectation-maximisation on a part of the training documents whose counts are
deleted first.  A text's context begins with a begin sign; its last token is the end.

All counts are exact and cover every training document.  Each block of documents
sends its distinct words and word pairs once, with their counts, to the partition of
their hash; there they are summed, and the sums go back to the blocks that asked, in
the order in which the block can list its pairs again.  So no task holds more than a
block or a hash range, and a word that is in every document is one entry per block.

Defined results: a NULL or empty text is the end alone; NULL ids belong to training;
rows count one by one, repeated ones too; without training documents N = V = 0 and all
scores are 0; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, partitions, prepare, shared_folder, stored
from .text_arrays import mix, pack, unpack
from .word_blocks import read_block, write_blocks

FOLDS, HELD_OUT = 7, 2
#: Training fold whose counts are deleted to learn the weights.
DELETED = 4
BUCKETS = 48
#: Ratios of the components are kept in steps of a quarter octave for the E-step, from
#: 2 ** -47.75 to 2 ** 79.75: wider than any ratio of counts.
STEPS, LOW, SPAN = 4, -192, 512

BEGIN, END = np.uint64(0x1F3D5B79A2C4E6F8), np.uint64(0x8E6C4A2F1D3B5979)
WORD, PAIR = 0, 1

COUNTS = "part int, block long, path string, kind int, keys binary, counts binary"
TOTALS = ("block long, path string, part int, kind int, totals binary, "
          "tokens long, deleted_tokens long, types long")
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def sequences(block: dict[str, np.ndarray]):
    """Token hashes of all documents with begin and end signs: dictionary, token index,
    document of each token, and the mask of tokens that are predicted."""
    dictionary = np.concatenate([np.cumsum(block["dictionary"]), [BEGIN, END]]).astype(np.uint64)
    n, words = len(block["words"]), block["words"]
    begin, end = len(dictionary) - 2, len(dictionary) - 1
    size = words + 2
    bounds = np.concatenate([[0], np.cumsum(size)])
    token = np.empty(bounds[-1], np.int64)
    predicted = np.ones(bounds[-1], bool)
    predicted[bounds[:-1]] = False
    inner = predicted.copy()
    inner[bounds[1:] - 1] = False
    token[bounds[:-1]], token[bounds[1:] - 1] = begin, end
    token[inner] = block["word"]
    return dictionary, token, np.repeat(np.arange(n), size), predicted


def listing(block: dict[str, np.ndarray]):
    """The block's words and pairs as sorted distinct hashes, with the index of every
    token, of its context, and of the pair."""
    dictionary, token, doc, predicted = sequences(block)
    order = np.argsort(dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    current = np.flatnonzero(predicted)
    word, context = rank[token[current]], rank[token[current - 1]]
    words = dictionary[order]
    pair_hash = mix(words[context] + mix(words[word], 7), 3)
    pairs, pair = np.unique(pair_hash, return_inverse=True)
    return words, pairs, word, context, pair, doc[current]


def tally(block, words, pairs, word, pair, doc):
    """Counts over training documents and over the deleted part: for words, pairs."""
    fold = block["tag"][doc]
    train, deleted = fold != HELD_OUT, fold == DELETED
    begin = np.searchsorted(words, BEGIN)
    out = []
    for n, index in ((len(words), word), (len(pairs), pair)):
        out.append([np.bincount(index[m], minlength=n) for m in (train, deleted)])
    for k, m in enumerate((block["tag"] != HELD_OUT, block["tag"] == DELETED)):
        out[WORD][k][begin] = m.sum()
    return out


def count_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    def count(batches):
        import pyarrow as pa
        edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for batch in batches:
            for number, path in zip(*(c.to_pylist() for c in batch.columns)):
                block = read_block(path)
                words, pairs, word, _, pair, doc = listing(block)
                counts = tally(block, words, pairs, word, pair, doc)
                rows = []
                for kind, keys in ((WORD, words), (PAIR, pairs)):
                    cut = [0, *np.searchsorted(keys, edges), len(keys)]
                    for part in range(parts):
                        a, b = cut[part], cut[part + 1]
                        if a < b:
                            gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                            rows.append((part, number, path, kind, pack({"gap": gaps}), pack(
                                {"train": counts[kind][0][a:b].astype(np.uint32),
                                 "deleted": counts[kind][1][a:b].astype(np.uint32)})))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), (
                        pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["part", "block", "path", "kind", "keys", "counts"])

    return blocks.select("block", "path").repartition(parts).mapInArrow(count, COUNTS)


def total_counts(counts: DataFrame) -> DataFrame:
    """Sum the counts of every word and pair, and answer each block."""

    def total(pdf):
        import pandas as pd
        out = []
        for kind, rows in pdf.groupby("kind"):
            keys = [np.cumsum(unpack(x)["gap"], dtype=np.uint64) for x in rows["keys"]]
            given = [unpack(x) for x in rows["counts"]]
            distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
            sums = {k: np.bincount(index, np.concatenate([g[k] for g in given]),
                                   len(distinct)).astype(np.int64) for k in ("train", "deleted")}
            real = distinct != BEGIN
            own = kind == WORD
            facts = [int(sums["train"][real].sum()) * own, int(sums["deleted"][real].sum()) * own,
                     int((sums["train"][real] > 0).sum()) * own]
            at = 0
            for k, block, path, part in zip(keys, rows["block"], rows["path"], rows["part"]):
                mine = index[at:at + len(k)]
                at += len(k)
                out.append((block, path, part, kind, pack(
                    {n: s[mine].astype(np.uint32 if s.max(initial=0) < 1 << 32 else np.uint64)
                     for n, s in sums.items()}), *facts))
                facts = [0, 0, 0]
        return pd.DataFrame(out, columns=[x.split()[0] for x in TOTALS.split(", ")])

    return counts.groupBy("part").applyInPandas(total, TOTALS)


def answers(pdf):
    """A block with its listing and the totals of its words and pairs."""
    block = read_block(pdf["path"].iloc[0])
    words, pairs, word, context, pair, doc = listing(block)
    found = {}
    for kind, rows in pdf.sort_values(["kind", "part"]).groupby("kind"):
        given = [unpack(x) for x in rows["totals"]]
        found[kind] = {n: np.concatenate([g[n] for g in given]).astype(np.float64)
                       for n in ("train", "deleted")}
    if len(found[WORD]["train"]) != len(words) or len(found.get(PAIR, found[WORD])["train"]) != len(pairs):
        raise ValueError("a block's totals do not match its listing")
    return block, found, word, context, pair, doc


def bucket(context_count: np.ndarray) -> np.ndarray:
    seen = context_count > 0
    return np.where(seen, 1 + np.floor(np.log2(np.where(seen, context_count, 1))), 0).astype(np.int64)


def components(pair_count, context_count, word_count, tokens, types):
    """The three estimates for each token."""
    p2 = np.divide(pair_count, context_count, out=np.zeros_like(pair_count), where=context_count > 0)
    p1 = word_count / tokens if tokens else np.zeros_like(word_count)
    return p2, p1, 1.0 / (types + 1)


def histogram(totals: DataFrame, tokens: int, types: int) -> DataFrame:
    """Held-out counts: tokens of the deleted part by bucket and component ratios."""

    def collect(pdf):
        import pandas as pd
        if not (read_block(pdf["path"].iloc[0])["tag"] == DELETED).any():
            return pd.DataFrame({"cell": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        block, found, word, context, pair, doc = answers(pdf)
        out = block["tag"][doc] == DELETED
        kept = {k: f["train"] - f["deleted"] for k, f in found.items()}
        seen = kept[WORD][context[out]]
        p2, p1, p0 = components(kept[PAIR][pair[out]], seen, kept[WORD][word[out]], tokens, types)
        cells = bucket(seen)
        for p in (p2, p1):
            step = np.round(STEPS * (np.log2(np.where(p > 0, p, 1) / p0)) - LOW)
            cells = cells * SPAN + np.where(p > 0, np.clip(step, 1, SPAN - 1), 0).astype(np.int64)
        cell, n = np.unique(cells, return_counts=True)
        return pd.DataFrame({"cell": cell, "n": n})

    return totals.groupBy("block").applyInPandas(collect, "cell long, n long") \
        .groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """EM over the histogram (at most BUCKETS * SPAN * SPAN cells): weights (a2, a1, a0)
    per bucket; a bucket without held-out tokens takes those of all buckets together."""
    def ratio(step):
        return np.where(step > 0, 2.0 ** ((step + LOW) / STEPS), 0.0)

    p = np.stack([ratio(cells // SPAN % SPAN), ratio(cells % SPAN),
                  np.ones(len(cells))], 1)
    of = cells // (SPAN * SPAN)

    def fit(rows, weight):
        a = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = p[rows] * a
            share /= share.sum(1, keepdims=True)
            a = (share * weight[:, None]).sum(0) / weight.sum()
        a = np.maximum(a, 1e-6)
        return a / a.sum()

    general = fit(slice(None), n) if len(cells) else np.array([0.4, 0.4, 0.2])
    out = np.tile(general, (BUCKETS, 1))
    for b in np.unique(of):
        out[b] = fit(of == b, n[of == b])
    out[0] = [0, out[0][0] + out[0][1], out[0][2]]  # an unseen context says nothing
    return out


def score_blocks(totals: DataFrame, weights: np.ndarray, tokens: int, types: int) -> DataFrame:
    def score(pdf):
        import pandas as pd
        block, found, word, context, pair, doc = answers(pdf)
        n = len(block["id"])
        count = found[WORD]["train"][word]
        if tokens:
            seen = found[WORD]["train"][context]
            p2, p1, p0 = components(found[PAIR]["train"][pair], seen, count, tokens, types)
            a = weights[bucket(seen)]
            model = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] * p0)
        else:
            model = np.zeros(len(word))
        base = np.log10((count + 1) / (tokens + types + 1))
        return pd.DataFrame({
            "doc_id": pd.Series(block["id"], dtype="Int64").where(block["null"] == 0),
            "held_out": block["tag"] == HELD_OUT, "n_tokens": np.bincount(doc, minlength=n),
            "n_known": np.bincount(doc, count > 0, n).astype(np.int64), "train_tokens": tokens,
            "base_score": np.bincount(doc, base, n), "score": np.bincount(doc, model, n)})

    return totals.groupBy("block").applyInPandas(score, SCORES)


def interpolated_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents under the model learned from the training folds."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = write_blocks(docs, shared_folder(spark, "lm"), F.col(doc_id), F.col(text),
                          F.pmod(id_crc(F.col(doc_id)), F.lit(FOLDS)))
    totals = stored(total_counts(count_blocks(blocks, partitions(spark))), "lm-totals")
    tokens, deleted, types = (x or 0 for x in totals.agg(
        F.sum("tokens"), F.sum("deleted_tokens"), F.sum("types")).first())
    cells = histogram(totals, tokens - deleted, types).toPandas() if deleted else None
    weights = learn_weights(*((cells["cell"].to_numpy(), cells["n"].to_numpy(np.float64))
                              if deleted else (np.zeros(0, np.int64), np.zeros(0))))
    return score_blocks(totals, weights, tokens, types)
