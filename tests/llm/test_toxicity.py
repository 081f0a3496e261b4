"""Toxic passages: segments by definition, the extreme-value fit, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quayside.llm import toxic_segments
from quayside.llm.queries import QUERIES


def all_maximal(scores):
    """By definition, recursively: the best segment (the shortest of equals, leftmost), and
    those on either side of it."""
    def find(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return find(a, i) + [(best[0], i, j - i)] + find(j, b)
    return find(0, len(scores))


def test_maximal_segments_by_definition(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"t{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 2, 5, 12, 25]))) for _ in range(200)]
    table = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(toxic_segments.BUCKETS)], np.float32)
    _, hashes, counts = next(toxic_segments.rows_of_words(pa.array(texts), toxic_segments.PUNCTUATION, toxic_segments.FOLD))
    values = np.split(table[toxic_segments.buckets(hashes)].tolist(), np.cumsum(counts)[:-1])
    got = {row: (n, some) for row, n, some in toxic_segments.segments(pa.array(texts), table)}
    for row, value in enumerate(values):
        n, some = got[row]
        assert n == len(value)
        # ties of neutral stretches are cut differently by definition and scan: compare sums
        assert [s for s, _, _ in some] == [s for s, _, _ in all_maximal(list(value))]
        for s, a, m in some:
            assert s == sum(value[a:a + m]) and value[a] > 0 and value[a + m - 1] > 0


def test_extremes_are_fitted():
    rng = np.random.default_rng(2)
    n, rate, k = rng.integers(50, 5000, 20_000), 0.8, 0.02
    best = np.maximum(0, (np.log(k * n) - np.log(-np.log(rng.random(len(n))))) / rate)
    got_rate, got_k = toxic_segments.fit_extremes(n, best)
    assert abs(got_rate - rate) < 0.02 and abs(np.log(got_k / k)) < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_toxic_segments"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    ranks, y = out["score"].rank(), out["toxic"] == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95
    assert (out["predicted"][~y] == 1).mean() < 0.02
    # passages in clean texts are as rare as the threshold says
    assert (out["n_passages"][~y] > 0).mean() < 2 * toxic_segments.CHANCE


def test_planted_passages(spark):
    """Toxic words in the middle of long ordinary texts are found where they are."""
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.choice([30, 200, 1500]))
        bad = i % 6 == 0
        if bad:
            at = rng.randrange(len(words) - 8)
            words[at:at + 8] = rng.choices(["vile", "scum", "rotten"], k=8)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    got = toxic_segments.toxicity(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for r in got:
        words = docs[r.doc_id][1].split(" ")
        assert r.predicted == (r.doc_id % 6 == 0)
        if r.predicted:
            p = max(r.passages, key=lambda p: p.score)
            assert set(words[p.start:p.start + p.n_tokens]) <= {"vile", "scum", "rotten"} | set(plain)
            assert sum(w in ("vile", "scum", "rotten") for w in words[p.start:p.start + p.n_tokens]) == 8


def test_odd_rows(spark, corpus, rows, empty):
    labels = spark.createDataFrame(
        [(r[0], k % 2) for k, r in enumerate(rows)] + [(5, 1), (5, 0), (7, None), (8, 3), (None, 1)],
        "doc_id long, toxic int").withColumn("score", F.lit("x"))
    got = toxic_segments.toxicity(corpus, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.n_passages == 0 for r in got if r.doc_id in (900, 901, 902))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert toxic_segments.toxicity(empty, labels).collect() == []
    one_sided = toxic_segments.toxicity(corpus, labels.filter("toxic = 1")).collect()
    assert {r.score for r in one_sided} == {1.0}
    assert {r.score for r in toxic_segments.toxicity(corpus, labels.limit(0)).collect()} == {0.5}
