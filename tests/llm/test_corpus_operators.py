"""op1, op4 and op5: decontamination, archives, language model."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quayside.llm import interpolation, spaced_seeds, warc
from quayside.llm.common import stored

from .conftest import lowered, words_of


def tokens_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute_contamination(docs, items):
    """(doc, item) pairs with a segment that fulfils the rule, over all alignments, if
    the alignment also has a common seed (an equal indexed window under some mask)."""
    out = set()
    for doc, text in docs:
        d = tokens_of(text)
        for item, passage in items:
            t = tokens_of(passage)
            if len(t) < spaced_seeds.LEAST:
                continue
            for shift in range(-len(t), len(d)):
                a, b = max(0, -shift), min(len(t), len(d) - shift)
                same = [t[i] == d[i + shift] for i in range(a, b)]
                if sum(same) < min(5, len(t)):
                    continue
                first, last = spaced_seeds.best_segment(np.array(same))
                n, equal = last - first, sum(same[first:last])
                if n >= min(spaced_seeds.SEGMENT, len(t)) and 100 * equal >= spaced_seeds.EQUAL_SHARE * n \
                        and seeded(t, d, shift):
                    out.add((doc, item))
    return out


def seeded(t, d, shift):
    span, masks = spaced_seeds.SPAN, spaced_seeds.MASKS
    if len(t) < span:
        return 0 <= shift <= len(d) - len(t)  # every allowed substitution has a seed
    places = {*range(0, len(t) - span + 1, spaced_seeds.STRIDE), len(t) - span}
    return any(0 <= p + shift <= len(d) - span and all(t[p + k] == d[p + shift + k] for k in m)
               for p in places for m in masks)


def test_contamination_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 9, 12, 20, 45])))) for i in range(25)]
    items += [(50, None), (51, ""), (None, items[4][1]), items[6]]
    docs = []
    for k in range(120):
        body = rng.choices(vocabulary, k=rng.randint(0, 80))
        if k % 2:
            passage = tokens_of(rng.choice(items)[1])
            for _ in range(k % 6):
                if passage:
                    passage[rng.randrange(len(passage))] = "changed"
            cut = rng.randint(0, len(body))
            body = body[:cut] + passage + body[cut:]
        docs.append((k, ", ".join(body).title()))
    docs += [(500, None), (501, ""), docs[1], (None, docs[3][1])]
    got = spaced_seeds.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("seeds", F.lit(1)),
        spark.createDataFrame(items, "item_id long, text string").withColumn("tokens", F.lit(1))).collect()
    want = brute_contamination(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 15
    text = dict(docs)
    for r in got:
        d, t = tokens_of(text[r.doc_id]), tokens_of(dict(items)[r.item_id])
        pairs = list(zip(d[r.doc_start:], t[r.item_start:]))[:r.n_tokens]
        assert sum(x == y for x, y in pairs) == r.n_equal and len(pairs) == r.n_tokens


def test_substituted_passages_are_found_and_clean_ones_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng = random.Random(1)
    clean = [r.text for r in docs.filter("doc_id < 40").collect()]
    planted = []
    for k, r in enumerate(items.collect()):
        w = r.text.split()
        if len(w) < 24:
            continue
        for place in rng.sample(range(len(w)), len(w) // 12):
            w[place] = "substitute"
        planted.append((10_000 + k, clean[k % 40][:300] + " " + " ".join(w) + " " + clean[k % 40][:300]))
    both = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {r.doc_id for r in spaced_seeds.contaminated(both, items).collect()}
    assert len(found & {p[0] for p in planted}) >= 0.95 * len(planted)
    exact = {r.doc_id for r in docs.collect() if any(
        " ".join(tokens_of(i.text)) in " ".join(tokens_of(r.text)) for i in items.collect())}
    assert exact <= found and len(found - exact - {p[0] for p in planted}) <= 3


def overlaps(t, d):
    """Whether some alignment has a segment of 12 tokens or more with at least 80 % equal,
    by trying all segments: no strides, masks or seeds."""
    for shift in range(-len(t) + 1, len(d)):
        a, b = max(0, -shift), min(len(t), len(d) - shift)
        sums = [0]
        for i in range(a, b):
            sums.append(sums[-1] + (t[i] == d[i + shift]))
        if sums[-1] >= 10 and any(100 * (sums[j] - sums[i]) >= 80 * (j - i)
                                  for j in range(12, len(sums)) for i in range(j - 11)):
            return True
    return False


def damaged_passages():
    """(items, docs, kinds): every sixth token replaced in each phase, exact parts of 12
    tokens, and 15 % or 20 % of the tokens replaced at random."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(5000)]
    items, docs, kinds = [], [], []

    def plant(item, passage, kind):
        docs.append((len(docs), rng.choices(vocabulary, k=70) + passage + rng.choices(vocabulary, k=70), item))
        kinds.append(kind)

    for n in (20, 50, 100):
        items.append((n, rng.choices(vocabulary, k=n)))
        for phase in range(6):
            plant(n, ["changed" if k % 6 == phase else w for k, w in enumerate(items[-1][1])], "sixth")
    for place in range(9):
        plant(20, items[0][1][place:place + 12], "part")
    for k in range(300):
        items.append((1000 + k, rng.choices(vocabulary, k=20)))
        lost = rng.sample(range(20), 3 + k % 2)
        plant(1000 + k, ["changed" if i in lost else w for i, w in enumerate(items[-1][1])], "random")
    return items, docs, kinds


def test_damaged_passages_are_found_wherever_they_begin(spark):
    """Recall against all segments: all with regular damage and all exact parts, and at
    least 93 % of those with 15 % to 20 % of 20 tokens replaced."""
    items, docs, kinds = damaged_passages()
    got = spaced_seeds.contaminated(
        spark.createDataFrame([(i, " ".join(w)) for i, w, _ in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    found, tokens = {(r.doc_id, r.item_id) for r in got}, dict(items)
    want = {(i, item): kind for (i, d, item), kind in zip(docs, kinds) if overlaps(tokens[item], d)}
    assert sum(k == "sixth" for k in want.values()) == 18 and sum(k == "part" for k in want.values()) == 9
    assert not [x for x, kind in want.items() if kind != "random" and x not in found]
    hard = [x for x, kind in want.items() if kind == "random"]
    assert len(hard) > 200 and len(found & set(hard)) >= 0.93 * len(hard)


def test_weaker_surroundings_do_not_hide_a_segment():
    """A segment that passes counts, whatever stands beside it."""
    worse = np.array([True] * 14 + ([False] * 2 + [True] * 5) * 5)
    rng = np.random.default_rng(5)
    for same in [worse, worse[::-1], np.zeros(9, bool), *(rng.random(30) < p for p in (0.3, 0.5, 0.7, 0.9) * 50)]:
        first, last = spaced_seeds.best_segment(same)
        longest = max([j - i for j in range(len(same) + 1) for i in range(j) if 100 * same[i:j].sum() >= 80 * (j - i)] or [0])
        assert last - first == longest and 100 * same[first:last].sum() >= 80 * longest
    assert spaced_seeds.best_segment(worse)[1] - spaced_seeds.best_segment(worse)[0] >= 14


def test_short_items_with_every_allowed_substitution(spark):
    """Items of 5 to 11 tokens: each set of replaced tokens that leaves 80 % is found, none
    with one more is; three tokens are searched for only if asked to."""
    from itertools import combinations
    items, docs, want = [], [], set()
    for n in range(5, 12):
        passage = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(passage)))
        most = n // 5
        for size in range(most + 2):
            for gone in combinations(range(n), size):
                if size <= most:
                    want.add((len(docs), n))
                docs.append((len(docs), " ".join(["before"] + ["other" if k in gone else w for k, w in enumerate(passage)] + ["after"])))
    got = spaced_seeds.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                    spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 150
    three = spark.createDataFrame([(1, "three short words")], "item_id long, text string")
    held = spark.createDataFrame([(7, "here three short words stand"), (8, "three words short")], "doc_id long, text string")
    assert spaced_seeds.contaminated(held, three).count() == 0
    assert [r.doc_id for r in spaced_seeds.contaminated(held, three, least=1).collect()] == [7]


def test_scripts_without_blanks_and_their_punctuation(spark):
    """Characters are tokens there, so a passage is found inside a longer run, with
    substitutions; other scripts' punctuation separates words."""
    chinese = "春天的花园里有许多红色和白色的花朵正在开放"
    thai = "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่าง"
    french = "« Les enfants jouent » — dans “le jardin” de la vieille maison près du grand moulin"
    items = spark.createDataFrame([(1, chinese), (2, thai), (3, french)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "他说" + chinese + "，然后走了"), (2, "他说" + chinese.replace("红", "蓝").replace("朵", "儿") + "吗"),
        (3, "คือ" + thai + "ครับ"), (4, "les enfants jouent dans le jardin de la vieille maison près du grand moulin"),
        (5, "完全不同的一句话，没有任何重复的内容在这里出现过"), (6, chinese[:9])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_the_filter_grows_with_the_seeds_and_equal_items_are_all_reported(spark):
    assert spaced_seeds.filter_bits(0) == 24 and spaced_seeds.filter_bits(10 ** 7) == 28
    assert spaced_seeds.filter_bits(10 ** 12) == 30
    text = "one passage of enough tokens that stands in two items of the benchmark at once"
    items = spark.createDataFrame([(1, text), (2, text.upper()), (None, text), (2, text)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x " + text)], "doc_id long, text string")
    got = spaced_seeds.contaminated(docs, items).collect()
    assert sorted(str(r.item_id) for r in got) == ["1", "2", "None"]


def test_contamination_of_empty_tables(spark, corpus, empty):
    items = spark.createDataFrame([(1, "some words that make up a benchmark passage here")], "item_id long, text string")
    assert spaced_seeds.contaminated(empty, items).count() == 0
    assert spaced_seeds.contaminated(corpus, items.limit(0)).count() == 0


def pages_of(spark):
    big, other = "<p>" + "x" * 200 + "</p>", "<p>" + "é" * 150 + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (0, None, other), (3, "u r\nl", other), (4, "x", "short"),
            (5, "x", "short"), (6, "x", None), (7, "x", ""), (None, "n", big), (None, None, None), (2, "http://a/2", big),
            (8, "y", "y" * 100_000), (9, "z", "WARC/1.1\r\n\r\n\r\n\r\n" * 20), (10, "e", "a" * 99), (11, "e", "a" * 99)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("ord", F.lit("x"))


def test_archives_round_trip(spark):
    rows, df = pages_of(spark)
    got = warc.archive(df.repartition(4)).collect()
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (p, len(b), hashlib.sha256(b).hexdigest()) for p, b in payload)
    first = {}
    for p, b in payload:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    for digest in {r.payload_digest for r in got}:
        own = [r for r in got if r.payload_digest == digest]
        if own[0].payload_bytes < 100:
            assert all(r.record_type == "response" and r.refers_to is None for r in own)
            continue
        response = [r for r in own if r.record_type == "response"]
        want = next(v for b, v in first.items() if hashlib.sha256(b).hexdigest() == digest)
        assert [r.page_id for r in response] == [want]
        assert all(r.refers_to == want for r in own if r.record_type == "revisit")


def test_each_member_opens_alone(spark, tmp_path):
    rows, df = pages_of(spark)
    got = warc.archive(df.coalesce(1), folder=str(tmp_path)).collect()
    data = open(got[0].file, "rb").read()
    for r in got:
        record = gzip.decompress(data[r.member_offset:r.member_offset + r.member_bytes])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    at = sorted((r.member_offset, r.member_bytes) for r in got)
    assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]] and sum(n for _, n in at) == len(data)


def test_whole_file_streams_of_any_shape(tmp_path):
    """Several members, tiny input chunks: the records come out the same."""
    head = warc.header({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "Content-Length": 5})
    raw = (head + b"hello\r\n\r\n") * 3
    data = gzip.compress(raw[:40]) + gzip.compress(raw[40:])

    class Slow:
        def __init__(self):
            self.at = 0

        def read(self, _):
            self.at += 7
            return data[self.at - 7:self.at]

    stream, found = warc.RecordStream(Slow()), []
    while (fields := stream.head()) is not None:
        found.append(b"".join(stream.block(int(fields["Content-Length"]))))
    assert found == [b"hello"] * 3


def test_archives_of_an_empty_table(spark):
    assert warc.archive(pages_of(spark)[1].limit(0)).count() == 0


def fold(i):
    return (0 if i is None else zlib.crc32(str(i).encode())) % interpolation.FOLDS


def brute_model(rows, weights):
    """Scores of every row from plain counts and the given weights."""
    word, pair = Counter(), Counter()
    texts = [["\0begin", *words_of(lowered(r[1])), "\0end"] for r in rows]
    for r, t in zip(rows, texts):
        if fold(r[0]) != interpolation.HELD_OUT:
            word.update(t)
            pair.update(zip(t, t[1:]))
    n = sum(c for w, c in word.items() if w != "\0begin")
    v = len(word) - ("\0begin" in word)
    out = []
    for r, t in zip(rows, texts):
        base = sum(np.log10((word[w] + 1) / (n + v + 1)) for w in t[1:])
        score = 0.0
        for a, b in zip(t, t[1:]):
            c = word[a]
            k = 1 + int(np.floor(np.log2(c))) if c else 0
            p = [pair[a, b] / c if c else 0, word[b] / n, 1 / (v + 1)]
            score += np.log10(float(np.dot(weights[k], p)))
        out.append((r[0], fold(r[0]) == interpolation.HELD_OUT, len(t) - 1, sum(word[w] > 0 for w in t[1:]), n,
                    round(base, 6), round(score, 6)))
    return out


def test_model_by_brute_force(spark, corpus, rows, monkeypatch):
    used = {}
    learn = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: used.setdefault("w", learn(*a)))
    got = interpolation.interpolated_scores(corpus).collect()
    want = brute_model(rows, used["w"])
    key = lambda x: (x[0] is not None, x[0] or 0, x[2], x[5])
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
            for r in got]
    for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def test_weights_are_those_of_em_on_single_tokens():
    rng = np.random.default_rng(0)
    p0 = 1 / 1001
    p = np.stack([rng.choice([0, 0.5, 0.02], 4000, p=[0.5, 0.2, 0.3]), rng.choice([1e-4, 1e-2], 4000)], 1)
    steps = np.where(p > 0, np.clip(np.round(interpolation.STEPS * np.log2(np.where(p > 0, p, 1) / p0)
                                             - interpolation.LOW), 1, interpolation.SPAN - 1), 0).astype(np.int64)
    cells = (5 * interpolation.SPAN + steps[:, 0]) * interpolation.SPAN + steps[:, 1]
    cell, n = np.unique(cells, return_counts=True)
    got = interpolation.learn_weights(cell, n.astype(float))[5]
    full, a = np.column_stack([p, np.full(4000, p0)]), np.array([0.4, 0.4, 0.2])
    for _ in range(200):
        share = full * a
        a = (share / share.sum(1, keepdims=True)).mean(0)
    assert np.abs(got - a).max() < 0.02


def test_weights_of_words_far_rarer_than_uniform():
    """60 of 4000 tokens at 2 ** -9 of the uniform part: their ratio is not clipped."""
    ratio = np.repeat([2.0 ** -9, 8.0], [60, 3940])
    step = np.clip(np.round(interpolation.STEPS * np.log2(ratio) - interpolation.LOW), 1, interpolation.SPAN - 1)
    cell, n = np.unique(5 * interpolation.SPAN ** 2 + step.astype(np.int64), return_counts=True)
    got = interpolation.learn_weights(cell, n.astype(float))[5]
    full, a = np.column_stack([np.zeros(4000), ratio, np.ones(4000)]), np.array([0.4, 0.4, 0.2])
    for _ in range(200):
        share = full * a
        a = (share / share.sum(1, keepdims=True)).mean(0)
    assert abs(got[2] / a[2] - 1) < 0.02


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = interpolation.interpolated_scores(docs).filter("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.3


def test_model_without_training_or_rows(spark, empty):
    assert interpolation.interpolated_scores(empty).count() == 0
    held = next(i for i in range(100) if fold(i) == interpolation.HELD_OUT)
    r = interpolation.interpolated_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_stored_tables_cut_the_plan(spark, corpus):
    df = stored(corpus.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "probe")
    assert "Aggregate" not in df._jdf.queryExecution().toString()


def test_tables_of_a_step_are_gone_after_it(spark, corpus):
    from quayside.llm.common import open_fs, temporary
    with temporary(spark, "probe") as folder:
        assert stored(corpus.select("doc_id"), "ids", folder).count() == corpus.count()
        fs, path = open_fs(folder)
        assert fs.get_file_info(f"{path}/ids").is_file is False
    from pyarrow import fs as pafs
    assert fs.get_file_info(f"{path}/ids").type == pafs.FileType.NotFound


def test_bucketed_tables_join_without_a_shuffle(spark, corpus):
    from quayside.llm.common import stored_by
    a = stored_by(corpus.select("doc_id", "text"), "probe-buckets", "doc_id")
    b = stored_by(corpus.select("doc_id", "lang"), "probe-buckets", "doc_id")
    joined = a.join(b, "doc_id")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() >= corpus.filter("doc_id IS NOT NULL").count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("probe_buckets")]
