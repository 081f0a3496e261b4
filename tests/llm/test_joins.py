"""op3 and op8: exact similarity joins against brute force; components; trees."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import graph, line_join, signature_trees

from .conftest import lowered, words_of


def brute_components(docs, size, num, den):
    """{row: (set size, component as a set of rows)} by comparing all pairs."""
    sets = {}
    for k, (_, text) in enumerate(docs):
        w = words_of(lowered(text))
        grams = [tuple(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []
        sets[k] = frozenset(grams)
    group = {k: {k} for k in sets}
    shared = Counter()
    where = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            for other in where[g]:
                shared[other, k] += 1
            where[g].append(k)
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n) and group[a] is not group[b]:
            joined = group[a] | group[b]
            for k in joined:
                group[k] = joined
    return {k: (len(s), group[k]) for k, s in sets.items()}


def check_groups(spark, docs, size, num, den, **_):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id)
                  for r in signature_trees.similar_groups(df, size, num, den).collect())
    want = Counter()
    for k, (n, members) in brute_components(docs, size, num, den).items():
        ids = [docs[m][0] for m in members if docs[m][0] is not None]
        want[docs[k][0], n, docs[k][0] if not n else min(ids, default=None)] += 1
    assert got == want


def near_copies(rng, words, count, edits):
    out = []
    for _ in range(count):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 8, 10)])
def test_groups_by_brute_force(spark, size, num, den):
    rng = random.Random(size)
    vocabulary = [f"v{i}" for i in range(300)]
    docs, at = [], 0
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(2, 120))
        for text in near_copies(rng, base, rng.choice([1, 2, 40]), 3):
            docs.append((at * 7 % 1009, text))
            at += 1
    common = " ".join(vocabulary[:40])
    docs += [(2000 + i, common + " " + " ".join(rng.choices(vocabulary, k=30))) for i in range(30)]
    docs += [(3000, None), (3001, ""), (3002, "A b"), (3003, "a B"), (None, "a b"), (3004, "a"), (None, None)]
    docs += docs[:3]
    check_groups(spark, docs, size, num, den)


def test_groups_on_the_odd_corpus(corpus, rows, empty):
    got = {(r.doc_id, r.component_id) for r in signature_trees.similar_groups(corpus, 3, 90, 100).collect()}
    assert (906, 5) in got and (900, 900) in got and len(got) >= len({r[0] for r in rows})
    assert signature_trees.similar_groups(empty).count() == 0


def test_trees_find_what_all_pairs_find():
    """Dual traversal against the same bound on all pairs, over cells with one and two
    sides, and with members that already lie in one component."""
    rng = np.random.default_rng(4)
    n = 160
    base = rng.integers(0, 10_000, (6, 60))
    sets = []
    for i in range(n):
        s = base[i % 6].copy()
        s[rng.integers(0, 60)] = rng.integers(10_000, 99_999)
        sets.append(np.unique(s).astype(np.uint64))
    from quayside.llm.text_arrays import mix
    hashed = [np.sort(mix(s)) for s in sets]
    bits = signature_trees.bitmap_of(np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(hashed), n)
    size = np.array([len(s) for s in sets])
    cell = rng.integers(0, 3, n)
    side = np.where(cell == 1, rng.integers(0, 2, n), 0)
    label = np.where(rng.random(n) < 0.3, 0, np.arange(n) + 1)
    forest = signature_trees.Forest(cell, side, size, label, bits)
    got = {(min(a, b), max(a, b)) for x, y in forest.pairs(9, 10) for a, b in zip(x.tolist(), y.tolist())}
    links = {(a, b) for a in range(n) for b in range(a + 1, n)
             if cell[a] == cell[b] and (cell[a] != 1 or side[a] != side[b]) and label[a] != label[b]
             and 10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b]))}
    assert links and links <= got
    assert all(cell[a] == cell[b] and label[a] != label[b] for a, b in got)


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160))
    assert got[300] == got[299] == 299 and len(got) == 41 + 60 + 2
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(docs):
    """{(doc, line_no): the earlier lines with a similar set of words}, by comparing all lines."""
    lines = []
    for doc, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if words_of(line):
                lines.append(((doc is not None, doc or 0, k), doc, frozenset(words_of(line.lower()))))
    lines.sort(key=lambda x: x[0])
    return {(doc, place[2]): {(q, p[2]) for p, q, o in lines[:i] if p < place and 10 * len(s & o) >= 8 * len(s | o)}
            for i, (place, doc, s) in enumerate(lines)}


def check_lines(spark, docs):
    """Lines are removed as by brute force, and each for a line that is similar and earlier."""
    want = brute_lines(docs)
    got = {(r.doc_id, r.line_no): r
           for r in line_join.line_verdicts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: r.removed for k, r in got.items()} == {k: bool(v) for k, v in want.items()}
    for k, r in got.items():
        if r.removed:
            assert (r.like_doc_id, r.like_line_no) in want[k]
        else:
            assert r.like_doc_id is None and r.like_line_no is None


def test_lines_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(120)] + ["The", "the", "é"]
    base = [rng.choices(vocabulary, k=rng.choice([1, 4, 5, 9, 60, 140, 200])) for _ in range(25)]
    docs = []
    for d in range(60):
        text = "\n".join(near_copies(rng, rng.choice(base), 1, 3)[0] for _ in range(rng.randint(0, 8)))
        docs.append((d * 13 % 67, text))
    docs += [(200, None), (201, ""), (202, "\n \n\t"), (203, "one\none\nOne one"), (None, docs[3][1])]
    check_lines(spark, docs)


def test_a_dense_group_of_lines(spark):
    """Hundreds of variants of one line, with and without the original among them."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = near_copies(rng, base, 250, 4) + [" ".join(base)] * 20
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    check_lines(spark, docs)


def test_lines_on_the_odd_corpus(corpus, empty):
    got = line_join.line_verdicts(corpus).collect()
    assert sum(not r.removed for r in got if r.doc_id == 909) == 1       # one of eighty equal lines
    assert all(r.removed for r in got if r.doc_id == 906)                # an exact copy
    assert all(r.like_doc_id is not None or r.like_line_no is not None for r in got if r.removed)
    assert line_join.line_verdicts(empty).count() == 0


def test_repeated_rows_do_not_remove_each_other(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma")] * 2, "doc_id long, text string")
    assert [r.removed for r in line_join.line_verdicts(df).collect()] == [False, False]


def test_plan_of_the_native_operator_has_no_python(corpus):
    plan = line_join.line_verdicts(corpus.select(F.col("doc_id"), "text"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_short_lines_as_sets_of_words(spark):
    """Lines of 1 to 25 words: a changed word, another order and repeated words."""
    rng = random.Random(19)
    vocabulary = [f"v{i}" for i in range(120)] + ["The", "the", "é"]
    base = [rng.choices(vocabulary, k=rng.randint(1, 25)) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = [near_copies(rng, rng.choice(base), 1, 3)[0].split(" ") for _ in range(rng.randint(0, 8))]
        for w in lines[::3]:
            rng.shuffle(w)
        docs.append((d * 13 % 67, "\n".join(" ".join(w) for w in lines)))
    docs += [(203, "one\none\nOne one"), (None, docs[3][1])]
    check_lines(spark, docs)


def test_a_dense_group_of_short_lines(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(30)]
    texts = near_copies(rng, base, 250, 4) + [" ".join(base)] * 20
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    check_lines(spark, docs)


def test_unlike_lines_are_seldom_candidates(spark):
    """Lines of a hundred words with nothing but some of them in common."""
    from quayside.llm.common import prepare
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(600)]
    docs = [(d, " ".join(rng.sample(vocabulary, rng.randint(105, 115)))) for d in range(80)]
    assert not any(brute_lines(docs).values())
    prepare(spark)
    lines = line_join.lines_of(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    tokens = line_join.signed(line_join.with_tokens(line_join.first_lines(lines)))
    rare = line_join.rarest(tokens, line_join.rarity_table(tokens))
    assert line_join.prefix_pairs(rare, rare.filter("id IS NULL")).count() < 10


def test_lines_whose_sizes_just_suffice(spark):
    """Four of five words, eight of ten, and so on to 256 of 320: found; one word less: not."""
    docs = []
    for k in range(1, 65):
        words = [f"k{k}x{i}" for i in range(5 * k)]
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:4 * k]))]
        docs += [(10 * k + 2, " ".join(f"y{w}" for w in words)), (10 * k + 3, " ".join(f"y{w}" for w in words[:4 * k - 1]))]
    check_lines(spark, docs)
