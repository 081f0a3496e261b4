"""Prefix trie and collocations against plain Python and SQL, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quayside.llm import collocations, prefix_trie

from .conftest import lowered

CONVERSATION = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """Nodes by all prefixes of all rebuilt conversations; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, code, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        own_saved = (len(who) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += own_saved
    return sorted((
        min(who), len(path), min(members[path[:-1]]) if path else -10**9, len(who), children[path], leaves[path],
        saved[path], hashlib.sha256(",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path)))).encode())
        .hexdigest()) for path, who in members.items())


def trie(spark, rows):
    df = spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "'x' AS name", "'y' AS root", "1 AS depth", "2 AS c")
    got = prefix_trie.prefix_nodes(df.repartition(4))
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
                   r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect())


def odd_conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(-105, -95), *range(0, 12), *range(100, 130), 1_000_000_007]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "日本\U0001F600"])))
    rows += [(5, None, "user", "first of all"), (5, None, None, None), (5, 2, "user", "tie"), (5, 2, "user", "tie"),
             (5, 2, "user", "tie, other"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(c, t, "user", f"hot {t}") for c in range(300, 345) for t in range(3)]  # equal conversations
    rows += [(400, t, "user", "x" * (t % 3)) for t in range(40)]                     # a long one, and its like
    rows += [(401, t, "user", "x" * (t % 3)) for t in range(33)]
    rows += [(500, 0, "user", "line " * 20_000)]
    rng.shuffle(rows)
    return rows


def test_trie_against_all_prefixes(spark):
    rows = odd_conversations()
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_conversations_in_many_rows(spark, monkeypatch):
    """Conversations longer than a chunk: roots by halving over chunks, totals across them."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 8)
    rows = odd_conversations()
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_one_conversation_with_all_rows(spark):
    """One conversation spans every range of the ordering."""
    rows = [(7, t, "user", str(t % 5)) for t in range(700)]
    assert trie(spark, rows) == brute_trie(rows)


def test_empty_trie(spark):
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], CONVERSATION)).collect() == []
    assert prefix_trie.prefix_nodes(spark.createDataFrame([(None, 1, "a", "b")], CONVERSATION)).collect() == []


@pytest.mark.parametrize("name,module,table", [("op11_prefix_trie", prefix_trie, "conversations"),
                                               ("op13_collocations", collocations, "documents")])
def test_against_sql(spark, name, module, table):
    from quayside.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    want = con.execute(module.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, got.select(*names).toLocalIterator()), key=str) == sorted(
        (str(r) for r in spark.createDataFrame(want, got.select(*names).schema).collect()), key=str)


def brute_collocations(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for n in range(1, 6):
                    if i + n <= len(w):
                        counts[lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in cands.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i:i + n]] = max(covered[p[i:i + n]], a)
        rows = []
        for p, a in cands.items():
            if 100 * covered.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrases(spark, rows, least, top):
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr(
        "*", "'x' AS key", "'y' AS block", "1 AS n", "2 AS score", "3 AS t")
    return sorted(map(tuple, collocations.top_collocations(df.repartition(3), least=least, top=top).collect()))


def odd_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本語", "\U0001F600"]
    rows = [(" ".join(rng.choice(words[:rng.choice([5, 20, 44])]) + rng.choice(["", "", "", ",", ".", "\n", "\t", "\x0b"])
                      for _ in range(rng.randint(0, 80))), rng.choice(["en", "fr", None])) for _ in range(300)]
    rows += [("New York City and THE rest of it", "en")] * 40 + [("a a a a a a a a", "de")] * 5
    rows += [(None, "en"), (None, None), ("", "xx"), (" .,\t!\r\n", "xx"), ("long " * 30_000, "en")]
    return rows


@pytest.mark.parametrize("least,top", [(8, 10**6), (3, 7)])
def test_collocations_against_all_phrases(spark, least, top):
    rows = odd_texts()
    assert phrases(spark, rows, least, top) == brute_collocations(rows, least, top)


def test_collocations_that_the_sample_misses(spark, monkeypatch):
    """A sample of almost nothing proposes almost nothing: the border finds the rest, size by size."""
    monkeypatch.setattr(collocations, "RATE", 10**6)
    rows = odd_texts()
    assert phrases(spark, rows, 5, 1000) == brute_collocations(rows, 5, 1000)


def test_false_hits_of_the_filter_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MIN_BITS", 7)
    monkeypatch.setattr(collocations, "MAX_BITS", 7)
    rows = odd_texts()
    assert phrases(spark, rows, 5, 1000) == brute_collocations(rows, 5, 1000)


def test_exact_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, n, left, right = 9 * 10**11, 7 * 10**13, 10**12 + 39, 10**12 + 61
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(left).alias("l"), F.lit(right).alias("r")) \
        .select(collocations.score()).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_no_collocations(spark):
    assert phrases(spark, [("one two three", "en")], 100, 10) == []
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.top_collocations(empty).collect() == []
