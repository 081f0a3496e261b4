"""Collocations of two to five words by Toivonen's sampling (op13).

A phrase can only be frequent if its words without the first, and without the last, are.
A sample of the documents proposes frequent phrases, at a lowered threshold.  One pass
over all documents counts the proposals and their negative border exactly: every phrase
that was not proposed but whose two parts of one word less were, and every single word.
If a phrase of the border turns out to be frequent, longer phrases may have been missed:
it joins the proposals, and a further pass counts what this adds to the border, until
no uncounted phrase is left whose two parts are frequent.  Such a pass goes on from an
uncounted phrase to longer ones at once, as if it were frequent, so that it closes the
border by itself.  The counts of all frequent phrases are exact and complete, whatever
the sample says.

Documents are tokenised once, into blocks in the shared folder.  A pass sends the counts
of a block's phrases under 64-bit keys, summed in one shuffle.  Tasks look proposals up
in a bitmap of bounded size (``MAX_BITS``): a false hit adds a phrase to those counted,
which costs time and changes no result.  The words of a frequent phrase are read again
from one of the blocks that hold it.

Defined results: NULL text is empty, NULL lang ``und``; doc_id is not needed, so rows
count one by one, repeated ones too; phrases of a language with equal scores and counts
are in byte order; an empty table, or one without a frequent phrase, gives no row;
further columns are ignored.  A document of any length is one run of pieces, never cut.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, prepare, shared_folder, stored
from .graph import join_stored
from .text_arrays import FOLD, chunks, hashed_spans, mix, pack, raw_rows, word_bounds
from .word_blocks import read_block, write_file

LONGEST = 5
#: Documents in the sample, one of RATE; the sample's threshold is lowered by SLACK.
RATE, SLACK = 16, 2
BLOCK_WORDS = 1 << 20
#: Bits of the bitmap of proposals, as a power of two: 16 a proposal, within bounds.
MIN_BITS, MAX_BITS, PROBES = 16, 27, 2
#: First ranking of each language's phrases is in so many parts.
PARTS = 64

#: Marks that end a piece: . , ; : ! ? line feed, vertical tab, form feed, carriage return.
MARKS = np.zeros(256, bool)
MARKS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
APART = MARKS.copy()
APART[[0x20, 0x09]] = True

#: Rows of a batch of counts; bits of a block's number.
ROWS, BLOCK_MASK = 1 << 16, (1 << 56) - 1

BLOCK = "block long, path string"
COUNT = "key long, block long, n long"
#: The low bits of a key hold the number of words.
SIZE_BITS = 3
PHRASE = "key long, block long, lang string, size int, phrase string, firsts array<long>, rests array<long>"


def sized(hashes: np.ndarray, size: int) -> np.ndarray:
    """Keys: hashes with the number of words in the low bits."""
    return hashes >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS) | np.uint64(size)


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def write_pieces(docs: DataFrame, folder: str) -> DataFrame:
    """Blocks of documents (t, lang): words as indices into the block's dictionary, the
    words that begin a piece, and each document's language."""

    def write(batches):
        import pyarrow as pa
        part, done, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal held, count, done
            hashes, fresh, sizes, langs, letters, lengths = (
                np.concatenate([h[k] for h in held]) for k in range(6))
            dictionary, first, word = np.unique(hashes, return_index=True, return_inverse=True)
            names, lang = np.unique(langs, return_inverse=True)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            text = b"".join(letters[starts[i]:ends[i]].tobytes() for i in first)
            uri = f"{folder}/pieces-{part:06d}-{done:05d}-{uuid.uuid4().hex}"
            write_file(uri, pack({
                "dictionary": dictionary, "word": word.astype(np.uint32), "fresh": fresh,
                "docs": sizes, "lang": lang.astype(np.uint32), "letters": np.frombuffer(text, np.uint8),
                "lengths": lengths[first],
                "names": np.frombuffer(json.dumps(names.tolist()).encode(), np.uint8)}))
            row = {"block": [(part << 24) + done], "path": [uri]}
            held, count, done = [], 0, done + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            data, bounds = raw_rows(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for at, to in chunks(bounds):
                text, own = FOLD[data[bounds[at]:bounds[to]]], bounds[at:to + 1] - bounds[at]
                starts, ends = word_bounds(text, own, APART)
                sizes = np.diff(np.searchsorted(starts, own))
                marks = np.concatenate([[0], np.cumsum(MARKS[text])])[starts]
                fresh = np.append(True, marks[1:] != marks[:-1])[:len(starts)]
                firsts = np.cumsum(sizes) - sizes
                fresh[firsts[sizes > 0]] = True
                inside = np.repeat(np.arange(len(starts)), ends - starts)
                lengths = ends - starts
                place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[inside]
                hashes = hashed_spans(text, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                held.append((hashes, fresh, sizes, langs[at:to].astype(str), text[place], lengths))
                count += len(starts) + to - at
                if count >= BLOCK_WORDS:
                    yield flush()
        if held:
            yield flush()

    return stored(docs.select("t", "lang").mapInArrow(write, BLOCK), "pieces", folder)


class Filter:
    """Bitmap of phrase keys; says yes to each that was added, and to few others."""

    def __init__(self, bits: int, words=None):
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def slots(self, keys: np.ndarray):
        mixed = mix(keys, 99)
        for probe in range(PROBES):
            yield (mixed >> np.uint64(probe * self.bits)) & np.uint64((1 << self.bits) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for bit in self.slots(keys):
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def with_keys(self, keys: DataFrame) -> "Filter":
        """This filter and the column ``key``; bits are OR-ed on the executors, and the
        bitmap's size bounds what reaches the driver."""
        def mark(batches):
            import pyarrow as pa
            for batch in batches:
                bit = np.concatenate(list(self.slots(batch.column(0).to_numpy().view(np.uint64))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((bit >> np.uint64(6)).astype(np.int32)),
                     pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["word", "bits"])

        found = keys.select("key").mapInArrow(mark, "word int, bits long").groupBy("word") \
            .agg(F.bit_or("bits").alias("bits")).toPandas()
        words = self.words.copy()
        words[found["word"].to_numpy()] |= found["bits"].to_numpy(np.int64).view(np.uint64)
        return Filter(self.bits, words)


class Phrases:
    """A block's phrases by size.  Of size s: ``ids`` (phrase at each word, or -1), and per
    phrase ``keys``, ``counts``, ``first`` (a place) and ``old``, whether an earlier pass with
    the filter ``before`` has counted it.  Phrases are left out unless each of their two
    parts is in ``proposed`` or has not been counted by an earlier pass."""

    def __init__(self, block, proposed: Filter | None, before: Filter | None, keep=None):
        langs = json.loads(block["names"].tobytes())
        of = np.repeat(block["lang"], block["docs"]).astype(np.int64)
        keep = np.ones(len(of), bool) if keep is None else np.repeat(keep, block["docs"])
        word, fresh = block["word"].astype(np.int64)[keep], block["fresh"][keep].astype(bool)
        of = of[keep]
        n, width = len(word), len(block["dictionary"])
        self.langs, self.place = langs, np.flatnonzero(keep)
        self.lang_keys = sized(np.array([lang_key(x) for x in langs], np.uint64), 0)
        self.lang_counts = np.bincount(of, minlength=len(langs))
        code, first, ids, counts = np.unique(of * max(width, 1) + word, return_index=True,
                                             return_inverse=True, return_counts=True)
        keys = sized(mix(mix(self.lang_keys[code // max(width, 1)], 5) + block["dictionary"][code % max(width, 1)], 1), 1) \
            if len(code) else np.zeros(0, np.uint64)
        self.sizes = {1: (ids, keys, counts, first, np.full(len(keys), before is not None))}
        single, words = ids, keys
        for size in range(2, LONGEST + 1):
            ids, keys, counts, first, old = self.sizes[size - 1]
            good = proposed.has(keys) if proposed else np.ones(len(keys), bool)
            known = np.zeros(len(keys), bool)
            if before:
                known = old & before.has(keys)
                good |= ~old
            a, b = ids[:-1], ids[1:]
            both = (a >= 0) & (b >= 0)
            if size == 2:
                both &= ~fresh[1:]
            at = np.flatnonzero(both)
            at = at[good[a[at]] & good[b[at]]] if len(at) else at
            code, place, inverse, counts = np.unique(a[at] * max(len(keys), 1) + b[at], return_index=True,
                                                     return_inverse=True, return_counts=True)
            here = np.full(n, -1)
            here[at] = inverse
            head, tail = code // max(len(keys), 1), code % max(len(keys), 1)
            place = at[place]
            longer = sized(mix(keys[head] + mix(words[single[place + size - 1]], 7), 3), size)
            self.sizes[size] = (here, longer, counts, place, known[head] & known[tail])


def counts_of(blocks: DataFrame, proposed: Filter | None, before: Filter | None, sample: bool = False) -> DataFrame:
    """Counts (key, n) with a block that has the phrase: of all phrases of the sample; or
    of the proposals and their border, less what was counted with the filter ``before``."""
    share = blocks.sparkSession.sparkContext.broadcast((proposed, before))

    def count(batches):
        import pyarrow as pa
        proposed, before = share.value
        for batch in batches:
            for number, path in zip(*(c.to_pylist() for c in batch.columns)):
                block = read_block(path)
                chosen = None
                if sample:
                    docs = np.arange(len(block["docs"]), dtype=np.uint64) + (np.uint64(number) << np.uint64(24))
                    chosen = mix(docs, 41) % np.uint64(RATE) == 0
                found = Phrases(block, proposed, before, chosen)
                rows = [(keys, counts, ~old) for _, keys, counts, _, old in found.sizes.values()]
                if before is None and not sample:
                    rows.append((found.lang_keys, found.lang_counts, np.ones(len(found.langs), bool)))
                for keys, counts, new in rows:
                    keys, counts = keys[new].view(np.int64), counts[new]
                    for at in range(0, len(keys), ROWS):
                        some = keys[at:at + ROWS]
                        # the largest of these sums shows one of the blocks, any with like chance
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some), pa.array(number ^ (some & BLOCK_MASK)), pa.array(counts[at:at + ROWS])],
                            names=["key", "block", "n"])

    return blocks.repartition(partitions(blocks.sparkSession)).mapInArrow(count, COUNT) \
        .groupBy("key").agg(F.sum("n").alias("n"), F.max("block").alias("block")) \
        .withColumn("block", F.col("block").bitwiseXOR(F.col("key").bitwiseAND(F.lit(BLOCK_MASK))))


def frequent_phrases(blocks: DataFrame, least: int, folder: str) -> tuple[DataFrame, Filter]:
    """Every phrase that occurs ``least`` times, and every language: (key, n, block); and
    the filter that lets all of them through."""
    low = max(2, least // RATE // SLACK)
    proposals = stored(counts_of(blocks, None, None, sample=True).filter(F.col("n") >= low).select("key"),
                       "proposals", folder)
    # room for later finds
    bits = min(MAX_BITS, max(MIN_BITS, int(32 * proposals.count()).bit_length()))
    proposed = Filter(bits).with_keys(proposals)
    found = stored(counts_of(blocks, proposed, None).filter(F.col("n") >= least), "frequent-0", folder)
    # of the border, what is frequent: longer phrases with these have not been counted
    size = F.col("key").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    failed = found.join(proposals, "key", "left_anti").filter(size.between(1, LONGEST - 1))
    larger = proposed.with_keys(failed)
    if (larger.words != proposed.words).any():
        more = counts_of(blocks, larger, proposed).filter(F.col("n") >= least)
        found = found.union(stored(more, "frequent-1", folder))
    return found, Filter(bits).with_keys(found)


def spelled(frequent: DataFrame, blocks: DataFrame, proposed: Filter) -> DataFrame:
    """The words of each frequent phrase, and the keys of the parts of each of its cuts.
    ``proposed`` has all frequent phrases."""
    share = blocks.sparkSession.sparkContext.broadcast(proposed)

    def spell(key, wanted, where):
        import pandas as pd
        out = []
        if len(wanted) and len(where):
            block = read_block(where["path"].iloc[0])
            found = Phrases(block, share.value, None)
            ends = np.cumsum(block["lengths"])
            letters = block["letters"].tobytes()

            def text(i):
                return letters[ends[i] - block["lengths"][i]:ends[i]].decode("utf-8", "replace")

            wish = np.sort(wanted["key"].to_numpy().view(np.uint64))
            for k in np.flatnonzero(np.isin(found.lang_keys, wish)):
                out.append((found.lang_keys[k], found.langs[k], 0, "", [], []))
            lang = np.repeat(block["lang"], block["docs"])
            words = block["word"]
            for size, (_, keys, _, first, _) in found.sizes.items():
                for k in np.flatnonzero(np.isin(keys, wish)):
                    at = first[k]
                    cuts = [[int(found.sizes[n][1][found.sizes[n][0][at + shift]].view(np.int64))
                             for n, shift in ((c, 0), (size - c, c))] for c in range(1, size)]
                    out.append((keys[k], found.langs[lang[at]], size,
                                " ".join(text(words[at + j]) for j in range(size)),
                                [c[0] for c in cuts], [c[1] for c in cuts]))
        frame = pd.DataFrame(out, columns=["key", "lang", "size", "phrase", "firsts", "rests"])
        frame["key"] = frame["key"].to_numpy(np.uint64).view(np.int64)
        frame["block"] = key[0]
        return frame[[c.split()[0] for c in PHRASE.split(", ")]]

    # numbers of partitions of one's own: their rows are few, the work on them is not
    parts = partitions(blocks.sparkSession)
    return frequent.select("key", "block").repartition(parts, "block").groupBy("block").cogroup(
        blocks.repartition(parts, "block").groupBy("block")).applyInPandas(spell, PHRASE)


def score() -> Column:
    """floor(1000 a n / (l r)), exact while the products have up to 38 digits."""
    a, n, l, r = (f"cast({c} as decimal(38,0))" for c in "anlr")
    return F.expr(f"(1000 * {a} * {n}) div ({l} * {r})")


def top_collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100,
                     top: int = 2000) -> DataFrame:
    """Per language the phrases with the highest scores: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "collocations")
    blocks = write_pieces(docs.select(F.col(text).cast("string").alias("t"),
                                      F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")), folder)
    frequent, proposed = frequent_phrases(blocks, least, folder)
    counts = frequent.select("key", F.col("n").alias("a"))
    spelt = stored(spelled(frequent, blocks, proposed).join(counts, "key"), "spelled", folder)
    totals = spelt.filter("size = 0").select("lang", F.col("a").alias("n"))
    phrases = spelt.filter("size > 1")
    # a phrase that never occurs but inside a longer one has that one's count
    inside = phrases.filter("size > 2").select(
        F.explode(F.array(F.element_at("firsts", -1), F.element_at("rests", 1))).alias("key"), "a") \
        .groupBy("key").agg(F.max("a").alias("longer"))
    alone = phrases.join(inside, "key", "left").filter(F.coalesce("longer", F.lit(0)) < F.col("a"))
    cuts = alone.select("key", "lang", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "c")) \
        .select("key", "lang", "a", "k", F.col("c.firsts").alias("first"), F.col("c.rests").alias("rest"))
    cuts = join_stored(cuts, counts.select(F.col("key").alias("first"), F.col("a").alias("l")), "first")
    cuts = join_stored(cuts, counts.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    scored = join_stored(cuts, totals, "lang").withColumn("score", score())
    best = scored.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("b")) \
        .join(alone.select("key", "lang", "phrase", "a"), "key") \
        .select("lang", "phrase", "a", "b.l", "b.r", "b.n", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = best.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase",
                                             "a", "l", "r", "n", "score")


#: The definition in SQL, over all phrases.
ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
grams AS (
  SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM placed, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
cands AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
inner_parts AS (
  SELECT lang, array_to_string(w[s:s + k - 1], ' ') AS phrase, max(a) AS longer
  FROM cands, range(2, 5) AS t(k), range(1, 5) AS u(s) WHERE k < size AND s + k - 1 <= size GROUP BY ALL),
alone AS (
  SELECT c.* FROM cands c LEFT JOIN inner_parts i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
cuts AS (
  SELECT a.lang, a.phrase, a.a, k, x.f AS l, y.f AS r, t.n,
         (1000::HUGEINT * a.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM alone a, range(1, 5) AS q(k), counts x, counts y, totals t
  WHERE k < a.size AND t.lang = a.lang
    AND x.lang = a.lang AND x.phrase = array_to_string(a.w[1:k], ' ')
    AND y.lang = a.lang AND y.phrase = array_to_string(a.w[k + 1:a.size], ' ')),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
