"""Benchmark decontamination with spaced seeds (op1).

A mask covers ``SPAN`` token positions and looks at some of them only; two passages
that differ in ignored positions have the same seed under it.  Benchmark items give
the seeds of their windows, training documents those of all theirs, and the two are
joined on the seed.  Around each hit the item and the document are compared token by
token along the same alignment, and the longest segment with at least ``EQUAL_SHARE``
per cent equal tokens counts as contamination if it is long enough.  Items shorter than a
mask must lie whole in the document; their positions are dealt into ``CLASSES`` classes, and
each mask ignores as many classes as tokens may differ, so that no allowed substitution
escapes all of them.

Tokens are runs of letters and digits; characters of scripts written without blanks are
tokens of their own, and punctuation of any script separates.

Before the join a bitmap, sized by the number of the benchmark's seeds, drops nearly all
document seeds that occur in no item; it lets through every seed that does, so it
changes the amount of work but no result, however large the benchmark is.

Defined results: NULL and empty texts hold nothing; items of fewer than ``least`` (a
parameter, ``LEAST`` if not given) tokens are too short to be a passage and match nothing; rows that share a doc_id (or
item_id) are taken together, NULL ids included; equal items are all reported; an empty
table on either side gives no row; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .text_arrays import KEEP, PUNCTUATION, mix, rows_of_words

SPAN = 12
#: Positions that each mask looks at; fixed values.
MASKS = (
    (0, 1, 2, 4, 7, 9, 10, 11),
    (0, 1, 3, 4, 5, 8, 10, 11),
    (0, 2, 3, 6, 7, 8, 9, 11),
)
#: Windows of an item are taken at every STRIDE-th position, and the last one; at 1,
#: every overlap with SPAN equal tokens in a row has a seed.
STRIDE = 1
#: Classes of positions for the masks of items shorter than SPAN.
CLASSES = 5
#: Fewest tokens of an item unless the caller says otherwise, and of a segment (or the whole item, if shorter).
LEAST, SEGMENT = 5, 12
#: Least share of equal tokens in a segment, in hundredths.
EQUAL_SHARE = 80
#: Tokens kept on either side of a hit for the comparison.
CONTEXT = 64
#: Least and most bits of the filter, as powers of two, bits per seed, and slots per seed.
FILTER_BITS, FILTER_MOST, BITS_PER_SEED, PROBES = 24, 30, 16, 2
#: Scripts whose words are not set apart by blanks, and what separates words in any script.
NO_BLANKS = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
APART = r"[[^\x00-\x7F]&&[\p{P}\p{S}\p{Z}]]"

REGION = ("region long, doc_id long, first int, tokens array<long>, "
          "seeds array<long>, places array<int>")
MATCH = ("region long, doc_id long, item_row long, doc_start long, item_start long, "
         "n_tokens long, n_equal long, item_tokens long")


def spaced(text: Column) -> Column:
    """Lower-cased text in which blanks or ASCII punctuation separate all tokens."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(
        F.regexp_replace(low, APART, " "), rf"([[\x{{0E00}}-\x{{3FFFF}}]&&[{NO_BLANKS}]])", " $1 ")).otherwise(low)


def masks_of(n: int) -> list[tuple[tuple[int, ...], int]]:
    """(positions looked at, span) of the masks for items of n tokens."""
    if n >= SPAN:
        return [(m, SPAN) for m in MASKS]
    lost = n * (100 - EQUAL_SHARE) // 100
    return [(tuple(p for p in range(n) if p % CLASSES not in gone), n)
            for gone in combinations(range(CLASSES), lost)]


def seeds_of(tokens: np.ndarray, mask: tuple[int, ...], span: int) -> np.ndarray:
    """Seed of the window at every position with ``span`` tokens left."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(span * 1000 + len(mask)))
    for p in mask:
        out = mix(out + tokens[p:p + n], p + 1)
    return out


def slots(seeds: np.ndarray, bits: int):
    """The numbers of each seed's bits in a filter of 2**bits."""
    mixed = mix(seeds, 99)
    for probe in range(PROBES):
        yield (mixed >> np.uint64(probe * bits)) & np.uint64((1 << bits) - 1)


def filter_bits(n_seeds: int) -> int:
    """Size of the filter, as a power of two, for so many seeds."""
    return min(FILTER_MOST, max(FILTER_BITS, (n_seeds * BITS_PER_SEED).bit_length()))


def item_seeds(items: DataFrame, least: int = LEAST) -> DataFrame:
    """Per item of at least ``least`` tokens: its tokens and its (seed, place) pairs."""

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for at, hashes, counts in rows_of_words(batch.column(1), PUNCTUATION, KEEP):
                for k, tokens in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
                    n = len(tokens)
                    if n < least:
                        continue
                    last = max(0, n - SPAN)
                    at_ = np.unique(np.append(np.arange(0, last + 1, STRIDE), last))
                    pairs = [(seeds_of(tokens, m, span)[at_], at_) for m, span in masks_of(n)]
                    out.append((ids[at + k], n, tokens.view(np.int64),
                                np.concatenate([p[0] for p in pairs]).view(np.int64),
                                np.concatenate([p[1] for p in pairs])))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                        pa.list_(pa.int32())))],
                    names=["item_id", "item_tokens", "tokens", "seeds", "places"])

    return items.mapInArrow(cut, "item_id long, item_tokens long, tokens array<long>, "
                                 "seeds array<long>, places array<int>")


def seed_filter(items: DataFrame) -> np.ndarray:
    """Bitmap of the items' seeds: bits are OR-ed per 64-bit word on the executors, and at
    most 2**FILTER_MOST bits reach the driver."""
    bits = filter_bits(items.agg(F.sum(F.size("seeds"))).first()[0] or 0)

    def mark(batches):
        import pyarrow as pa
        for batch in batches:
            seeds = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if len(seeds):
                bit = np.concatenate(list(slots(seeds, bits)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((bit >> np.uint64(6)).astype(np.int32)),
                     pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))],
                    names=["word", "bits"])

    words = np.zeros(1 << (bits - 6), np.uint64)
    marked = items.select("seeds").mapInArrow(mark, "word int, bits long").groupBy("word") \
        .agg(F.bit_or("bits").alias("bits")).toPandas()
    words[marked["word"].to_numpy()] = marked["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def regions(docs: DataFrame, words: np.ndarray, short: list[int]) -> DataFrame:
    """Stretches of documents around seeds that pass the filter.  ``short``: numbers of
    tokens of the items that are shorter than a mask."""
    masks = [m for n in (SPAN, *short) for m in masks_of(n)]
    bits = len(words).bit_length() + 5

    def passing(seeds):
        keep = np.ones(len(seeds), bool)
        for bit in slots(seeds, bits):
            keep &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return np.flatnonzero(keep)

    def find(batches):
        import pyarrow as pa
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for at, hashes, counts in rows_of_words(batch.column(1), PUNCTUATION, KEEP):
                ends = np.cumsum(counts)
                found = []
                for mask, span in masks:
                    seeds = seeds_of(hashes, mask, span)
                    place = passing(seeds)
                    row = np.searchsorted(ends, place, "right")
                    inside = place + span <= ends[row] if len(place) else np.zeros(0, bool)
                    found.append((row[inside], place[inside], place[inside] + span, seeds[place[inside]]))
                row, place, stop, seeds = (np.concatenate(x) for x in zip(*found))
                if not len(row):
                    continue
                order = np.lexsort((place, row))
                row, place, stop, seeds = row[order], place[order], stop[order], seeds[order]
                new = np.append(True, (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 2 * CONTEXT))
                cut = np.append(np.flatnonzero(new), len(row))
                for a, b in zip(cut[:-1], cut[1:]):
                    begin = ends[row[a]] - counts[row[a]]
                    first = max(begin, place[a] - CONTEXT)
                    last = min(ends[row[a]], stop[a:b].max() + CONTEXT)
                    out.append((number, ids[at + row[a]], first - begin,
                                hashes[first:last].view(np.int64), seeds[a:b].view(np.int64),
                                place[a:b] - begin))
                    number += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                        pa.list_(pa.int64()), pa.list_(pa.int32())))],
                    names=["region", "doc_id", "first", "tokens", "seeds", "places"])

    return docs.mapInArrow(find, REGION)


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """(first, last + 1) of the longest segment with a large enough share of equal tokens."""
    sums = np.concatenate([[0], np.cumsum(100 * equal.astype(np.int64) - EQUAL_SHARE)])
    # for each end, the first place whose sum is not above that of the end
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    last = int(np.argmax(np.arange(len(sums)) - first))
    return int(first[last]), last


def compare(batches):
    """Longest segment of each aligned (region, item) pair; rows that fall short go."""
    import pyarrow as pa
    names = [x.split()[0] for x in MATCH.split(", ")]
    for batch in batches:
        out = []
        cols = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            doc = cols["tokens"][k].values.to_numpy()
            item = cols["item"][k].values.to_numpy()
            shift = cols["shift"][k].as_py() - cols["first"][k].as_py()
            a, b = max(0, -shift), min(len(item), len(doc) - shift)
            if a >= b:
                continue
            equal = item[a:b] == doc[a + shift:b + shift]
            first, last = best_segment(equal)
            n, same = last - first, int(equal[first:last].sum())
            if n >= min(SEGMENT, len(item)) and 100 * same >= EQUAL_SHARE * n:
                out.append((cols["region"][k].as_py(), cols["doc_id"][k].as_py(),
                            cols["item_row"][k].as_py(), a + first + cols["shift"][k].as_py(),
                            a + first, n, same, len(item)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=names)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document and item that it holds, with the best aligned segment:
    doc_id, item_id, doc_start and item_start (token numbers), n_tokens, n_equal,
    item_tokens, contaminated (always true).  Items of equal tokens are searched for once."""
    prepare(docs.sparkSession)
    items = stored(item_seeds(benchmark.select(
        F.col(item_id).cast("long").alias("item_id"),
        spaced(F.col(item_text)).alias("t")), least), "item-seeds")
    words = seed_filter(items)
    # fewer than SPAN different lengths
    short = [r[0] for r in items.filter(F.col("item_tokens") < SPAN).select("item_tokens").distinct().collect()]
    found = stored(regions(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        spaced(F.col(text)).alias("t")), words, short), "regions")

    named = items.withColumn("item_row", F.xxhash64("tokens"))
    item_rows = named.dropDuplicates(["item_row"])
    item_places = item_rows.select("item_row", F.explode(F.arrays_zip("seeds", "places")).alias("s")) \
        .select("item_row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_place"))
    hits = found.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("s")) \
        .select("region", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    aligned = hits.join(item_places, "seed").select(
        "region", "item_row", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    pairs = aligned.join(found.select("region", "doc_id", "first", "tokens"), "region").join(
        item_rows.select("item_row", F.col("tokens").alias("item")), "item_row")
    best = F.max(F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("d"),
                          (-F.col("item_start")).alias("i"), "item_tokens")).alias("best")
    return (pairs.mapInArrow(compare, MATCH).groupBy("doc_id", "item_row").agg(best)
            .join(named.select("item_row", "item_id").distinct(), "item_row")
            .select("doc_id", "item_id", (-F.col("best.d")).alias("doc_start"),
                    (-F.col("best.i")).alias("item_start"), "best.n_tokens", "best.n_equal",
                    "best.item_tokens", F.lit(True).alias("contaminated")))
