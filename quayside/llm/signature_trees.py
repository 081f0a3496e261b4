"""N-gram Jaccard join with signature trees (op8).

Documents are sets of word n-grams; two documents link when their Jaccard similarity
reaches ``num / den``.  Equal sets form one class.  The classes that have each n-gram are
counted exactly, and of each class the rarest n-grams are published, as many as any
partner must share one of.  Classes that published the
same n-gram form a cell, and the cells are searched by signature trees: leaves hold a
class's bitmap of hashed n-grams, inner nodes the OR of the bitmaps below them, the
range of sizes, and the most n-grams that fell on a taken bit.  A traversal of two
trees at once drops a pair of nodes when even the largest possible overlap,
bits in common plus the smaller number of such n-grams, is too small for the sizes.
Pairs of classes that remain are compared on their whole sets.

A group of thousands of near copies has millions of links but few are needed to join
it.  So two rounds first compare each class with one central class of its cells; the
trees then skip pairs of nodes that already lie in one component.  Every link is
either found or lies inside a component, so the components are exact.  The number of
links is not counted: that takes all pairs within a group.

Defined results: texts that are NULL or have no word have an empty set and link with
nothing; with fewer words than n the whole sequence is one n-gram; rows that share a
doc_id are separate nodes with one name; NULL ids take part, but a component is named
by its smallest non-NULL id; an empty table gives no row; further columns are ignored.
N-grams and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, shared_folder, stored, temporary
from .graph import components, join_stored
from .text_arrays import mix, pack, unpack
from .word_blocks import read_block, write_blocks

#: 64-bit words of a bitmap, and children of a tree node.
BITMAP_WORDS, FANOUT = 32, 8
#: Members of a cell that one task holds; larger cells are dealt out as pairs of pages.
PAGE = 4096
#: Rows that a task of the tree search gets, on average.
TASK_ROWS = 20_000
STAR_ROUNDS = 2
#: Hash ranges of n-grams per shuffle partition; a task holds one range at a time.
HASH_RANGES = 4
#: Words of a stored block: its sets, sorted, are what a task holds at once.
BLOCK_WORDS = 1 << 18

SUMMARY = "block long, row int, doc_id long, n long, c long"
POSTINGS = "part int, data binary"
SHARED = "key long, k long, n long, m long, size long"


def sets_of(block: dict, size: int, only: np.ndarray | None = None):
    """(document, n-gram) of the block's documents (or of the rows ``only``): distinct,
    sorted by document and hash."""
    words = block["words"]
    starts = np.concatenate([[0], np.cumsum(words)])
    token = block["word"]
    if only is not None:
        wanted = np.zeros(len(words), bool)
        wanted[only] = True
        token = token[np.repeat(wanted, words)]
        words = np.where(wanted, words, 0)
        starts = np.concatenate([[0], np.cumsum(words)])
    h = np.cumsum(block["dictionary"], dtype=np.uint64)[token]
    doc = np.repeat(np.arange(len(words)), words)

    def grams(at, n):
        out = np.full(len(at), np.uint64(n * 7919))
        for p in range(n):
            out = mix(out + h[at + p], p + 1)
        return out

    at = np.arange(len(h))
    full = at + size <= starts[doc + 1] if len(h) else np.zeros(0, bool)
    docs, hashes = [doc[full]], [grams(at[full], size)]
    for n in range(1, size):
        short = np.flatnonzero(words == n)
        docs.append(short)
        hashes.append(grams(starts[short], n))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[first], h[first]


def summaries(blocks: DataFrame, size: int) -> DataFrame:
    """Per document its set's size and identity."""

    def work(batches):
        import pyarrow as pa
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = read_block(path)
                doc, h = sets_of(block, size)
                n = len(block["id"])
                sizes = np.bincount(doc, minlength=n)
                identity = np.zeros(n, np.uint64)
                some = np.flatnonzero(sizes)
                if len(some):
                    identity[some] = np.add.reduceat(mix(h, 5), np.cumsum(sizes[some]) - sizes[some])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((
                    np.full(n, number), np.arange(n, dtype=np.int32),
                    pa.array(block["id"], mask=block["null"] == 1), sizes,
                    identity.view(np.int64)), types)], names=names)

    return blocks.select("block", "path").repartition(partitions(blocks.sparkSession)) \
        .mapInArrow(work, SUMMARY)


def at_home(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Classes with the path of the block that holds their first document."""
    return classes.join(blocks.select("block", "path"), "block").select(
        "path", "row", "k", "n", "m")


def home_sets(pdf, size: int):
    """The rows of a block's classes in order, and (position among them, n-gram)."""
    pdf = pdf.sort_values("row")
    rows = pdf["row"].to_numpy()
    doc, h = sets_of(read_block(pdf["path"].iloc[0]), size, rows)
    return pdf, np.searchsorted(rows, doc), h


def hash_ranges(keys: np.ndarray, parts: int):
    """(part, first, last) of the runs of sorted keys that fall into each hash range."""
    cut = [0, *np.searchsorted(keys, np.array([(x << 64) // parts for x in range(1, parts)], np.uint64)), len(keys)]
    return [(part, a, b) for part, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]


def gram_counts(homes: DataFrame, size: int, parts: int) -> DataFrame:
    """Every block's distinct n-grams with the number of its classes that have them, in
    packed runs by hash range."""

    def work(pdf):
        import pandas as pd
        path = pdf["path"].iloc[0]
        grams, n = np.unique(home_sets(pdf, size)[2], return_counts=True)
        return pd.DataFrame([(part, path, pack({"gap": np.diff(grams[a:b], prepend=np.uint64(0)),
                                                "n": n[a:b].astype(np.uint32)}))
                             for part, a, b in hash_ranges(grams, parts)], columns=["part", "path", "data"])

    # few rows, much work: one task per partition, however small
    return homes.repartition(parts, "path").groupBy("path").applyInPandas(work, "part int, path string, data binary")


def gram_totals(counts: DataFrame) -> DataFrame:
    """The number of classes that have each n-gram (at most 65535 is told), for every block
    in the order of its own list."""

    def work(pdf):
        import pandas as pd
        given = [unpack(x) for x in pdf["data"]]
        grams = [np.cumsum(g["gap"], dtype=np.uint64) for g in given]
        _, index = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.minimum(np.bincount(index, np.concatenate([g["n"] for g in given])), 65535).astype(np.uint16)
        ends = np.cumsum([len(g) for g in grams])
        return pd.DataFrame({"part": pdf["part"], "path": pdf["path"],
                             "data": [pack({"n": total[i]}) for i in np.split(index, ends[:-1])]})

    return counts.groupBy("part").applyInPandas(work, "part int, path string, data binary")


def publish(homes: DataFrame, totals: DataFrame, size: int, num: int, den: int, parts: int) -> DataFrame:
    """Each class's rarest n-grams, in packed runs by hash range."""

    def work(pdf, answers):
        import pandas as pd
        if not len(pdf):
            return pd.DataFrame({"part": pd.Series(dtype="int32"), "data": pd.Series(dtype=object)})
        pdf, of, h = home_sets(pdf, size)
        grams, which = np.unique(h, return_inverse=True)
        total = np.concatenate([unpack(x)["n"] for x in answers.sort_values("part")["data"]])
        if len(total) != len(grams):
            raise ValueError("a block's totals do not match its list")
        order = np.lexsort((h, total[which], of))
        of, h = of[order], h[order]
        n = np.bincount(of, minlength=len(pdf))
        place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        # n-grams of one class alone meet nothing
        keep = (place < (n - (num * n + den - 1) // den + 1)[of]) & (total[which][order] > 1)
        of, h = of[keep], h[keep]
        order = np.argsort(h)
        of, h = of[order], h[order]
        k, m = pdf["k"].to_numpy(), pdf["m"].to_numpy()
        return pd.DataFrame([(part, pack({"gap": np.diff(h[a:b], prepend=np.uint64(0)), "k": k[of[a:b]],
                                          "n": n[of[a:b]].astype(np.uint32), "m": m[of[a:b]]}))
                             for part, a, b in hash_ranges(h, parts)], columns=["part", "data"])

    # small rows, much work: dealt by number, not by bytes
    home, answer = (x.repartition(parts, "path").groupBy("path") for x in (homes, totals))
    return home.cogroup(answer).applyInPandas(work, POSTINGS)


def shared_grams(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Cells: classes that published the same n-gram, cut wherever the next larger size is
    too large for a link across the cut.  Only cells of two classes or more are given."""

    def work(pdf):
        import pandas as pd
        given = [unpack(x) for x in pdf["data"]]
        key = np.concatenate([np.cumsum(g["gap"], dtype=np.uint64) for g in given])
        k, n, m = (np.concatenate([g[x] for g in given]).astype(np.int64) for x in ("k", "n", "m"))
        order = np.lexsort((n, key))
        key, k, n, m = key[order], k[order], n[order], m[order]
        cut = (key[1:] != key[:-1]) | (den * n[:-1] < num * n[1:])
        first = np.flatnonzero(np.append(True, cut))[:len(key)]
        size = np.diff(np.append(first, len(key)))
        cell = np.repeat(mix(key[first] + n[first].astype(np.uint64)), size)
        size = np.repeat(size, size)
        keep = size > 1
        return pd.DataFrame({"key": cell[keep].view(np.int64), "k": k[keep], "n": n[keep], "m": m[keep],
                             "size": size[keep]})

    return postings.groupBy("part").applyInPandas(work, SHARED)


def bitmap_of(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Bitmaps (n x BITMAP_WORDS) of the sets."""
    bit = h & np.uint64(64 * BITMAP_WORDS - 1)
    out = np.zeros((n, BITMAP_WORDS), np.uint64)
    np.bitwise_or.at(out, (of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fetch(homes: DataFrame, nodes: DataFrame, size: int, bitmaps: bool) -> DataFrame:
    """Whole sets (or bitmaps) of the classes ``nodes(k)``, read from their blocks."""

    def work(pdf):
        import pandas as pd
        pdf, of, h = home_sets(pdf, size)
        if bitmaps:
            data = [x.tobytes() for x in bitmap_of(of, h, len(pdf))]
        else:
            data = [x.tobytes() for x in np.split(h, np.cumsum(np.bincount(of, minlength=len(pdf)))[:-1])]
        return pd.DataFrame({"k": pdf["k"].to_numpy(), "data": data})

    wanted = homes.join(nodes.distinct(), "k").repartition(partitions(homes.sparkSession), "path")
    return wanted.groupBy("path").applyInPandas(work, "k long, data binary")


def verified(edges: DataFrame, homes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The edges(a, b) whose whole sets are similar enough."""

    def work(batches):
        import pyarrow as pa
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                good.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good, pa.bool_())),
                 batch.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    with temporary(edges.sparkSession, "verification") as folder:
        edges = stored(edges, "candidates", folder)
        nodes = edges.select(F.col("a").alias("k")).union(edges.select(F.col("b").alias("k")))
        sets = stored(fetch(homes, nodes, size, bitmaps=False), "sets", folder)
        return stored(edges.join(sets.select(F.col("k").alias("a"), F.col("data").alias("x")), "a")
                      .join(sets.select(F.col("k").alias("b"), F.col("data").alias("y")), "b")
                      .select("a", "b", "x", "y").mapInArrow(work, "a long, b long"), "links")


def open_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``cells`` that still span several components, with the members' labels."""
    rows = cells.drop("label").join(labels.withColumnRenamed("node", "k"), "k", "left") \
        .withColumn("label", F.coalesce("label", "k"))
    several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return stored(join_stored(rows, several.select("key"), "key"), "cells")


def star_edges(cells: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """For every class one likely partner: among the central classes of its cells that lie
    in another component, the one it meets most often, if that is in a quarter of the
    n-grams it published.  Central is the class with the most copies; equal ones are drawn
    by a hash.  Pairs that are passed over here are left to the trees."""
    centre = cells.groupBy("key").agg(F.max(F.struct(
        "m", F.xxhash64("key", "k", F.lit(turn)).alias("x"), "k", "n", "label")).alias("centre")) \
        .select("key", F.col("centre.k").alias("a"), F.col("centre.n").alias("an"),
                F.col("centre.label").alias("al"))
    met = join_stored(cells, centre, "key").filter(
        (F.col("label") != F.col("al")) & (den * F.col("n") >= num * F.col("an"))
        & (den * F.col("an") >= num * F.col("n")))
    published = F.col("n") - F.ceil(num * F.col("n") / den) + 1
    return met.groupBy("k", "a", "n").agg(F.count(F.lit(1)).alias("times")) \
        .filter(4 * F.col("times") >= published).groupBy("k").agg(F.max(F.struct("times", "a")).alias("best")) \
        .select(F.col("best.a").alias("a"), F.col("k").alias("b"))


class Forest:
    """Signature trees over the members of many cells at once, level by level.

    ``cell`` and ``side`` say which tree a member belongs to; trees of one cell with
    two sides are searched against each other, a single tree against itself."""

    def __init__(self, cell, side, n, label, bits):
        order = np.lexsort((bits[:, 0], n, side, cell))
        self.order, cell, side = order, cell[order], side[order]
        bits, n, label = bits[order], n[order], label[order]
        new = np.append(True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1]))
        tree = np.cumsum(new) - 1
        slack = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [dict(bits=bits, lo=n, hi=n, slack=slack, label=label, tree=tree)]
        while len(self.levels[-1]["tree"]) > tree[-1] + 1:
            below = self.levels[-1]
            t = below["tree"]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            place = np.arange(len(t)) - start[t]
            first = np.flatnonzero(place % FANOUT == 0)
            low, high = (f.reduceat(below["label"], first) for f in (np.minimum, np.maximum))
            self.levels.append(dict(
                bits=np.bitwise_or.reduceat(below["bits"], first, axis=0),
                lo=np.minimum.reduceat(below["lo"], first), hi=np.maximum.reduceat(below["hi"], first),
                slack=np.maximum.reduceat(below["slack"], first),
                label=np.where(low == high, low, -1), tree=t[first],
                first=first, last=np.append(first[1:], len(t))))
        cells = cell[new]
        two = np.append(cells[1:] == cells[:-1], False)
        alone = ~two & ~np.append(False, two[:-1])
        left = np.flatnonzero(two)
        self.roots = (np.concatenate([np.flatnonzero(alone), left]),
                      np.concatenate([np.flatnonzero(alone), left + 1]))

    def possible(self, level, a, b, num, den):
        """Mask of node pairs that may hold a link between different components."""
        x = self.levels[level]
        keep = (den * x["hi"][a] >= num * x["lo"][b]) & (den * x["hi"][b] >= num * x["lo"][a])
        keep &= (x["label"][a] != x["label"][b]) | (x["label"][a] < 0)
        at = np.flatnonzero(keep)
        a, b = a[at], b[at]
        common = np.bitwise_count(x["bits"][a] & x["bits"][b]).sum(1).astype(np.int64)
        most = np.minimum(common + np.minimum(x["slack"][a], x["slack"][b]),
                          np.minimum(x["hi"][a], x["hi"][b]))
        return at[(num + den) * most >= num * (x["lo"][a] + x["lo"][b])]

    def pairs(self, num: int, den: int, step: int = 2048):
        """Yield arrays (member, member) that survive down to the leaves."""
        top = len(self.levels) - 1
        stack = [(top, *self.roots)]
        if top == 0:  # single members only
            a, b = self.roots
            a, b = a[a != b], b[a != b]
            good = self.possible(0, a, b, num, den)
            yield self.order[a[good]], self.order[b[good]]
            return
        while stack:
            level, a, b = stack.pop()
            if len(a) > step:
                stack.append((level, a[step:], b[step:]))
                a, b = a[:step], b[:step]
            x = self.levels[level]
            ca, cb = x["last"][a] - x["first"][a], x["last"][b] - x["first"][b]
            each = ca * cb
            pair = np.repeat(np.arange(len(a)), each)
            local = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i = x["first"][a][pair] + local // cb[pair]
            j = x["first"][b][pair] + local % cb[pair]
            own = (a == b)[pair]
            keep = ~own | (j > i if level == 1 else j >= i)
            i, j = i[keep], j[keep]
            good = self.possible(level - 1, i, j, num, den)
            if not len(good):
                continue
            if level == 1:
                yield self.order[i[good]], self.order[j[good]]
            else:
                stack.append((level - 1, i[good], j[good]))


def tree_edges(cells: DataFrame, homes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Candidate pairs between components, by dual traversal of signature trees."""
    tasks = max(1, cells.count() // TASK_ROWS)
    bitmaps = fetch(homes, cells.select("k"), size, bitmaps=True)
    pages = F.ceil(F.col("size") / PAGE).cast("int")
    page = F.pmod(F.xxhash64("k"), F.col("pages")).cast("int")
    # a cell of p pages becomes p * (p + 1) / 2 cells, one for each pair of pages
    dealt = cells.withColumn("pages", pages).withColumn("page", page) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))) \
        .select("k", "n", "label",
                F.xxhash64("key", F.least("page", "other"), F.greatest("page", "other")).alias("cell"),
                F.when(F.col("page") <= F.col("other"), 0).otherwise(1).alias("side"))
    rows = join_stored(dealt, bitmaps, "k").withColumn("task", F.pmod("cell", F.lit(tasks)))

    def work(pdf):
        import pandas as pd
        bits = np.frombuffer(b"".join(pdf["data"]), np.uint64).reshape(len(pdf), BITMAP_WORDS)
        k = pdf["k"].to_numpy()
        forest = Forest(*(pdf[c].to_numpy() for c in ("cell", "side", "n", "label")), bits)
        found = np.zeros((0, 2), np.int64)
        for i, j in forest.pairs(num, den):
            more = np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])], 1)
            found = np.unique(np.concatenate([found, more]), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy("task").applyInPandas(work, "a long, b long").distinct()


def grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of all classes that have a link so far, after adding ``links(a, b)``."""
    if labels is None:
        return stored(components(links), "labels")
    named = links
    for side in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(side), F.col("label").alias("l")),
                           side, "left") \
            .withColumn(side, F.coalesce("l", side)).drop("l")
    merged = components(named)
    old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")),
                      "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return stored(old.union(new), "labels")


def similar_groups(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, copies (documents with the
    same set), first (whether the row stands for its component)."""
    spark = docs.sparkSession
    prepare(spark)
    parts = HASH_RANGES * partitions(spark)
    blocks = write_blocks(docs, shared_folder(spark, "grams"), F.col(doc_id), F.col(text), F.lit(0),
                          BLOCK_WORDS)
    summary = stored(summaries(blocks, size), "summaries")
    full = summary.filter("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "block", "row")
    classes = stored(full.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"),
                                           F.min(place).alias("rep")), "classes")
    classes = stored(classes.select("c", "m", "n", "rep", "rep.block", "rep.row",
                                    F.monotonically_increasing_id().alias("k")), "classes")
    homes = at_home(classes, blocks)
    with temporary(spark, "gram-totals") as folder:
        totals = stored(gram_totals(gram_counts(homes, size, parts)), "totals", folder)
        shared = stored(shared_grams(publish(homes, totals, size, num, den, parts), num, den), "shared")

    labels, cells = None, shared.withColumn("label", F.col("k"))
    for turn in range(STAR_ROUNDS):
        links = verified(star_edges(cells, turn, num, den), homes, size, num, den)
        labels = grown(labels, links)
        cells = open_cells(cells, labels)
    links = verified(tree_edges(cells, homes, size, num, den), homes, size, num, den)
    labels = grown(labels, links)

    named = classes.select("c", "k", "m", "rep").join(
        labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    leader = named.groupBy("label").agg(F.min("rep").alias("lead"))
    by_class = join_stored(named, leader, "label").select("c", "m", "lead")
    grouped = join_stored(full, by_class, "c").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"),
        F.col("m").alias("copies"),
        ((F.col("lead.block") == F.col("block")) & (F.col("lead.row") == F.col("row"))).alias("first"))
    empty = summary.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(1).cast("long").alias("copies"), F.lit(True).alias("first"))
    return grouped.unionByName(empty)
