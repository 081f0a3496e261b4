"""Trie of conversation prefixes by a van Emde Boas recursion (op11).

A conversation is a sequence of turns, a turn a fixed-size binary of its digest and
its number of code points.  Tries of height h hold runs of at most h turns below a
named root.  Each round cuts all runs at half their height: the first halves make the
upper tries, and every first half that goes on is named (a digest of root and turns),
which makes it the root of a lower trie.  Upper and lower tries are of the same height
and are handled by the same job, and equal runs under one root become one row with a
count before the next cut, so that a conversation that a third of all share is cut
once.  At height 1 each row is a node.

Totals are then grafted upward in reverse: what the top nodes of the lower tries hold
in sum belongs to their root and to its ancestors in the upper trie, whose names
follow from the run that was named.  A node gets at most one such sum per height.

A conversation may hold any share of all turns: turns are put in order by a range
partitioning with numbers carried over its bounds, and a conversation of more than
``CHUNK`` turns is several rows, whose roots come from the same halving over chunks.

Defined results: turns of one conversation with the same number are ordered by role,
then by the digest of role and text; equal rows are turns of their own; rows without
conv_id belong to no conversation; ``c % 100`` takes the sign of c; an empty table
gives no row; further columns are ignored.  Nodes are told apart by 128-bit digests.
The digest of the members that end at a node is by definition taken over all their ids
in order; their ids are joined in ranges first, and one task reads a node's ranges one
after the other, holding one at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, shared_folder, stored
from .graph import join_stored

#: Conversations of one group begin alike: with up to HEAD - 1 turns of the group's first.
GROUP, HEAD = 100, 6
#: Most turns in a row; a power of two.
CHUNK = 256
DIGEST, WIDTH = 16, 24
#: Conversations whose ids one task joins.
IDS = 1 << 16



def constant(hexadecimal: str) -> Column:
    return F.unhex(F.lit(hexadecimal))


def trie_root() -> Column:
    """Name of the root, the node without turns."""
    return constant("00" * DIGEST)


def digest(*parts) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turn_code(role: Column, text: Column) -> Column:
    """Digest of role and text, then the text's number of code points in 8 bytes."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    own = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.concat(F.unhex(F.md5(own)), F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 16, "0")))


def turns(run: Column, first, n) -> Column:
    """``n`` turns of a run from number ``first`` (from 0) on."""
    return F.substring(run, first * WIDTH + 1, n * WIDTH)


def size(run: Column) -> Column:
    return (F.length(run) / WIDTH).cast("int")


def walk(root: Column, run: Column, path: bool = False) -> Column:
    """Name of the node that a run leads to from a root; or the names of all nodes on it."""
    def step(name, i):
        return digest(name, F.substring(run, i * WIDTH + 1, F.lit(WIDTH)))

    places = F.filter(F.sequence(F.lit(0), F.greatest(size(run), F.lit(1)) - 1), lambda i: i < size(run))
    if not path:
        return F.aggregate(places, root, step)
    start = F.struct(root.alias("name"), F.array().cast("array<binary>").alias("seen"))
    return F.aggregate(places, start, lambda a, i: F.struct(
        step(a["name"], i).alias("name"), F.concat(a["seen"], F.array(step(a["name"], i))).alias("seen")))["seen"]


def numbered(rows: DataFrame, tasks: int, folder: str) -> DataFrame:
    """Rows (c, turn, role, code) with ``place``, their number in the conversation."""
    dealt = rows.repartitionByRange(tasks, "c", F.col("turn").asc_nulls_first(), "role", "code") \
        .sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "code")

    def count(batches):
        import pyarrow as pa
        part, held, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            place = np.arange(len(c)) - np.repeat(starts, np.diff(np.append(starts, len(c))))
            if c[0] == held:
                place[:starts[1] if len(starts) > 1 else len(c)] += seen
            held, seen = c[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(place, pa.int64()),
                 pa.array(np.full(len(c), part, np.int32))], names=["c", "code", "place", "part"])

    found = stored(dealt.select("c", "code").mapInArrow(count, "c long, code binary, place long, part int"),
                   "numbered", folder)
    # only a partition's first conversation can have begun in an earlier one
    ends = found.groupBy("part").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    bounds = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("c"))
    sizes = found.join(F.broadcast(bounds), ["part", "c"]).groupBy("part", "c") \
        .agg((F.max("place") + 1).alias("n")).collect()  # two rows per task at most
    before, total = [], {}
    for r in sorted(sizes, key=lambda r: (r["c"], r["part"])):
        if total.get(r["c"]):
            before.append((r["part"], r["c"], total[r["c"]]))
        total[r["c"]] = total.get(r["c"], 0) + r["n"]
    shift = found.sparkSession.createDataFrame(before, "part int, c long, shift long")
    return found.join(F.broadcast(shift), ["part", "c"], "left").select(
        "c", "code", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))


def rebuilt(numbers: DataFrame) -> DataFrame:
    """Chunks (c, chunk, run) of the rebuilt conversations; one without turns has one
    empty chunk."""
    first = F.col("c") - F.col("c") % GROUP
    heads = numbers.filter((F.col("c") % GROUP == 0) & (F.col("place") < HEAD - 1)).groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("place", "code"))).alias("head")) \
        .select(F.col("c").alias("g"), "head")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEAD
    lent = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,code:binary>>")), F.lit(1), h.cast("int"))
    joined = join_stored(numbers.withColumn("g", first), heads, "g", "left").select(
        "c", "place", "code", h.alias("h"), lent.alias("lent"))
    # a conversation's first row brings the lent turns and, in case there are none, a mark
    nothing = F.struct(F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("code"))
    own = F.array(F.struct((F.col("place") - F.col("h") + F.size("lent")).alias("place"), "code"))
    given = F.when(F.col("place") == 0, F.concat(F.array(nothing), "lent")).otherwise(F.slice("lent", 1, 0))
    rows = joined.select("c", F.explode(F.when(F.col("place") >= F.col("h"), F.concat(given, own))
                                        .otherwise(given)).alias("t"))
    return rows.groupBy("c", F.floor(F.col("t.place") / CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.when(F.col("t.code").isNotNull(), F.col("t")))).alias("ts")) \
        .select("c", "chunk", F.aggregate("ts", constant(""), lambda a, t: F.concat(a, t["code"])).alias("run"))


def rooted(chunks: DataFrame, levels: int, folder: str) -> tuple[DataFrame, list]:
    """Give each chunk its root, halving the sequences of chunks ``levels`` times; the
    cuts: (height in turns, boundaries) from the largest height on."""
    current, cuts = chunks.withColumn("root", trie_root()), []
    for level in range(levels, 0, -1):
        half = 1 << (level - 1)
        block, inner = F.floor(F.col("chunk") / (2 * half)), F.col("chunk") % (2 * half)
        upper = current.filter(inner < half)
        # equal first halves get equal names: digests by place, summed by exclusive or
        words = [F.bit_xor(F.xxhash64(F.lit(k), inner, "run")).alias(f"w{k}") for k in (1, 2)]
        names = upper.groupBy("c", block.alias("b")).agg(*words, F.max("root").alias("upper_root"))
        named = names.select("c", "b", digest("upper_root", F.lpad(F.hex("w1"), 16, "0").cast("binary"),
                                              F.lpad(F.hex("w2"), 16, "0").cast("binary")).alias("named"))
        current = stored(join_stored(current.withColumn("b", block), named, ["c", "b"], "left")
                         .withColumn("root", F.when(inner >= half, F.col("named")).otherwise(F.col("root")))
                         .select("c", "chunk", "run", "root"), f"rooted-{level}", folder)
    for level in range(levels, 0, -1):  # with the roots that all levels together gave
        half = 1 << (level - 1)
        block, inner = F.floor(F.col("chunk") / (2 * half)), F.col("chunk") % (2 * half)
        below = current.filter(inner == half).select("c", block.alias("b"), F.col("root").alias("x"))
        above = current.filter(inner < half).select("c", block.alias("b"), "root", "run")
        cuts.append((2 * half * CHUNK, above.join(below, ["c", "b"]).select("x", "root", "run").distinct()))
    return current, cuts


def paths_to(chunks: DataFrame, folder: str) -> DataFrame:
    """(x, by_path): the name that each chunk's root has as the last node of the chunk before."""
    following = chunks.filter("chunk > 0").select("c", (F.col("chunk") - 1).alias("chunk"), F.col("root").alias("x"))
    return stored(chunks.join(following, ["c", "chunk"]).groupBy("x").agg(F.min(F.struct("root", "run")).alias("l"))
                  .select("x", walk(F.col("l.root"), F.col("l.run")).alias("by_path")), "paths", folder)


def ends_of(chunks: DataFrame, several: bool, folder: str) -> DataFrame:
    """(c, name): the node at which each conversation ends."""
    if several:
        chunks = chunks.groupBy("c").agg(F.max(F.struct("chunk", "root", "run")).alias("l")).select("c", "l.root", "l.run")
    return stored(chunks.select("c", walk(F.col("root"), F.col("run")).alias("name")), "ends", folder)


def member_digests(ends: DataFrame, n: int) -> DataFrame:
    """(name, ends_sha256) over the ids that end at a node, in order."""
    def join_ids(batches):
        import pyarrow as pa
        for batch in batches:
            names, ids = batch.column(0), batch.column(1).to_numpy()
            if not len(ids):
                continue
            runs = names.dictionary_encode().indices.to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, runs[1:] != runs[:-1])), len(ids))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(cut[:-1])), pa.array(ids[cut[:-1]]),
                 pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut[:-1], cut[1:])])],
                names=["name", "first", "ids"])

    def sum_up(batches):
        import pyarrow as pa
        held, state, out = None, None, []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()),
                                               pa.array([x[1] for x in out], pa.string())], names=["name", "ends_sha256"])
        for batch in batches:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == held:
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((held, state.hexdigest()))
                    held, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield rows()
        if held is not None:
            out = [(held, state.hexdigest())]
            yield rows()

    spark = ends.sparkSession
    tasks = max(partitions(spark), -(-n // IDS))
    ranges = ends.repartitionByRange(tasks, "c").sortWithinPartitions("name", "c").select("name", "c") \
        .mapInArrow(join_ids, "name binary, first long, ids string")
    return ranges.repartition(partitions(spark), "name").sortWithinPartitions("name", "first") \
        .select("name", "ids").mapInArrow(sum_up, "name binary, ends_sha256 string")


def cut(runs: DataFrame, height: int, folder: str) -> tuple[list[DataFrame], list]:
    """Cut runs (root, depth, run, n, conv) of at most ``height`` turns down to nodes;
    returns the rows of height 1 and the cuts, (height, boundaries), largest first."""
    cuts = []
    while height > 1:
        half = height // 2
        longer = size(F.col("run")) > half
        upper = turns(F.col("run"), F.lit(0), F.lit(half))
        halves = stored(runs.select("root", "depth", "n", "conv", upper.alias("upper"),
                                    F.when(longer, F.substring(F.col("run"), half * WIDTH + 1, (height - half) * WIDTH)).alias("lower"),
                                    F.when(longer, walk(F.col("root"), upper)).alias("x")), f"cut-{height}", folder)
        cuts.append((height, halves.filter("x IS NOT NULL").groupBy("x").agg(
            F.min("root").alias("root"), F.min("upper").alias("run"))))
        runs = merged(halves.select("root", "depth", F.col("upper").alias("run"), "n", "conv").union(
            halves.filter("x IS NOT NULL").select("x", F.col("depth") + half, "lower", "n", "conv")))
        height = half
    return runs, cuts


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("root", "run").agg(F.min("depth").alias("depth"), F.sum("n").alias("n"),
                                           F.min("conv").alias("conv"))


NODE = ("parent", "depth", "n_convs", "conv_id", "n_children")


def graft(nodes: DataFrame, cuts: list, folder: str) -> DataFrame:
    """Add the totals of lower tries to the nodes above them, from the lowest height up."""
    for height, bounds in sorted(cuts, key=lambda x: x[0]):
        half = height // 2
        tops = nodes.filter((F.col("depth") - 1) % height == half).groupBy(F.col("parent").alias("x")) \
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        gains = bounds.join(tops, "x").select(
            F.explode(walk(F.col("root"), F.col("run"), path=True)).alias("name"), "n_leaves", "saved_tokens")
        nodes = stored(nodes.unionByName(gains, allowMissingColumns=True).groupBy("name").agg(
            *(F.max(c).alias(c) for c in NODE), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens")), f"grafted-{height}", folder)
    return nodes


def prefix_nodes(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "trie")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        turn_code(F.col(role), F.col(text)).alias("code")).filter("c IS NOT NULL")
    chunks = stored(rebuilt(numbered(rows, partitions(spark), folder)), "chunks", folder)
    most, longest, convs = chunks.agg(F.max("chunk"), F.max(size(F.col("run"))),
                                      F.sum((F.col("chunk") == 0).cast("long"))).first()
    levels = int(most or 0).bit_length()
    chunks, cuts = rooted(chunks, levels, folder)
    ends = ends_of(chunks, levels > 0, folder)

    height = 1 << max(int(longest or 1) - 1, 0).bit_length()
    runs, inner = cut(merged(chunks.filter(F.length("run") > 0).select(
        "root", (F.col("chunk") * CHUNK).alias("depth"), "run", F.lit(1).cast("long").alias("n"),
        F.col("c").alias("conv"))), height, folder)
    chars = F.conv(F.hex(F.substring("run", DIGEST + 1, WIDTH - DIGEST)), 16, 10).cast("long")
    nodes = runs.select(
        walk(F.col("root"), F.col("run")).alias("name"), F.col("root").alias("parent"),
        (F.col("depth") + 1).alias("depth"), F.col("n").alias("n_convs"), F.col("conv").alias("conv_id"),
        ((F.col("n") - 1) * chars).alias("saved"))
    if levels:
        paths = paths_to(chunks, folder)
        nodes = nodes.join(paths.withColumnRenamed("x", "parent"), "parent", "left") \
            .withColumn("parent", F.coalesce("by_path", "parent")).drop("by_path")
        cuts = [(h, b.join(paths, "x").select(F.col("by_path").alias("x"), "root", "run")) for h, b in cuts]
    return finished(stored(nodes, "nodes", folder), cuts + inner, ends, convs or 0, folder)


def finished(nodes: DataFrame, cuts: list, ends: DataFrame, convs: int, folder: str) -> DataFrame:
    spark = nodes.sparkSession
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("k"))
    counted = nodes.join(children, "name", "left").select(
        "name", "parent", "depth", "n_convs", "conv_id", F.coalesce("k", F.lit(0)).alias("n_children"),
        F.col("k").isNull().cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    whole = graft(stored(counted, "counted", folder), cuts, folder)
    tops = whole.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("l"),
                                         F.sum("saved_tokens").alias("s"))
    top = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).filter("n_convs > 0") \
        .crossJoin(tops).select(
        trie_root().alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "n_convs", "conv_id", "n_children", F.greatest(F.coalesce("l", F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce("s", F.lit(0)).alias("saved_tokens"))
    every = stored(whole.select(*top.columns).union(top), "totals", folder)
    parents = every.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = join_stored(every, parents, "parent", "left").join(member_digests(ends, convs), "name", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same nodes in SQL: every prefix of every rebuilt conversation as one string.
ORACLE = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, list_reduce(list_concat([4294967295::BIGINT],
           list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))) AS crc
  FROM (SELECT DISTINCT c FROM own)),
heights AS (SELECT c, c - c % 100 AS g, xor(crc, 4294967295) % 6 AS h FROM convs),
rebuilt AS (
  SELECT t.c, t.part, o.place, o.role, o.txt FROM (SELECT c, g, h, 0 AS part FROM heights) t
    JOIN own o ON o.c = t.g AND o.place < t.h
  UNION ALL
  SELECT t.c, 1, o.place, o.role, o.txt FROM heights t JOIN own o ON o.c = t.c AND o.place >= t.h),
turns AS (
  SELECT c, row_number() OVER w AS depth, length(txt) AS chars,
         string_agg(length(role) || ':' || role || ':' || length(txt) || ':' || txt, '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, place)),
marks AS (
  SELECT c, depth, chars, sha256(path) AS name, coalesce(lag(sha256(path)) OVER (PARTITION BY c ORDER BY depth), '') AS parent
  FROM turns
  UNION ALL SELECT c, 0, 0, '', NULL FROM heights),
nodes AS (
  SELECT name, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id,
         count(*) AS n_convs, any_value(chars) AS chars FROM marks GROUP BY name),
children AS (SELECT parent AS name, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
own_values AS (
  SELECT n.name, n.depth, n.conv_id, coalesce(k.n, 0) AS n_children,
         CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * n.chars END AS saved
  FROM nodes n LEFT JOIN children k USING (name)),
totals AS (
  SELECT m.name, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM own_values v JOIN marks m ON m.c = v.conv_id AND m.depth <= v.depth GROUP BY m.name),
last AS (SELECT c, max(depth) AS depth FROM marks GROUP BY c),
ends AS (
  SELECT m.name, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS digest
  FROM marks m JOIN last l ON l.c = m.c AND l.depth = m.depth GROUP BY m.name)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, v.n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens,
       coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN own_values v USING (name) JOIN totals t USING (name)
LEFT JOIN nodes p ON p.name = n.parent LEFT JOIN ends e ON e.name = n.name
"""
