"""Line deduplication by an exact set-similarity join (op3); DataFrame functions only.

The tokens of a line are its distinct lower-cased words.  A line goes when an earlier
line, by document id and line number, has a Jaccard similarity of at least ``NUM / DEN``
with it.  Equal lines are reduced to their first occurrence.  The tokens of each remaining line are
ordered from rare to frequent, and only its first few, of which any similar line must
share one, take part in a self-join on the token and on a class of sizes: similar lines
are of one class or of neighbouring ones, and the shorter line needs about half of its first
tokens only.  The join keeps a pair if the sizes are close enough (length filter), if enough
tokens can follow the shared one in both orders (positional filter), and if the lines'
signatures of 128 bits differ in few bits; pairs that remain are verified on all their tokens.

A line that thousands of lines resemble would still meet all of them.  So each line is
first compared with four lines only, the most frequent among those that agree in the
smallest or in the largest token of two orders; pairs of lines that are both known to go after that
need no further comparison.

Defined results: NULL and empty texts have no line with a word, and such lines are
neither kept nor removed but passed through; rows that share a doc_id are taken as one
document, so equal lines at one place do not remove each other; NULL ids come first;
an empty table gives no row; further columns are ignored.  The line that a removed line
is said to repeat is similar and earlier, the earliest of those that it was compared
with: all but lines that, like itself, already fell to the most frequent line of their
group.  Lines and tokens are told apart by 64-bit hashes (tokens by 56 bits while
candidates are sought).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, partitions, prepare, stored, stored_by, temporary
from .graph import join_stored

NUM, DEN = 8, 10
#: Buckets of the table of token frequencies; a fixed number, one byte each.  With fewer
#: buckets than different words, rare words share their bucket's frequency.
BUCKETS, SLICE = 1 << 20, 1 << 12
#: Pairs that are verified in one go, for each shuffle partition.
SLICE_PAIRS = 10_000
#: Printable sign of frequency 1; two signs further for each doubling.
SIGN = 33
HASH_BITS = 56
#: Ratio of the sizes at which classes of lines begin: a little over DEN / NUM, so that the
#: sizes of similar lines are never two classes apart.
CLASS_RATIO = 1.001 * DEN / NUM
#: Turns the order of tokens into another one.
OTHER_ORDER = 0x2545F4914F6CDD1D
FIRST_ID = -(1 << 63)


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, line_no, line) of every line with a word."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID)).alias("doc"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")) \
        .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def with_tokens(lines: DataFrame, name: str = "h") -> DataFrame:
    """Replace ``line`` by its tokens, the hashes of its distinct lower-cased words."""
    keep = [c for c in lines.columns if c != "line"]
    # a split at one plain character is much faster than one at a pattern
    cut = F.when(F.col("line").rlike(r"[\x09-\x0D]"), F.split(F.lower("line"), SEPARATORS)) \
        .otherwise(F.split(F.lower("line"), " "))
    return lines.select(*keep, F.array_distinct(
        F.transform(F.array_remove(cut, ""), lambda x: F.xxhash64(x))).alias(name))


def signature(h: Column, half: int) -> Column:
    """64 of 128 bits, of which bit k tells if an odd number of tokens are k modulo 128: those
    of one half."""
    def add(bits: Column, x: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.when(x.bitwiseAND(F.lit(64)) == 64 * half, bits.bitwiseXOR(bit)).otherwise(bits)

    return F.aggregate(h, F.lit(0).cast("long"), add)


def signed(tokens: DataFrame) -> DataFrame:
    """Add the number of tokens, both halves of the signature (``bits`` and ``more``) and
    ``ends``, the smallest and the largest token in each of two orders."""
    other = F.transform("h", lambda x: x.bitwiseXOR(F.lit(OTHER_ORDER)))
    return tokens.withColumns({"n": F.size("h"), "bits": signature(F.col("h"), 0),
                               "more": signature(F.col("h"), 1), "o": other}) \
        .withColumn("ends", F.array(F.array_min("h"), F.array_max("h"), F.array_min("o"), F.array_max("o"))).drop("o")


def bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def first_lines(lines: DataFrame) -> DataFrame:
    """One row per different line: its hash as id, its first place and the number of copies."""
    return lines.groupBy(F.xxhash64("line").alias("id")).agg(
        F.min(F.struct("doc", "line_no", "line")).alias("f"), F.count(F.lit(1)).alias("copies")) \
        .select("id", "f.doc", "f.line_no", "f.line", "copies")


def rarity_table(tokens: DataFrame) -> bytes:
    """Per bucket of tokens, one byte: the number of times its tokens occur, as a power
    of the root of two.  The signs of a slice of buckets are joined on the executors."""
    counts = tokens.select(F.explode_outer("h").alias("x")).filter("x IS NOT NULL") \
        .groupBy(bucket(F.col("x")).alias("b")) \
        .agg(F.floor(2 * F.log2(F.count(F.lit(1)))).cast("int").alias("level"))
    used = counts.groupBy(F.floor(F.col("b") / SLICE).alias("s")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("b") % SLICE).alias("p"), "level"))).alias("x"))
    gap = lambda i, v: v["p"] - F.when(i > 0, F.get("x", i - 1)["p"]).otherwise(-1) - 1
    signs = F.array_join(F.transform("x", lambda v, i: F.concat(
        F.repeat(F.lit(chr(SIGN)), gap(i, v)), F.char(v["level"] + SIGN))), "")
    table = bytearray([SIGN]) * BUCKETS
    for r in used.select("s", signs.alias("signs")).collect():
        at = r["s"] * SLICE
        table[at:at + len(r["signs"])] = r["signs"].encode("ascii")
    return bytes(table)


def rarest(tokens: DataFrame, table: bytes) -> DataFrame:
    """Number of tokens, the signature, and the rarest tokens in order: as many as a similar
    line must share one of."""
    def rank(x: Column) -> Column:
        # one number: sign of the frequency level, then hash
        level = F.ascii(F.substring(F.lit(bytearray(table)), bucket(x) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(level.cast("long"), HASH_BITS).bitwiseOR(
            x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    n = F.col("n")
    prefix = n - F.ceil(n * NUM / DEN).cast("int") + 1
    return tokens.select("id", "n", "bits", "more",
                         F.slice(F.sort_array(F.transform("h", rank)), F.lit(1), prefix).alias("rare"))


def close_sizes(x: str, y: str) -> Column:
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (DEN * nx >= NUM * ny) & (DEN * ny >= NUM * nx)


def few_differences(x: str, y: str) -> Column:
    """A bit in which x and y differ stands for at least one token that only one of them has."""
    bits = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("bits", "more")]
    return (NUM + DEN) * (bits[0] + bits[1]) <= (DEN - NUM) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def earlier(x: str, y: str) -> Column:
    return (F.col(f"{x}.doc") < F.col(f"{y}.doc")) | (
        (F.col(f"{x}.doc") == F.col(f"{y}.doc")) & (F.col(f"{x}.line_no") < F.col(f"{y}.line_no")))


def central_pairs(tokens: DataFrame) -> DataFrame:
    """(a, b): each line b with the most frequent line a of its group, if a is earlier and
    their sizes and signatures are close.  Lines with the same smallest or the same largest
    token are a group, in each of two orders of the tokens: few variants of a line differ
    from it in all four."""
    groups = tokens.select("id", "doc", "line_no", "copies", "n", "bits", "more", F.explode("ends").alias("g"))
    centre = groups.groupBy("g").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct(
            "copies", F.bitwise_not("doc").alias("x"), "id", "doc", "line_no", "n", "bits", "more")).alias("c")) \
        .filter("size > 1").select("g", F.struct("c.id", "c.doc", "c.line_no", "c.n", "c.bits", "c.more").alias("x"))
    met = join_stored(groups.select("g", F.struct("id", "doc", "line_no", "n", "bits", "more").alias("y")), centre, "g")
    return met.filter((F.col("x.id") != F.col("y.id")) & earlier("x", "y") & close_sizes("x", "y")
                      & few_differences("x", "y")) \
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


@contextmanager
def joined_where_dealt(spark: SparkSession):
    """Rows dealt by one of the keys of a join need not be dealt again by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    yield
    if before is None:
        spark.conf.unset(name)
    else:
        spark.conf.set(name, before)


def prefix_pairs(rare: DataFrame, gone: DataFrame) -> DataFrame:
    """(a, b) of all pairs that pass the filters and that are not both known to go.  Both
    sides of the join are the same rows, dealt once by token.  A word of one line only
    (level 0) meets nothing and is left out."""
    marked = rare.join(
        gone.select("id", F.lit(True).alias("gone")).hint("shuffle_hash"), "id", "left")
    size_class = F.floor(F.log("n") / F.log(F.lit(CLASS_RATIO))).cast("int")
    # the token may be the shorter line's part of a pair; class and mark are one column that
    # both sides read, or they would not share their rows
    leads = DEN * F.col("n") - NUM * F.col("n") >= (NUM + DEN) * F.col("place")
    tokens = marked.select("id", "n", "bits", "more", F.coalesce("gone", F.lit(False)).alias("gone"),
                           F.posexplode("rare").alias("place", "token")) \
        .filter(F.col("token") >= SIGN + 1 << HASH_BITS) \
        .withColumn("kind", F.coalesce(2 * size_class + leads.cast("int"), F.lit(0))) \
        .repartition(partitions(rare.sparkSession), "token")
    size_class, leads = F.shiftright("kind", 1), F.col("kind").bitwiseAND(F.lit(1)) == 1
    x = tokens.withColumn("class", F.when(leads, size_class).otherwise(F.lit(-2))).hint("shuffle_hash").alias("x")
    y = tokens.withColumn("class", F.explode(F.array(size_class, size_class - 1))).alias("y")
    after = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class"))
                  & ((F.col("x.n") < F.col("y.n"))
                     | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))))
                  & ((NUM + DEN) * after >= NUM * (F.col("x.n") + F.col("y.n")))
                  & ~(F.col("x.gone") & F.col("y.gone")) & close_sizes("x", "y")
                  & few_differences("x", "y")) \
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def verified(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs whose token sets are similar enough, as (id, of): the line that goes and the
    place of the earlier one.  A pair carries one line's tokens to the other's, so pairs
    are taken in slices of bounded size and each slice's shuffle files go before the next."""
    spark = first.sparkSession
    with temporary(spark, "line-verification") as folder:
        pairs = stored(pairs, "pairs", folder)
        # the needed lines are few: hashing them saves sorting the texts of all
        needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = stored_by(with_tokens(first.join(needed.hint("shuffle_hash"), "id")
                                     .select("id", "doc", "line_no", "line")), "sets", "id", folder)
        slices = max(1, -(-pairs.count() // (SLICE_PAIRS * partitions(spark))))
        number = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
        found = [stored(similar(pairs.filter(number == k), sets), f"similar-{k}", folder) for k in range(slices)]
        every = found[0]
        for part in found[1:]:
            every = every.union(part)
        return stored(every.groupBy("id").agg(F.min("of").alias("of")), "lines-gone")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, of) of the pairs whose sets are similar enough."""

    def side(name):
        return sets.select(F.col("id").alias(name), F.struct("id", "doc", "line_no", "h").alias(f"s{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa.h", "sb.h"))
    union = F.size("sa.h") + F.size("sb.h") - common
    first_is_early = earlier("sa", "sb")
    return both.filter(DEN * common >= NUM * union).select(
        F.when(first_is_early, F.col("sb.id")).otherwise(F.col("sa.id")).alias("id"),
        F.when(first_is_early, F.struct("sa.doc", "sa.line_no")).otherwise(F.struct("sb.doc", "sb.line_no")).alias("of")) \
        .groupBy("id").agg(F.min("of").alias("of"))


def similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
    """(all lines, first lines with ``of``): ``of`` is the earliest known similar line
    (struct doc, line_no) of a first line that goes, else NULL."""
    prepare(docs.sparkSession)
    lines = lines_of(docs, doc_id, text)
    first = stored_by(first_lines(lines), "first-lines", "id")
    with temporary(docs.sparkSession, "line-tokens") as folder:
        tokens = stored(signed(with_tokens(first)), "tokens", folder)
        rare = stored_by(rarest(tokens, rarity_table(tokens)), "rare-tokens", "id")
        gone = verified(central_pairs(tokens), first)
    with joined_where_dealt(docs.sparkSession):
        more = verified(prefix_pairs(rare, gone), first)
    every = gone.union(more).groupBy("id").agg(F.min("of").alias("of"))
    return lines, first.select("id", "doc", "line_no").join(every.hint("shuffle_hash"), "id", "left")


def line_fates(lines: DataFrame, first: DataFrame) -> DataFrame:
    """Every line with ``like``, the earlier line (struct doc, line_no) that it repeats, or
    NULL if it stays."""
    verdict = first.select("id", F.struct("doc", "line_no").alias("place"), "of")
    joined = join_stored(lines, verdict, "id")
    is_first = (F.col("place.doc") == F.col("doc")) & (F.col("place.line_no") == F.col("line_no"))
    return joined.withColumn("like", F.when(is_first, F.col("of")).otherwise(
        F.least("place", F.coalesce("of", "place")))).drop("place", "of")


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: doc_id, line_no, n_chars, removed, and the earlier
    line that it repeats (like_doc_id, like_line_no) or NULLs."""
    lines, first = similar_lines(docs, doc_id, text)
    slim = lines.select(F.xxhash64("line").alias("id"), "doc", "line_no",
                        F.length("line").cast("long").alias("n_chars"))

    def shown(c):
        return F.when(c != FIRST_ID, c)

    return line_fates(slim, first).select(
        shown(F.col("doc")).alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "n_chars",
        F.col("like").isNotNull().alias("removed"), shown(F.col("like.doc")).alias("like_doc_id"),
        F.col("like.line_no").cast("long").alias("like_line_no"))


def cut_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that loses a line: doc, dropped (numbers of the lines that go) and
    some_left (whether any line with a word stays)."""
    lines, first = similar_lines(docs, doc_id, text)
    slim = lines.select(F.xxhash64("line").alias("id"), "doc", "line_no")
    removed = F.col("like").isNotNull()
    return line_fates(slim, first).groupBy("doc").agg(
        F.collect_set(F.when(removed, F.col("line_no"))).alias("dropped"),
        F.max(~removed).alias("some_left")).filter(F.size("dropped") > 0)
