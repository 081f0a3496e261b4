"""D14, names: every name of a dictionary is found in any text and taken out.

No text has a list of its own names.  A name is the run of its words (letters and digits,
case ignored); it stands in a text where the same words follow each other, whatever signs
are between them.  Each name is looked up by the word of it that the fewest names have
(its anchor), so a word that all names share, such as a title, joins nothing.  An anchor's
hit tells where the name would begin and how many words it would have; the words that
stand there are joined with the dictionary, so a frequent anchor costs one row per hit
and shape, not one per name.

Equal texts are worked on once.  Work per text is in proportion to its words; nothing is
broadcast by hint and nothing passes through the driver.

Defined results: NULL texts stay NULL; texts without names and texts beside an empty
dictionary stay as they are; NULL names and names without a letter or digit are no names;
names that overlap in a text become one mark, names side by side one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REDACTED, redact
from ..sources.tables import materialize

WORD = r"[\p{L}\p{N}]+"
#: Words and what stands between them, alternating; joined they are the text.
PIECE = WORD + r"|[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def dictionary(names: DataFrame, name_col: str) -> DataFrame:
    """(name, n_words, anchor, place): distinct names, words joined by blanks, each with the
    word that the fewest names have and where it stands in the name."""
    known = names.select(words_of(F.col(name_col)).alias("words")).filter(F.size("words") > 0).distinct() \
        .select(F.array_join("words", " ").alias("name"), F.size("words").alias("n_words"), "words")
    spread_over = known.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word") \
        .agg(F.count(F.lit(1)).alias("n_names"))
    rarest = F.min(F.struct("n_names", "word", "place")).alias("r")
    return known.select("name", "n_words", F.posexplode("words").alias("place", "word")) \
        .join(spread_over, "word").groupBy("name", "n_words").agg(rarest) \
        .select("name", "n_words", F.col("r.word").alias("anchor"), F.col("r.place").alias("place"))


def text_key(text: Column) -> Column:
    """What stands for a text in shuffles: the first 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def name_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, first, last): word numbers of every occurrence of a name.  texts: (key, words);
    names: as ``dictionary`` gives them."""
    shapes = names.select("anchor", "place", "n_words").distinct()
    # a row per word is what is shuffled most: nothing in it but key, place and word
    places = texts.select("key", F.posexplode("words").alias("at", "anchor")) \
        .join(shapes, "anchor") \
        .select("key", (F.col("at") - F.col("place")).alias("first"), "n_words") \
        .filter(F.col("first") >= 0).distinct()
    there = places.join(texts, "key").filter(F.col("first") + F.col("n_words") <= F.size("words")).select(
        "key", "first", (F.col("first") + F.col("n_words") - 1).alias("last"),
        F.array_join(F.slice("words", F.col("first") + 1, F.col("n_words")), " ").alias("name"))
    return there.join(names.select("name"), "name", "left_semi").select("key", "first", "last")


def merged(spans: DataFrame) -> DataFrame:
    """(key, spans): overlapping spans of a text as one, in order."""
    before = Window.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("first") > reach, 1).otherwise(F.when(reach.isNull(), 1).otherwise(0)))
    return new.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")) \
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text with each span of words replaced by the mark."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    lead = F.when(text.rlike(f"^{WORD}"), 0).otherwise(1)

    def piece(word: Column) -> Column:
        return 2 * word + lead + 1

    def upto(span: Column, k: Column) -> Column:
        done = F.coalesce(piece(F.get(spans, k - 1)["last"]), F.lit(0))
        return F.concat(F.array_join(F.slice(pieces, done + 1, piece(span["first"]) - done - 1), ""), F.lit(REDACTED))

    end = piece(F.element_at(spans, -1)["last"])
    return F.concat(F.array_join(F.transform(spans, upto), ""),
                    F.array_join(F.slice(pieces, end + 1, F.size(pieces)), ""))


def redact_known_names(df: DataFrame, text_col: str, names: DataFrame, name_col: str,
                       out_col: str = "redacted", count_col: str = "n_names") -> DataFrame:
    """``df`` with ``out_col``, its text without any name of ``names``, and ``count_col``,
    the number of marks."""
    keyed = df.withColumn("_key", text_key(F.col(text_col)))
    texts = materialize(keyed.filter(F.col("_key").isNotNull()).select(
        F.col("_key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"]))
    spans = merged(name_spans(texts.select("key", words_of(F.col("text")).alias("words")),
                              materialize(dictionary(names, name_col))))
    done = texts.join(spans, "key").select(
        F.col("key").alias("_key"), without_spans(F.col("text"), F.col("spans")).alias("_out"),
        F.size("spans").alias("_n"))
    return keyed.join(done, "_key", "left") \
        .withColumn(out_col, F.coalesce("_out", F.col(text_col))) \
        .withColumn(count_col, F.when(F.col(text_col).isNotNull(), F.coalesce("_n", F.lit(0)))) \
        .drop("_key", "_out", "_n")


def redaction_audit(df: DataFrame, text_col: str, names: DataFrame, name_col: str, subject_col: str,
                    time_col: str) -> DataFrame:
    """One audit row per redaction call, names and patterns both, with the text that
    went in and the one that came out."""
    done = redact_known_names(df, text_col, names, name_col, "_redacted", "_n_names")
    return done.select(
        F.col(time_col).alias("called_at"), F.lit("redact_free_text").alias("function_name"),
        F.lit("rules").alias("model_name"), F.col(subject_col).cast("string").alias("subject_id"),
        F.col(text_col).alias("input_summary"), redact("_redacted").alias("output_summary"))
