"""Quality rules on the level of hosts (op2); DataFrame functions only.

Every document is measured and put to a few rules.  Per host the share of documents
that fail a rule is shrunk towards the corpus by a beta prior whose two parameters
come from the hosts themselves (moments of the beta-binomial distribution: the spread of
the shares less that of drawing few documents), so that a host with three documents is
not judged on three documents alone, nor a long tail of such hosts taken for a spread.  The shrunk share sets how the
host's documents are treated: a rejected host loses all, a trusted host's documents
may fail one rule, any other host's documents must pass all rules.

Defined results: a NULL text has no words and so fails; a NULL host is a host of its
own; rows count one by one, repeated ids or rows included; an empty table gives no
row; further columns are ignored.  Equal 8-word windows are found by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, prepare, stored

WINDOW = 8
#: Shrunk failure share above which a host is rejected, and below which it is trusted.
REJECT_ABOVE = 0.5
TRUST_BELOW = 0.03
#: Bounds of the prior's strength, in documents.
PRIOR_STRENGTH = (1.0, 1000.0)
#: Ways a host is dealt out in the join, so that no host fills one task.
SALTS = 32

RULES = ("symbols", "shouting", "line_repeats", "word_length")


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             host: str = "source") -> DataFrame:
    """Measures of every text.  Each step is a projection of its own, as its arrays are
    used more than once by the next."""
    t = F.col("t")
    w, h = F.col("w"), F.col("h")
    words = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "doc_id", "host", "t",
        F.array_remove(F.split(t, SEPARATORS), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = words.select(
        "doc_id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("w"))

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    starts = F.sequence(F.lit(0), F.size("w") - F.lit(WINDOW))
    keep = [c for c in counted.columns if c != "w"]
    hashed = counted.select(*keep, F.when(F.size("w") >= WINDOW,
                                          F.transform(starts, window)).alias("h"))
    # only texts with a repeated window are sorted: equal windows are then neighbours
    ordered = hashed.select(*keep, F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
        .alias("o"))
    o = F.col("o")
    repeated = ordered.select(*keep, F.sort_array(F.transform(
        F.filter(o, lambda s, i: (F.get(o, i + 1)["x"] == s["x"])
                 | ((i > 0) & (F.get(o, F.greatest(i - 1, F.lit(0)))["x"] == s["x"]))),
        lambda s: s["i"])).alias("p"))
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW),
                                            F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return repeated.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_rules(measured: DataFrame) -> DataFrame:
    """Add the verdict of the base rule and the number of failed rules."""
    n, chars = F.col("n_words"), F.col("word_chars")
    rules = {
        "symbols": 10 * F.col("n_symbols") > n,
        "shouting": 2 * F.col("n_upper") > chars,
        "line_repeats": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (chars < 3 * n) | (chars > 12 * n),
    }
    failed = sum((F.when(rules[r], 1).otherwise(0) for r in RULES), F.lit(0))
    return measured.withColumns({
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "rules_failed": failed.cast("long")})


def host_verdicts(judged: DataFrame) -> DataFrame:
    """Per host: documents, failures, the shrunk share and the verdict."""
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.when(F.col("base_failed") | (F.col("rules_failed") > 0), 1).otherwise(0))
        .alias("host_failures"))
    n = F.col("host_docs")
    share = F.col("host_failures") / n
    low, high = (F.lit(x) for x in PRIOR_STRENGTH)
    # one row, whatever the number of hosts.  A host of n documents adds to the variance of
    # the shares what drawing n documents gives by itself, which is taken off
    # (beta-binomial moments); hosts of one document say nothing about the spread
    moments = hosts.agg(F.avg(share).alias("m"), F.coalesce(F.var_samp(share), F.lit(0.0)).alias("v"),
                        F.avg(1 / n).alias("a"))
    by_chance = F.col("m") * (1 - F.col("m"))
    over, room = F.col("v") - by_chance * F.col("a"), by_chance * (1 - F.col("a"))
    prior = moments.select("m", F.when((over > 0) & (room > 0), F.least(high, F.greatest(low, room / over - 1)))
                           .otherwise(high).alias("s"))
    shrunk = (F.col("host_failures") + F.col("m") * F.col("s")) / (F.col("host_docs") + F.col("s"))
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "host_docs", "host_failures", shrunk.alias("host_share"),
        F.when(shrunk > REJECT_ABOVE, "rejected").when(shrunk < TRUST_BELOW, "trusted")
        .otherwise("mixed").alias("host_verdict"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          host: str = "source") -> DataFrame:
    """Measures, base verdict, host verdict and ``kept`` of every document."""
    prepare(docs.sparkSession)
    judged = stored(with_rules(measures(docs, doc_id, text, host)), "host-measures")
    key = [F.col("host").isNull().alias("x"), F.coalesce("host", F.lit("")).alias("k")]
    hosts = host_verdicts(judged).select(
        *key, "host_docs", "host_failures", "host_share", "host_verdict",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = judged.select("*", *key, F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"),
                                             F.lit(SALTS)).cast("int").alias("salt"))
    joined = salted.join(hosts, ["x", "k", "salt"], "left").drop("x", "k", "salt")
    allowed = F.when(F.col("host_verdict") == "trusted", 1).otherwise(0)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") != "rejected")
                             & (F.col("rules_failed") <= allowed))


#: DuckDB twin over ``documents``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS k, source IS NULL AS x, coalesce(text, '') AS t,
         row_number() OVER () AS r
  FROM documents),
w AS (
  SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM d),
win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM rep GROUP BY r),
m AS (
  SELECT d.r, doc_id, x, k, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         (10 * n_symbols > n_words)::BIGINT + (2 * n_upper > word_chars)::BIGINT
         + (10 * n_dup_lines > 3 * n_lines)::BIGINT
         + (word_chars < 3 * n_words OR word_chars > 12 * n_words)::BIGINT AS rules_failed
  FROM m),
h AS (
  SELECT x, k, count(*) AS host_docs,
         sum((base_failed OR rules_failed > 0)::BIGINT)::BIGINT AS host_failures
  FROM j GROUP BY x, k),
p AS (SELECT avg(host_failures / host_docs) AS m, avg(1 / host_docs) AS a, count(*) AS n FROM h),
e AS (
  SELECT m, coalesce(sum((host_failures / host_docs - m) ** 2) / nullif(any_value(n) - 1, 0), 0) AS v,
         any_value(m * (1 - m) * a) AS drawn, any_value(m * (1 - m) * (1 - a)) AS room
  FROM h, p GROUP BY m),
s AS (SELECT m, CASE WHEN v > drawn AND room > 0 THEN least(1000.0, greatest(1.0, room / (v - drawn) - 1))
                     ELSE 1000.0 END AS s FROM e),
g AS (
  SELECT x, k, host_docs, host_failures,
         (host_failures + m * s) / (host_docs + s) AS share FROM h, s),
v AS (
  SELECT x, k, host_docs, host_failures,
         CASE WHEN share > 0.5 THEN 'rejected' WHEN share < 0.03 THEN 'trusted'
              ELSE 'mixed' END AS host_verdict FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       rules_failed, host_docs, host_failures, host_verdict,
       NOT base_failed AND host_verdict <> 'rejected'
       AND rules_failed <= CASE WHEN host_verdict = 'trusted' THEN 1 ELSE 0 END AS kept
FROM j JOIN v USING (x, k)
"""
