"""Names of a dictionary taken out of any text, against a plain search."""

import random
import re

from pyspark.sql import functions as F

from quayside.operators import names as N

PIECE = re.compile(r"[^\W_]+|(?:[\W_])+")


def plain(text, names):
    """(redacted, marks) by trying every name at every word."""
    if text is None:
        return None, None
    pieces = PIECE.findall(text)
    at = [k for k, p in enumerate(pieces) if p[0].isalnum()]
    known = {tuple(w.lower() for w in PIECE.findall(n or "") if w[0].isalnum()) for n in names} - {()}
    spans = [(i, i + len(n) - 1) for i in range(len(at)) for n in known
             if tuple(pieces[k].lower() for k in at[i:i + len(n)]) == n]
    out, i, marks = [], 0, 0
    while i < len(pieces):
        reach = [b for a, b in spans if at[a] == i]
        if not reach:
            out.append(pieces[i])
            i += 1
            continue
        end = max(reach)
        while any(a <= end < b for a, b in spans if at[a] >= i):
            end = max(b for a, b in spans if at[a] >= i and a <= end)
        out.append("[REDACTED]")
        marks, i = marks + 1, at[end] + 1
    return "".join(out), marks


def check(spark, texts, names):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("name", F.lit("clash"))
    known = spark.createDataFrame([(n,) for n in names], "name string").withColumn("text", F.lit(0))
    got = N.redact_known_names(df, "text", known, "name")
    assert got.columns == ["id", "text", "name", "redacted", "n_names"]
    rows = {r.id: (r.redacted, r.n_names) for r in got.collect()}
    assert rows == {k: plain(t, names) for k, t in enumerate(texts)}
    return rows


def test_names_in_every_form(spark):
    rows = check(spark, [
        "Ann Lee wrote to BO; ann-lee, Bo.", "Annlee and Bob are others", "Dr. Ann Lee Marsh", "bo", "", None, " -- ",
        "Lee Ann Lee", "Érika Núñez, ÉRIKA  NÚÑEZ", "Customer#000000007 and customer 000000008", "Bo Ann Lee"],
        ["Ann Lee", "Bo", "Lee Marsh", "Érika Núñez", "Customer#000000007", None, "", "--", "Bo"])
    assert rows[0] == ("[REDACTED] wrote to [REDACTED]; [REDACTED], [REDACTED].", 4)
    assert rows[2] == ("Dr. [REDACTED]", 1) and rows[10] == ("[REDACTED] [REDACTED]", 2)
    assert rows[1][1] == 0 and rows[9] == ("[REDACTED] and customer 000000008", 1)


def test_names_by_plain_search(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["Ä", "öl"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)]
    names = [n for n in names if len(n.split()) > 1 or rng.random() < 0.2]
    texts = ["".join(rng.choice(words).upper() + rng.choice([" ", ", ", "-", "\n", " # "])
                     for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = check(spark, texts + texts[:20], names)
    assert sum(n > 0 for _, n in rows.values()) > 80


def test_hot_texts_frequent_words_and_long_texts(spark):
    """Half of the rows share one text, every name has the same first word, and one text
    has 30,000 words."""
    names = [f"Customer {k}" for k in range(500)]
    long = " ".join(f"customer {k}" if k % 3 else "customer" for k in range(20_000))
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit("from customer 7 to Customer 700"))
                                  .when(F.col("id") == 1, F.lit(long))
                                  .otherwise(F.concat(F.lit("Customer "), F.col("id").cast("string"))).alias("text"))
    got = N.redact_known_names(df, "text", spark.createDataFrame([(n,) for n in names], "name string"), "name")
    rows = {r.id: (r.redacted, r.n_names) for r in got.collect()}
    assert rows[2] == rows[3998] == ("from [REDACTED] to Customer 700", 1)
    assert rows[3] == ("[REDACTED]", 1) and rows[501] == ("Customer 501", 0)
    assert rows[1][1] == sum(k % 3 > 0 for k in range(500))


def test_empty_sides_and_audit(spark):
    texts = spark.createDataFrame([(1, "Ann pays $5 to a@b.example", 3), (2, None, 4)], "id long, text string, at int")
    none = spark.createDataFrame([], "name string")
    assert [(r.redacted, r.n_names) for r in N.redact_known_names(texts, "text", none, "name").orderBy("id").collect()] \
        == [("Ann pays $5 to a@b.example", 0), (None, None)]
    assert N.redact_known_names(texts.limit(0), "text", none, "name").count() == 0
    one = spark.createDataFrame([("ann",)], "name string")
    audit = {r.subject_id: r for r in N.redaction_audit(texts, "text", one, "name", "id", "at").collect()}
    assert audit["1"].output_summary == "[REDACTED] pays [REDACTED] to [REDACTED]"
    assert audit["1"].input_summary.startswith("Ann pays") and audit["2"].output_summary is None


def test_narrow_keys_stand_for_texts_in_shuffles(spark, monkeypatch):
    widths, spans = [], N.name_spans

    def seen(texts, names):
        widths.extend(r.n for r in texts.select(F.octet_length("key").alias("n")).collect())
        return spans(texts, names)
    monkeypatch.setattr(N, "name_spans", seen)
    check(spark, ["a long text about Ann Lee " * 20, "Bo", None], ["Ann Lee", "Bo"])
    assert len(widths) == 2 and max(widths) <= 16
