"""A small corpus with every odd case, as (rows, DataFrame): NULLs in each column, empty
and very long texts, repeated rows, equal texts, and extra columns whose names clash with
names that operators use."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
EXTRA = ["t", "w", "row", "key", "score", "label", "id", "part", "block", "n", "salt", "_row", "dropped"]


@pytest.fixture(scope="session")
def rows():
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' "
                      "ORDER BY doc_id LIMIT 80").fetchall()
    base = docs[5]
    words = docs[7][1].split(" ")
    near = " ".join(["changed" if i == len(words) // 2 else w for i, w in enumerate(words)])
    odd = [
        (900, None, "en", "src0", 0), (901, "", "en", "src1", 0), (902, " \n\t ", None, "src1", None),
        (903, "one", "de", None, 3), (904, "two words", "fr", "src2", 9), (905, "123 456 $$ ||", None, "src2", 12),
        (None, "a text without an id but with a few words in it", "en", "src3", 40),
        (None, None, None, None, None),
        base, base,                                     # repeated rows
        (906, base[1], base[2], "src4", base[4]),       # an exact copy
        (907, near, docs[7][2], "src4", len(near)),     # a near copy
        (908, " ".join(f"w{i % 997} x{i}" for i in range(30_000)), "en", "src5", 400_000),
        (909, "same line here\nsame line here\n" * 40, "en", "src5", 1200),
        (910, "Été   naïve 日本語 \U0001F600 tab\there\r\nend.", "fr", "src6", 30),
        (-1, "negative id " * 15, "en", "src6", 180),
    ]
    return docs + odd


@pytest.fixture(scope="session")
def corpus(spark, rows):
    from quayside.llm.common import prepare
    prepare(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.filter("doc_id = 123456789 AND doc_id <> 123456789")


def words_of(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
