"""The corpus pipeline: stages against plain Python, and the whole run."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import host_rules, stages

from .conftest import words_of
from .test_corpus_operators import tokens_of
from .test_joins import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(corpus):
    from quayside.llm.common import stored
    return stored(corpus, "pipeline-input")


def plain(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_rules_keep_what_the_sql_twin_keeps(docs, rows):
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", pdf)
    kept = con.execute(f"SELECT doc_id FROM ({host_rules.ORACLE}) WHERE kept").fetchall()
    assert sorted(x[0] for x in kept) == sorted(i for i, _ in plain(stages.keep_by_rules(docs)))


def test_line_dedup_stage(docs):
    rows, number = stages.numbered(docs)
    order = [(r[number], r.doc_id, r.text, r.n_chars) for r in rows.orderBy(number).collect()]
    removed = brute_lines([(n, t) for n, _, t, _ in order])
    want = []
    for n, i, text, chars in order:
        own = {k: gone for (d, k), gone in removed.items() if d == n}
        if any(own.values()):
            if all(own.values()):
                continue
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if not own.get(k))
            chars = len(text)
        want.append((str(i), str(text), str(chars)))
    got = [(str(r.doc_id), str(r.text), str(r.n_chars)) for r in stages.drop_lines(docs).collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicate_stage(docs):
    order = plain(docs)
    groups = brute_components(order, 5, 8, 10)
    want = sum(len({id(m)}) for m in {id(m): m for _, m in groups.values()}.values())
    got = plain(stages.one_of_each_group(docs))
    assert len(got) == want
    texts = [t for _, t in got if words_of(t)]
    again = brute_components([(k, t) for k, t in enumerate(texts)], 5, 8, 10)
    assert all(len(m) == 1 for _, m in again.values())


def test_decontamination_stage(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    passages = [" ".join(tokens_of(r.text)) for r in items.collect()]
    dirty = {i for i, t in plain(docs) if any(p in " ".join(tokens_of(t)) for p in passages)}
    kept = [i for i, _ in plain(stages.decontaminated(docs, items))]
    assert dirty and not dirty & set(kept)
    assert len(kept) >= docs.count() - len(dirty) - 2


def test_stages_take_empty_tables(spark, docs):
    none = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_names_that_clash(docs):
    rows, number = stages.numbered(docs.withColumn("_ROW_", F.lit(1)))
    assert number == "_row__" and re.fullmatch(r"_row_*", number)


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 60 < len(ids) < 200
