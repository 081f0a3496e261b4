"""Replies are kept: equal prompts are asked once, known ones not at all, failures again."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.operators import model as M


@pytest.fixture
def cache():
    return os.path.join(tempfile.mkdtemp(prefix="replies-"), "store")


def backend(calls, bad=()):
    class Counting:
        name = "counting"

        def __call__(self, prompts):
            if any(p in bad for p in prompts):
                if len(prompts) == 1:
                    calls.add(1)
                raise ValueError("no answer")
            calls.add(len(prompts))
            return pd.Series([p.upper() for p in prompts], index=prompts.index, dtype=object)
    return Counting


def rows(df):
    return sorted(((r.id, r.reply, r.model_error) for r in df.collect()), key=str)


def test_a_second_run_makes_no_call(spark, cache):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id int, prompt string")
    want = sorted([(1, "A", None), (2, "B", None), (3, "A", None), (4, None, None), (5, "", None)], key=str)
    assert rows(M.run_model_cached(df, cache, backend=backend(calls))) == want
    assert calls.value == 3                                     # a, b and the empty prompt
    assert rows(M.run_model_cached(df, cache, backend=backend(calls))) == want
    assert calls.value == 3
    more = df.unionByName(spark.createDataFrame([(6, "c"), (7, "c")], "id int, prompt string"))
    assert len(rows(M.run_model_cached(more, cache, backend=backend(calls)))) == 7
    assert calls.value == 4
    # another model has answered nothing yet
    M.run_model_cached(df, cache, backend=backend(calls), model="other").collect()
    assert calls.value == 7


def test_failures_are_asked_again(spark, cache):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "bad")], "id int, prompt string").coalesce(1)
    got = rows(M.run_model_cached(df, cache, backend=backend(calls, bad=("bad",))))
    assert got == sorted([(1, "A", None), (2, None, "ValueError: no answer"), (3, None, "ValueError: no answer")], key=str)
    before = calls.value
    got = rows(M.run_model_cached(df, cache, backend=backend(calls)))
    assert got == [(1, "A", None), (2, "BAD", None), (3, "BAD", None)]
    assert calls.value == before + 1                            # only the one that failed
    assert rows(M.run_model_cached(df, cache, backend=backend(calls))) == got
    assert calls.value == before + 1


def test_the_same_rows_as_without_a_store(spark, cache):
    df = spark.range(200).selectExpr("id", "concat('Mechanical recommendation: do ', id % 7) AS prompt", "id * 2 AS extra")
    plain, kept = M.run_model(df), M.run_model_cached(df, cache)
    assert kept.columns == plain.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    empty = M.run_model_cached(df.limit(0), cache)
    assert empty.collect() == [] and empty.columns == plain.columns


def test_rows_are_computed_once(spark, cache):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def ask(i):
        computed.add(1)
        return f"p{i % 5}"
    df = spark.range(40).select("id", ask.asNondeterministic()("id").alias("prompt"))
    assert len(rows(M.run_model_cached(df, cache))) == 40
    assert computed.value == 40
