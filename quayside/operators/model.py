"""Batch model calls (T13) and reply parsing.

``run_model`` sends a prompt column through a backend in Arrow batches with
``mapInPandas`` (iterator form: one backend instance per task, reused for
every batch).  No network and no hosted model: the default backend is a
deterministic rule that answers from the prompt itself, so results repeat.
A real client can be plugged in by passing another ``backend`` factory.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_fence
from ..session import ensure_checkpoint_dir


class RuleBackend:
    """Deterministic stand-in for a text model.

    * prompts that begin with ``Redact names:`` get the text with every known name (the
      quoted list in the first line) replaced;
    * prompts containing a ``Mechanical recommendation:`` line get a JSON
      reply ``{"diagnosis", "recommended_action"}`` built from that line;
    * other prompts get ``{"reply": <first line of the prompt>}``.
    """

    name = "rules"
    DIAGNOSIS = ("Billed amount differs from the contracted position; correcting it "
                 "avoids revenue leakage.")
    REDACT = "Redact names: "
    _mech = re.compile(r"Mechanical recommendation:\s*(.*)")

    def __call__(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(self._one)

    def _one(self, p):
        if p is None:
            return None
        if p.startswith(self.REDACT):
            first, _, text = p.partition("\n")
            for name in sorted(json.loads(first[len(self.REDACT):]), key=len, reverse=True):
                text = text.replace(name, "[REDACTED]")
            return json.dumps({"reply": text})
        m = self._mech.search(p)
        if m:
            act = m.group(1).strip()
            return json.dumps({"diagnosis": self.DIAGNOSIS, "recommended_action": act})
        return json.dumps({"reply": p.strip().split("\n", 1)[0]})


def _one_reply(model, prompt) -> tuple[str | None, str | None]:
    """(reply, error) for a single prompt."""
    try:
        return model(pd.Series([prompt], dtype=object)).iloc[0], None
    except Exception as e:  # noqa: BLE001 - reported in the row
        return None, f"{type(e).__name__}: {e}"


def run_model(df: DataFrame, prompt_col: str = "prompt",
              backend: Callable[[], Callable[[pd.Series], pd.Series]] = RuleBackend,
              out_col: str = "reply") -> DataFrame:
    """Append ``reply`` and ``model_error`` columns computed by ``backend``."""
    schema = T.StructType(df.schema.fields + [
        T.StructField(out_col, T.StringType()), T.StructField("model_error", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for pdf in batches:
            try:
                pdf[out_col], pdf["model_error"] = model(pdf[prompt_col]), None
            except Exception:  # noqa: BLE001 - find the prompts that fail, one by one
                answers = [_one_reply(model, p) for p in pdf[prompt_col]]
                pdf[out_col] = pd.Series([a for a, _ in answers], index=pdf.index, dtype=object)
                pdf["model_error"] = pd.Series([e for _, e in answers], index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(call, schema)


CACHE_SCHEMA = "digest string, reply string, model_error string"


def _replies(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder of replies on any file system; none if there is no such folder."""
    try:
        return spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def run_model_cached(df: DataFrame, cache: str, prompt_col: str = "prompt",
                     backend: Callable[[], Callable[[pd.Series], pd.Series]] = RuleBackend,
                     model: str | None = None, out_col: str = "reply") -> DataFrame:
    """As ``run_model``, but a prompt that ``model`` has answered before is not asked again,
    and equal prompts are asked once.

    Replies are kept in the folder ``cache`` under the digest of model name and prompt; each
    run adds a folder of its own when its calls are done, so a run that fails leaves
    nothing and two runs at a time do no harm (the smaller of two replies to a prompt
    counts).  Failed calls are stored for this run's rows only and asked again by the
    next run.  A NULL prompt is not asked: reply and error are NULL.  ``df`` is computed
    once and stored in the shared checkpoint folder, and read from there, once for the
    different prompts and once for the rows."""
    spark = df.sparkSession
    name = model or getattr(backend, "name", "model")
    digest = F.sha2(F.concat(F.lit(name), F.lit("\n"), F.col(prompt_col)), 256)
    rows = f"{ensure_checkpoint_dir(spark).rstrip('/')}/prompts-{uuid.uuid4().hex}"
    df.withColumn("_digest", digest).write.parquet(rows)
    df = spark.read.parquet(rows)
    known = _replies(spark, cache).filter(F.col("model_error").isNull()).select("digest").distinct()
    prompts = df.filter(F.col(prompt_col).isNotNull()) \
        .select(F.col("_digest").alias("digest"), F.col(prompt_col).alias("prompt")).distinct()
    folder = f"{cache.rstrip('/')}/run-{uuid.uuid4().hex}"
    # stored before anything reads them: a lost task does not ask again what others were told
    run_model(prompts.join(known, "digest", "left_anti"), "prompt", backend) \
        .select("digest", "reply", "model_error").write.parquet(folder)
    answered = _replies(spark, cache).filter(F.col("model_error").isNull()).groupBy("digest").agg(
        F.min("reply").alias("reply"), F.lit(None).cast("string").alias("model_error"))
    failed = _replies(spark, folder).filter(F.col("model_error").isNotNull()).join(
        answered.select("digest"), "digest", "left_anti")
    replies = answered.unionByName(failed).withColumnsRenamed({"digest": "_digest", "reply": out_col})
    return df.join(replies, "_digest", "left").drop("_digest")


def parse_reply(reply_col: str, schema: str) -> F.Column:
    """Strip a code fence and parse JSON; malformed JSON gives NULL
    (the reference raises) - callers keep the raw reply for the audit log."""
    return F.from_json(strip_fence(reply_col), schema)
