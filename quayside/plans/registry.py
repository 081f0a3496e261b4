"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def set_oracle(name: str, oracle: str) -> None:
    """Give a registered query its SQL twin (for twins that need a later definition)."""
    REGISTRY[name].oracle = oracle


def load_all() -> dict[str, Query]:
    from . import (billing, callable, documents, governance, ledger, operations,  # noqa: F401
                   quality, relational, retrieval, watchlist)
    return REGISTRY


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = load_all()[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(Tables(spark, sf_dir))
    run.__name__ = name
    return run
