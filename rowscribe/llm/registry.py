"""The queries of this package and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "order_minhash", "cross_polytope", "va_file", "mixing", "language_crf", "rendezvous", "rank_queue_bpe",
    "pii_crf", "html_text", "license_scan", "conversation_trie", "token_alignment", "chunk_recipes",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL of the same result where SQL can state it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"rowscribe.llm.{module}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
