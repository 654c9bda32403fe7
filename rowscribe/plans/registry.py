"""The query registry, and helpers to write the matching SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowscribe.functions.text import CLEANING_STEPS, DOT_RUN, KEPT_ELLIPSIS, WS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "serialization", "labelling", "prompting", "sampling", "features", "scoring",
    "timelines", "storage", "evaluation", "loading",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL of the same result where SQL can state it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"rowscribe.plans.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table. A file of one row group is read by one task."""
    return table(spark, sf_dir, name).select(*columns)


# --- SQL text -----------------------------------------------------------------------


def sql_hash(*parts: object) -> str:
    """md5 of the parts joined by '-'. Strings in quotes are literals, others SQL."""
    return f"md5(concat_ws('-', {', '.join(str(p) for p in parts)}))"


def sql_hash_int(*parts: object) -> str:
    return f"('0x' || substr({sql_hash(*parts)}, 1, 15))::BIGINT"


def sql_uniform(*parts: object) -> str:
    return f"({sql_hash_int(*parts)} / 1152921504606846976.0::DOUBLE)"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def sql_clean(expr: str) -> str:
    """The cleaning steps of a note as nested calls."""
    for pattern, replacement in CLEANING_STEPS:
        plain = replacement.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        expr = f"regexp_replace({expr}, '{pattern}', '{plain}', 'g')"
    return (
        f"(SELECT CASE WHEN contains(t, '{KEPT_ELLIPSIS}') THEN t "
        f"ELSE regexp_replace(t, '{DOT_RUN}', '. ', 'g') END FROM (SELECT {expr} AS t))"
    )
