"""Small tables that steer a run: dictionaries, templates, tasks, field settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.functions.text import short_name, task_name
from rowscribe.operators.sampling import deny
from rowscribe.phrasebook import DENIED_TASKS


def read_dictionary(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object per line as (key, value) rows; keys come as text."""
    return spark.read.text(path).select(
        F.explode(F.from_json("value", "map<string,string>")).alias(key, value)
    )


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """concept_id, value."""
    return read_dictionary(spark, path, "concept_id", "value").withColumn(
        "concept_id", F.col("concept_id").cast("bigint")
    )


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """id, new_id."""
    pairs = read_dictionary(spark, path, "id", "new_id")
    return pairs.select(*[F.col(c).cast("bigint").alias(c) for c in ("id", "new_id")])


def read_short_names(spark: SparkSession, path: str) -> DataFrame:
    """long_name (lower case), short_name (normalised)."""
    pairs = read_dictionary(spark, path, "long_name", "short_name")
    return pairs.select(
        F.lower("long_name").alias("long_name"), short_name(F.col("short_name")).alias("short_name")
    )


TEMPLATE_SCHEMA = (
    "task string, template_name string, question string, choices array<string>, "
    "position int, original_task boolean, metrics array<string>"
)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates as JSON lines."""
    return spark.read.schema(TEMPLATE_SCHEMA).json(path)


TASK_SCHEMA = (
    "HF_name string, subset string, task_by_convention string, do_train string, "
    "do_eval string, train_size string"
)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The task catalogue: an empty subset is absent, train_size a number."""
    raw = spark.read.schema(TASK_SCHEMA).option("header", True).csv(path)
    return raw.withColumns(
        {
            "subset": F.nullif("subset", F.lit("")),
            "train_size": F.coalesce(F.nullif("train_size", F.lit("")).cast("bigint"), F.lit(0)),
        }
    )


def training_tasks(tasks: DataFrame, templates: DataFrame, source: str) -> DataFrame:
    """Templates of the tasks of one training source, with their task names; tasks on the
    deny list are left out. ``templates`` has dataset, subset, template_name."""
    chosen = tasks.where(F.col("do_train") == source).withColumnRenamed("HF_name", "dataset")
    counted = templates.groupBy("dataset", "subset").agg(F.count(F.lit(1)).alias("n_templates"))
    same = lambda a, b: (a["dataset"] == b["dataset"]) & a["subset"].eqNullSafe(b["subset"])
    joined = templates.alias("t").join(
        chosen.alias("c"), same(templates, chosen)
    )
    sized = joined.select("t.*", "c.train_size")
    n = counted.withColumnsRenamed({"dataset": "_d", "subset": "_s"})
    named = (
        sized.join(n, (F.col("dataset") == F.col("_d")) & F.col("subset").eqNullSafe(F.col("_s")))
        .drop("_d", "_s")
        .withColumn("task", task_name(F.col("dataset"), F.col("subset"), F.col("template_name")))
    )
    return deny(named, "task", DENIED_TASKS)


def read_field_settings(spark: SparkSession, path: str) -> DataFrame:
    """Two JSON lines, field order and instructions, as task, fields, instruction."""
    lines = spark.read.text(path)
    as_fields = F.from_json("value", "map<string,array<string>>")
    as_text = F.from_json("value", "map<string,string>")
    is_order = F.col("value").rlike(r'^\s*\{\s*"[^"]*"\s*:\s*\[')
    fields = lines.where(is_order).select(F.explode(as_fields).alias("task", "fields"))
    texts = lines.where(~is_order).select(F.explode(as_text).alias("task", "instruction"))
    return fields.join(texts, "task")
