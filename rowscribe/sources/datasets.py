"""Load a known dataset: read, rename, label, drop, check, key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.operators.sampling import first_after_shuffle
from rowscribe.operators.splits import split_ordered, split_seeded
from rowscribe.sources.tables import add_row_key, in_file_order, read_arff, read_csv
from rowscribe.spec import DatasetSpec, dataset_spec

_PLACE = ["_file", "_block", "_line"]


def read_raw(spark: SparkSession, spec: DatasetSpec, path: str | list[str]) -> DataFrame:
    """The file as it is, with columns that hold each row's place in it."""
    if spec.file_format == "arff":
        return read_arff(spark, path, place=True)
    table = read_csv(
        spark, path, spec.schema, spec.file_format == "csv_header", spec.null_token
    )
    return in_file_order(table)


def check_width(df: DataFrame, spec: DatasetSpec, extra: int = 0) -> DataFrame:
    """Fail early, without a job, where columns are missing or too many."""
    if len(df.columns) - extra != spec.width:
        raise ValueError(f"{spec.name}: {len(df.columns) - extra} columns, expected {spec.width}")
    return df


def label_table(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Renames, drops and the INT label."""
    named = df.withColumnsRenamed(dict(spec.renames)).drop(*spec.drops)
    return named.withColumn("label", spec.label(named))


def load_dataset(
    spark: SparkSession, name: str, path: str | list[str], split: str | None = None, seed: int = 1
) -> DataFrame:
    """A labelled table with a dense ``idx``. ``split`` adds a split column: 'ordered'
    (80/10/10 in file order) or 'seeded' (80/20 by hash)."""
    spec = dataset_spec(name)
    raw = read_raw(spark, spec, path)
    place = [c for c in _PLACE if c in raw.columns]
    table = label_table(raw, spec)
    check_width(table, spec, extra=len(place))
    keyed = add_row_key(table, place).drop(*place)
    if split == "ordered":
        return split_ordered(keyed, "idx")
    if split == "seeded":
        return split_seeded(keyed, "idx", seed)
    return keyed


# Rows a debug run keeps per split.
DEBUG_ROWS = {"train": 10, "validation": 5, "test": 5}


def debug_sample(df: DataFrame, key: str, seed: int, split: str = "split") -> DataFrame:
    """A few rows of every split."""
    parts = [
        first_after_shuffle(df.where(F.col(split) == name), key, seed, rows)
        for name, rows in DEBUG_ROWS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
