"""Tables the library writes and reads again: notes, samples, features, scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.functions.arrays import normalised, ordered_join
from rowscribe.operators.report import experiment_key


def write_notes(df: DataFrame, path: str, dataset: str, variant: str) -> None:
    """Serialized rows (idx, note, label and, where given, split) below one path."""
    keep = [c for c in ("idx", "note", "label", "split") if c in df.columns]
    named = df.select(*keep, F.lit(dataset).alias("dataset"), F.lit(variant).alias("variant"))
    named.write.mode("append").partitionBy("dataset", "variant").parquet(path)


def read_notes(
    spark: SparkSession,
    path: str,
    dataset: str,
    variant: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """Notes of a dataset. A variant that was never written is an error. Both filters prune
    folders, the split filter reaches the scan."""
    notes = spark.read.parquet(path).where(F.col("dataset") == dataset)
    if variant is not None:
        notes = notes.where(F.col("variant") == variant)
        if notes.isEmpty():
            raise ValueError(f"no variant {variant!r} of {dataset!r} was written")
    return notes if split is None else notes.where(F.col("split") == split)


def read_or_create(
    spark: SparkSession, path: str, make: Callable[[], DataFrame], schema: str
) -> DataFrame:
    """JSON lines below ``path``; written once from ``make`` where there are none yet, or
    where a write broke off before it left its mark beside the rows."""
    rows, mark = f"{path}/rows", f"{path}/done"
    try:
        done = not spark.read.text(mark).isEmpty()
    except AnalysisException:  # no such folder
        done = False
    if not done:
        make().write.mode("overwrite").json(rows)
        spark.range(1).select(F.lit("done").alias("value")).write.mode("overwrite").text(mark)
    return spark.read.schema(schema).json(rows)


def few_shot_path(root: str, dataset: str, shots: int, seed: int) -> str:
    return f"{root}/dataset={dataset}/num_shot={shots}/seed={seed}"


def write_bundle(
    train: DataFrame, pool: DataFrame, test: DataFrame, path: str, keys: Mapping[str, object]
) -> None:
    """Training rows, unlabelled pool and test rows of one experiment as one table with a
    ``role`` column, in folders by ``keys`` (dataset, num_shot, seed)."""
    parts = {"train": train, "unlab": pool, "test": test}
    tables = [df.withColumn("role", F.lit(role)) for role, df in parts.items()]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    union = union.withColumns({k: F.lit(v) for k, v in keys.items()})
    union.write.mode("append").partitionBy(*keys, "role").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_probabilities(df: DataFrame, path: str, key: str, probabilities: str) -> None:
    """The class probabilities of every example, by key."""
    df.select(key, F.col(probabilities).alias("probabilities")).write.parquet(path)


def write_predictions(
    df: DataFrame, path: str, key: str, prediction: str, choices: Sequence[str]
) -> None:
    """CSV with ID and the text of the predicted label."""
    text = F.element_at(F.array(*[F.lit(c) for c in choices]), F.col(prediction).cast("int") + 1)
    df.select(F.col(key).alias("ID"), text.alias("Label")).write.option("header", True).csv(path)


def append_scores(record: DataFrame, path: str) -> None:
    """Add metric records as JSON lines."""
    record.write.mode("append").json(path)


def last_records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The last JSON line of every experiment folder, with what the folder's name says.

    A folder holds one file that grows, or one file per append. Lines carry their place
    (time of the file, start of the file block, order of reading), and an aggregate keeps
    the last of each folder; no file is loaded as a whole.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("place"),
        "value",
    )
    last = (
        lines.where(F.length(F.trim("value")) > 0)
        .groupBy(F.regexp_replace("file", r"/[^/]*$", "").alias("folder"))
        .agg(F.max_by("value", "place").alias("value"), F.max_by("file", "place").alias("file"))
    )
    return last.select(
        "folder",
        *[c.alias(n) for n, c in experiment_key(F.col("file")).items()],
        F.from_json("value", schema).alias("r"),
    ).select("folder", "model", "dataset", "num_shot", "seed", "spec", "r.*")


def write_summary(grid: DataFrame, path: str) -> None:
    """A result grid as CSV with a header."""
    grid.write.mode("overwrite").option("header", True).csv(path)


def quoted_records(lines: DataFrame) -> DataFrame:
    """(file, value) of CSV records whose quoted fields may span lines, from lines (file,
    block, line, value); the first line of a file is its header and left out.

    A line that starts outside quotes starts a record. Whether a block of a file starts
    inside quotes follows from the number of quotes in the blocks before it, which is a
    table of one row per block; so a file is read by as many tasks as it has blocks. Only
    lines of records that span several are moved to each other.
    """
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("_q", marks)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("file", "block").agg(F.sum("_q").alias("_n"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    upto = F.sum("_q").over(inside) - F.col("_q") + F.col("_before")
    placed = counted.join(blocks, ["file", "block"]).withColumn("_start", upto % 2 == 0)
    placed = placed.withColumn("_row", F.row_number().over(inside)).where((F.col("block") > 0) | (F.col("_row") > 1))
    whole = F.col("_start") & (F.col("_q") % 2 == 0)
    single = placed.where(whole & (F.trim("value") != "")).select("file", "value")
    # Within the rest, a record runs from a start to the line before the next start.
    parts = placed.where(~whole).select("file", "block", "line", "value", "_start")
    own = parts.withColumn("_of", F.last(F.when(F.col("_start"), F.col("line")), True).over(inside))
    last = own.groupBy("file", "block").agg(F.max("_of").alias("_last"))
    carried = last.select("file", "block", F.last("_last", True).over(before).alias("_carried"))
    joined = own.join(carried, ["file", "block"]).withColumn("_of", F.coalesce("_of", "_carried"))
    entry = F.struct(F.col("line").alias("at"), F.col("value").alias("text"))
    several = joined.groupBy("file", "_of").agg(ordered_join(F.collect_list(entry), "\n").alias("value"))
    return single.union(several.select("file", "value"))


def read_outputs(spark: SparkSession, path: str, schema: str = "idx bigint, output0 string") -> DataFrame:
    """Stored model outputs as CSV with a header. Quoted fields may span lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    parsed = F.from_csv("value", schema, {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    return quoted_records(lines).select(parsed.alias("r")).select("r.*")


def write_outputs(df: DataFrame, path: str) -> None:
    """Add output rows as CSV; call once per slice to keep what is done so far."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("append").options(header=True, escape='"', **kept).csv(path)


def normalised_columns(outputs: Column, names: Sequence[str]) -> dict[str, Column]:
    """A probability array as named columns that sum to one."""
    shares = normalised(outputs)
    return {n: F.element_at(shares, i) for i, n in enumerate(names, 1)}
