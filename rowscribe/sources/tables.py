"""Delimited and ARFF tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe.operators.ranking import number_by_order


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    header: bool = False,
    null_token: str | None = None,
) -> DataFrame:
    """CSV with a declared schema, blanks around values trimmed. With ``header`` the
    first line is skipped and the names of the schema count. A value that does not fit
    its type fails the query."""
    reader = (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("mode", "FAILFAST")
    )
    if null_token is not None:
        reader = reader.option("nullValue", null_token)
    return reader.csv(path)


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.trim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def decode_binary(df: DataFrame) -> DataFrame:
    """Binary columns as text."""
    return df.select(
        *[
            F.decode(f.name, "UTF-8").alias(f.name)
            if isinstance(f.dataType, T.BinaryType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


_ATTRIBUTE = re.compile(r"""^@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)
_NUMBERS = ("real", "numeric", "integer")


def arff_schema(lines: list[str]) -> T.StructType:
    """The columns an ARFF head declares: numbers as DOUBLE, the rest as STRING."""
    fields = []
    for line in lines:
        match = _ATTRIBUTE.match(line.strip())
        if match:
            name, kind = match.group(1).strip("'\""), match.group(2).strip().lower()
            number = kind.split()[0] in _NUMBERS
            fields.append(T.StructField(name, T.DoubleType() if number else T.StringType()))
    if not fields:
        raise ValueError("no @attribute lines in the head of the file")
    return T.StructType(fields)


def arff_head(spark: SparkSession, path: str) -> list[str]:
    """The lines before @data. Only the start of the file is read."""
    size = 256
    while True:
        lines = [r[0] for r in spark.read.text(path).take(size)]
        for at, line in enumerate(lines):
            if line.strip().lower().startswith("@data"):
                return lines[:at]
        if len(lines) < size:
            return lines
        size *= 8


def read_arff(
    spark: SparkSession, path: str, head: str | None = None, place: bool = False
) -> DataFrame:
    """A dense ARFF table. ``head`` names the file with the @attribute lines when the
    data lines are spread over several files. ``place`` adds each row's place."""
    schema = arff_schema(arff_head(spark, head or path))
    line = F.trim(F.col("value"))
    is_data = (F.length(line) > 0) & ~line.rlike(r"^[%@]")
    options = {
        "quote": "'",
        "nullValue": "?",
        "mode": "FAILFAST",
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
    }
    parsed = F.from_csv(line, _ddl(schema), options)
    lines = spark.read.text(path)
    rest = _PLACE if place else ()
    lines = in_file_order(lines) if place else lines
    return lines.where(is_data).select(parsed.alias("r"), *rest).select("r.*", *rest)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def arff_head_lines(relation: str, schema: T.StructType) -> list[str]:
    kinds = {
        f.name: "numeric" if isinstance(f.dataType, T.NumericType) else "string"
        for f in schema.fields
    }
    return [
        f"@relation {relation}",
        *[f"@attribute '{name}' {kind}" for name, kind in kinds.items()],
        "@data",
    ]


def write_arff(df: DataFrame, path: str, relation: str) -> None:
    """Head lines in '<path>/head', data lines as text files in '<path>/data'."""
    spark = df.sparkSession
    head = "\n".join(arff_head_lines(relation, df.schema))
    spark.createDataFrame([(head,)], "value string").write.text(f"{path}/head")

    def cell(field: T.StructField) -> Column:
        text = F.col(field.name).cast("string")
        if isinstance(field.dataType, T.StringType):
            text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.coalesce(text, F.lit("?"))

    line = F.concat_ws(",", *[cell(f) for f in df.schema.fields])
    df.select(line.alias("value")).write.text(f"{path}/data")


_PLACE = ("_file", "_block", "_line")


def in_file_order(df: DataFrame) -> DataFrame:
    """Add sortable columns for the place of a row in its file. Use on a file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def add_row_key(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Dense zero-based key along ``order``, kept as it is where the table has one."""
    if out in df.columns:
        return df
    return number_by_order(df, order, "_rn").withColumn(out, F.col("_rn") - 1).drop("_rn")
