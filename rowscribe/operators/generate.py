"""Text models, scorers and tokenizers from outside, as column functions.

The model itself is not part of the library. A caller passes a loader; it runs once per
task, and rows reach the model in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe.operators import linearize as G
from rowscribe.operators import serialize as S

Loader = Callable[[], Callable[[list[str]], list]]


def model_column(load: Loader, result_type: str = "string") -> Callable[[Column], Column]:
    """A column function over text: 'int' for a token counter, 'array<double>' for a
    scorer, 'array<int>' for a tokenizer."""

    @F.pandas_udf(result_type)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.tolist()), index=batch.index)

    return apply


def with_model(df: DataFrame, column: str, out: str, load: Loader) -> DataFrame:
    """Add the model's text for a text column. The rows pass through as Arrow batches, so
    the request is computed before the call and the answer once."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            answers = pa.array(model(batch.column(at).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, answers], names=[*batch.schema.names, out]
            )

    return df.mapInArrow(run, schema)


def notes_from_pairs(df: DataFrame, note: str, keys: Sequence[str], load: Loader) -> DataFrame:
    """List notes rewritten feature by feature: each feature becomes a grid of its name
    over its value, the tagged grid goes to the model, and the answers are joined in the
    order of the features."""
    pairs = S.explode_pairs(df, note, keys)
    marked = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(0)))
    grid = G.feature_grid(F.col("name"), F.col("value"))
    asked = pairs.select(
        *keys, "pos", G.linearize(grid, marked, F.lit(""), F.lit("")).alias("request")
    )
    said = with_model(asked, "request", "answer", load)
    worded = said.select(*keys, "pos", S.generated_between_tags(F.col("answer")).alias("text"))
    return S.regroup(worded, keys, "pos", "text")


def notes_from_chunks(df: DataFrame, note: str, keys: Sequence[str], load: Loader) -> DataFrame:
    """List notes rewritten two features at a time; the answers are joined in order."""
    said = with_model(S.explode_chunks(df, note, keys), "chunk", "answer", load)
    worded = said.select(*keys, "pos", S.generated_inside_marks(F.col("answer")).alias("text"))
    return S.regroup(worded, keys, "pos", "text")
