"""Serialize table rows as notes, cut notes into pieces and put pieces together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.functions.arrays import ordered_join
from rowscribe.functions.text import clean_notes, strip
from rowscribe.operators.template import (
    ColumnFn,
    NoteTemplate,
    list_template,
    permute_features,
    sentence_template,
    values_template,
)

STYLES = ("text", "list", "values", "permuted")


def feature_template(
    features: Sequence[tuple[str, str]],
    style: str = "text",
    pre: Mapping[str, ColumnFn] | None = None,
    permutation: Sequence[int] | None = None,
) -> NoteTemplate:
    """The template of a serialization style over ordered (column, display name) pairs."""
    if style == "text":
        text = sentence_template(features)
    elif style == "list":
        text = list_template(features)
    elif style == "values":
        text = values_template(features)
    elif style == "permuted":
        if permutation is None:
            raise ValueError("style 'permuted' needs a permutation")
        text = list_template(permute_features(features, permutation))
    else:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(STYLES)}")
    return NoteTemplate(text, pre=pre or {})


def serialize(df: DataFrame, template: NoteTemplate, out: str = "note") -> DataFrame:
    """Add the cleaned note of every row."""
    return clean_notes(df, template.render(df), out)


def importance_rows(
    df: DataFrame,
    key: str,
    features: Sequence[tuple[str, str]],
    pre: Mapping[str, ColumnFn],
    explained: DataFrame,
) -> DataFrame:
    """key, note, features, values: the list note of every row beside its explanation
    features, (key, feature, value) rows, in the order of their names."""
    notes = serialize(df, feature_template(features, "list", pre)).select(key, "note")
    pairs = F.sort_array(F.collect_list(F.struct("feature", "value")))
    own = explained.groupBy(key).agg(pairs.alias("_pairs"))
    return notes.join(own, key, "left").select(
        key, "note", F.col("_pairs.feature").alias("features"), F.col("_pairs.value").alias("values")
    )


# Fixed value: a list line of a note is "- name: value", the value without a colon.
LIST_LINE = r"(?m)^- (.*):([^:]*)$"


def name_value_pairs(note: Column) -> Column:
    """The (name, value) pairs of a list note, in order, both trimmed."""
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(note, F.lit(LIST_LINE), F.lit(1)).alias("name"),
            F.regexp_extract_all(note, F.lit(LIST_LINE), F.lit(2)).alias("value"),
        ),
        lambda p: F.struct(
            strip(p["name"]).alias("name"), strip(p["value"]).alias("value")
        ),
    )


def explode_pairs(df: DataFrame, note: str, keys: Sequence[str]) -> DataFrame:
    """One row per (name, value) pair; ``pos`` keeps the order within a row."""
    return df.select(
        *keys, F.posexplode(name_value_pairs(F.col(note))).alias("pos", "pair")
    ).select(*keys, "pos", F.col("pair.name").alias("name"), F.col("pair.value").alias("value"))


# The request around two list lines.
CHUNK_PREFIX = "Write this information as a sentence: "
CHUNK_SUFFIX = ". \n"


def chunk_pairs(note: Column, per_chunk: int = 2) -> Column:
    """Requests over ``per_chunk`` list lines each, the line marks removed."""
    names = F.regexp_extract_all(note, F.lit(LIST_LINE), F.lit(1))
    lines = F.transform(
        F.slice(F.split(note, "\n"), 1, F.size(names)),
        lambda line: F.substring(line, 3, 2147483647),
    )
    starts = F.when(
        F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(per_chunk))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda at: F.concat(
            F.lit(CHUNK_PREFIX),
            F.array_join(F.slice(lines, at, F.lit(per_chunk)), ", "),
            F.lit(CHUNK_SUFFIX),
        ),
    )


def explode_chunks(df: DataFrame, note: str, keys: Sequence[str], per_chunk: int = 2) -> DataFrame:
    """One row per request; ``pos`` keeps the order within a row."""
    return df.select(
        *keys, F.posexplode(chunk_pairs(F.col(note), per_chunk)).alias("pos", "chunk")
    )


def regroup(df: DataFrame, keys: Sequence[str], pos: str, text: str, out: str = "note") -> DataFrame:
    """Join the pieces of each row again, in order, with a blank.

    A group is the pieces of one row: as many as the row has features.
    """
    return df.groupBy(*keys).agg(
        ordered_join(
            F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))), " "
        ).alias(out)
    )


def generated_between_tags(text: Column) -> Column:
    """The text before the last closing tag of a generated string, on one line."""
    pieces = F.split(text, ">")
    body = F.when(F.size(pieces) >= 2, F.element_at(pieces, -2))
    return strip(F.replace(F.substring_index(body, "<", 1), F.lit("\n"), F.lit(" ")))


def generated_inside_marks(text: Column, start: int = 6, end: int = 4) -> Column:
    """Drop a start mark of 6 and an end mark of 4 characters."""
    return F.substring(text, F.lit(start + 1), F.greatest(F.length(text) - start - end, F.lit(0)))
