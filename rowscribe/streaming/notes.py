"""Serialize rows as they arrive and keep what is done so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowscribe.operators.prompts import render_prompt
from rowscribe.operators.serialize import serialize
from rowscribe.operators.template import NoteTemplate


def prompt_stream(
    rows: DataFrame, template: NoteTemplate, question: str, choices: str
) -> DataFrame:
    """Notes, prompts and answers of a stream of labelled rows."""
    return render_prompt(serialize(rows, template), question, choices)


def append_outputs(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to ``path``; ends when the input at hand is done. The
    file sink commits each batch once, also after a restart."""
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
