"""Prompts: template selection, rendering, targets and requests for external scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe import phrasebook as P
from rowscribe.functions.hashing import pick
from rowscribe.functions.text import strip
from rowscribe.operators.template import NoteTemplate

CHOICE_SEPARATOR = r"\s*\|\|\|\s*"

# What stands for a side of a prompt that is empty, and for no label.
NO_LABEL = "<NO LABEL>"
NO_INPUT = "<NO INPUT>"
UNLABELED = "Unlabeled"


def answer_choices(choices: Column | str) -> Column:
    """'No ||| Yes' as an array."""
    text = choices if isinstance(choices, Column) else F.lit(choices)
    return F.split(strip(text), CHOICE_SEPARATOR)


def answer_of(choices: Column, label: Column) -> Column:
    """The choice of a zero-based label; -1 is unlabelled."""
    return F.when(label == -1, F.lit(UNLABELED)).otherwise(
        F.element_at(choices, label.cast("int") + 1)
    )


def render_prompt(
    df: DataFrame, question: str, choices: str, note: str = "note", label: str = "label"
) -> DataFrame:
    """Add ``prompt`` and ``answer``: the note, the question, and the label's choice."""
    sides = {"note": F.col(note), "question": F.lit(question)}
    prompt = F.concat(
        *[
            F.lit(value) if kind == "text" else sides[value]
            for kind, value in NoteTemplate(P.PROMPT_SHAPE).parts()
        ]
    )
    return df.withColumn("prompt", strip(prompt)).withColumn(
        "answer", answer_of(answer_choices(choices), F.col(label))
    )


def template_catalogue(spark: SparkSession, tasks: Sequence[str] | None = None) -> DataFrame:
    """The prompt templates as rows: task, template_name, question, choices, position,
    original_task."""
    rows = [
        (task, name, question, choices, 0, True)
        for task, (name, question, choices) in P.PROMPTS.items()
        if tasks is None or task in tasks
    ]
    return spark.createDataFrame(
        rows,
        "task string, template_name string, question string, choices string, "
        "position int, original_task boolean",
    ).withColumn("choices", answer_choices(F.col("choices")))


def select_templates(catalogue: DataFrame, index: int, first: int | None = None) -> DataFrame:
    """Templates by number: n picks one, -1 those of the original task, -2 all.
    ``first`` keeps the first templates of a -1 or -2 choice."""
    if index >= 0:
        return catalogue.where(F.col("position") == index)
    if index not in (-1, -2):
        raise ValueError("index must be a position, -1 or -2")
    chosen = catalogue.where(F.col("original_task")) if index == -1 else catalogue
    if first is None:
        return chosen
    order = Window.partitionBy("task").orderBy("position")
    return chosen.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= first).drop("_at")


def attach_template(df: DataFrame, catalogue: DataFrame, task: str = "task") -> DataFrame:
    """Join the templates of each row's task."""
    return df.join(catalogue.withColumnRenamed("task", task), task)


def all_templates(df: DataFrame, templates: Sequence[Mapping[str, str]], out: str = "template") -> DataFrame:
    """Every row once per template, as a struct column."""
    return df.withColumn(out, F.explode(_template_array(templates)))


def random_template(
    df: DataFrame, templates: Sequence[Mapping[str, str]], seed, key: str, out: str = "template"
) -> DataFrame:
    """One template per row, chosen by the hash of seed and key."""
    number = pick(len(templates), seed, "template", F.col(key)).cast("int") + 1
    return df.withColumn(out, F.element_at(_template_array(templates), number))


def _template_array(templates: Sequence[Mapping[str, str]]) -> Column:
    return F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in templates]
    )


def label_options(choices: Sequence[str], style: str | None) -> str:
    """The possible labels as the instruction states them."""
    if style == "comma":
        return " Possible labels: " + ", ".join(choices)
    if style == "newline":
        return "\nPossible labels:\n" + "\n".join(
            f"{number}. {choice}" for number, choice in enumerate(choices, 1)
        )
    if style is None:
        return ""
    raise ValueError(f"unknown style {style!r}")


def clean_choice(choice: Column) -> Column:
    """A choice label in plain words."""
    return F.replace(F.replace(choice, F.lit("_"), F.lit(" ")), F.lit(". "), F.lit(" "))


def field_prompt(
    instruction: str, fields: Sequence[str], choices: Sequence[str] = (), options: str | None = None
) -> Column:
    """Instruction, one 'name: value' line per present field, and a final 'Label:'."""
    lines = [F.lit(instruction.strip() + label_options(choices, options))]
    for name in fields:
        value = strip(F.col(name).cast("string"))
        lines.append(F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value)))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\nLabel:"))


def filled_sides(prompt: Column, target: Column) -> tuple[Column, Column]:
    """Placeholders for an empty target, and for a prompt that is missing altogether."""
    return (
        F.coalesce(prompt, F.lit(NO_INPUT)),
        F.when(prompt.isNull(), F.lit(NO_LABEL)).otherwise(
            F.coalesce(F.nullif(target, F.lit("")), F.lit(NO_LABEL))
        ),
    )


def json_escaped(text: Column) -> Column:
    """The text as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("t")))  # {"t":"..."}
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


# The decoding settings of a scoring request.
REQUEST_SETTINGS = {"temperature": 0, "max_tokens": 1, "logprobs": 50}


def request_table(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """One request per row, as JSON, for an external scorer to pick up."""
    return df.select(key, request_of(F.col(prompt)).alias("request"))


def request_of(prompt: Column) -> Column:
    """A scoring request as JSON."""
    settings = [F.lit(v).alias(k) for k, v in REQUEST_SETTINGS.items()]
    return F.to_json(F.struct(strip(prompt).alias("prompt"), *settings))


def output_records(df: DataFrame, prompts: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """The row with its prompts and outputs numbered prompt0, output0, ..."""
    numbered = {f"prompt{i}": F.col(c) for i, c in enumerate(prompts)}
    numbered |= {f"output{i}": F.col(c) for i, c in enumerate(outputs)}
    return df.withColumns(numbered)
