"""Rules of known benchmark tasks: where the label comes from, how splits are named, and
how many templates count."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.operators.splits import ROUND_ROUTES, STORY_ROUTES, route_split


@dataclass(frozen=True)
class TaskRule:
    """How rows of a task are read. ``label`` builds the zero-based label column;
    ``multi_field`` tasks are prompted from several text fields."""

    stored_as: tuple[str, ...]
    label: Callable[[], Column] = field(default=lambda: F.col("label").cast("int"))
    routes: Mapping[str, str] = field(default_factory=dict)
    split_suffix: str = ""
    first_templates: int | None = None
    multi_field: bool = False


def _one_based(column: str) -> Callable[[], Column]:
    return lambda: F.col(column).cast("int") - 1


def _round(number: int) -> TaskRule:
    return TaskRule(("anli",), routes=ROUND_ROUTES, split_suffix=f"_r{number}")


# The tasks, the tables they are stored in, and their label columns.
MULTI_FIELD_TASKS = (
    "ade_corpus_v2", "banking_77", "terms_of_service", "tai_safety_research",
    "neurips_impact_statement_risks", "overruling", "systematic_review_inclusion",
    "one_stop_english", "tweet_eval_hate", "twitter_complaints", "semiconductor_org_types",
)
TASK_RULES: dict[str, TaskRule] = {
    "rte": TaskRule(("super_glue", "rte")),
    "cb": TaskRule(("super_glue", "cb")),
    "wic": TaskRule(("super_glue", "wic")),
    "wsc": TaskRule(("super_glue", "wsc.fixed")),
    "copa": TaskRule(("super_glue", "copa"), first_templates=8),
    "h-swag": TaskRule(("hellaswag",)),
    "storycloze": TaskRule(
        ("story_cloze", "2016"), _one_based("answer_right_ending"), routes=STORY_ROUTES
    ),
    "winogrande": TaskRule(("winogrande", "winogrande_xl"), _one_based("answer")),
    "anli-r1": _round(1),
    "anli-r2": _round(2),
    "anli-r3": _round(3),
    **{
        name: TaskRule(
            ("raft", name), _one_based("Label"), routes={"validation": "test"}, multi_field=True
        )
        for name in MULTI_FIELD_TASKS
    },
}


def task_rule(name: str, num_shot: int | str | None = None) -> TaskRule | None:
    """The rule of a task: by its name, or by its name without a '_<shots>' ending. None
    stands for a serialized table, which needs no rule."""
    if name in TASK_RULES:
        return TASK_RULES[name]
    return TASK_RULES.get(name.split(f"_{num_shot}")[0]) if num_shot is not None else None


def read_task(df: DataFrame, rule: TaskRule, split: str, key: str | None = None) -> DataFrame:
    """Rows of the asked split with their label. ``df`` has a ``split`` column with the
    names under which splits are stored; ``key`` becomes ``idx`` where one is named."""
    stored = route_split(F.lit(split), rule.routes, rule.split_suffix)
    rows = df.where(F.col("split") == stored).withColumn("label", rule.label())
    return rows if key is None else rows.withColumn("idx", F.col(key))
