"""Exact classification metrics.

Areas are computed from a histogram of distinct scores. Ties get half credit and no
score is binned; running counts are spread over score ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe.functions.search import range_of
from rowscribe.operators.ranking import accumulate_by_order, quantile_bounds
from rowscribe.session import cut_lineage


def score_histogram(
    df: DataFrame, positive: Column, score: Column, by: Sequence[str] = ()
) -> tuple[DataFrame, list[tuple]]:
    """(by..., score, pos, neg), rows per distinct score, and bounds that cut the scores
    into ranges. The bounds come from a sketch over the rows, so that the histogram is
    computed once only."""
    rows = _score_rows(df, positive, score, by)
    return _counted(rows, by), quantile_bounds(rows, "score")


def stored_histogram(
    df: DataFrame, positive: Column, score: Column, by: Sequence[str] = ()
) -> tuple[DataFrame, list[tuple]]:
    """The same from one pass over the rows, for rows that are costly to make: the histogram
    is written once, and the bounds come from its scores, which are what the ranges hold."""
    histogram = cut_lineage(_counted(_score_rows(df, positive, score, by), by), "histogram")
    return histogram, quantile_bounds(histogram, "score")


def _score_rows(df: DataFrame, positive: Column, score: Column, by: Sequence[str]) -> DataFrame:
    return df.select(
        *by, positive.cast("boolean").alias("_p"), score.cast("double").alias("score")
    )


def _counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "score").agg(
        F.sum(F.when(F.col("_p"), 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("_p"), 0).otherwise(1)).cast("bigint").alias("neg"),
    )


def _score_range(bounds: list[tuple]) -> Column:
    return range_of([F.col("score")], bounds, [T.DoubleType()])


def roc_auc_of_histogram(
    histogram: DataFrame, bounds: list[tuple], by: Sequence[str] = (), out: str = "roc_auc"
) -> DataFrame:
    """Area under the ROC curve per group; NULL where a class is empty."""
    steps = accumulate_by_order(
        histogram, ["score"], {"neg_upto": F.col("neg")}, by, _score_range(bounds)
    )
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return steps.groupBy(*by).agg((F.sum(wins) / F.nullif(pairs, F.lit(0.0))).alias(out))


def roc_auc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), out: str = "roc_auc"
) -> DataFrame:
    """Binary ROC AUC of the score of class 1."""
    histogram, bounds = score_histogram(df, F.col(label) == 1, F.col(score), by)
    return roc_auc_of_histogram(histogram, bounds, by, out)


def class_scores(df: DataFrame, label: str, probabilities: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per class: (by..., class, is_class, score)."""
    # an inner unnesting adds a filter on the size of the list, which makes the list again
    unnested = df.select(*by, F.col(label).alias("_l"), F.posexplode_outer(probabilities))
    return unnested.where(F.col("pos").isNotNull()).select(
        *by,
        F.col("pos").alias("class"),
        (F.col("_l") == F.col("pos")).alias("is_class"),
        F.col("col").alias("score"),
    )


def roc_auc_ovr_classes(
    df: DataFrame, label: str, probabilities: str, by: Sequence[str] = ()
) -> DataFrame:
    """One-vs-rest ROC AUC of every class."""
    long = class_scores(df, label, probabilities, by)
    keys = [*by, "class"]
    histogram, bounds = stored_histogram(long, F.col("is_class"), F.col("score"), keys)
    return roc_auc_of_histogram(histogram, bounds, keys)


def roc_auc_ovr(
    df: DataFrame, label: str, probabilities: str, by: Sequence[str] = ()
) -> DataFrame:
    """One-vs-rest ROC AUC, plain mean over classes."""
    return roc_auc_ovr_classes(df, label, probabilities, by).groupBy(*by).agg(
        F.avg("roc_auc").alias("roc_auc_ovr")
    )


def roc_auc_ovo(
    df: DataFrame, label: str, probabilities: str, by: Sequence[str] = ()
) -> DataFrame:
    """One-vs-one ROC AUC, mean over ordered pairs of classes.

    A row of class l meets every other class once as a positive (with its own score)
    and once as a negative: 2(L-1) entries for L classes, merged by the histogram.
    """
    own = F.element_at(F.col(probabilities), F.col("_l") + 1)
    meets = df.select(*by, F.col(label).cast("int").alias("_l"), probabilities).select(
        *by, "_l", own.alias("_own"), F.posexplode_outer(probabilities)
    ).where(F.col("pos") != F.col("_l"))
    entries = meets.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("_l").alias("class"), F.col("pos").alias("against"),
                    F.lit(True).alias("is_class"), F.col("_own").alias("score"),
                ),
                F.struct(
                    F.col("pos").alias("class"), F.col("_l").alias("against"),
                    F.lit(False).alias("is_class"), F.col("col").alias("score"),
                ),
            )
        ).alias("e"),
    ).select(*by, "e.*")
    keys = [*by, "class", "against"]
    histogram, bounds = stored_histogram(entries, F.col("is_class"), F.col("score"), keys)
    pairs = roc_auc_of_histogram(histogram, bounds, keys)
    return pairs.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc_ovo"))


def pr_curve(histogram: DataFrame, bounds: list[tuple], by: Sequence[str] = ()) -> DataFrame:
    """Histogram with true positives and all rows from the highest score downwards."""
    falling = histogram.withColumn("_falling", -F.col("score"))
    return accumulate_by_order(
        falling,
        ["_falling"],
        {"tp": F.col("pos"), "taken": F.col("pos") + F.col("neg")},
        by,
        F.lit(len(bounds)) - _score_range(bounds),
    ).drop("_falling")


def pr_auc_of_histogram(
    histogram: DataFrame, bounds: list[tuple], by: Sequence[str] = (), out: str = "pr_auc"
) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from (recall 0, precision 1)."""
    steps = pr_curve(histogram, bounds, by)
    precision = F.col("tp") / F.col("taken")
    taken_before = F.col("taken") - F.col("pos") - F.col("neg")
    before = F.when(taken_before == 0, F.lit(1.0)).otherwise(
        (F.col("tp") - F.col("pos")) / F.nullif(taken_before, F.lit(0))
    )
    area = F.sum(F.col("pos") * (precision + before) / 2)
    return steps.groupBy(*by).agg(
        (area / F.nullif(F.sum("pos"), F.lit(0))).alias(out)
    )


def pr_auc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), out: str = "pr_auc"
) -> DataFrame:
    """The same of the score of class 1."""
    return pr_auc_of_histogram(*score_histogram(df, F.col(label) == 1, F.col(score), by), by, out)


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, prediction, n): at most one row per pair of classes."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy_f1(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, micro_f1, macro_f1 and num per group. Classes are those that occur as a
    label or as a prediction."""
    cells = confusion(df, label, prediction, by)
    hit = F.col("label") == F.col("prediction")
    parts = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("real"),
                    F.lit(0).cast("bigint").alias("said"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("real"),
                    F.col("n").alias("said"),
                ),
            )
        ).alias("c"),
    ).select(*by, "c.*")
    classes = parts.groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said")
    )
    f1 = 2 * F.col("tp") / F.nullif(F.col("real") + F.col("said"), F.lit(0))
    total = classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("real")).alias("accuracy"),
        (2 * F.sum("tp") / (F.sum("real") + F.sum("said"))).alias("micro_f1"),
        F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"),
        F.sum("real").alias("num"),
    )
    return total


def is_binary(df: DataFrame, label: str) -> Column:
    """Whether all labels are 0 or 1, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(F.col(label)) <= 1, F.lit(True)).alias("b")).scalar()


def metric_record(
    df: DataFrame, label: str, prediction: str, probabilities: str, n_labels: int,
    logs: Sequence[str] = (),
) -> DataFrame:
    """One row of metrics, as an evaluation run reports it. Two labels give AUC and PR;
    more give the one-vs-rest and one-vs-one areas. ``logs`` are columns to average."""
    if n_labels == 2:
        # Both areas read one histogram.
        positive = F.element_at(F.col(probabilities), 2)
        histogram, bounds = stored_histogram(df, F.col(label) == 1, positive)
        areas = {
            "AUC": roc_auc_of_histogram(histogram, bounds).scalar(),
            "PR": pr_auc_of_histogram(histogram, bounds).scalar(),
        }
    else:
        areas = {
            "AUC": roc_auc_ovr(df, label, probabilities).scalar(),
            "AUC_ovo": roc_auc_ovo(df, label, probabilities).scalar(),
        }
    means = df.agg(*[F.avg(c).alias(c) for c in logs]) if logs else None
    record = accuracy_f1(df, label, prediction).select(
        *[expr.alias(name) for name, expr in areas.items()],
        "micro_f1", "macro_f1", "accuracy", "num",
        *[means.select(c).scalar().alias(c) for c in logs],
    )
    return record


def record_json(record: DataFrame) -> DataFrame:
    """The record as one JSON text column."""
    return record.select(F.to_json(F.struct("*")).alias("value"))
