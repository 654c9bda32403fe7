"""Choice scores from token losses.

Input is a long table with one row per token of each answer choice of each example.
Sums run over (example, choice) with map-side combining, so an example with very many
tokens is reduced before it is shuffled. A group after that holds one row per choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.functions.arrays import array_total


def choice_rows(df: DataFrame, choices: str, keys: Sequence[str]) -> DataFrame:
    """One row per answer choice of each example."""
    return df.select(*keys, F.posexplode(choices).alias("choice", "choice_text"))


def choice_scores(
    tokens: DataFrame,
    keys: Sequence[str],
    choice: str = "choice",
    nll: str = "nll",
    is_pad: str = "is_pad",
    length_norm: float = 0.0,
) -> DataFrame:
    """Sum of the token losses per choice, padding aside; divided by length^p if p > 0."""
    kept = F.when(~F.col(is_pad), F.col(nll)).otherwise(F.lit(0.0))
    length = F.sum(F.when(~F.col(is_pad), 1).otherwise(0))
    score = F.sum(kept)
    if length_norm > 0:
        score = score / F.nullif(F.pow(length.cast("double"), F.lit(length_norm)), F.lit(0.0))
    return tokens.groupBy(*keys, choice).agg(score.alias("score"), length.alias("length"))


def predict(scores: DataFrame, keys: Sequence[str], label: str, choice: str = "choice") -> DataFrame:
    """One row per example: prediction (lowest score, first of equals), pseudo
    probabilities per choice, score of the gold choice and of its best rival.

    ``label`` is one of ``keys``. With a single choice the rival is the gold itself.
    """
    listed = scores.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(choice).alias("choice"), "score"))).alias("_s"),
        F.min(F.struct("score", F.col(choice).alias("choice"))).alias("_best"),
        F.max(F.when(F.col(choice) == F.col(label), F.col("score"))).alias("score_gt"),
        F.min(F.when(F.col(choice) != F.col(label), F.col("score"))).alias("_rival"),
        F.max("score").alias("_worst"),
    )
    weights = F.transform(F.col("_s"), lambda s: F.exp(-s["score"]))
    total = array_total(weights)
    return listed.select(
        *keys,
        F.col("_best.choice").alias("prediction"),
        F.transform(weights, lambda w: w / total).alias("probabilities"),
        "score_gt",
        F.coalesce("_rival", "_worst").alias("score_cand"),
    )


def loss_terms(
    tokens: DataFrame,
    scores: DataFrame,
    keys: Sequence[str],
    label: str,
    choice: str = "choice",
    nll: str = "nll",
    is_pad: str = "is_pad",
) -> DataFrame:
    """One row: mean token loss of the gold choice, mean softmax loss over choices, and
    mean unlikelihood of the tokens of the other choices.

    Masked tokens (gold or padding) add their constant term to the unlikelihood sum but
    do not count in its divisor.
    """
    gold = (F.col(choice) == F.col(label)) & ~F.col(is_pad)
    other = (F.col(choice) != F.col(label)) & ~F.col(is_pad)
    log_likelihood = F.when(other, -F.col(nll)).otherwise(F.lit(MASKED))
    unlikely = -F.log(F.lit(1.0) - F.exp(log_likelihood) + F.lit(SMOOTHING))
    by_token = tokens.agg(
        F.avg(F.when(gold, F.col(nll))).alias("lm_loss"),
        (F.sum(unlikely) / F.sum(other.cast("int"))).alias("unlikely_loss"),
    )
    per_example = scores.groupBy(*keys).agg(
        (
            F.log(F.sum(F.exp(-F.col("score"))))
            + F.max(F.when(F.col(choice) == F.col(label), F.col("score")))
        ).alias("_mc")
    )
    mc = per_example.agg(F.avg("_mc").alias("mc_loss")).scalar()
    return by_token.withColumn("mc_loss", mc)


# Log-likelihood of a masked token, and the term that keeps the logarithm
# finite.
MASKED = -100.0
SMOOTHING = 1e-2
