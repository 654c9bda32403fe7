"""Read model answers: token log-probabilities, probability lists, stored outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.functions.arrays import normalised

# The answer tokens of the two-way and the four-way question.
YES_TOKEN, NO_TOKEN = " Yes", " No"
CAR_TOKENS = (" Un", " Accept", " Good", " Very")


def top_logprobs(response: Column) -> Column:
    """The token -> log-probability map of a JSON object."""
    return F.from_json(response, "map<string,double>")


def token_probability(logprobs: Column, token: str) -> Column:
    """exp of the token's log-probability, 0 where the token is absent."""
    return F.coalesce(F.exp(F.try_element_at(logprobs, F.lit(token))), F.lit(0.0))


def yes_probability(logprobs: Column, yes: str = YES_TOKEN, no: str = NO_TOKEN) -> Column:
    """P(yes) among yes and no; one half where both are absent."""
    p_yes, p_no = token_probability(logprobs, yes), token_probability(logprobs, no)
    total = p_yes + p_no
    return F.when(total == 0, F.lit(0.5)).otherwise(p_yes / F.nullif(total, F.lit(0.0)))


def token_probabilities(logprobs: Column, tokens: Sequence[str] = CAR_TOKENS) -> Column:
    """One probability per token, in order, not normalised."""
    return F.array(*[token_probability(logprobs, t) for t in tokens])


def probability_list(text: Column) -> Column:
    """'0.1, 0.3' as an array that sums to one."""
    return normalised(F.transform(F.split(text, ", "), lambda p: p.cast("double")))


def attach_outputs(df: DataFrame, outputs: DataFrame, key: str, n_labels: int = 2) -> DataFrame:
    """Join stored answers (key, output0) and parse them: one number for two labels, a
    list for more. The column is ``probabilities``. A row without an answer is an error."""
    parsed = (
        F.array(1 - F.col("output0").cast("double"), F.col("output0").cast("double"))
        if n_labels == 2
        else probability_list(F.col("output0"))
    )
    answers = outputs.select(key, parsed.alias("probabilities"), F.lit(True).alias("_answered"))
    missing = F.raise_error(F.concat(F.lit("no answer for "), F.col(key).cast("string")))
    found = F.when(F.col("_answered"), F.col("probabilities")).otherwise(missing)
    return df.join(answers, key, "left").withColumn("probabilities", found).drop("_answered")
