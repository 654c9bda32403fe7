"""Baselines on features: grids of settings, seeds and numbers of shots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscribe.functions.hashing import seeded_hash
from rowscribe.operators import linear
from rowscribe.operators.metrics import accuracy_f1, roc_auc, roc_auc_of_histogram, roc_auc_ovr, stored_histogram
from rowscribe.operators.ranking import number_by_hash
from rowscribe.operators.sampling import few_shot_sample
from rowscribe.operators.splits import fold_count, split_seeds, stratified_folds
from rowscribe.session import cut_lineage

# The numbers of shots and the seeds of the sweep.
SHOTS = (4, 8, 16, 32, 64, 128, 256, 512, "all")
SEEDS = (42, 1024, 0, 1, 32)

FOLDS = 4  # at most; fewer where the smallest class is smaller


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weight n / (L * count) per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    facts = counts.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("l"))
    share = facts.select((F.col("n") / F.col("l")).alias("s")).scalar()
    return df.join(counts, label).withColumn(out, share / F.col("_c")).drop("_c")


def _sample_folds(draws: DataFrame) -> DataFrame:
    """Folds with equal label shares inside every draw; two plain ones where a label was
    drawn once. A draw is as small as its number of shots."""
    cell = Window.partitionBy("seed", "num_shot")
    own = Window.partitionBy("seed", "num_shot", "label")
    numbered = draws.withColumn("_c", F.count(F.lit(1)).over(own)).withColumn("_least", F.min("_c").over(cell))
    inside = F.row_number().over(own.orderBy("draw_no")) - 1
    return numbered.withColumn(
        "fold", F.when(F.col("_least") > 1, F.pmod(inside, F.least("_least", F.lit(FOLDS)))).otherwise(F.pmod("draw_no", F.lit(2))).cast("int")
    ).drop("_c", "_least")


def _set_folds(train: DataFrame, rows: DataFrame, key: str, seeds: Sequence[int]) -> DataFrame:
    """(features, label, folds): every training row once, with its fold in the set of each
    seed or -1. Folds have equal label shares; two plain ones where a label has one row."""
    hashed = train.withColumn("_h", seeded_hash(F.col("seed"), "fold", F.col(key)))
    counts = train.groupBy("seed", "label").count().groupBy("seed").agg(F.min("count").alias("_least"))
    by_label = number_by_hash(hashed, "_h", "_rn", [key], ["seed", "label"])
    plain = number_by_hash(hashed, "_h", "_all", [key], ["seed"]).select("seed", key, "_all")
    numbered = by_label.join(plain, ["seed", key]).join(counts, "seed")
    fold = F.when(F.col("_least") > 1, F.pmod(F.col("_rn") - 1, F.least("_least", F.lit(FOLDS)))).otherwise(F.pmod(F.col("_all") - 1, F.lit(2)))
    own = [F.coalesce(F.max(F.when(F.col("seed") == s, fold)), F.lit(-1)).cast("int") for s in seeds]
    folds = numbered.groupBy(key).agg(F.array(*own).alias("folds"))
    return rows.join(folds, key).select("features", "label", "folds")


def sweep(
    rows: DataFrame,
    key: str,
    n_labels: int = 2,
    shots: Sequence[int | str] = SHOTS,
    seeds: Sequence[int] = SEEDS,
    grid: Sequence[tuple[float, str]] = (),
) -> DataFrame:
    """Logistic regressions on (key, features, label). One row per seed and number of shots:
    the setting chosen by cross-validation on the training rows, and the holdout's area and
    accuracy.

    ``features`` is an array of doubles without nulls and ``label`` an integer from 0.
    Draws of a number of shots are fitted side by side, one task each; the sets of 'all'
    shots are fitted together, by scans over all rows.
    """
    split = cut_lineage(split_seeds(rows.select(key, "label"), key, seeds), "sweep-split")
    train = split.where("split = 'train'").drop("split")
    numbers = [s for s in shots if s != "all"]
    place = {s: i for i, s in enumerate(shots)}
    found = []
    if numbers:
        draws = _sample_folds(few_shot_sample(train, key, "label", numbers, seed_column="seed"))
        # a row drawn twice is two training rows
        samples = draws.withColumnRenamed("draw_no", "order").join(rows.drop("label"), key)
        samples = samples.select("seed", "num_shot", "order", "features", "label", "fold")
        for r in linear.search_samples(samples, ["seed", "num_shot"], n_labels, grid).collect():  # a row per seed and shots
            found.append({**r.asDict(), "num_shot": place[r["num_shot"]]})
    if "all" in shots:
        members = cut_lineage(_set_folds(train, rows, key, seeds), "sweep-rows")
        for seed, r in zip(seeds, linear.search_spread(members, len(seeds), n_labels, grid)):
            found.append({**r, "seed": seed, "num_shot": place["all"]})
    held = split.where("split <> 'train'").select("seed", key).join(rows, key).withColumn("seed", F.col("seed").cast("int"))
    models = {(r["seed"], r["num_shot"]): r.pop("weights") for r in found}
    scored = cut_lineage(linear.scored(held, models, "num_shot", "seed"), "sweep-scores")
    return _with_scores(scored, found, shots, n_labels)


def _with_scores(scored: DataFrame, found: list[dict], shots: Sequence, n_labels: int) -> DataFrame:
    by = ["seed", "num_shot"]
    likely = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
    correct = accuracy_f1(scored.withColumn("prediction", likely), "label", "prediction", by).select(*by, "accuracy", F.col("num").alias("num_test"))
    if n_labels == 2:
        areas = roc_auc(scored.withColumn("_p", F.element_at("probabilities", 2)), "label", "_p", by)
    else:
        areas = roc_auc_ovr(scored, "label", "probabilities", by).withColumnRenamed("roc_auc_ovr", "roc_auc")
    kinds = {str: "string", float: "double", int: "bigint"}
    fields = [c for c in found[0] if c not in by] if found else []
    of = {c: next((type(r[c]) for r in found if r[c] is not None), float) for c in fields}
    schema = "seed int, num_shot int" + "".join(f", {c} {kinds[of[c]]}" for c in fields)
    chosen = scored.sparkSession.createDataFrame([tuple(r[c] for c in (*by, *fields)) for r in found], schema)
    names = F.element_at(F.array(*[F.lit(str(s)) for s in shots]), F.col("num_shot") + 1)
    return chosen.join(correct, by, "left").join(areas, by, "left").withColumn("num_shot", names)


# Depths and learning rates of the boosted baseline.
DEPTHS = (2, 4, 6)
RATES = (0.1, 0.3)
ROUNDS = 10


class OneVsRestAuc(Evaluator):
    """Mean one-vs-rest ROC AUC of the ``probabilities`` column, exact."""

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.withColumn("probabilities", vector_to_array("probability"))
        return float(roc_auc_ovr(scored, "label", "probabilities").first()[0] or 0.0)

    def isLargerBetter(self) -> bool:  # noqa: N802 - name given by MLlib
        return True


def tree_grid(n_labels: int, seed: int = 0, rounds: int = ROUNDS) -> tuple[Estimator, list]:
    """Boosted trees for two labels over depth and learning rate, a forest for more over
    depth. MLlib grows them level by level from histograms of quantised features."""
    if n_labels == 2:
        trees = GBTClassifier(maxIter=rounds, weightCol="weight", seed=seed)
        return trees, ParamGridBuilder().addGrid(trees.maxDepth, list(DEPTHS)).addGrid(trees.stepSize, list(RATES)).build()
    trees = RandomForestClassifier(numTrees=rounds, weightCol="weight", seed=seed)
    return trees, ParamGridBuilder().addGrid(trees.maxDepth, list(DEPTHS)).build()


def tree_search(train: DataFrame, key: str, seed: int, n_labels: int = 2, rounds: int = ROUNDS, parallelism: int = 4):
    """Cross-validated trees on (key, features, label), with balanced weights and stratified
    folds: as many as the smallest class allows, at most ``FOLDS``."""
    folds = max(2, fold_count(train, "label", FOLDS))
    weighted = stratified_folds(balanced_weights(train), key, "label", seed, FOLDS, out="fold").select(
        array_to_vector("features").alias("features"), "label", "weight", "fold"
    )
    weighted = cut_lineage(weighted, "tree-rows")
    estimator, grid = tree_grid(n_labels, seed, rounds)
    # numBins=0: every distinct score is a threshold
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0) if n_labels == 2 else OneVsRestAuc()
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism
    )
    return search.fit(weighted)


def score_holdout(model, holdout: DataFrame, n_labels: int = 2) -> DataFrame:
    """One row: the ROC AUC (one-vs-rest for more than two labels) and the accuracy."""
    scored = model.transform(holdout.withColumn("features", array_to_vector("features")))
    scored = scored.withColumn("probabilities", vector_to_array("probability"))
    if n_labels == 2:
        area = roc_auc(scored.withColumn("_p1", F.element_at("probabilities", 2)), "label", "_p1").scalar()
    else:
        area = roc_auc_ovr(scored, "label", "probabilities").scalar()
    return accuracy_f1(
        scored.withColumn("prediction", F.col("prediction").cast("int")), "label", "prediction"
    ).select(area.alias("roc_auc"), "accuracy", "num")


def zero_shot_score(df: DataFrame, label: str, probabilities: str, n_labels: int = 2) -> DataFrame:
    """ROC AUC of stored probabilities, without a model."""
    if n_labels == 2:
        # stored lists are costly to parse
        likely = F.element_at(F.col(probabilities), 2)
        return roc_auc_of_histogram(*stored_histogram(df, F.col(label) == 1, likely))
    return roc_auc_ovr(df, label, probabilities)
