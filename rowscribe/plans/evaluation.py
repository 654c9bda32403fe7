"""Classifiers on features and few-shot samples. Fits differ in their last digits
between engines; the points here are separable, so that their areas are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscribe.operators import evaluate as V
from rowscribe.operators import report as R
from rowscribe.operators import splits as J
from rowscribe.plans.registry import query, sql_hash, table


def points(spark, sf_dir):
    """Customers in debt or not: one feature tells them apart, the others are weak."""
    rows = table(spark, sf_dir, "customer")
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    flags = [(F.col("c_mktsegment").eqNullSafe(s)).cast("double") / 10 for s in segments]
    debt = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    features = F.array(F.when(debt, 10.0).otherwise(-10.0), F.coalesce(F.col("c_nationkey"), F.lit(0)) / 250, *flags)
    return rows.select("c_custkey", features.alias("features"), debt.cast("int").alias("label"))


def _split_sql(seeds: str) -> str:
    return f"""p AS (SELECT c_custkey, coalesce(c_acctbal < 0, false)::INT AS label FROM customer),
    g AS (SELECT p.*, seed FROM p, (SELECT unnest({seeds}) AS seed)),
    r AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n,
          row_number() OVER (PARTITION BY seed ORDER BY {sql_hash('seed', "'split'", 'c_custkey')}, c_custkey) AS rn FROM g),
    s AS (SELECT *, rn <= n - ceil(0.2 * n)::BIGINT AS train FROM r),
    sizes AS (SELECT seed, count(*) FILTER (train) AS num_train, count(*) FILTER (NOT train) AS num_test,
              least(count(*) FILTER (train AND label = 0), count(*) FILTER (train AND label = 1)) AS least FROM s GROUP BY seed)"""


@query(
    "balanced_weights",
    """WITH c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label)
    SELECT vec_id, e.label, round((SELECT sum(c) FROM c) / ((SELECT count(*) FROM c) * c), 9) AS weight
    FROM embeddings e JOIN c ON c.label = e.label""",
)
def balanced_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return V.balanced_weights(rows).select("vec_id", "label", F.round("weight", 9).alias("weight"))


@query(
    "grid_search_lr",
    f"""WITH {_split_sql('[42]')}
    SELECT num_train, CASE WHEN least > 1 THEN least(least, 4) ELSE 2 END AS folds, 100.0::DOUBLE AS strength,
           'l1' AS penalty, 1.0::DOUBLE AS cv_area, num_test, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS accuracy
    FROM sizes""",
)
def grid_search_lr(spark, sf_dir):
    """All 16 settings cross-validated on 80 %, the chosen one scored on the rest."""
    found = V.sweep(points(spark, sf_dir), "c_custkey", shots=("all",), seeds=(42,))
    return _rounded(found).select("num_train", "folds", "strength", "penalty", "cv_area", "num_test", "roc_auc", "accuracy")


@query(
    "few_shot_sweep",
    f"""WITH {_split_sql(str(list(V.SEEDS)))},
    cells AS (SELECT seed, num_test, k.num_shot, CASE num_shot WHEN 'all' THEN num_train ELSE num_shot::BIGINT END AS num_train,
                     CASE num_shot WHEN 'all' THEN least ELSE num_shot::BIGINT // 2 END AS least
              FROM sizes, (SELECT unnest({[str(s) for s in V.SHOTS]}) AS num_shot) k)
    SELECT seed::INT AS seed, num_shot, num_train, CASE WHEN least > 1 THEN least(least, 4) ELSE 2 END AS folds,
           100.0::DOUBLE AS strength, 'l1' AS penalty, 1.0::DOUBLE AS cv_area, num_test, 1.0::DOUBLE AS roc_auc,
           1.0::DOUBLE AS mean_area, 0.0::DOUBLE AS std_area
    FROM cells""",
)
def few_shot_sweep(spark, sf_dir):
    """Five seeds, eight numbers of shots and all rows, 16 settings each, and the mean over seeds."""
    found = _rounded(V.sweep(points(spark, sf_dir), "c_custkey"))
    means = R.rounded(R.mean_std(found, ["num_shot"], "roc_auc"))
    means = means.select("num_shot", F.col("mean").alias("mean_area"), F.col("std").alias("std_area"))
    columns = ("seed", "num_shot", "num_train", "folds", "strength", "penalty", "cv_area", "num_test", "roc_auc")
    return found.select(*columns).join(means, "num_shot")


@query(
    "grid_search_trees",
    f"""WITH {_split_sql('[42]')}
    SELECT 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS accuracy, num_test AS num FROM sizes""",
)
def grid_search_trees(spark, sf_dir):
    """Boosted trees over depth and learning rate, cross-validated on 80 %, scored on the rest."""
    split = J.split_seeded(points(spark, sf_dir), "c_custkey", 42)
    model = V.tree_search(split.where("split = 'train'").drop("split"), "c_custkey", 42)
    return V.score_holdout(model, split.where("split <> 'train'").drop("split"))


def _rounded(found):
    return found.withColumns({c: F.round(c, 6) for c in ("cv_area", "roc_auc", "accuracy")})
