import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowscribe.operators import evaluate as V
from rowscribe.operators import linear as L


def data(n_labels, rows=90, spread=1.0):
    rng = random.Random(2)
    return [(i, [i % n_labels * 3 + rng.gauss(0, spread), rng.gauss(0, 1)], i % n_labels) for i in range(rows)]


def points(spark, n_labels, rows=90, spread=1.0):
    return spark.createDataFrame(data(n_labels, rows, spread), "idx bigint, features array<double>, label int")


def test_fits_are_optimal():
    """Every model of the grid meets the conditions of its minimum."""
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(80, 5)), np.ones((80, 1))])
    y = rng.random(80) < 1 / (1 + np.exp(-x @ rng.normal(size=6)))
    grid = L.settings()
    assert len(grid) == 16 and grid[:2] == [(100, "l1"), (100, "l2")]
    strength, absolute = np.array([c for c, _ in grid], float), np.array([p == "l1" for _, p in grid])
    positive, weight = np.repeat(y[:, None], 16, 1), rng.random((80, 16)) + 0.5
    w = L.fit(x, positive, weight, strength, absolute)
    _, gradient, _ = L.sums(x, positive, weight, w)
    slope = strength[:, None] * gradient
    squared = np.abs(slope + w)
    edge = np.where(w != 0, np.abs(slope + np.sign(w)), np.maximum(np.abs(slope) - 1, 0))
    assert np.where(absolute[:, None], edge, squared).max() < 1e-4


def test_sums_of_wide_and_narrow_rows_agree(monkeypatch):
    """The curvature of all models from one product is that of one product per model."""
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(50, 6)) * 9, rng.normal(size=(7, 6)) * 9
    positive, weight = rng.random((50, 7)) < 0.5, rng.random((50, 7))
    narrow = L.sums(x, positive, weight, w)
    monkeypatch.setattr(L, "NARROW", 0)
    for a, b in zip(narrow, L.sums(x, positive, weight, w)):
        assert np.allclose(a, b, rtol=1e-12)
    margin = x @ w.T
    loss = (weight * np.logaddexp(0, -np.where(positive, margin, -margin))).sum(axis=0)
    assert np.allclose(narrow[0], loss, rtol=1e-12)


def test_rows_of_slices_as_arrays():
    import pyarrow as pa

    batch = pa.record_batch({"features": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], "label": [0, 1, 0], "folds": [[0], [1], [-1]]}).slice(1)
    ((x, labels, folds),) = L._batches([batch])
    assert x.tolist() == [[3.0, 4.0, 1.0], [5.0, 6.0, 1.0]] and labels.tolist() == [1, 0] and folds.tolist() == [[1], [-1]]
    assert list(L._batches([batch.slice(2)])) == []


def test_area_and_choice():
    assert L.area(np.array([True, False, True]), np.array([0.5, 0.5, 0.9])) == 0.75
    assert np.isnan(L.area(np.array([True]), np.array([0.5])))
    nan = float("nan")
    assert L.best_setting(np.array([[nan, nan], [0.5, nan], [0.5, 0.5], [0.9, 0.1]])) == 1
    assert L.balance(np.array([[3, 1], [2, 0]])).tolist() == [[4 / 6, 2.0], [1.0, 2.0]]


@pytest.mark.parametrize("n_labels", [2, 3])
def test_many_scans_equal_one_task(spark, n_labels):
    """Models fitted by scans over all rows are those that one task fits, set by set."""
    rows = data(n_labels, 60, 2.0)
    folds = [[(i // 3) % 3, (i // 6) % 2 if i % 5 else -1] for i, *_ in rows]
    table = spark.createDataFrame([(f, y, k) for (_, f, y), k in zip(rows, folds)], "features array<double>, label int, folds array<int>").repartition(3)
    grid = [(10, "l1"), (1, "l2"), (1e-2, "l2")]
    found = L.search_spread(table, 2, n_labels, grid)
    for s, made in enumerate(found):
        mine = [i for i in range(60) if folds[i][s] >= 0]
        x = np.array([rows[i][1] + [1.0] for i in mine])
        labels, fold = np.array([rows[i][2] for i in mine]), np.array([folds[i][s] for i in mine])
        setting, cv, w = L.search_here(x, labels, fold, n_labels, grid)
        assert (made["strength"], made["penalty"]) == setting and made["num_train"] == len(mine)
        assert abs(made["cv_area"] - cv) < 0.01 and np.allclose(made["weights"], w, atol=1e-4)
    assert L.search_spread(table.limit(0), 2, n_labels, grid) == []


@pytest.mark.parametrize("n_labels", [2, 3])
def test_sweep(spark, n_labels):
    got = V.sweep(points(spark, n_labels, 60), "idx", n_labels, shots=(6, "all"), seeds=(1, 2), grid=[(1, "l2"), (1, "l1")]).collect()
    assert {(r["seed"], r["num_shot"]) for r in got} == {(s, n) for s in (1, 2) for n in ("6", "all")}
    for r in got:
        assert r["num_train"] == (6 if r["num_shot"] == "6" else 48) and r["num_test"] == 12
        assert r["roc_auc"] > (0.9 if r["num_shot"] == "all" else 0.5)


def test_draws_of_single_labels_get_two_folds(spark):
    draws = spark.createDataFrame([(1, 3, i, i) for i in range(3)], "seed int, num_shot int, draw_no int, label int")
    assert sorted(r["fold"] for r in V._sample_folds(draws).collect()) == [0, 0, 1]


def test_trees(spark):
    df = points(spark, 2, 40)
    score = V.score_holdout(V.tree_search(df, "idx", 1, rounds=2), df).first()
    assert score["roc_auc"] > 0.9 and score["num"] == 40


def test_zero_shot(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.2, 0.8]), (1, [0.95, 0.05])], "label int, p array<double>")
    assert V.zero_shot_score(df, "label", "p").first()[0] == 0.5
    weights = V.balanced_weights(points(spark, 2, 30).where(F.col("idx") < 9)).groupBy("label").agg(F.sum("weight").alias("w"))
    assert [round(r["w"], 9) for r in weights.collect()] == [4.5, 4.5]
