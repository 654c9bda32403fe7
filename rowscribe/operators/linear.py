"""Logistic regressions of a whole grid of settings, for many training sets at once.

A model minimises ``r(w) + C * sum(weight * loss)`` with the absolute or half the squared
weights as ``r``; the intercept is a weight like the others. Newton steps need the loss,
gradient and curvature of every model, which one scan adds up for all models together:
every task sums its rows, and the sums, whose size follows models and features and not
the rows, are added in two steps and brought to the driver, which moves all models.

A training set of bounded size, as a few-shot draw, is fitted by one task with the same
steps; all sets are fitted side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The grid of the linear baseline, tried in this order.
INVERSE_STRENGTHS = (100, 10, 1, 1e-1, 1e-2, 1e-3, 1e-4, 1e-5)
PENALTIES = ("l1", "l2")

ITERATIONS = 60
SWEEPS = 60  # over the weights, for absolute weights
CLOSE = 1e-7  # a step this small ends a model
HELD = 8_000_000  # numbers summed per task at once: models times squared features
ROWS = 250  # taken at once, so that their numbers for all models stay in the processor's cache
NARROW = 40  # features up to which their products are laid out per row
BINS = 4096  # of scores, for the choice of settings on a set that no task holds


def settings(strengths: Sequence[float] = INVERSE_STRENGTHS, penalties: Sequence[str] = PENALTIES) -> list[tuple[float, str]]:
    return list(product(strengths, penalties))


def sums(x: np.ndarray, positive: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of every model ``w`` (models, features) over rows ``x``;
    ``positive`` and ``weight`` are (rows, models)."""
    margin = x @ w.T
    small = np.exp(-np.abs(margin))
    loss = (weight * (np.maximum(np.where(positive, -margin, margin), 0) + np.log1p(small))).sum(axis=0)
    near = 1 / (1 + small)  # the larger of p and 1 - p
    far = small * near
    p = np.where(margin >= 0, near, far)
    gradient = (weight * (p - positive)).T @ x
    curved = weight * near * far
    n, width = w.shape
    if width <= NARROW:
        # one product for all models, over the products of features of every row
        upper = np.triu_indices(width)
        curvature = np.empty((n, width, width))
        curvature[:, upper[0], upper[1]] = curved.T @ (x[:, upper[0]] * x[:, upper[1]])
        curvature[:, upper[1], upper[0]] = curvature[:, upper[0], upper[1]]
    else:
        curvature = np.stack([(x * curved[:, [b]]).T @ x for b in range(n)])
    return loss, gradient, curvature


@dataclass
class Search:
    """The state of all models between two scans."""

    strength: np.ndarray
    absolute: np.ndarray
    width: int
    w: np.ndarray = field(init=False)
    tried: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.strength)
        self.w = np.zeros((n, self.width))
        self.tried = self.w.copy()
        self.value = np.full(n, np.inf)
        self.way = np.zeros_like(self.w)
        self.step = np.ones(n)
        self.done = np.zeros(n, bool)

    def _cost(self, w: np.ndarray) -> np.ndarray:
        return np.where(self.absolute, np.abs(w).sum(axis=1), (w * w).sum(axis=1) / 2)

    def move(self, loss: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Take the tried weights where they are better, and choose the next ones to try."""
        value = self._cost(self.tried) + self.strength * loss
        better = (value <= self.value) & ~self.done
        self.w[better], self.value[better] = self.tried[better], value[better]
        gradient, curvature = self.strength[:, None] * gradient, self.strength[:, None, None] * curvature
        for kind, way in ((False, self._squared), (True, self._absolute)):
            now = np.flatnonzero(better & (self.absolute == kind))
            if len(now):
                self.way[now] = way(self.w[now], gradient[now], curvature[now])
        self.step = np.where(better, 1.0, self.step / 2)
        self.tried = self.w + self.step[:, None] * self.way
        self.done |= (self.step[:, None] * np.abs(self.way) <= CLOSE * (1 + np.abs(self.w))).all(axis=1)

    @staticmethod
    def _squared(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        return -np.linalg.solve(curvature + np.eye(w.shape[1]), (gradient + w)[:, :, None])[:, :, 0]

    @staticmethod
    def _absolute(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        """Coordinate descent on the quadratic model, all models side by side."""
        n = w.shape[1]
        curvature = curvature + 1e-9 * np.eye(n)
        own = np.diagonal(curvature, axis1=1, axis2=2)
        way, slope = np.zeros_like(w), gradient.copy()
        for _ in range(SWEEPS):
            most = 0.0
            for j in range(n):
                target = w[:, j] + way[:, j] - slope[:, j] / own[:, j]
                target = np.sign(target) * np.maximum(np.abs(target) - 1 / own[:, j], 0)
                change = target - w[:, j] - way[:, j]
                way[:, j] += change
                slope += change[:, None] * curvature[:, j]
                most = max(most, float(np.abs(change).max()))
            if most < CLOSE:
                break
        return way


def fit(x: np.ndarray, positive: np.ndarray, weight: np.ndarray, strength: np.ndarray, absolute: np.ndarray) -> np.ndarray:
    """The weights of every model over rows that one task holds."""
    search = Search(strength, absolute, x.shape[1])
    for _ in range(ITERATIONS):
        search.move(*sums(x, positive, weight, search.tried))
        if search.done.all():
            break
    return search.w


def balance(counts: np.ndarray) -> np.ndarray:
    """Weight n / (labels * count) of each label; labels without rows do not count."""
    present = np.maximum((counts > 0).sum(axis=-1, keepdims=True), 1)
    return counts.sum(axis=-1, keepdims=True) / (present * np.maximum(counts, 1))


def probabilities(margins: np.ndarray) -> np.ndarray:
    """(rows, labels) of margins per class, or of the margin of class 1 alone."""
    p = np.exp(-np.logaddexp(0, -margins))
    if p.shape[1] == 1:
        return np.hstack([1 - p, p])
    return p / p.sum(axis=1, keepdims=True)


def area(positive: np.ndarray, score: np.ndarray) -> float:
    """ROC AUC with half credit for ties; not a number where a class is empty."""
    n, m = int(positive.sum()), int((~positive).sum())
    if not n or not m:
        return float("nan")
    _, at, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = np.cumsum(count) - (count - 1) / 2
    return (rank[at][positive].sum() - n * (n + 1) / 2) / (n * m)


def mean_area(labels: np.ndarray, p: np.ndarray) -> float:
    """The area of class 1 of two, or the mean of one-vs-rest areas."""
    if p.shape[1] == 2:
        return area(labels == 1, p[:, 1])
    return float(np.mean([area(labels == c, p[:, c]) for c in range(p.shape[1])]))


def best_setting(areas: np.ndarray) -> int:
    """The first setting of the highest mean over folds; folds without an area do not count."""
    known = ~np.isnan(areas)
    means = np.where(known, areas, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    return int(np.argmax(np.where(known.any(axis=1), np.round(means, 12), -1)))


def targets_of(n_labels: int) -> list[int]:
    """The classes that get a model: class 1 of two, else every class against the rest."""
    return [1] if n_labels == 2 else list(range(n_labels))


def _with_one(features: Sequence) -> np.ndarray:
    x = np.array([np.asarray(f, float) for f in features])
    return np.hstack([x, np.ones((len(x), 1))])


def search_here(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, n_labels: int, grid: Sequence[tuple[float, str]]):
    """(setting, mean area, weights per class) of a training set that one task holds."""
    targets = targets_of(n_labels)
    folds = np.unique(fold)

    def weights(rows: np.ndarray) -> np.ndarray:
        return balance(np.bincount(labels[rows], minlength=n_labels))[labels] * rows

    def fitted(chosen: Sequence[tuple[float, str]], trained: Sequence[np.ndarray]) -> np.ndarray:
        every = [(c, p, t, s) for s in trained for c, p in chosen for t in targets]
        w = fit(
            x, np.stack([labels == t for _, _, t, _ in every], 1), np.stack([s for *_, s in every], 1),
            np.array([c for c, *_ in every], float), np.array([p == "l1" for _, p, *_ in every]),
        )
        return w.reshape(len(trained), len(chosen), len(targets), -1)

    w = fitted(grid, [weights(fold != f) for f in folds])
    areas = np.array([
        [mean_area(labels[fold == f], probabilities(x[fold == f] @ w[i, s].T)) for i, f in enumerate(folds)] for s in range(len(grid))
    ])
    best = best_setting(areas)
    kept = areas[best][~np.isnan(areas[best])]
    return grid[best], float(kept.mean()) if len(kept) else None, fitted([grid[best]], [weights(np.ones(len(x), bool))])[0, 0]


MODEL = "strength double, penalty string, cv_area double, num_train bigint, folds int, weights array<array<double>>"


def search_samples(samples: DataFrame, by: Sequence[str], n_labels: int, grid: Sequence[tuple[float, str]] = ()) -> DataFrame:
    """One model per training set, of (by..., features, label, fold). A set is held by one
    task, so it has to be of bounded size, as draws of a number of shots are."""
    grid = list(grid) or settings()
    kinds = dict(samples.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + MODEL

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order") if "order" in rows else rows
        fold = rows["fold"].to_numpy()
        (c, penalty), cv, w = search_here(_with_one(rows["features"]), rows["label"].to_numpy(int), fold, n_labels, grid)
        found = dict(zip(by, key)) | {"strength": float(c), "penalty": penalty, "cv_area": cv, "num_train": len(rows), "folds": len(set(fold))}
        return pd.DataFrame([found | {"weights": w.tolist()}])

    return samples.groupBy(*by).applyInPandas(run, schema)


# --- sets of any size ------------------------------------------------------------------


PARTS = 64  # tasks' sums added at once


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """Sums of equally long packed numbers per model, of many tasks first in parts."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py()) for v in rows.column("packed")], axis=0)
        first = {c: rows.column(c)[:1] for c in ("model", "part")}
        return pa.table({**first, "packed": pa.array([total.tobytes()], pa.binary())})

    schema = "model int, part int, packed binary"
    if tasks > PARTS:
        parts = parts.groupBy("model", "part").applyInArrow(add, schema)
    return parts.withColumn("part", F.lit(0)).groupBy("model", "part").applyInArrow(add, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists without nulls as (rows, length), without an object per number."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            x = _matrix(rows.column("features"))
            x = np.hstack([x, np.ones((len(x), 1))])
            yield x, rows.column("label").to_numpy(zero_copy_only=False), _matrix(rows.column("folds"))


def _scanned(rows: DataFrame, models: Sequence[tuple[int, int, int]], share: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Loss, gradient and curvature of (set, left-out fold, class) models over all rows.
    ``share`` (sets, folds + 1, labels) has the weight of a label without a fold, the last
    one without any left out."""
    n, width = w.shape
    upper = np.triu_indices(width)
    of_set, out, target = np.array(models).T
    sent = rows.sparkSession.sparkContext.broadcast((w, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, share = sent.value
        total = np.zeros((n, 1 + width + len(upper[0])))
        for x, labels, folds in _batches(batches):
            mine = folds[:, of_set]
            weight = share[of_set, out][:, labels].T * ((mine >= 0) & (mine != out))
            loss, gradient, curvature = sums(x, labels[:, None] == target, weight, w)
            total += np.hstack([loss[:, None], gradient, curvature[:, upper[0], upper[1]]])
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())],
            ["model", "part", "packed"],
        )

    rows = rows.select("features", "label", "folds")
    parts = rows.mapInArrow(run, "model int, part int, packed binary")
    found = {r["model"]: np.frombuffer(r["packed"]) for r in _added(parts, rows.rdd.getNumPartitions()).collect()}
    sent.unpersist()
    total = np.stack([found[i] for i in range(n)])
    curvature = np.zeros((n, width, width))
    curvature[:, upper[0], upper[1]] = total[:, 1 + width :]
    curvature[:, upper[1], upper[0]] = total[:, 1 + width :]
    return [total[:, 0], total[:, 1 : 1 + width], curvature]


def _fit_spread(rows: DataFrame, models: list[tuple[int, int, int, float, str]], share: np.ndarray, width: int) -> np.ndarray:
    """The weights of (set, left-out fold, class, strength, penalty) models, as many of
    them per scan as ``HELD`` allows; models that have ended leave the scan."""
    out = np.zeros((len(models), width))
    size = max(1, HELD // (width * width))
    for start in range(0, len(models), size):
        block = models[start : start + size]
        search = Search(np.array([m[3] for m in block], float), np.array([m[4] == "l1" for m in block]), width)
        for _ in range(ITERATIONS):
            left = np.flatnonzero(~search.done)
            if not len(left):
                break
            found = _scanned(rows, [block[i][:3] for i in left], share, search.tried[left])
            whole = [np.full((len(block), *f.shape[1:]), np.inf if f.ndim == 1 else 0.0) for f in found]
            for into, f in zip(whole, found):
                into[left] = f
            search.move(*whole)
        out[start : start + size] = search.w
    return out


def _binned_areas(rows: DataFrame, models: Sequence[tuple[int, int, int, int]], w: np.ndarray, targets: Sequence[int]) -> DataFrame:
    """(set, setting, fold, area): mean one-vs-rest areas over held-out folds, of scores in
    ``BINS`` bins. Tasks count their bins before anything is shuffled."""
    place = {m: i for i, m in enumerate(models)}
    combos = sorted({m[:3] for m in models})
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        counts: dict[tuple, np.ndarray] = {}
        for x, labels, folds in _batches(batches):
            for s, setting, f in combos:
                held = folds[:, s] == f
                if not held.any():
                    continue
                p = probabilities(x[held] @ w[[place[s, setting, f, t] for t in targets]].T)
                for t in targets:
                    at = np.minimum((p[:, t] * BINS).astype(int), BINS - 1) * 2 + (labels[held] == t)
                    key = (s, setting, f, t)
                    counts[key] = counts.get(key, 0) + np.bincount(at, minlength=2 * BINS)
        for (s, setting, f, t), n in counts.items():
            n = n.reshape(-1, 2)
            bins = np.flatnonzero(n.sum(axis=1))
            same = [pa.array([v] * len(bins), pa.int32()) for v in (s, setting, f, t)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(bins, pa.int32()), pa.array(n[bins, 1]), pa.array(n[bins, 0])], names)

    names = ["set", "setting", "fold", "class", "bin", "pos", "neg"]
    rows = rows.select("features", "label", "folds")
    made = rows.mapInArrow(run, "set int, setting int, fold int, class int, bin int, pos bigint, neg bigint")
    group = names[:4]
    bins = made.groupBy(*names[:5]).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    areas = bins.withColumn("wins", wins).groupBy(*group).agg(
        (F.sum("wins") / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("area")
    )
    whole = F.when(F.count("area") == F.count(F.lit(1)), F.avg("area"))  # as one class without an area leaves none
    return areas.groupBy("set", "setting", "fold").agg(whole.alias("area"))


def search_spread(rows: DataFrame, n_sets: int, n_labels: int, grid: Sequence[tuple[float, str]] = ()) -> list[dict]:
    """One model per training set of any size, of rows (features, label, folds): ``folds``
    has the fold of the row in each set, or -1 where it is not in the set."""
    grid, targets = list(grid) or settings(), targets_of(n_labels)
    counted = rows.select("label", F.posexplode("folds").alias("set", "fold")).groupBy("set", "fold", "label").count().collect()
    most = max((r["fold"] for r in counted), default=-1) + 1
    n = np.zeros((n_sets, most + 1, n_labels))
    for r in counted:
        if r["fold"] >= 0:
            n[r["set"], r["fold"], r["label"]] = r["count"]
    whole = n.sum(axis=1, keepdims=True)
    share = balance(whole - n)  # without each fold; the last one leaves nothing out
    first = rows.select(F.size("features").alias("n")).first()
    if first is None:
        return []
    width = first["n"] + 1
    folds = [(n[s].sum(axis=1) > 0).nonzero()[0].tolist() for s in range(n_sets)]
    tried = [(s, i, f, t) for s in range(n_sets) for i in range(len(grid)) for f in folds[s] for t in targets]
    w = _fit_spread(rows, [(s, f, t, *grid[i]) for s, i, f, t in tried], share, width)
    areas = np.full((n_sets, len(grid), most), np.nan)
    for r in _binned_areas(rows, tried, w, targets).collect():
        areas[r["set"], r["setting"], r["fold"]] = np.nan if r["area"] is None else r["area"]
    best = [best_setting(a) for a in areas]
    last = [(s, most, t, *grid[best[s]]) for s in range(n_sets) for t in targets]
    w = _fit_spread(rows, last, share, width).reshape(n_sets, len(targets), width)
    out = []
    for s, i in enumerate(best):
        known = areas[s, i][~np.isnan(areas[s, i])]
        out.append({
            "strength": float(grid[i][0]), "penalty": grid[i][1], "cv_area": float(known.mean()) if len(known) else None,
            "num_train": int(n[s].sum()), "folds": len(folds[s]), "weights": w[s].tolist(),
        })
    return out


def scored(rows: DataFrame, models: dict[tuple, list[list[float]]], by: str, group: str) -> DataFrame:
    """(group, by, label, probabilities) of every row (group, features, label) under every
    model of its group. ``models`` maps (group, by) to weights: a few numbers per model."""
    held: dict[int, list] = {}
    for (of, own), w in models.items():
        held.setdefault(of, []).append((own, np.array(w, float)))
    sent = rows.sparkSession.sparkContext.broadcast(held)
    names = [group, by, "label", "probabilities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(group).to_numpy(zero_copy_only=False)
            for g in set(of.tolist()):
                mine = batch.filter(pa.array(of == g))
                x = _matrix(mine.column("features"))
                x = np.hstack([x, np.ones((len(x), 1))])
                for own, w in sent.value.get(g, []):
                    p = probabilities(x @ w.T)
                    p = pa.ListArray.from_arrays(pa.array(range(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([mine.column(group), pa.array([own] * len(x), pa.int32()), mine.column("label"), p], names)

    rows = rows.select(group, "features", F.col("label").cast("int").alias("label"))
    return rows.mapInArrow(run, f"{group} int, {by} int, label int, probabilities array<double>")
