from pyspark.sql import functions as F
import math
from collections import Counter

import pytest

from rowscribe.operators import perturb as B
from rowscribe.operators import sampling as K
from rowscribe.operators import splits as J


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, 0 if i % 3 else (1 if i % 2 else 2)) for i in range(500)]
    return spark.createDataFrame(data, "id bigint, label int").cache()


@pytest.mark.parametrize("seed", [1, 42])
def test_few_shot_does_not_depend_on_partitions(rows, seed):
    draws = [
        sorted(map(tuple, K.few_shot_sample(rows.repartition(p), "id", "label", [4, 100], [seed]).collect()))
        for p in (1, 8)
    ]
    assert draws[0] == draws[1]


def test_few_shot_sizes(rows):
    sample = K.few_shot_sample(rows, "id", "label", [4, 8, 512], [1, 2]).collect()
    sizes = Counter((r["seed"], r["num_shot"], r["label"]) for r in sample)
    for seed in (1, 2):
        for shots in (4, 8, 512):
            share = shots // 3
            assert [sizes[seed, shots, l] for l in range(3)] == [share, share, shots - 2 * share]
    labels = {r["id"]: r["label"] for r in rows.collect()}
    assert all(labels[r["id"]] == r["label"] for r in sample)
    numbers = sorted(r["draw_no"] for r in sample if r["seed"] == 1 and r["num_shot"] == 512)
    assert numbers == list(range(512))
    # with replacement: 170 draws from 83 rows must repeat
    assert max(Counter(r["id"] for r in sample if r["num_shot"] == 512).values()) > 1


def test_training_sets(rows):
    seeded = rows.selectExpr("explode(array(1, 2)) as seed", "id", "label")
    found = K.training_sets(seeded, "id", "label", [6, "all"]).collect()
    assert Counter((r["seed"], r["num_shot"]) for r in found if r["num_shot"] == "6") == {(1, "6"): 6, (2, "6"): 6}
    orders = []
    for seed in (1, 2):
        whole = sorted((r["draw_no"], r["id"]) for r in found if r["num_shot"] == "all" and r["seed"] == seed)
        assert [n for n, _ in whole] == list(range(rows.count()))
        orders.append([i for _, i in whole])
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) == sorted(r["id"] for r in rows.collect())
    assert K.training_sets(seeded, "id", "label", ["all"]).count() == 2 * rows.count()


def test_training_sets_send_no_sample_to_the_driver(spark, rows, monkeypatch):
    def refused(*args):
        raise AssertionError("keys of a sample collected")

    monkeypatch.setattr(type(rows), "collect", refused)
    seeded = rows.selectExpr("explode(array(1, 2)) as seed", "id", "label")
    found = K.training_sets(seeded, "id", "label", [6, "all"])
    monkeypatch.undo()
    assert found.count() == 2 * (6 + 500)
    assert found.inputFiles() and all("training-rows" in f for f in found.inputFiles())  # made once


def test_few_shot_of_fewer_shots_than_labels(rows):
    sample = K.few_shot_sample(rows, "id", "label", [2], [1]).collect()
    assert [r["label"] for r in sample] == [2, 2]


def test_pool_is_what_was_not_drawn(rows):
    sample = K.few_shot_sample(rows, "id", "label", [64], [1])
    pool = {r["id"] for r in K.unlabelled_pool(rows, sample, ["id"]).collect()}
    drawn = {r["id"] for r in sample.collect()}
    assert pool.isdisjoint(drawn) and len(pool | drawn) == 500


def test_shuffle_sizes(rows):
    assert K.first_after_shuffle(rows, "id", 1, 7).count() == 7
    assert K.first_after_shuffle(rows, "id", 1, 0).count() == 0
    everything = [r["id"] for r in K.first_after_shuffle(rows, "id", 1, "all").collect()]
    assert sorted(everything) == list(range(500)) != everything


def test_exchange_categories(spark):
    data = [(i, None if i % 5 == 0 else f"c{i % 4}", "one") for i in range(60)]
    df = spark.createDataFrame(data, "id bigint, c string, flat string")
    after = {r["id"]: r for r in K.exchange_categories(df, ["c", "flat"], 3).collect()}
    assert len(after) == 60
    pairs = {(c, after[i]["c"]) for i, c, _ in data}
    assert len(pairs) == 5 and all(a != b for a, b in pairs)
    assert {b for _, b in pairs} == {a for a, _ in pairs}
    assert {r["flat"] for r in after.values()} == {"one"}


@pytest.mark.parametrize("parts", [1, 5])
def test_exchange_numbers(spark, parts):
    values = [i * 1.5 if i % 3 else 7.0 for i in range(103)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v double").repartition(parts)
    after = {r["id"]: r["v"] for r in K.exchange_numbers(df, "id", ["v"], 3).collect()}
    ordered = sorted(values)
    cut = [math.floor(b * (103 / 10)) for b in range(11)]
    bins = [ordered[a:b] for a, b in zip(cut, cut[1:])]
    home = lambda v: next(i for i, b in enumerate(bins) if b[0] <= v <= b[-1])
    targets = {}
    for i, v in enumerate(values):
        there = {j for j, b in enumerate(bins) if after[i] in b}
        targets.setdefault(home(v), set(range(10))).intersection_update(there)
    # all rows of a bin moved to one common bin, not their own
    assert all(t and t != {h} for h, t in targets.items())


def test_exchange_numbers_needs_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id bigint, v double")
    with pytest.raises(Exception, match="fewer rows than 10 bins"):
        K.exchange_numbers(df, "id", ["v"], 3).collect()


@pytest.mark.parametrize("n", [1, 4, 5, 10, 99, 100])
def test_ordered_split(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "id bigint").repartition(3)
    got = {r["id"]: r["split"] for r in J.split_ordered(df, "id").collect()}
    held = math.ceil(n * 0.2)
    test = math.ceil(held * 0.5)
    want = ["train"] * (n - held) + ["validation"] * (held - test) + ["test"] * test
    assert [got[i] for i in range(n)] == want


@pytest.mark.parametrize("n", [1, 5, 15, 101])
def test_seeded_split(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    runs = [
        {r["id"]: r["split"] for r in J.split_seeded(df.repartition(p), "id", 9).collect()}
        for p in (1, 8)
    ]
    assert runs[0] == runs[1] and len(runs[0]) == n
    assert Counter(runs[0].values())["validation"] == math.ceil(n * 0.2 - 1e-9)
    if n == 101:
        other = {r["id"]: r["split"] for r in J.split_seeded(df, "id", 10).collect()}
        assert other != runs[0]
        many = {
            (r["seed"], r["id"]): r["split"] for r in J.split_seeds(df, "id", [9, 10]).collect()
        }
        assert many == {(9, i): s for i, s in runs[0].items()} | {(10, i): s for i, s in other.items()}


def test_folds(spark, rows):
    folds = J.stratified_folds(rows, "id", "label", 5).collect()
    sizes = Counter((r["label"], r["fold"]) for r in folds)
    assert {f for _, f in sizes} == {0, 1, 2, 3}
    for label in range(3):
        per_fold = [sizes[label, f] for f in range(4)]
        assert max(per_fold) - min(per_fold) <= 1
    lone = spark.createDataFrame([(i, int(i == 0)) for i in range(11)], "id bigint, label int")
    plain = Counter(r["fold"] for r in J.stratified_folds(lone, "id", "label", 5).collect())
    assert plain == {0: 6, 1: 5}


def test_perturbation(spark):
    df = spark.createDataFrame([(i, 3, "a") for i in range(200)], "id bigint, n int, c string")
    got = B.perturb_rows(df, "id", {"n": 99, "c": ("a", "b")}, seed=1).collect()
    assert len(got) == 200 * B.COPIES
    changed = sum(r["n"] != 3 for r in got) / len(got)
    assert abs(changed - B.SHARE) < 0.03
    assert all(0 <= r["n"] < 99 for r in got) and {r["c"] for r in got} == {"a", "b"}


def test_caps(spark):
    data = [(i, "hot" if i % 3 else "cold") for i in range(90)] + [(100, "none")]
    df = spark.createDataFrame(data, "id bigint, task string")
    sizes = spark.createDataFrame([("hot", 1000, 50), ("cold", 5, 1)], "task string, train_size int, t int")
    caps = K.mixture_caps(sizes, "t", "train_size", total=1000)
    kept = K.cap_rows(df, caps, "task", "id").collect()
    assert Counter(r["task"] for r in kept) == {"hot": 20, "cold": 5}
    assert max(r["id"] for r in kept if r["task"] == "hot") == 29


def test_permute_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "c bigint")
    pairs = spark.createDataFrame([(1, 9)], "id bigint, new_id bigint")
    assert {r["c"] for r in K.permute_ids(df, pairs, "c").collect()} == {9, 2, None}


def test_draws_reach_past_32_bits(spark):
    from rowscribe.functions.hashing import pick

    n = 20_000_000_000
    drawn = [r[0] for r in spark.range(2000).select(pick(n, "seed", F.col("id"))).collect()]
    assert 0 <= min(drawn) < n // 100 and n - n // 100 < max(drawn) < n
