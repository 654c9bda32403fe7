import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowscribe.operators import metrics as M
from rowscribe.operators import report as R
from rowscribe.operators import scoring as C


def auc(pos, neg):
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg)) if pos and neg else None


def pr_area(rows):
    points = [(0.0, 1.0)]
    total = sum(l for l, _ in rows)
    for cut in sorted({s for _, s in rows}, reverse=True):
        taken = [l for l, s in rows if s >= cut]
        points.append((sum(taken) / total, sum(taken) / len(taken)))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(points))


@pytest.fixture(scope="module")
def binary(spark):
    rng = random.Random(3)
    # a third of all scores are one value
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.4 else round(rng.random(), 2)) for _ in range(400)]
    return rows, spark.createDataFrame(rows, "label int, score double")


@pytest.mark.parametrize("parts", [1, 8])
def test_binary_areas(binary, parts):
    rows, df = binary
    df = df.repartition(parts)
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    assert M.roc_auc(df, "label", "score").first()[0] == pytest.approx(auc(pos, neg))
    assert M.pr_auc(df, "label", "score").first()[0] == pytest.approx(pr_area(rows))


def test_empty_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    assert M.roc_auc(df, "label", "score").first()[0] is None


def test_multi_class_areas(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        w = [rng.randint(1, 5) for _ in range(3)]
        rows.append((rng.randint(0, 2), [x / sum(w) for x in w]))
    df = spark.createDataFrame(rows, "label int, p array<double>")
    rest = [auc([p[c] for l, p in rows if l == c], [p[c] for l, p in rows if l != c]) for c in range(3)]
    assert M.roc_auc_ovr(df, "label", "p").first()[0] == pytest.approx(sum(rest) / 3)
    pairs = [
        auc([p[a] for l, p in rows if l == a], [p[a] for l, p in rows if l == b])
        for a in range(3) for b in range(3) if a != b
    ]
    assert M.roc_auc_ovo(df, "label", "p").first()[0] == pytest.approx(sum(pairs) / 6)
    record = M.metric_record(df.withColumn("pred", F.lit(1)), "label", "pred", "p", 3).first()
    assert record["AUC_ovo"] == pytest.approx(sum(pairs) / 6) and record["num"] == 150
    text = M.record_json(M.metric_record(df.withColumn("pred", F.lit(1)), "label", "pred", "p", 3))
    assert '"num":150' in text.first()[0]


def test_f1_counts_classes_of_both_sides(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 3)]
    df = spark.createDataFrame(rows, "l int, p int")
    got = M.accuracy_f1(df, "l", "p").first()
    f1 = [2 * 1 / 3, 2 * 1 / 3, 0.0, 0.0]
    assert got["accuracy"] == got["micro_f1"] == 0.5
    assert got["macro_f1"] == pytest.approx(sum(f1) / 4) and got["num"] == 4


def test_is_binary(spark):
    df = spark.createDataFrame([(0,), (1,)], "l int")
    assert df.select(M.is_binary(df, "l")).first()[0] is True
    three = df.unionByName(spark.createDataFrame([(2,)], "l int"))
    assert three.select(M.is_binary(three, "l")).first()[0] is False


TOKENS = "idx int, label int, choice int, nll double, is_pad boolean"


def test_choice_scores(spark):
    rows = [
        (1, 0, 0, 1.0, False), (1, 0, 0, 3.0, False), (1, 0, 1, 2.5, False), (1, 0, 1, 9.0, True),
        (2, 1, 0, 1.0, False), (2, 1, 1, 1.0, False),
    ]
    tokens = spark.createDataFrame(rows, TOKENS)
    plain = C.choice_scores(tokens, ["idx", "label"])
    scores = {(r["idx"], r["choice"]): (r["score"], r["length"]) for r in plain.collect()}
    assert scores == {(1, 0): (4.0, 2), (1, 1): (2.5, 1), (2, 0): (1.0, 1), (2, 1): (1.0, 1)}
    normed = C.choice_scores(tokens, ["idx", "label"], length_norm=1.0)
    got = {r["idx"]: r for r in C.predict(normed, ["idx", "label"], "label").collect()}
    assert got[1]["prediction"] == 0 and (got[1]["score_gt"], got[1]["score_cand"]) == (2.0, 2.5)
    assert sum(got[1]["probabilities"]) == pytest.approx(1) and got[2]["prediction"] == 0
    alone = C.predict(normed.where("choice = label"), ["idx", "label"], "label").collect()
    assert all(r["score_cand"] == r["score_gt"] for r in alone)


def test_result_cells(spark):
    df = spark.createDataFrame([("a", 4, 0.5), ("a", 4, 0.7), ("b", 4, 0.617825)], "d string, k int, s double")
    cells = R.mean_std(df, ["d", "k"], "s")
    text = {r["d"]: r["t"] for r in cells.select("d", R.result_text(F.col("mean"), F.col("std"), F.col("n"), 100.0).alias("t")).collect()}
    assert text == {"a": "60.00 (10.00)", "b": "61.78"}
    latex = cells.where("d = 'a'").select(R.latex_cell(F.col("mean"), F.col("std"))).first()[0]
    assert latex == "& $0.60_{.10}$"


def test_best_step_is_the_earliest(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9)], "r string, step int, auc double")
    assert R.best_step(df, ["r"], "step", "auc").first()["best_step"] == 2


def test_experiment_key(spark):
    paths = ["/x/m3b_car_list_numshot4_seed42_ia3_pretrained100k/dev_scores.json", "/x/exp=m11b_heart_numshotall_seed1/f"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in R.experiment_key(F.col("p")).items()]).collect()]
    assert got == [("m3b", "car_list", "4", "42", "ia3_pretrained100k"), ("m11b", "heart", "all", "1", "")]
