import pytest
from pyspark.sql import functions as F

from rowscribe.operators import batching as P
from rowscribe.operators import features as L

SCHEMA = "idx bigint, label int, c string, n double, flat int, hole double"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(0, 0, "a", 1.0, 3, None), (1, 1, "b", 3.0, 3, 2.0), (2, 1, None, 5.0, 3, 2.0), (3, 0, "a", 0.0, 3, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_roles(df):
    assert L.column_roles(df) == (["n", "flat", "hole"], ["c"])


def test_constants_and_sparse_columns(df):
    assert L.drop_constants(df).columns == ["idx", "label", "c", "n"]
    numbers = df.fillna({"hole": 0.0}).drop("c")
    assert L.drop_sparsest(numbers, keep=2).columns == ["idx", "label", "n", "flat"]
    assert L.drop_sparsest(numbers, keep=5).columns == numbers.columns


def test_one_hot(df):
    wide = L.one_hot(df.select("idx", "c"), {"c": ["a", "b", None]}).orderBy("idx")
    assert wide.columns == ["idx", "c_a", "c_b", "c_nan"]
    assert [tuple(r)[1:] for r in wide.collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)]
    long = L.one_hot_long(df, "idx", ["c", "flat"])
    kept = L.drop_constant_features(long, df.agg(F.count("*").alias("n")).scalar())
    assert sorted((r["idx"], r["feature"]) for r in kept.collect()) == [(0, "c_a"), (1, "c_b"), (2, "c_nan"), (3, "c_a")]
    aligned = L.align_features(long, L.one_hot_long(df.where("idx < 2"), "idx", ["c"]))
    assert sorted((r["idx"], r["feature"]) for r in aligned.collect()) == [(0, "c_a"), (1, "c_b"), (3, "c_a")]


def test_align(df):
    aligned = L.align_columns(df.select("n", "idx"), ["idx", "c_z", "n"])
    assert aligned.columns == ["idx", "c_z", "n"] and aligned.first()["c_z"] == 0.0


def test_ordinal(spark, df):
    codes = L.fit_ordinal(df, ["c"])
    new = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    got = {r["k"]: r["c"] for r in L.apply_ordinal(new.withColumn("k", F.col("c")), codes, ["c"]).collect()}
    assert got == {"b": 1.0, "z": -1.0, None: -1.0}


def test_scaler(df):
    scaled = L.apply_scaler(df, L.fit_scaler(df, ["n", "flat"]), ["n", "flat"])
    rows = scaled.collect()
    assert sum(r["n"] for r in rows) == pytest.approx(0)
    assert sum(r["n"] ** 2 for r in rows) / 4 == pytest.approx(1)  # divided by n
    assert {r["flat"] for r in rows} == {0.0}


def test_missing_flag_and_explanation(df):
    flagged = L.missing_flag(df, "hole").orderBy("idx").collect()
    assert [r["hole_nan"] for r in flagged] == [1, 0, 0, 1] and flagged[0]["hole"] == 0.0
    long = L.explanation_features(df.drop("hole"), "idx", {"n": (1.0, 2.0), "flat": (3.0, 1.0)})
    got = sorted((r["feature"], r["idx"], r["value"]) for r in long.collect())
    assert got == [
        ("c_a", 0, 1.0), ("c_a", 3, 1.0), ("c_b", 1, 1.0), ("c_nan", 2, 1.0),
        ("n", 0, 0.0), ("n", 1, 1.0), ("n", 2, 2.0), ("n", 3, -0.5),
    ]
    assert L.explanation_features(df.select("idx", "label"), "idx", {}).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_batches(spark, parts):
    rows = [(i, list(range(1, 2 + i % 5))) for i in range(21)]
    df = spark.createDataFrame(rows, "id bigint, ids array<int>").repartition(parts)
    batched = P.assign_batches(df, "id", 4)
    assert {r["id"]: r["batch"] for r in batched.collect()} == {i: i // 4 for i in range(21)}
    assert P.assign_batches(df, "id", 4, drop_last=True).count() == 20
    padded = P.pad_batches(batched, "ids", ["batch"]).collect()
    for r in padded:
        own = max(len(x) for i, x in rows if i // 4 == r["batch"])
        assert len(r["input_ids"]) == own == len(r["attention_mask"])
        assert sum(r["attention_mask"]) == len(r["ids"]) and r["input_ids"][: len(r["ids"])] == r["ids"]


def test_choice_count_check(spark):
    same = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "batch int, c array<string>")
    assert P.check_choice_counts(same, "c", ["batch"]).count() == 2
    mixed = spark.createDataFrame([(1, ["a"]), (1, ["b", "c"])], "batch int, c array<string>")
    with pytest.raises(Exception, match="different numbers of choices"):
        P.check_choice_counts(mixed, "c", ["batch"]).collect()


def test_joined_fields(spark):
    df = spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>")
    got = df.select(P.joined_fields([F.col("a"), F.col("b")], F.array(F.lit(0)))).first()[0]
    assert got == [1, 2, 3, 0]
