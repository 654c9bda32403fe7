import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowscribe.functions.hashing import cyclic_derangement, seeded_hash
from rowscribe.functions.search import TREE_SIZE, range_of
from rowscribe.operators import ranking as R
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group and with one value."""
    rng = random.Random(1)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"g{rng.randint(0, 20)}", 5.0 if hot else rng.randint(0, 40) / 4))
    rng.shuffle(rows)
    return rows


SCHEMA = "id bigint, grp string, v double"


@pytest.mark.parametrize("parts", [1, 2, 8])
@pytest.mark.parametrize("ranges", [None, 200])
def test_number_by_order(spark, skewed, parts, ranges):
    df = spark.createDataFrame(skewed, SCHEMA).repartition(parts)
    got = {r["id"]: r["n"] for r in R.number_by_order(df, ["v", "id"], "n", ranges=ranges).collect()}
    order = sorted(skewed, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}


@pytest.mark.parametrize("parts", [1, 8])
def test_number_by_order_in_groups(spark, skewed, parts):
    df = spark.createDataFrame(skewed, SCHEMA).repartition(parts)
    got = {r["id"]: r["n"] for r in R.number_by_order(df, ["v", "id"], "n", ["grp"]).collect()}
    want = {}
    for g in {r[1] for r in skewed}:
        own = sorted((r for r in skewed if r[1] == g), key=lambda r: (r[2], r[0]))
        want |= {r[0]: k for k, r in enumerate(own, 1)}
    assert got == want


@pytest.mark.parametrize("parts", [1, 8])
def test_number_by_hash(spark, skewed, parts):
    df = spark.createDataFrame(skewed, SCHEMA).repartition(parts)
    hashed = df.withColumn("h", seeded_hash(3, "x", F.col("id")))
    numbered = R.number_by_hash(hashed, "h", "n", ["id"]).collect()
    order = sorted(numbered, key=lambda r: (r["h"], r["id"]))
    assert [r["n"] for r in order] == list(range(1, len(skewed) + 1))


def test_nth_key(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA).withColumn("h", seeded_hash(3, "x", F.col("id")))
    for keep in (0, 1, 450, 900):
        rows = R.nth_key(df, ["h", "id"], R.hash_range(df, "h"), F.lit(keep)).collect()
        if keep == 0:
            assert rows == []
            continue
        assert df.where(F.col("h") <= rows[0]["_edge"]["k0"]).count() == keep
    by = R.sampled_range(df, [F.col("id")])
    limits = spark.createDataFrame([("hot", 7), ("g1", 2)], "grp string, cap int")
    last = R.nth_key(df, ["id"], by, F.col("cap"), ["grp"], limits).collect()
    own = {g: sorted(r[0] for r in skewed if r[1] == g) for g in ("hot", "g1")}
    assert {r["grp"]: r["_edge"]["k0"] for r in last} == {"hot": own["hot"][6], "g1": own["g1"][1]}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 501])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = [5.0 if rng.random() < 0.4 else round(rng.gauss(0, 3), 3) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    row = R.exact_quantiles(df, "x", at).first()
    for name, q in at.items():
        assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantiles_of_nothing(spark):
    row = R.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", {"m": 0.5}).first()
    assert row["m"] is None


@pytest.mark.parametrize("size", [0, 1, 5, TREE_SIZE, TREE_SIZE + 1, 300])
def test_range_of(spark, size):
    bounds = [(float(i), i) for i in range(size)]
    keys = [(i / 2, j) for i in range(-2, 2 * size + 3) for j in (-1, i // 2, 400)]
    df = spark.createDataFrame(keys, "a double, b bigint")
    col = range_of([F.col("a"), F.col("b")], bounds, [T.DoubleType(), T.LongType()])
    got = df.select("a", "b", col.alias("r")).collect()
    assert all(r["r"] == sum(b <= (r["a"], r["b"]) for b in bounds) for r in got)


def test_null_keys_are_in_the_first_range(spark):
    df = spark.createDataFrame([(None,), (0.5,), (9.0,)], "a double")
    for size in (3, 100):
        col = range_of([F.col("a")], [(float(i),) for i in range(size)], [T.DoubleType()])
        assert [r[0] for r in df.select(col).collect()][:2] == [0, 1]


@pytest.mark.parametrize("n", [2, 3, 10, 57])
def test_cyclic_derangement(n):
    target = cyclic_derangement(n, "seed")
    assert sorted(target) == list(range(n)) and all(i != t for i, t in enumerate(target))


def test_no_derangement_of_one():
    with pytest.raises(ValueError):
        cyclic_derangement(1)
