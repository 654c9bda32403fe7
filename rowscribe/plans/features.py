"""Encodings, scaling and column selection."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowscribe.operators import features as L
from rowscribe.operators import splits as J
from rowscribe.plans.registry import query, sql_hash, table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# Every fifth segment is taken as missing.
_MISSING_SEGMENT = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", F.expr(_MISSING_SEGMENT).alias("segment")
    )


@query(
    "one_hot",
    f"""WITH l AS (SELECT c_custkey, unnest(['segment_' || coalesce({_MISSING_SEGMENT}, 'nan'),
                        'nation_' || c_nationkey, 'planet_earth']) AS feature FROM customer)
    SELECT c_custkey, feature, 1.0::DOUBLE AS value FROM l WHERE feature <> 'planet_earth'""",
)
def one_hot(spark, sf_dir):
    rows = _customers(spark, sf_dir).select(
        "c_custkey", "segment", F.col("c_nationkey").cast("string").alias("nation"),
        F.lit("earth").alias("planet"),
    )
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return L.drop_constant_features(
        L.one_hot_long(rows, "c_custkey", ["segment", "nation", "planet"]), n
    )


_CUSTOMER_SPLIT = f"""CASE WHEN row_number() OVER (ORDER BY {sql_hash(42, "'split'", 'c_custkey')}, c_custkey)
    <= count(*) OVER () - ceil(0.2 * count(*) OVER ())::BIGINT THEN 'train' ELSE 'validation' END"""


@query(
    "one_hot_aligned",
    f"""SELECT c_custkey, c_acctbal, {', '.join(f"coalesce(({_MISSING_SEGMENT}) = '{s}', false)::INT::DOUBLE AS segment_{s}" for s in SEGMENTS)},
        (c_custkey % 5 = 0 AND part = 'train')::INT::DOUBLE AS segment_nan, part
    FROM (SELECT *, {_CUSTOMER_SPLIT} AS part FROM customer)""",
)
def one_hot_aligned(spark, sf_dir):
    """Training and holdout rows, both with the columns of the training rows. The holdout
    is encoded without a column for gaps and gets that one as zeros."""
    rows = _customers(spark, sf_dir).drop("c_nationkey")
    split = J.split_seeded(rows, "c_custkey", 42, out="part")
    train, holdout = split.where("part = 'train'"), split.where("part <> 'train'")
    encoded = L.one_hot(train, {"segment": [*SEGMENTS, None]})
    own = L.one_hot(holdout, {"segment": SEGMENTS})
    return encoded.unionByName(L.align_columns(own, encoded.columns))


@query(
    "one_hot_aligned_long",
    f"""WITH l AS (SELECT c_custkey, part, unnest(['segment_' || coalesce({_MISSING_SEGMENT}, 'nan'), 'c_name_' || c_name]) AS feature
        FROM (SELECT *, {_CUSTOMER_SPLIT} AS part FROM customer))
    SELECT c_custkey, part, feature, 1.0::DOUBLE AS value FROM l WHERE feature IN (SELECT feature FROM l WHERE part = 'train')""",
)
def one_hot_aligned_long(spark, sf_dir):
    """The sparse form, with the name as a column of nearly as many values as rows;
    values that only the holdout has go."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(_MISSING_SEGMENT).alias("segment"), "c_name"
    )
    split = J.split_seeded(rows, "c_custkey", 42, out="part")
    features = {
        part: L.one_hot_long(split.where(F.col("part") == part), "c_custkey", ["segment", "c_name"])
        for part in ("train", "validation")
    }
    aligned = L.align_features(features["validation"], features["train"])
    return features["train"].withColumn("part", F.lit("train")).unionByName(
        aligned.withColumn("part", F.lit("validation"))
    )


@query(
    "explanation_features",
    f"""SELECT c_custkey, feature, round(value, 6) AS value FROM (SELECT c_custkey,
            unnest(['c_acctbal', 'c_nationkey', 'segment_' || coalesce({_MISSING_SEGMENT}, 'nan')]) AS feature,
            unnest([(c_acctbal - 4500.0) / 2500.0, c_nationkey, 1.0]::DOUBLE[]) AS value FROM customer)""",
)
def explanation_features(spark, sf_dir):
    """Numbers scaled by constants and dummies; the planet and the flat number go."""
    rows = _customers(spark, sf_dir).withColumns({"planet": F.lit("earth"), "flat": F.lit(3.0)})
    found = L.explanation_features(rows, "c_custkey", {"c_acctbal": (4500.0, 2500.0)})
    return found.withColumn("value", F.round("value", 6))


_SPLIT = f"row_number() OVER (ORDER BY {sql_hash(42, chr(39) + 'split' + chr(39), 'p_partkey')}, p_partkey)"


@query(
    "ordinal",
    f"""WITH r AS (SELECT p_partkey, p_name, p_brand, {_SPLIT} AS rn, count(*) OVER () AS n FROM part),
    t AS (SELECT * FROM r WHERE rn <= n - ceil(0.98 * n - 1e-9)::BIGINT),
    c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM t)),
    b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM t))
    SELECT p_partkey, coalesce(c.code, -1)::DOUBLE AS p_name, coalesce(b.code, -1)::DOUBLE AS p_brand
    FROM part LEFT JOIN c ON c.p_name = part.p_name LEFT JOIN b ON b.p_brand = part.p_brand""",
)
def ordinal(spark, sf_dir):
    """Codes learned on a small training split; values unseen there are -1."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    split = J.split_seeded(part, "p_partkey", 42, share=0.98)
    codes = L.fit_ordinal(split.where("split = 'train'"), ["p_name", "p_brand"])
    return L.apply_ordinal(part, codes, ["p_name", "p_brand"])


@query(
    "zscore",
    f"""WITH r AS (SELECT p_partkey, p_size, p_retailprice, {_SPLIT} AS rn, count(*) OVER () AS n FROM part),
    t AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp,
                 stddev_pop(p_retailprice) AS sp FROM r WHERE rn <= n - ceil(0.2 * n)::BIGINT)
    SELECT p_partkey, round((p_size - ms) / ss, 6) AS p_size, round((p_retailprice - mp) / sp, 6) AS p_retailprice,
        0.0::DOUBLE AS flat FROM r, t""",
)
def zscore(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.lit(3.0).alias("flat")
    )
    split = J.split_seeded(part, "p_partkey", 42)
    columns = ["p_size", "p_retailprice", "flat"]
    scaler = L.fit_scaler(split.where("split = 'train'"), columns)
    scaled = L.apply_scaler(split, scaler, columns)
    return scaled.select("p_partkey", *[F.round(c, 6).alias(c) for c in columns])


@query(
    "scale_constants",
    """SELECT o_orderkey, round((o_totalprice - 1092.5) / 7514.25, 6) AS o_totalprice,
        CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END AS seen,
        (o_custkey % 7 = 0)::INT::DOUBLE AS seen_nan FROM orders""",
)
def scale_constants(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("seen")
    )
    flagged = L.missing_flag(orders, "seen")
    scaled = L.scale_by_constants(flagged, {"o_totalprice": (1092.5, 7514.25)})
    return scaled.withColumn("o_totalprice", F.round("o_totalprice", 6))


LINE_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "one",
)


@query(
    "drop_constants",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', {'false' if c == 'one' else 'true'})" for c in LINE_COLUMNS)
    + ') t("column", kept)',
)
def drop_constants(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return L.varying_columns(lines, LINE_COLUMNS)


@query(
    "drop_sparse",
    """WITH c AS (SELECT unnest(['l_discount', 'l_tax', 'l_quantity', 'odd_line']) AS col,
        unnest([sum((l_discount <> 0)::INT), sum((l_tax <> 0)::INT), sum((l_quantity <> 0)::INT),
                sum((l_linenumber % 2 <> 0)::INT)])::BIGINT AS nonzero FROM lineitem)
    SELECT col AS "column", nonzero, row_number() OVER (ORDER BY nonzero DESC, col) <= 2 AS kept FROM c""",
)
def drop_sparse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("odd_line", F.col("l_linenumber") % 2)
    return L.densest_columns(lines, ["l_discount", "l_tax", "l_quantity", "odd_line"], keep=2)


@query(
    "feature_vector",
    """SELECT p_partkey, round(p_size + 2 * p_retailprice, 4) AS weighted, 2 AS width FROM part""",
)
def feature_vector(spark, sf_dir):
    rows = L.assemble(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    parts = vector_to_array("features")
    return rows.select(
        "p_partkey",
        F.round(F.element_at(parts, 1) + 2 * F.element_at(parts, 2), 4).alias("weighted"),
        F.size(parts).alias("width"),
    )
