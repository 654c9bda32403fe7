"""Known datasets from files: written from the tables in a dataset's own layout, loaded,
labelled, split and stored, with the small files that steer a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscribe.operators import features as L
from rowscribe.operators import prompts as D
from rowscribe.operators import timeline as T
from rowscribe.operators.serialize import importance_rows
from rowscribe.plans.registry import query, sql_clean, sql_hash, table
from rowscribe.plans.serialization import PART, PART_FORMATS, PART_LIST_SQL, parts
from rowscribe.plans.timelines import entries
from rowscribe.session import scratch_path
from rowscribe.sources import catalogs as C
from rowscribe.sources import datasets as A
from rowscribe.sources import stores as O

_SEGMENT = "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END"
_INCOME = f"""i AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, 20 + c_custkey % 50 AS age, {_SEGMENT} AS workclass,
        n_name AS native_country, (c_acctbal > 5000)::INT AS label FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def income_file(spark, sf_dir) -> str:
    """Customers in the columns of the income data, '?' for a missing workclass."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    answer = F.when(F.col("c_acctbal") > 5000, F.when(key % 2 == 0, ">50K").otherwise(">50K.")).otherwise("<=50K")
    columns = [
        20 + key % 50, F.when(key % 7 != 0, F.col("c_mktsegment")).otherwise("?"), key, F.lit("HS-grad"), key % 16,
        F.lit("Divorced"), F.lit("Sales"), F.lit("Unmarried"), F.lit("Other"), F.lit("Male"), F.lit(0), F.lit(0),
        20 + key % 41, "n_name", answer,
    ]
    path = scratch_path(spark, "income")
    rows.orderBy("c_custkey").select(F.concat_ws(", ", *columns).alias("value")).write.text(path)
    return path


@query("load_income", f"WITH {_INCOME} SELECT * FROM i")
def load_income(spark, sf_dir):
    """Headerless file, '?' as missing, two columns dropped, the label one of two texts."""
    rows = A.load_dataset(spark, "income", income_file(spark, sf_dir))
    return rows.select("idx", "age", "workclass", "native_country", "label")


@query(
    "load_diabetes",
    """WITH r AS (SELECT p_size, p_retailprice, p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS n FROM part),
    s AS (SELECT *, ceil(0.2 * n)::BIGINT AS held, ceil(0.5 * ceil(0.2 * n))::BIGINT AS test FROM r)
    SELECT idx, p_size::BIGINT AS "Glucose", p_retailprice AS "BMI", (p_partkey % 2)::INT AS label,
        CASE WHEN idx < n - held THEN 'train' WHEN idx < n - test THEN 'validation' ELSE 'test' END AS split FROM s""",
)
def load_diabetes(spark, sf_dir):
    """File with a header, the label renamed and cast, split in file order."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(
        F.lit(0).alias("a"), "p_size", F.lit(70).alias("b"), F.lit(20).alias("c"), F.lit(0).alias("d"), "p_retailprice",
        F.lit(0.5).alias("e"), (key % 60).alias("f"), (key % 2).alias("g"),
    )
    path = scratch_path(spark, "diabetes")
    rows.write.option("header", True).csv(path)
    loaded = A.load_dataset(spark, "diabetes", path, split="ordered")
    return loaded.select("idx", "Glucose", "BMI", "label", "split")


_DEBUG_ORDER = f"row_number() OVER (PARTITION BY split ORDER BY {sql_hash(7, chr(39) + 'shuffle' + chr(39), 'idx')}, idx)"


@query(
    "debug_sample",
    f"""WITH {_INCOME}, n AS (SELECT idx, label, count(*) OVER () AS n FROM i),
    s AS (SELECT idx, label, CASE WHEN idx < n - ceil(0.2 * n)::BIGINT THEN 'train'
        WHEN idx < n - ceil(0.5 * ceil(0.2 * n))::BIGINT THEN 'validation' ELSE 'test' END AS split FROM n),
    r AS (SELECT *, {_DEBUG_ORDER} AS rn FROM s)
    SELECT idx, label, split FROM r WHERE rn <= CASE split WHEN 'train' THEN {A.DEBUG_ROWS['train']} ELSE {A.DEBUG_ROWS['test']} END""",
)
def debug_sample(spark, sf_dir):
    """The few rows of each split that a trial run keeps."""
    rows = A.load_dataset(spark, "income", income_file(spark, sf_dir), split="ordered")
    return A.debug_sample(rows, "idx", 7).select("idx", "label", "split")


@query(
    "column_roles",
    """SELECT 'c_acctbal' AS column, 'number' AS role, count(c_acctbal) AS filled FROM customer
    UNION ALL SELECT 'c_nationkey', 'number', count(c_nationkey) FROM customer
    UNION ALL SELECT 'c_name', 'category', count(c_name) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'category', count(c_mktsegment) FROM customer""",
)
def column_roles(spark, sf_dir):
    """What each column counts as, and how many rows have it."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    numbers, others = L.column_roles(rows, ("c_custkey",))
    filled = L.column_facts(rows, [*numbers, *others], F.count, "filled")
    role = F.when(F.col("column").isin(numbers), "number").otherwise("category")
    return filled.select("column", role.alias("role"), "filled")


@query(
    "feature_store",
    """SELECT c_custkey, 'segment_' || c_mktsegment AS feature, 1.0::DOUBLE AS value FROM customer
    UNION ALL SELECT c_custkey, 'c_acctbal', round((c_acctbal - 4500) / 2500, 6) FROM customer""",
)
def feature_store(spark, sf_dir):
    """The sparse feature table of an explanation, written and read again."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    path = scratch_path(spark, "features")
    O.write_features(L.explanation_features(rows, "c_custkey", {"c_acctbal": (4500.0, 2500.0)}), path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))


@query(
    "importance_variant",
    f"""SELECT p_partkey, {sql_clean(PART_LIST_SQL)} AS note,
        ['p_brand_' || p_brand, 'p_name_' || p_name, 'p_retailprice', 'p_size', 'p_type_' || p_type] AS features,
        [1.0, 1.0, round((p_retailprice - 1000) / 100, 6), round((p_size - 25) / 10.0, 6), 1.0]::DOUBLE[] AS "values" FROM part""",
)
def importance_variant(spark, sf_dir):
    """Each row's list note beside the features that explain it."""
    rows = parts(spark, sf_dir).select("p_partkey", *[c for c, _ in PART])
    constants = {"p_size": (25.0, 10.0), "p_retailprice": (1000.0, 100.0)}
    found = importance_rows(rows, "p_partkey", PART, PART_FORMATS, L.explanation_features(rows, "p_partkey", constants))
    return found.withColumn("values", F.transform("values", lambda v: F.round(v, 6)))


@query(
    "score_append",
    """SELECT c_nationkey::BIGINT AS step, round(avg(c_acctbal), 6) AS score FROM customer GROUP BY c_nationkey""",
)
def score_append(spark, sf_dir):
    """Metric records added to one file store in two goes."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("step")).agg(F.round(F.avg("c_acctbal"), 6).alias("score"))
    path = scratch_path(spark, "scores")
    O.append_scores(rows.where("step < 10"), path)
    O.append_scores(rows.where("step >= 10"), path)
    return spark.read.schema("step bigint, score double").json(path)


@query(
    "probability_store",
    """SELECT s_suppkey, [round(1 - (s_suppkey % 10) / 10.0, 6), round((s_suppkey % 10) / 10.0, 6)]::DOUBLE[] AS probabilities FROM supplier""",
)
def probability_store(spark, sf_dir):
    p = (F.col("s_suppkey") % 10) / 10.0
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.round(1 - p, 6), F.round(p, 6)).alias("p"))
    path = scratch_path(spark, "probabilities")
    O.write_probabilities(rows, path, "s_suppkey", "p")
    return spark.read.parquet(path)


@query(
    "template_file",
    """SELECT n_nationkey, template_name, question, len(choices)::INT AS n_choices FROM (
        SELECT n_nationkey, 'ask ' || unnest([0, 1]) AS template_name, 'Is it in ' || r_name || '?' AS question, ['No', 'Yes'] AS choices
        FROM nation JOIN region ON r_regionkey = n_regionkey)""",
)
def template_file(spark, sf_dir):
    """A catalogue of three templates per region as JSON lines, read, chosen and attached."""
    region = table(spark, sf_dir, "region")
    catalogue = region.select(
        F.col("r_name").alias("task"), F.explode(F.array(*map(F.lit, (2, 1, 0)))).alias("position"),
        F.concat(F.lit("Is it in "), "r_name", F.lit("?")).alias("question"),
        F.array(F.lit("No"), F.lit("Yes")).alias("choices"), F.array(F.lit("Accuracy")).alias("metrics"),
    ).withColumns({"template_name": F.concat(F.lit("ask "), "position"), "original_task": F.col("position") < 2})
    path = scratch_path(spark, "templates")
    catalogue.write.json(path)
    chosen = D.select_templates(C.read_templates(spark, path), -1)
    rows = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    attached = D.attach_template(rows.select("n_nationkey", F.col("r_name").alias("task")), chosen)
    return attached.select("n_nationkey", "template_name", "question", F.size("choices").alias("n_choices"))


@query(
    "field_settings",
    """SELECT r_name AS task, list(n_name ORDER BY n_name) AS fields, 'Answer for ' || r_name AS instruction
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def field_settings(spark, sf_dir):
    """Field order and instructions per task, as two kinds of JSON lines."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tasks = nation.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("fields"))
    order = tasks.select(F.to_json(F.create_map("r_name", "fields")).alias("value"))
    texts = tasks.select(F.to_json(F.create_map("r_name", F.concat(F.lit("Answer for "), "r_name"))).alias("value"))
    path = scratch_path(spark, "settings")
    order.union(texts).write.text(path)
    return C.read_field_settings(spark, path)


@query(
    "permutation_file",
    """SELECT n_nationkey::BIGINT AS id, (24 - n_nationkey)::BIGINT AS new_id FROM nation""",
)
def permutation_file(spark, sf_dir):
    """An exchange of ids as a JSON object per line."""
    pair = F.create_map(F.col("n_nationkey").cast("string"), (24 - F.col("n_nationkey")).cast("string"))
    path = scratch_path(spark, "permutation")
    table(spark, sf_dir, "nation").select(F.to_json(pair).alias("value")).write.text(path)
    return C.read_permutation(spark, path)


@query(
    "timeline_unknown",
    """SELECT user_id AS person_id, 'unheard-of ' || event_id AS text FROM events WHERE event_id % 9 = 0""",
)
def timeline_unknown(spark, sf_dir):
    """Strings that are neither visit data nor a concept; parsing them would be an error."""
    known = entries(spark, sf_dir)
    odd = F.when((F.col("pos") % 18 == 0), F.array(F.concat(F.lit("unheard-of "), F.floor(F.col("pos") / 2))))
    return T.unknown_strings(known.withColumn("concepts", F.concat("concepts", F.coalesce(odd, F.slice("concepts", 1, 0)))))
