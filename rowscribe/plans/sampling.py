"""Shuffles, few-shot draws, perturbed rows and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscribe.functions.hashing import uniform
from rowscribe.operators import perturb as B
from rowscribe.operators import sampling as K
from rowscribe.operators import splits as J
from rowscribe.operators.report import experiment_grid
from rowscribe.plans.registry import (
    query,
    sql_hash,
    sql_hash_int,
    sql_uniform,
    table,
)

SHOTS = (4, 8, 16, 32, 64, 128, 256, 512)
SEEDS = (42, 1024, 0, 1, 32)


@query(
    "shuffle_top_n",
    f"""SELECT doc_id, lang FROM documents
    ORDER BY {sql_hash(11, "'shuffle'", 'doc_id')}, doc_id LIMIT 50""",
)
def shuffle_top_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return K.first_after_shuffle(docs, "doc_id", 11, 50)


def _few_shot_sql(rows: str, shots, seeds: str) -> str:
    """Draws over rows(seed, doc_id, label)."""
    return f"""r AS MATERIALIZED ({rows}),
    p AS MATERIALIZED (SELECT seed, doc_id, label, count(*) OVER (PARTITION BY seed, label) AS n,
        row_number() OVER (PARTITION BY seed, label ORDER BY {sql_hash("'order'", 'doc_id')}, doc_id) - 1 AS pos FROM r),
    l AS (SELECT seed, label, max(n) AS n, count(*) OVER (PARTITION BY seed) AS labels,
                 max(label) OVER (PARTITION BY seed) AS last FROM p GROUP BY seed, label),
    g AS (SELECT l.*, num_shot, CASE WHEN label = last THEN num_shot - (labels - 1) * (num_shot // labels)
                 ELSE num_shot // labels END AS draws FROM l, (SELECT unnest({list(shots)}) AS num_shot)),
    d AS (SELECT seed, num_shot, label, j, {sql_hash_int('seed', 'num_shot', "'draw'", 'label', 'j')} % n AS pos
          FROM (SELECT *, unnest(range(draws)) AS j FROM g)),
    s AS (SELECT d.seed::INT AS seed, d.num_shot::INT AS num_shot, row_number() OVER (PARTITION BY d.seed, d.num_shot
            ORDER BY {sql_hash('d.seed', 'd.num_shot', "'place'", 'd.label', 'd.j')}, d.label, d.j) - 1 AS draw_no,
          p.doc_id, d.label FROM d JOIN p ON d.seed = p.seed AND d.label = p.label AND d.pos = p.pos)"""


_ALL_ROWS = "SELECT 42 AS seed, doc_id, quality AS label FROM labels"
_TRAIN_ROWS = f"""SELECT seed, doc_id, quality AS label FROM (
    SELECT seed, doc_id, quality, count(*) OVER (PARTITION BY seed) AS n,
        row_number() OVER (PARTITION BY seed ORDER BY {sql_hash('seed', "'split'", 'doc_id')}, doc_id) AS rn
    FROM labels, (SELECT unnest({list(SEEDS)}) AS seed)) WHERE rn <= n - ceil(0.2 * n)::BIGINT"""


@query(
    "few_shot_balanced",
    f"""WITH {_few_shot_sql(_ALL_ROWS, (64,), '42')}
    SELECT seed, num_shot, draw_no::INT AS draw_no, doc_id, label AS quality FROM s""",
)
def few_shot_balanced(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return K.few_shot_sample(labels, "doc_id", "quality", [64], [42])


def _training_rows(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return J.split_seeds(labels, "doc_id", SEEDS).where(F.col("split") == "train")


@query(
    "few_shot_grid",
    f"""WITH {_few_shot_sql(_TRAIN_ROWS, SHOTS, str(list(SEEDS)))}
    SELECT seed, num_shot, draw_no::INT AS draw_no, doc_id, label AS quality FROM s""",
)
def few_shot_grid(spark, sf_dir):
    """All shots and seeds of the sweep in one job."""
    train = _training_rows(spark, sf_dir)
    return K.few_shot_sample(train, "doc_id", "quality", SHOTS, seed_column="seed")


@query(
    "few_shot_all",
    f"""WITH {_few_shot_sql(_TRAIN_ROWS, (16,), str(list(SEEDS)))}
    SELECT seed, num_shot::VARCHAR AS num_shot, draw_no, doc_id, label AS quality FROM s
    UNION ALL SELECT seed::INT, 'all', row_number() OVER (PARTITION BY seed ORDER BY {sql_hash('seed', "'shuffle'", 'doc_id')}, doc_id) - 1,
        doc_id, label FROM r""",
)
def few_shot_all(spark, sf_dir):
    """A draw and the whole training set side by side, for every seed."""
    return K.training_sets(_training_rows(spark, sf_dir), "doc_id", "quality", (16, "all"))


@query(
    "unlabelled_pool",
    f"""WITH {_few_shot_sql(_TRAIN_ROWS, (64,), str(list(SEEDS)))}
    SELECT r.seed::INT AS seed, r.doc_id FROM r
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.seed = r.seed AND s.doc_id = r.doc_id)""",
)
def unlabelled_pool(spark, sf_dir):
    train = _training_rows(spark, sf_dir)
    sample = K.few_shot_sample(train, "doc_id", "quality", [64], seed_column="seed")
    return K.unlabelled_pool(train.select("seed", "doc_id"), sample, ["seed", "doc_id"])


@query(
    "few_shot_rows",
    f"""WITH {_few_shot_sql(_ALL_ROWS, (16, 32), '42')}
    SELECT num_shot, draw_no::INT AS draw_no, s.doc_id, label AS quality, md5(text) AS text_md5
    FROM s JOIN documents d ON d.doc_id = s.doc_id""",
)
def few_shot_rows(spark, sf_dir):
    """The rows behind the draws, repeats kept."""
    draws = K.few_shot_sample(table(spark, sf_dir, "labels"), "doc_id", "quality", [16, 32], [42])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return draws.join(docs, "doc_id").select(
        "num_shot", "draw_no", "doc_id", "quality", F.md5("text").alias("text_md5")
    )


@query(
    "experiment_grid",
    f"""SELECT lang, num_shot, seed, count(*) AS n FROM documents,
        (SELECT unnest({list(SHOTS)}) AS num_shot), (SELECT unnest({list(SEEDS)}) AS seed) GROUP BY 1, 2, 3""",
)
def experiment_grid_query(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return experiment_grid(langs, SHOTS, SEEDS)


DOMAINS = {"s_nationkey": tuple(range(25)), "s_acctbal": 9999}


def _perturb_sql(column: str, value: str) -> str:
    draw = f"3, '{column}', s_suppkey, copy_no".split(", ")
    return (
        f"CASE WHEN {sql_uniform(chr(39) + 'hit' + chr(39), *draw)} < 2.0::DOUBLE / 12.0::DOUBLE "
        f"THEN {value} ELSE {column} END AS {column}"
    )


@query(
    "perturb_rows",
    f"""SELECT s_suppkey, copy_no::INT AS copy_no,
        {_perturb_sql('s_nationkey', "(" + sql_hash_int("'value'", 3, "'s_nationkey'", 's_suppkey', 'copy_no') + " % 25)::INT")},
        {_perturb_sql('s_acctbal', "floor(" + sql_uniform("'value'", 3, "'s_acctbal'", 's_suppkey', 'copy_no') + " * 9999.0::DOUBLE)")}
    FROM supplier, range(1, 21) t(copy_no)""",
)
def perturb_rows(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return B.perturb_rows(supplier, "s_suppkey", DOMAINS, seed=3)


_DROP = sql_uniform("'drop'", "vec_id", "copy_no", "i - 1")


@query(
    "perturb_weights",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, unnest(range(1, 6)) AS copy_no FROM embeddings),
    p AS (SELECT vec_id, copy_no, a, list_transform(a, lambda x, i:
        CASE WHEN {_DROP} < 2.0::DOUBLE / 12.0::DOUBLE THEN 0.0::DOUBLE ELSE x END) AS b FROM e)
    SELECT vec_id, copy_no::INT AS copy_no, round(list_dot_product(a, b)
        / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS weight FROM p""",
)
def perturb_weights(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    copies = vectors.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(5))))
    vec, copy = F.col("vec_id"), F.col("copy_no")
    dropped = F.transform(
        "embedding",
        lambda x, i: F.when(uniform("drop", vec, copy, i) < B.SHARE, F.lit(0.0).cast("float"))
        .otherwise(x),
    )
    perturbed = copies.withColumn("embedding", dropped)
    weighed = B.paired_weights(vectors, perturbed, "vec_id", "embedding")
    return weighed.select("vec_id", "copy_no", F.round("weight", 6).alias("weight"))


DENIED = ("src3", "src7")


@query(
    "mixture_cap",
    f"""WITH c AS (SELECT source, least(count(*), 120 // (1 + CAST(substr(source, 4) AS INT) % 4)) AS cap
                  FROM documents WHERE source NOT IN {DENIED} GROUP BY source),
    d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id, d.source, cap FROM d JOIN c ON c.source = d.source WHERE rn <= cap""",
)
def mixture_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = K.deny(docs, "source", DENIED).groupBy("source").agg(
        F.count(F.lit(1)).alias("train_size"),
        F.max(1 + F.substring("source", 4, 2147483647).cast("int") % 4).alias("templates"),
    )
    caps = K.mixture_caps(sizes, "templates", "train_size", total=120)
    return K.cap_rows(docs, caps, "source", "doc_id")


@query(
    "mixture_union",
    """SELECT 'docs' AS task, doc_id AS id, text AS body, lang FROM documents UNION ALL
    SELECT 'pages', page_id, url, NULL FROM pages UNION ALL
    SELECT 'bench', item_id, text, NULL FROM benchmark""",
)
def mixture_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS body", "lang")
    pages = table(spark, sf_dir, "pages").selectExpr("page_id AS id", "url AS body")
    bench = table(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "text AS body")
    return K.union_tasks({"docs": docs, "pages": pages, "bench": bench})


@query(
    "permute_ids",
    """SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 100000 + o_custkey ELSE o_custkey END AS o_custkey
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def permute_ids(spark, sf_dir):
    """Ids exchanged by a table of pairs; customers in debt have no pair and stay."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    pairs = customers.selectExpr("c_custkey AS id", "100000 + c_custkey AS new_id")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return K.permute_ids(orders, pairs, "o_custkey")
