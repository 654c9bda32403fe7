"""Labels, row keys, ranges, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscribe.operators import labels as L
from rowscribe.operators import ranking as R
from rowscribe.operators import splits as J
from rowscribe.operators.prompts import render_prompt
from rowscribe.operators.serialize import feature_template, serialize
from rowscribe.plans.registry import query, sql_clean, sql_hash, sql_strip, table, text_rows
from rowscribe.plans.serialization import CUSTOMER, CUSTOMER_FORMATS, SEGMENT_SQL, customers
from rowscribe.sources.tables import add_row_key

BALANCE_QUESTION = "Is the balance of this customer above the median? Yes or no?"
BALANCE_CHOICES = "No ||| Yes"
_BALANCE_NOTE = sql_clean(
    "'- Nation: ' || n_name || chr(10) || '- Market segment: ' || " + SEGMENT_SQL
    + " || chr(10) || '- Balance: ' || printf('%.2f', c_acctbal)"
)


@query(
    "customer_prompts",
    f"""WITH x AS (SELECT c_custkey, {_BALANCE_NOTE} AS note,
               (c_acctbal > (SELECT median(c_acctbal) FROM customer))::INT AS label
               FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, {sql_strip(f"note || chr(10) || chr(10) || '{BALANCE_QUESTION} Answer:'")} AS prompt,
           CASE label WHEN 1 THEN 'Yes' ELSE 'No' END AS answer, label FROM x""",
)
def customer_prompts(spark, sf_dir):
    """Load, label, serialize, prompt: the whole way from a table to a scored example."""
    rows = customers(spark, sf_dir)
    labelled = rows.withColumn("label", L.above_median("c_acctbal")(table(spark, sf_dir, "customer")))
    noted = serialize(labelled, feature_template(CUSTOMER, "list", CUSTOMER_FORMATS))
    return render_prompt(noted, BALANCE_QUESTION, BALANCE_CHOICES).select(
        "c_custkey", "prompt", "answer", "label"
    )


@query(
    "label_median",
    """SELECT c_custkey, (c_acctbal > (SELECT median(c_acctbal) FROM customer))::INT AS label
    FROM customer""",
)
def label_median(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select("c_custkey", L.above_median("c_acctbal")(customer).alias("label"))


@query(
    "exact_quantiles",
    """SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS q50 FROM orders
       GROUP BY 1""",
)
def exact_quantiles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [
        R.exact_quantiles(orders.where(F.col("o_orderstatus") == status), "o_totalprice", {"q50": 0.5})
        .select(F.lit(status).alias("o_orderstatus"), "q50")
        for status in ("F", "O", "P")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "label_bins",
    """SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10.5 THEN 0
        WHEN p_size > 10.5 AND p_size <= 50 THEN 1 ELSE error('outside') END AS label FROM part""",
)
def label_bins(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", L.binned("p_size", (0, 10.5, 50))(part).alias("label"))


@query(
    "label_dict",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
        WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4
        ELSE error('no label') END AS label FROM orders""",
)
def label_dict(spark, sf_dir):
    codes = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", L.coded("o_orderpriority", codes)(orders).alias("label"))


@query(
    "label_rules",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INT AS is_finished,
        (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS is_fast,
        substr(o_orderpriority, 1, 1)::INT - 1 AS shifted FROM orders""",
)
def label_rules(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("digit", F.substring("o_orderpriority", 1, 1))
    return orders.select(
        "o_orderkey",
        L.equals("o_orderstatus", "F")(orders).alias("is_finished"),
        L.one_of("o_orderpriority", ("1-URGENT", "2-HIGH"))(orders).alias("is_fast"),
        L.shifted("digit")(orders).alias("shifted"),
    )


@query(
    "label_counts",
    """SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic""",
)
def label_counts(spark, sf_dir):
    return (
        table(spark, sf_dir, "labels")
        .groupBy("quality", "toxic")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "row_key",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::VARCHAR AS shipped,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_shipdate, l_quantity, l_extendedprice) - 1 AS idx FROM lineitem""",
)
def row_key(spark, sf_dir):
    order = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice",
    ]
    lines = text_rows(spark, sf_dir, "lineitem", *order)
    return add_row_key(lines, order).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"), "idx",
    )


@query(
    "row_range",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900",
)
def row_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 900)).select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "split_ordered",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n
                 FROM orders),
    s AS (SELECT *, ceil(0.2 * n)::BIGINT AS held, ceil(0.5 * ceil(0.2 * n))::BIGINT AS test FROM r)
    SELECT o_orderkey, CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - test THEN 'validation'
        ELSE 'test' END AS split FROM s""",
)
def split_ordered(spark, sf_dir):
    return J.split_ordered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "split_seeded",
    f"""WITH r AS (SELECT o_orderkey, count(*) OVER () AS n,
               row_number() OVER (ORDER BY {sql_hash(42, "'split'", 'o_orderkey')}, o_orderkey) AS rn
               FROM orders)
    SELECT o_orderkey, CASE WHEN rn <= n - ceil(0.2 * n)::BIGINT THEN 'train' ELSE 'validation' END
        AS split FROM r""",
)
def split_seeded(spark, sf_dir):
    return J.split_seeded(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 42)


SEEDS = (42, 1024, 0, 1, 32)


@query(
    "split_seeds",
    f"""WITH g AS (SELECT doc_id, seed FROM labels, (SELECT unnest({list(SEEDS)}) AS seed)),
    r AS (SELECT doc_id, seed, count(*) OVER (PARTITION BY seed) AS n,
          row_number() OVER (PARTITION BY seed ORDER BY {sql_hash('seed', "'split'", 'doc_id')}, doc_id) AS rn
          FROM g)
    SELECT doc_id, seed, CASE WHEN rn <= n - ceil(0.2 * n)::BIGINT THEN 'train' ELSE 'validation' END
        AS split FROM r""",
)
def split_seeds(spark, sf_dir):
    return J.split_seeds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", SEEDS)


@query(
    "split_routes",
    """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n
                 FROM customer),
    s AS (SELECT *, ceil(0.2 * n)::BIGINT AS held, ceil(0.5 * ceil(0.2 * n))::BIGINT AS test FROM r),
    t AS (SELECT c_custkey, CASE WHEN rn <= n - held THEN 'train' WHEN rn <= n - test THEN 'validation'
        ELSE 'test' END AS split FROM s)
    SELECT c_custkey, CASE split WHEN 'train' THEN 'validation' WHEN 'validation' THEN 'test'
        ELSE split END AS story_split,
        CASE split WHEN 'validation' THEN 'test' ELSE split END || '_r2' AS round_split,
        CASE WHEN c_custkey BETWEEN 20 AND 29 THEN 'validation' ELSE 'train' END AS slice_split FROM t""",
)
def split_routes(spark, sf_dir):
    split = J.split_ordered(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    sliced = J.hold_out_range(split, "c_custkey", 20, out="slice_split")
    return sliced.select(
        "c_custkey",
        J.route_split(F.col("split"), J.STORY_ROUTES).alias("story_split"),
        J.route_split(F.col("split"), J.ROUND_ROUTES, "_r2").alias("round_split"),
        "slice_split",
    )


@query(
    "stratified_folds",
    f"""WITH k AS (SELECT least(min(c), 4) AS folds FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
    SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality
        ORDER BY {sql_hash(42, "'fold'", 'doc_id')}, doc_id) - 1) % (SELECT folds FROM k))::INT AS fold
    FROM labels""",
)
def stratified_folds(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return J.stratified_folds(labels, "doc_id", "quality", 42)
