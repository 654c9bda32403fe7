"""Sources and sinks: what is written is read again and compared with its origin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe.functions import text as X
from rowscribe.operators import answers as A
from rowscribe.operators import metrics as M
from rowscribe.operators import sampling as K
from rowscribe.operators import splits as J
from rowscribe.operators import tasks as B
from rowscribe.operators import prompts as D
from rowscribe.operators.report import mean_std, result_grid, result_text
from rowscribe.operators.serialize import feature_template
from rowscribe.plans.registry import query, sql_clean, sql_hash, sql_strip, table
from rowscribe.plans.sampling import _ALL_ROWS, _few_shot_sql
from rowscribe.plans.scoring import _auc_sql
from rowscribe.plans.serialization import PART, PART_FORMATS, PART_LIST_SQL, part_notes
from rowscribe.session import scratch_path
from rowscribe.sources import catalogs as C
from rowscribe.sources import stores as O
from rowscribe.sources import tables as S
from rowscribe.streaming.notes import append_outputs, prompt_stream


@query(
    "arff_scan",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_name || ', it''s' END AS s_name, s_acctbal FROM supplier""",
)
def arff_scan(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 7 != 0, F.concat("s_name", F.lit(", it's")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("s_name"), "s_acctbal")
    path = scratch_path(spark, "arff")
    S.write_arff(rows, path, "supplier")
    return S.read_arff(spark, f"{path}/data", f"{path}/head").withColumn(
        "s_suppkey", F.col("s_suppkey").cast("bigint")
    )


@query(
    "csv_scan",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, c_acctbal AS balance FROM customer""",
)
def csv_scan(spark, sf_dir):
    """Headerless lines with blanks around values and '?' for missing ones."""
    segment = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise("?")
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").select(
        F.concat_ws(" , ", "c_custkey", segment, "c_acctbal").alias("value")
    ).write.text(path)
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("segment", T.StringType()),
            T.StructField("balance", T.DoubleType()),
        ]
    )
    return S.trim_strings(S.read_csv(spark, path, schema, null_token="?"))


@query(
    "csv_header_scan",
    "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM part",
)
def csv_header_scan(spark, sf_dir):
    """A file with a header whose names are replaced."""
    path = scratch_path(spark, "csv-header")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.option(
        "header", True
    ).csv(path)
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("title", T.StringType()),
            T.StructField("price", T.DoubleType()),
        ]
    )
    return S.read_csv(spark, path, schema, header=True)


@query(
    "binary_columns",
    "SELECT n_nationkey, n_name FROM nation",
)
def binary_columns(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.encode("n_name", "UTF-8").alias("n_name")
    )
    return S.decode_binary(nation)


_SPLIT_SQL = f"""CASE WHEN row_number() OVER (ORDER BY {sql_hash(42, "'split'", 'p_partkey')}, p_partkey)
    <= count(*) OVER () - ceil(0.2 * count(*) OVER ())::BIGINT THEN 'train' ELSE 'validation' END"""


@query(
    "notes_store",
    f"""WITH n AS (SELECT p_partkey, p_size, {sql_clean(PART_LIST_SQL)} AS note, {_SPLIT_SQL} AS split FROM part)
    SELECT p_partkey AS idx, note, (p_size > 25)::INT AS label FROM n WHERE split = 'validation'""",
)
def notes_store(spark, sf_dir):
    """Serialized rows of one split, written in folders and read back by filter."""
    label = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") > 25).cast("int").alias("label")
    )
    notes = part_notes(spark, sf_dir).join(label, "p_partkey")
    split = J.split_seeded(notes, "p_partkey", 42).withColumnRenamed("p_partkey", "idx")
    path = scratch_path(spark, "notes")
    O.write_notes(split, path, "part", "list")
    return O.read_notes(spark, path, "part", "list", "validation").select("idx", "note", "label")


@query(
    "few_shot_cache",
    f"""WITH {_few_shot_sql(_ALL_ROWS, (32,), '42')}
    SELECT draw_no::INT AS draw_no, doc_id, label AS quality FROM s""",
)
def few_shot_cache(spark, sf_dir):
    """A draw that is written at the first reading and reused at the second."""
    labels = table(spark, sf_dir, "labels")
    path = O.few_shot_path(scratch_path(spark, "few-shot"), "labels", 32, 42)
    schema = "draw_no int, doc_id bigint, quality int"
    draw = lambda: K.few_shot_sample(labels, "doc_id", "quality", [32], [42]).select(
        "draw_no", "doc_id", "quality"
    )
    O.read_or_create(spark, path, draw, schema)

    def not_again():
        raise RuntimeError("the cached draw was not found")

    return O.read_or_create(spark, path, not_again, schema)


@query(
    "experiment_bundle",
    f"""WITH {_few_shot_sql("SELECT 42 AS seed, doc_id, quality AS label FROM (SELECT doc_id, quality, count(*) OVER () AS n, row_number() OVER (ORDER BY " + sql_hash(42, "'split'", 'doc_id') + ", doc_id) AS rn FROM labels) WHERE rn <= n - ceil(0.2 * n)::BIGINT", (32,), '42')}
    SELECT 'train' AS role, doc_id, label AS quality, count(*) AS copies FROM s GROUP BY ALL UNION ALL
    SELECT 'unlab', doc_id, label, 1 FROM r WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL
    SELECT 'test', doc_id, quality, 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM r)""",
)
def experiment_bundle(spark, sf_dir):
    """Training draw, unlabelled rest and holdout of one experiment in one table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    split = J.split_seeded(labels, "doc_id", 42)
    train = split.where("split = 'train'").drop("split")
    holdout = split.where("split <> 'train'").drop("split")
    sample = K.few_shot_sample(train, "doc_id", "quality", [32], [42])
    pool = K.unlabelled_pool(train, sample, ["doc_id"])
    path = scratch_path(spark, "bundle")
    keys = {"dataset": "labels", "num_shot": 32, "seed": 42}
    O.write_bundle(sample.select("doc_id", "quality"), pool, holdout, path, keys)
    return spark.read.parquet(path).groupBy("role", "doc_id", "quality").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query(
    "predictions_store",
    """SELECT o_orderkey AS "ID", ['late', 'on time'][o_custkey % 2 + 1] AS "Label" FROM orders""",
)
def predictions_store(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 2).alias("prediction")
    )
    path = scratch_path(spark, "predictions")
    O.write_predictions(rows, path, "o_orderkey", "prediction", ["late", "on time"])
    return spark.read.schema("ID bigint, Label string").option("header", True).csv(path)


@query(
    "stored_outputs",
    """SELECT o_orderkey, round(1 - (o_custkey % 100) / 100.0::DOUBLE, 9) AS p0,
        round((o_custkey % 100) / 100.0::DOUBLE, 9) AS p1 FROM orders""",
)
def stored_outputs(spark, sf_dir):
    """Model outputs written as CSV, read again and joined by key."""
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "outputs")
    stored = X.fixed_text(2)((F.col("o_custkey") % 100) / 100)
    O.write_outputs(orders.select(F.col("o_orderkey").alias("idx"), stored.alias("output0")), path)
    keyed = orders.select(F.col("o_orderkey").alias("idx"))
    joined = A.attach_outputs(keyed, O.read_outputs(spark, path), "idx")
    return joined.select(
        F.col("idx").alias("o_orderkey"),
        *[F.round(F.element_at("probabilities", i + 1), 9).alias(f"p{i}") for i in range(2)],
    )


_RUNS = """r AS (SELECT 'm3b' AS model, lower(o_orderstatus) || '_list' AS dataset, substr(o_orderpriority, 1, 1) AS num_shot,
        (o_custkey % 5)::VARCHAR AS seed, year(o_orderdate) * 12 + month(o_orderdate) AS num_steps,
        round(avg(o_totalprice) / 1000000, 6) AS "AUC" FROM orders GROUP BY ALL),
    l AS (SELECT model, dataset, num_shot, seed, max(num_steps) AS num_steps, arg_max("AUC", num_steps) AS "AUC"
        FROM r GROUP BY ALL)"""


def score_folders(spark, sf_dir) -> str:
    """Evaluation records by experiment and step, one line per step, in the experiment's
    folder. Steps are months, so a folder has as many lines as there are months."""
    orders = table(spark, sf_dir, "orders")
    folder = F.concat(
        F.lit("m3b_"), F.lower("o_orderstatus"), F.lit("_list_numshot"),
        F.substring("o_orderpriority", 1, 1), F.lit("_seed"),
        (F.col("o_custkey") % 5).cast("string"), F.lit("_ia3"),
    )
    step = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    records = orders.groupBy(folder.alias("exp"), step.cast("bigint").alias("num_steps")).agg(
        F.round(F.avg("o_totalprice") / 1000000, 6).alias("AUC")
    )
    path = scratch_path(spark, "scores")
    in_order = records.repartition("exp").sortWithinPartitions("exp", "num_steps")
    in_order.write.partitionBy("exp").json(path)
    return path


@query(
    "jsonl_last_record",
    f"""WITH {_RUNS} SELECT model, dataset, num_shot, seed, 'ia3' AS spec, num_steps, "AUC" FROM l""",
)
def jsonl_last_record(spark, sf_dir):
    path = score_folders(spark, sf_dir)
    return O.last_records(spark, f"{path}/exp=*", "num_steps bigint, AUC double").drop("folder")


@query(
    "result_summary",
    f"""WITH {_RUNS}, c AS (SELECT dataset, num_shot, printf('%.2f', round(avg("AUC") * 100, 6)) || ' ('
        || printf('%.2f', round(stddev_pop("AUC") * 100, 6)) || ')' AS t FROM l GROUP BY ALL)
    SELECT dataset, {', '.join(f"max(t) FILTER (num_shot = '{n}') AS shots_{n}" for n in range(1, 6))} FROM c GROUP BY dataset""",
)
def result_summary(spark, sf_dir):
    """From score folders to the summary file: mean and deviation over seeds."""
    path = score_folders(spark, sf_dir)
    last = O.last_records(spark, f"{path}/exp=*", "num_steps bigint, AUC double")
    cells = mean_std(last, ["dataset", "num_shot"], "AUC")
    mean, std = F.round(F.col("mean") * 100, 6), F.round(F.col("std") * 100, 6)
    worded = cells.withColumn("text", result_text(mean, std, F.col("n")))
    grid = result_grid(worded, "dataset", "num_shot", [str(n) for n in range(1, 6)], "text")
    out = scratch_path(spark, "summary")
    O.write_summary(grid.withColumnsRenamed({str(n): f"shots_{n}" for n in range(1, 6)}), out)
    schema = "dataset string, " + ", ".join(f"shots_{n} string" for n in range(1, 6))
    return spark.read.schema(schema).option("header", True).csv(out)


@query(
    "task_catalogue",
    r"""WITH t AS (SELECT source AS dataset, CASE WHEN lang <> 'en' THEN lang END AS subset, count(*) AS train_size,
        1 + length(lang || source) % 3 AS n_templates FROM documents WHERE CAST(substr(source, 4) AS INT) % 2 = 0 GROUP BY source, lang),
    n AS (SELECT *, unnest(range(n_templates)) AS i FROM t)
    SELECT dataset, subset, 'ask ' || i AS template_name, train_size, n_templates::BIGINT AS n_templates,
        dataset || coalesce('_' || subset || '_', '_') || 'ask_' || i AS task,
        least(train_size, 20 // n_templates)::BIGINT AS cap FROM n""",
)
def task_catalogue(spark, sf_dir):
    """A task table as CSV, joined with its templates, with the rows each may give."""
    docs = table(spark, sf_dir, "documents")
    base = F.substring("source", 4, 2147483647).cast("int") % 2 == 0
    sizes = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("train_size"))
    subset = F.when(F.col("lang") != "en", F.col("lang")).otherwise("")
    path = scratch_path(spark, "tasks")
    sizes.select(
        F.col("source").alias("HF_name"), subset.alias("subset"), F.lit("qa").alias("task_by_convention"),
        F.when(base, "BASE").otherwise("SGLUE").alias("do_train"), F.lit("").alias("do_eval"),
        F.col("train_size").cast("string").alias("train_size"),
    ).write.option("header", True).option("emptyValue", "").csv(path)
    count = 1 + F.length(F.concat("lang", "source")) % 3
    templates = sizes.select(
        F.col("source").alias("dataset"),
        F.nullif(subset, F.lit("")).alias("subset"),
        F.explode(F.sequence(F.lit(0), count - 1)).alias("i"),
    ).select("dataset", "subset", F.concat(F.lit("ask "), "i").alias("template_name"))
    chosen = C.training_tasks(C.read_tasks(spark, path), templates, "BASE")
    return K.mixture_caps(chosen, "n_templates", "train_size", total=20)


@query(
    "dictionary_scan",
    """SELECT p_partkey AS concept_id, p_name || ' "x"' AS value FROM part UNION ALL
    SELECT p_partkey + 1000000, p_brand FROM part""",
)
def dictionary_scan(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    entries = F.create_map(
        F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(' "x"')),
        (F.col("p_partkey") + 1000000).cast("string"), F.col("p_brand"),
    )
    table(spark, sf_dir, "part").select(F.to_json(entries).alias("value")).write.text(path)
    return C.read_values(spark, path)


@query(
    "short_names",
    """WITH n AS (SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || CASE WHEN p_size % 2 = 0 THEN '. ' ELSE ' ' END AS a,
        upper(p_name) || '!' AS b FROM part)
    SELECT p_partkey, lower(substr(a, 1, 1)) || substr(regexp_replace(trim(a), '\\.$', ''), 2) AS mixed,
        lower(substr(b, 1, length(b) - 1)) AS shouted FROM n""",
)
def short_names(spark, sf_dir):
    mixed = F.concat(
        F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 2147483647),
        F.when(F.col("p_size") % 2 == 0, ". ").otherwise(" "),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.short_name(mixed).alias("mixed"),
        X.short_name(F.concat(F.upper("p_name"), F.lit("!"))).alias("shouted"),
    )


_TASK_ROWS = """x AS (SELECT c_custkey, c_custkey % 2 + 1 AS answer, ['train', 'validation', 'test'][c_custkey % 3 + 1] AS split FROM customer)"""


@query(
    "task_rows",
    f"""WITH {_TASK_ROWS} SELECT 'winogrande' AS task, c_custkey, (answer - 1)::INT AS label FROM x WHERE split = 'train'
    UNION ALL SELECT 'storycloze', c_custkey, (answer - 1)::INT FROM x WHERE split = 'test'""",
)
def task_rows(spark, sf_dir):
    """Rows of benchmark tasks by their rules: one-based labels, splits under other names."""
    place = F.element_at(
        F.array(F.lit("train"), F.lit("validation"), F.lit("test")),
        (F.col("c_custkey") % 3 + 1).cast("int"),
    )
    answer = (F.col("c_custkey") % 2 + 1).cast("string")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", place.alias("split"), answer.alias("answer"),
        answer.alias("answer_right_ending"),
    )
    parts = {
        "winogrande": B.read_task(rows, B.task_rule("winogrande_4", 4), "train"),
        "storycloze": B.read_task(rows, B.task_rule("storycloze"), "validation"),
    }
    return K.union_tasks(parts).select("task", "c_custkey", "label")


STREAM_QUESTION = "Is this part large? Yes or no?"


@query(
    "stream_prompts",
    f"""WITH n AS (SELECT p_partkey, (p_size > 25)::INT AS label, {sql_clean(PART_LIST_SQL)} AS note FROM part)
    SELECT p_partkey, {sql_strip(f"note || chr(10) || chr(10) || '{STREAM_QUESTION} Answer:'")} AS prompt,
        ['No', 'Yes'][label + 1] AS answer FROM n""",
)
def stream_prompts(spark, sf_dir):
    """Prompts of rows that arrive as a stream of files, appended batch by batch."""
    part = table(spark, sf_dir, "part")
    arriving = spark.readStream.schema(part.schema).option("pathGlobFilter", "part.parquet")
    stream = arriving.parquet(sf_dir)
    labelled = stream.withColumn("label", (F.col("p_size") > 25).cast("int"))
    template = feature_template(PART, "list", PART_FORMATS)
    prompts = prompt_stream(labelled, template, STREAM_QUESTION, "No ||| Yes")
    path = scratch_path(spark, "stream")
    run = append_outputs(prompts.select("p_partkey", "prompt", "answer"), path, f"{path}-checkpoint")
    run.awaitTermination()
    return spark.read.schema("p_partkey bigint, prompt string, answer string").json(path)


@query(
    "request_records",
    """SELECT c_custkey, to_json({'prompt': c_name || ' "' || c_mktsegment || '"', 'temperature': 0,
        'max_tokens': 1, 'logprobs': 50})::VARCHAR AS request FROM customer""",
)
def request_records(spark, sf_dir):
    text = F.concat(F.lit("\n "), "c_name", F.lit(' "'), "c_mktsegment", F.lit('"\n'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("prompt"))
    return D.request_table(rows, "c_custkey", "prompt")


@query(
    "zero_shot_score",
    f"""WITH v AS (SELECT o_orderkey, ((o_orderkey * 7 + o_custkey) % 4)::INT AS label, [(o_custkey % 7 + 1)::DOUBLE, (o_orderkey % 5)::DOUBLE,
        (o_custkey % 3)::DOUBLE, (o_orderkey % 11)::DOUBLE] AS w FROM orders),
    q AS MATERIALIZED (SELECT label, unnest(range(4)) AS class, unnest(list_transform(w, lambda x: x / (w[1] + w[2] + w[3] + w[4]))) AS score FROM v)
    SELECT round(avg(auc), 9) AS roc_auc_ovr FROM ({_auc_sql('q', 'label = class', 'score', 'class')})""",
)
def zero_shot_score(spark, sf_dir):
    """Stored probability lists scored without a model."""
    orders = table(spark, sf_dir, "orders")
    stored = F.concat_ws(
        ", ", F.col("o_custkey") % 7 + 1, F.col("o_orderkey") % 5, F.col("o_custkey") % 3,
        F.col("o_orderkey") % 11,
    )
    label = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 4).cast("int")
    rows = orders.select(label.alias("label"), A.probability_list(stored).alias("probabilities"))
    area = M.roc_auc_ovr(rows, "label", "probabilities")
    return area.select(F.round("roc_auc_ovr", 9).alias("roc_auc_ovr"))
