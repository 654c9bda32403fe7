"""Choice scores, metrics, result tables and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscribe.functions.arrays import argmax, normalised
from rowscribe.operators import batching as P
from rowscribe.operators import metrics as M
from rowscribe.operators import report as R
from rowscribe.operators import scoring as C
from rowscribe.plans.registry import query, table, text_rows

# A token table from line items: an order is an example, a line a token of one of three
# choices; returned lines are padding.
_TOKENS = """t AS (SELECT l_orderkey AS idx, (l_orderkey % 3)::INT AS label, l_linenumber % 3 AS choice,
    l_discount * 10 + l_tax + 0.01 AS nll, l_returnflag = 'R' AS is_pad FROM lineitem)"""
_SCORES = """s AS (SELECT idx, label, choice, sum(CASE WHEN is_pad THEN 0 ELSE nll END)
    / nullif(pow(sum((NOT is_pad)::INT), 0.5), 0) AS score, sum((NOT is_pad)::INT)::BIGINT AS length
    FROM t GROUP BY ALL)"""


def tokens(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("idx"),
        (F.col("l_orderkey") % 3).cast("int").alias("label"),
        (F.col("l_linenumber") % 3).alias("choice"),
        (F.col("l_discount") * 10 + F.col("l_tax") + 0.01).alias("nll"),
        (F.col("l_returnflag") == "R").alias("is_pad"),
    )


@query(
    "choice_scores",
    f"""WITH {_TOKENS}, {_SCORES} SELECT idx, label, choice, round(score, 6) AS score, length FROM s""",
)
def choice_scores(spark, sf_dir):
    scores = C.choice_scores(tokens(spark, sf_dir), ["idx", "label"], length_norm=0.5)
    return scores.withColumn("score", F.round("score", 6))


@query(
    "choice_predictions",
    f"""WITH {_TOKENS}, {_SCORES}, k AS (SELECT * FROM s WHERE score IS NOT NULL),
    p AS (SELECT idx, label, arg_min(choice, (round(score, 9), choice)) AS prediction, sum(exp(-score)) AS z,
        max(score) FILTER (choice = label) AS score_gt, min(score) FILTER (choice <> label) AS rival,
        max(score) AS worst, min(score) AS best FROM k GROUP BY idx, label)
    SELECT idx, label, prediction, round(exp(-best) / z, 6) AS top_probability,
        round(score_gt, 6) AS score_gt, round(coalesce(rival, worst), 6) AS score_cand FROM p""",
)
def choice_predictions(spark, sf_dir):
    scores = C.choice_scores(tokens(spark, sf_dir), ["idx", "label"], length_norm=0.5)
    # equal sums may differ in their last digit by the order of addition
    scored = scores.where(F.col("score").isNotNull()).withColumn("score", F.round("score", 9))
    return C.predict(scored, ["idx", "label"], "label").select(
        "idx", "label", "prediction",
        F.round(F.array_max("probabilities"), 6).alias("top_probability"),
        F.round("score_gt", 6).alias("score_gt"),
        F.round("score_cand", 6).alias("score_cand"),
    )


@query(
    "choice_fan_out",
    """SELECT c_custkey, unnest([0, 1, 2])::INT AS choice, unnest(['No', 'Yes', c_mktsegment]) AS choice_text
    FROM customer""",
)
def choice_fan_out(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn(
        "choices", F.array(F.lit("No"), F.lit("Yes"), F.col("c_mktsegment"))
    )
    return C.choice_rows(rows, "choices", ["c_custkey"])


@query(
    "loss_terms",
    f"""WITH {_TOKENS}, s AS (SELECT idx, label, choice, sum(CASE WHEN is_pad THEN 0 ELSE nll END) AS score
        FROM t GROUP BY ALL),
    m AS (SELECT idx, ln(sum(exp(-score))) + max(score) FILTER (choice = label) AS mc FROM s GROUP BY idx)
    SELECT round(avg(nll) FILTER (choice = label AND NOT is_pad), 6) AS lm_loss,
        round(sum(-ln(1 - exp(CASE WHEN choice <> label AND NOT is_pad THEN -nll ELSE -100.0 END) + 0.01))
            / sum((choice <> label AND NOT is_pad)::INT), 6) AS unlikely_loss,
        round((SELECT avg(mc) FROM m), 6) AS mc_loss FROM t""",
)
def loss_terms(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    scores = C.choice_scores(rows, ["idx", "label"])
    terms = C.loss_terms(rows, scores, ["idx", "label"], "label")
    return terms.select(*[F.round(c, 6).alias(c) for c in terms.columns])


_SCORED = """x AS (SELECT l.doc_id, quality, toxic, n_chars, lang, (n_chars > 800)::INT AS prediction
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def scored_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn(
        "prediction", (F.col("n_chars") > 800).cast("int")
    )


@query(
    "accuracy_f1",
    f"""WITH {_SCORED}, c AS (SELECT k, sum((quality = k AND prediction = k)::INT) AS tp,
        sum((quality = k)::INT) AS real, sum((prediction = k)::INT) AS said FROM x, range(2) t(k) GROUP BY k)
    SELECT round(sum(tp) / sum(real), 9) AS accuracy, round(sum(tp) / sum(real), 9) AS micro_f1,
        round(avg(2 * tp / (real + said)), 9) AS macro_f1, sum(real)::BIGINT AS num FROM c""",
)
def accuracy_f1(spark, sf_dir):
    record = M.accuracy_f1(scored_documents(spark, sf_dir), "quality", "prediction")
    return record.select(
        *[F.round(c, 9).alias(c) for c in ("accuracy", "micro_f1", "macro_f1")], "num"
    )


@query(
    "binary_test",
    f"""WITH {_SCORED} SELECT count(*) AS num, max(quality) <= 1 AS quality, max(n_chars) <= 1 AS n_chars FROM x""",
)
def binary_test(spark, sf_dir):
    rows = scored_documents(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("num")).select(
        "num", *[M.is_binary(rows, c).alias(c) for c in ("quality", "n_chars")]
    )


def _auc_sql(rows: str, positive: str, score: str, by: str) -> str:
    """Rank-sum AUC with ties averaged."""
    return f"""SELECT {by}, (sum(rk) FILTER ({positive}) - np * (np + 1) / 2.0) / (np * (n - np)) AS auc FROM (
        SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score})
            + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0::DOUBLE AS rk,
            count(*) OVER (PARTITION BY {by}) AS n,
            count(*) FILTER ({positive}) OVER (PARTITION BY {by}) AS np FROM {rows}) GROUP BY {by}, n, np"""


@query(
    "roc_auc",
    f"""WITH {_SCORED}, y AS (SELECT *, 1 AS one FROM x) SELECT round(auc, 9) AS roc_auc FROM
    ({_auc_sql('y', 'quality = 1', 'n_chars', 'one')})""",
)
def roc_auc(spark, sf_dir):
    area = M.roc_auc(scored_documents(spark, sf_dir), "quality", "n_chars")
    return area.select(F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "roc_auc_groups",
    f"""WITH {_SCORED} SELECT lang, round(auc, 9) AS roc_auc FROM
    ({_auc_sql('x', 'toxic = 1', 'n_chars', 'lang')})""",
)
def roc_auc_groups(spark, sf_dir):
    area = M.roc_auc(scored_documents(spark, sf_dir), "toxic", "n_chars", ["lang"])
    return area.select("lang", F.round("roc_auc", 9).alias("roc_auc"))


CLASSES = 10
_SUM = " + ".join(f"abs(embedding[{i + 1}]::DOUBLE)" for i in range(CLASSES))
_PROBS = f"""p AS MATERIALIZED (SELECT vec_id, label, unnest(range({CLASSES})) AS class, unnest([{', '.join(
    f"abs(embedding[{i + 1}]::DOUBLE) / ({_SUM})" for i in range(CLASSES))}]) AS score FROM embeddings)"""


def class_probabilities(spark, sf_dir):
    head = F.transform(F.slice("embedding", 1, CLASSES), lambda x: F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", normalised(head).alias("probabilities")
    )


@query(
    "roc_auc_ovr",
    f"""WITH {_PROBS} SELECT round(avg(auc), 9) AS roc_auc_ovr FROM
    ({_auc_sql('p', 'label = class', 'score', 'class')})""",
)
def roc_auc_ovr(spark, sf_dir):
    area = M.roc_auc_ovr(class_probabilities(spark, sf_dir), "label", "probabilities")
    return area.select(F.round("roc_auc_ovr", 9).alias("roc_auc_ovr"))


@query(
    "roc_auc_ovo",
    f"""WITH {_PROBS}, q AS (SELECT a.class * 100 + o.b AS pair, a.class, a.label, a.score FROM p a,
        (SELECT unnest(range({CLASSES})) AS b) o WHERE o.b <> a.class AND a.label IN (a.class, o.b))
    SELECT round(avg(auc), 9) AS roc_auc_ovo FROM ({_auc_sql('q', 'label = class', 'score', 'pair')})""",
)
def roc_auc_ovo(spark, sf_dir):
    area = M.roc_auc_ovo(class_probabilities(spark, sf_dir), "label", "probabilities")
    return area.select(F.round("roc_auc_ovo", 9).alias("roc_auc_ovo"))


_PR = """h AS (SELECT n_chars AS score, sum((quality = 1)::INT) AS pos, count(*) AS n FROM x GROUP BY 1),
    u AS (SELECT score, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS taken, sum(pos) OVER () AS total
          FROM h WINDOW w AS (ORDER BY score DESC)),
    z AS (SELECT tp / total AS recall, tp / taken AS prec,
          coalesce(lag(tp / total) OVER (ORDER BY score DESC), 0) AS recall0,
          coalesce(lag(tp / taken) OVER (ORDER BY score DESC), 1) AS prec0 FROM u)"""


@query(
    "pr_auc",
    f"""WITH {_SCORED}, {_PR} SELECT round(sum((recall - recall0) * (prec + prec0) / 2), 9) AS pr_auc FROM z""",
)
def pr_auc(spark, sf_dir):
    area = M.pr_auc(scored_documents(spark, sf_dir), "quality", "n_chars")
    return area.select(F.round("pr_auc", 9).alias("pr_auc"))


@query(
    "metric_record",
    f"""WITH {_SCORED}, y AS (SELECT *, 1 AS one FROM x), {_PR},
    c AS (SELECT k, sum((quality = k AND prediction = k)::INT) AS tp,
        sum((quality = k)::INT) AS real, sum((prediction = k)::INT) AS said FROM x, range(2) t(k) GROUP BY k)
    SELECT (SELECT round(auc, 9) FROM ({_auc_sql('y', 'quality = 1', 'n_chars', 'one')})) AS "AUC",
        (SELECT round(sum((recall - recall0) * (prec + prec0) / 2), 9) FROM z) AS "PR",
        round(sum(tp) / sum(real), 9) AS accuracy, round(avg(2 * tp / (real + said)), 9) AS macro_f1,
        sum(real)::BIGINT AS num, (SELECT round(avg(n_chars), 6) FROM x) AS mean_chars FROM c""",
)
def metric_record(spark, sf_dir):
    rows = scored_documents(spark, sf_dir).withColumn(
        "probabilities",
        F.array(1 - F.col("n_chars").cast("double"), F.col("n_chars").cast("double")),
    )
    record = M.metric_record(rows, "quality", "prediction", "probabilities", 2, ["n_chars"])
    return record.select(
        *[F.round(c, 9).alias(c) for c in ("AUC", "PR", "accuracy", "macro_f1")],
        "num", F.round("n_chars", 6).alias("mean_chars"),
    )


@query(
    "arg_max_class",
    f"""WITH {_PROBS} SELECT vec_id, arg_max(class, (score, -class))::INT AS prediction FROM p GROUP BY vec_id""",
)
def arg_max_class(spark, sf_dir):
    return class_probabilities(spark, sf_dir).select(
        "vec_id", argmax(F.col("probabilities")).alias("prediction")
    )


STATUSES = ("F", "O", "P")
_CELLS = """c AS (SELECT o_orderpriority AS dataset, o_orderstatus AS shots, round(avg(o_totalprice / 100000), 2) AS mean,
    round(stddev_pop(o_totalprice / 100000), 2) AS std, count(*) AS n FROM orders GROUP BY 1, 2)"""


def result_cells(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderstatus").alias("shots"),
        (F.col("o_totalprice") / 100000).alias("score"),
    )
    return R.rounded(R.mean_std(scores, ["dataset", "shots"], "score"))


@query(
    "result_grid",
    f"""WITH {_CELLS} SELECT dataset, {', '.join(f"max(mean) FILTER (shots = '{s}') AS {s}" for s in STATUSES)}
    FROM c GROUP BY dataset""",
)
def result_grid(spark, sf_dir):
    return R.result_grid(result_cells(spark, sf_dir), "dataset", "shots", STATUSES, "mean")


@query(
    "result_latex",
    f"""WITH {_CELLS} SELECT dataset, shots, '& $' || printf('%.2f', mean) || '_{{' || substr(printf('%.2f', std), 2) || '}}$' AS cell,
        printf('%.2f', mean) || ' (' || printf('%.2f', std) || ')' AS text FROM c""",
)
def result_latex(spark, sf_dir):
    mean, std, n = F.col("mean"), F.col("std"), F.col("n")
    return result_cells(spark, sf_dir).select(
        "dataset", "shots", R.latex_cell(mean, std).alias("cell"),
        R.result_text(mean, std, n).alias("text"),
    )


@query(
    "result_averages",
    f"""WITH {_CELLS} SELECT shots, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std
    FROM c GROUP BY shots""",
)
def result_averages(spark, sf_dir):
    averages = R.column_averages(result_cells(spark, sf_dir), "shots")
    return averages.select("shots", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "dedupe_predictions",
    """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type,
        arg_min(value, event_id) AS value FROM events GROUP BY user_id""",
)
def dedupe_predictions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return R.first_per_key(events, ["user_id"], [F.col("event_id")])


@query(
    "best_step",
    """SELECT event_type, arg_max(event_id, (round(value), -event_id)) AS best_step, max(round(value)) AS best_metric
    FROM events GROUP BY event_type""",
)
def best_step(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.round("value").alias("value")
    )
    return R.best_step(events, ["event_type"], "event_id", "value")


@query(
    "experiment_keys",
    """SELECT o_orderkey, 'm3b' AS model, 'car_' || lower(o_orderstatus) AS dataset,
        (o_custkey % 512)::VARCHAR AS num_shot, (o_custkey % 7)::VARCHAR AS seed, 'ia3_x' AS spec FROM orders""",
)
def experiment_keys(spark, sf_dir):
    path = F.concat(
        F.lit("/exp/m3b_car_"), F.lower("o_orderstatus"), F.lit("_numshot"),
        (F.col("o_custkey") % 512).cast("string"), F.lit("_seed"),
        (F.col("o_custkey") % 7).cast("string"), F.lit("_ia3_x/dev_scores.json"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return rows.select(
        "o_orderkey", *[c.alias(n) for n, c in R.experiment_key(F.col("path")).items()]
    )


@query(
    "batch_pad",
    r"""WITH d AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, ' +'), lambda x: x <> ''),
            lambda x: length(x)::INT) AS ids, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents),
    b AS (SELECT doc_id, ids, k // 8 AS batch, max(len(ids)) OVER (PARTITION BY k // 8) AS longest,
                 count(*) OVER (PARTITION BY k // 8) AS c FROM d)
    SELECT doc_id, batch, longest::INT AS padded, len(ids)::INT AS attended, list_sum(ids)::BIGINT AS id_sum
    FROM b WHERE c = 8""",
)
def batch_pad(spark, sf_dir):
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    words = F.array_remove(F.split("text", " +"), "")
    rows = docs.select("doc_id", F.transform(words, F.length).alias("ids"))
    batched = P.assign_batches(rows, "doc_id", 8, drop_last=True)
    padded = P.pad_batches(P.check_choice_counts(batched.withColumn("choices", F.sequence(F.lit(0).cast("bigint"), F.col("batch") % 3)), "choices", ["batch"]), "ids", ["batch"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return padded.select(
        "doc_id", "batch", F.size("input_ids").alias("padded"),
        total(F.col("attention_mask")).cast("int").alias("attended"),
        total(F.col("input_ids")).alias("id_sum"),
    )


@query(
    "batch_fields",
    """SELECT p_partkey, list_sum([length(p_name), p_size, length(p_type), 99])::BIGINT AS id_sum, 4 AS width FROM part""",
)
def batch_fields(spark, sf_dir):
    ids = P.joined_fields(
        [F.array(F.length("p_name"), F.col("p_size")), F.array(F.length("p_type"))],
        F.array(F.lit(99)),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("id_sum"),
        F.size(ids).alias("width"),
    )
