"""Prompts, requests and parsed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscribe.functions import text as X
from rowscribe.operators import answers as A
from rowscribe.operators import prompts as D
from rowscribe.phrasebook import PROMPTS
from rowscribe.plans.registry import (
    query,
    sql_hash_int,
    sql_strip,
    table,
    text_rows,
)

QUALITY_QUESTION = "Is this a good text? Yes or no?"


@query(
    "prompt_render",
    f"""SELECT d.doc_id, md5({sql_strip(f"text || chr(10) || chr(10) || '{QUALITY_QUESTION} Answer:'")}) AS prompt_md5,
        CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS answer
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def prompt_render(spark, sf_dir):
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    prompts = D.render_prompt(rows, QUALITY_QUESTION, "No ||| Yes", "text", "quality")
    return prompts.select("doc_id", F.md5("prompt").alias("prompt_md5"), "answer")


TEMPLATES = [
    {"name": "plain", "question": "Is it good?"},
    {"name": "polite", "question": "Please tell whether it is good."},
    {"name": "short", "question": "Good?"},
]
_NAMES = str([t["name"] for t in TEMPLATES])
_QUESTIONS = str([t["question"] for t in TEMPLATES])


@query(
    "prompt_template_choice",
    f"""WITH p AS (SELECT doc_id, {sql_hash_int(5, "'template'", 'doc_id')} % 3 + 1 AS i FROM documents)
    SELECT doc_id, {_NAMES}[i] AS name, {_QUESTIONS}[i] AS question FROM p""",
)
def prompt_template_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return D.random_template(docs, TEMPLATES, 5, "doc_id").select(
        "doc_id", "template.name", "template.question"
    )


@query(
    "prompt_all_templates",
    f"""SELECT doc_id, unnest({_NAMES}) AS name, unnest({_QUESTIONS}) AS question FROM documents""",
)
def prompt_all_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return D.all_templates(docs, TEMPLATES).select("doc_id", "template.name", "template.question")


TASKS = ("bank", "car", "heart", "income")
_TASK_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS task, '{PROMPTS[t][0]}' AS template_name, '{PROMPTS[t][1]}' AS question, "
    f"{len(PROMPTS[t][2].split('|||'))} AS n_choices"
    for t in TASKS
)


@query(
    "prompt_catalogue",
    f"""WITH t AS ({_TASK_SQL}),
    d AS (SELECT doc_id, {list(TASKS)}[CAST(substr(source, 4) AS INT) % 4 + 1] AS task FROM documents)
    SELECT doc_id, task, template_name, question, n_choices FROM d JOIN t USING (task)""",
)
def prompt_catalogue(spark, sf_dir):
    number = F.substring("source", 4, 2147483647).cast("int") % len(TASKS)
    names = F.array(*[F.lit(t) for t in TASKS])
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.get(names, number).alias("task")
    )
    chosen = D.select_templates(D.template_catalogue(spark, TASKS), -1, first=8)
    return D.attach_template(docs, chosen).select(
        "doc_id", "task", "template_name", "question", F.size("choices").alias("n_choices")
    )


@query(
    "prompt_fields_conversations",
    f"""SELECT conv_id, turn, md5('Label the message. Possible labels: spam, not spam'
        || CASE WHEN length({sql_strip('role')}) > 0 THEN chr(10) || 'role: ' || {sql_strip('role')} ELSE '' END
        || CASE WHEN length({sql_strip('text')}) > 0 THEN chr(10) || 'text: ' || {sql_strip('text')} ELSE '' END
        || chr(10) || 'Label:') AS prompt_md5 FROM conversations""",
)
def prompt_fields_conversations(spark, sf_dir):
    prompt = D.field_prompt("Label the message. ", ["role", "text"], ["spam", "not spam"], "comma")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(prompt).alias("prompt_md5")
    )


@query(
    "prompt_fields_pages",
    f"""SELECT page_id, md5('Which site?' || chr(10) || 'Possible labels:' || chr(10) || '1. a b' || chr(10)
        || '2. c' || chr(10) || 'url: ' || {sql_strip('url')} || chr(10) || 'html: ' || {sql_strip('html')}
        || chr(10) || 'Label:') AS prompt_md5 FROM pages""",
)
def prompt_fields_pages(spark, sf_dir):
    prompt = D.field_prompt("Which site?", ["url", "html"], ["a b", "c"], "newline")
    return text_rows(spark, sf_dir, "pages", "page_id", "url", "html").select(
        "page_id", F.md5(prompt).alias("prompt_md5")
    )


@query(
    "prompt_sides",
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '<NO INPUT>' ELSE role END AS prompt,
        CASE WHEN turn % 5 = 4 OR turn % 3 = 0 THEN '<NO LABEL>' ELSE role || turn END AS target
    FROM conversations""",
)
def prompt_sides(spark, sf_dir):
    prompt = F.when(F.col("turn") % 5 != 4, F.col("role"))
    target = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat("role", F.col("turn")))
    filled, answer = D.filled_sides(prompt, target)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", filled.alias("prompt"), answer.alias("target")
    )


@query(
    "choice_labels",
    """SELECT p_partkey, replace(replace(replace(p_name, ' ', '_') || '. ' || p_type, '_', ' '), '. ', ' ') AS label,
        CASE WHEN p_size % 4 = 0 THEN 'Unlabeled' ELSE ['low', 'mid', 'high'][p_size % 4] END AS target
    FROM part""",
)
def choice_labels(spark, sf_dir):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(". "), "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        D.clean_choice(raw).alias("label"),
        D.answer_of(D.answer_choices("low ||| mid ||| high"), F.col("p_size") % 4 - 1).alias(
            "target"
        ),
    )


@query(
    "prompt_requests",
    f"""SELECT doc_id, md5('{{"prompt":' || to_json({sql_strip('text')})
        || ',"temperature":0,"max_tokens":1,"logprobs":50}}') AS request_md5,
        md5(substr(to_json(text)::VARCHAR, 2, length(to_json(text)::VARCHAR) - 2)) AS escaped_md5 FROM documents""",
)
def prompt_requests(spark, sf_dir):
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(
        "doc_id",
        F.md5(D.request_of(F.col("text"))).alias("request_md5"),
        F.md5(D.json_escaped(F.col("text"))).alias("escaped_md5"),
    )


def _response():
    """A response with the log-probabilities of the answer tokens, some left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    yes = F.when(k % 5 != 0, F.concat(F.lit('" Yes":-'), (k % 7).cast("string"), F.lit(".25")))
    no = F.when(k % 3 != 0, F.concat(F.lit('" No":-'), (k % 4).cast("string"), F.lit(".5")))
    other = F.lit('" Maybe":-1.5')
    return F.concat(F.lit("{"), F.concat_ws(",", yes, no, other), F.lit("}"))


@query(
    "parse_yes_no",
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
    p AS (SELECT event_id, CASE WHEN k % 5 <> 0 THEN exp(-(k % 7 + 0.25)::DOUBLE) ELSE 0::DOUBLE END AS y,
                 CASE WHEN k % 3 <> 0 THEN exp(-(k % 4 + 0.5)::DOUBLE) ELSE 0::DOUBLE END AS n FROM e)
    SELECT event_id, round(CASE WHEN y + n = 0 THEN 0.5::DOUBLE ELSE y / (y + n) END, 9) AS p_yes FROM p""",
)
def parse_yes_no(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", A.top_logprobs(_response()).alias("logprobs")
    )
    return events.select(
        "event_id", F.round(A.yes_probability(F.col("logprobs")), 9).alias("p_yes")
    )


@query(
    "parse_tokens",
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
    SELECT event_id, round(CASE WHEN k % 5 <> 0 THEN exp(-(k % 7 + 0.25)::DOUBLE) ELSE 0::DOUBLE END, 9) AS p0,
        round(exp(-1.5::DOUBLE), 9) AS p1, 0.0::DOUBLE AS p2 FROM e""",
)
def parse_tokens(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", A.top_logprobs(_response()).alias("logprobs")
    )
    found = A.token_probabilities(F.col("logprobs"), (" Yes", " Maybe", " Never"))
    return events.select(
        "event_id", *[F.round(F.element_at(found, i + 1), 9).alias(f"p{i}") for i in range(3)]
    )


@query(
    "parse_multiclass",
    """WITH v AS (SELECT o_orderkey, (o_custkey % 7 + 1)::DOUBLE AS a, (o_orderkey % 5)::DOUBLE AS b,
        (o_custkey % 3)::DOUBLE AS c, (o_orderkey % 11)::DOUBLE AS d FROM orders)
    SELECT o_orderkey, round(a / (a + b + c + d), 9) AS p0, round(b / (a + b + c + d), 9) AS p1,
        round(c / (a + b + c + d), 9) AS p2, round(d / (a + b + c + d), 9) AS p3 FROM v""",
)
def parse_multiclass(spark, sf_dir):
    stored = F.concat_ws(
        ", ",
        (F.col("o_custkey") % 7 + 1).cast("string"),
        (F.col("o_orderkey") % 5).cast("string"),
        (F.col("o_custkey") % 3).cast("string"),
        (F.col("o_orderkey") % 11).cast("string"),
    )
    orders = table(spark, sf_dir, "orders")
    outputs = orders.select("o_orderkey", stored.alias("output0"))
    joined = A.attach_outputs(orders.select("o_orderkey"), outputs, "o_orderkey", n_labels=4)
    return joined.select(
        "o_orderkey",
        *[F.round(F.element_at("probabilities", i + 1), 9).alias(f"p{i}") for i in range(4)],
    )


@query(
    "task_names",
    r"""SELECT doc_id, regexp_replace(source || CASE WHEN lang = 'en' THEN '_' ELSE '_' || lang || '_' END
        || 'how many, chars?' || n_chars, '[^\p{L}\p{N}_.]+', '_', 'g') AS task FROM documents""",
)
def task_names(spark, sf_dir):
    subset = F.when(F.col("lang") != "en", F.col("lang"))
    template = F.concat(F.lit("how many, chars?"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.task_name(F.col("source"), subset, template).alias("task")
    )


@query(
    "token_lengths",
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{X.WS}+'), lambda x: x <> '') AS t
                  FROM documents)
    SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t[1:64], ' ')) AS cut_md5 FROM w""",
)
def token_lengths(spark, sf_dir):
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(
        "doc_id",
        X.token_count(F.col("text")).alias("tokens"),
        F.md5(X.token_cut(F.col("text"), 64)).alias("cut_md5"),
    )


@query(
    "output_records",
    """SELECT c_custkey, c_mktsegment, c_name AS prompt0, c_nationkey::VARCHAR AS output0,
        upper(c_name) AS prompt1, 'x' AS output1 FROM customer""",
)
def output_records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_name").alias("_a"), F.upper("c_name").alias("_b"),
        F.col("c_nationkey").cast("string").alias("_c"), F.lit("x").alias("_d"),
    )
    return D.output_records(rows, ["_a", "_b"], ["_c", "_d"]).drop("_a", "_b", "_c", "_d")
