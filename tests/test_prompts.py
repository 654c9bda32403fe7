import json

import pytest
from pyspark.sql import functions as F

from rowscribe.operators import answers as A
from rowscribe.operators import prompts as D
from rowscribe.phrasebook import PROMPTS


def test_prompt_and_answer(spark):
    df = spark.createDataFrame([("- A: 1 ", 1), ("x", -1)], "note string, label int")
    got = D.render_prompt(df, "Good? Yes or no?", "No ||| Yes").collect()
    assert got[0]["prompt"] == "- A: 1 \n\nGood? Yes or no? Answer:" and got[0]["answer"] == "Yes"
    assert got[1]["answer"] == "Unlabeled"


def test_catalogue(spark):
    rows = {r["task"]: r for r in D.template_catalogue(spark).collect()}
    assert set(rows) == set(PROMPTS)
    assert rows["car"]["choices"] == ["Unacceptable", "Acceptable", "Good", "Very good"]
    assert rows["heart"]["template_name"] == "heart_disease"


def test_selection_by_index(spark):
    rows = [("t", f"n{i}", "q", ["a"], i, i % 2 == 0) for i in range(10)]
    catalogue = spark.createDataFrame(rows, "task string, template_name string, question string, choices array<string>, position int, original_task boolean")
    names = lambda df: sorted(r["template_name"] for r in df.collect())
    assert names(D.select_templates(catalogue, 3)) == ["n3"]
    assert names(D.select_templates(catalogue, -1)) == ["n0", "n2", "n4", "n6", "n8"]
    assert len(names(D.select_templates(catalogue, -2))) == 10
    assert names(D.select_templates(catalogue, -1, first=3)) == ["n0", "n2", "n4"]
    with pytest.raises(ValueError):
        D.select_templates(catalogue, -3)


def test_random_template_does_not_depend_on_partitions(spark):
    df = spark.range(50)
    templates = [{"name": n} for n in "abc"]
    runs = [
        sorted((r["id"], r["template"]["name"]) for r in D.random_template(df.repartition(p), templates, 4, "id").collect())
        for p in (1, 7)
    ]
    assert runs[0] == runs[1] and {n for _, n in runs[0]} == set("abc")
    assert D.all_templates(df, templates).count() == 150


def test_field_prompt(spark):
    df = spark.createDataFrame([(" t ", None, "")], "a string, b string, c string")
    prompt = lambda **kw: df.select(D.field_prompt(" Do it. ", ["a", "b", "c"], ["x", "y"], **kw)).first()[0]
    assert prompt() == "Do it.\na: t\nLabel:"
    assert prompt(options="comma") == "Do it. Possible labels: x, y\na: t\nLabel:"
    assert prompt(options="newline") == "Do it.\nPossible labels:\n1. x\n2. y\na: t\nLabel:"
    with pytest.raises(ValueError):
        D.label_options(["x"], "tabs")


def test_requests_are_json(spark):
    text = ' say "hi"\n\\ é\t '
    df = spark.createDataFrame([(1, text)], "k int, p string")
    request = json.loads(D.request_table(df, "k", "p").first()["request"])
    assert request == {"prompt": text.strip(), "temperature": 0, "max_tokens": 1, "logprobs": 50}
    escaped = df.select(D.json_escaped(F.col("p"))).first()[0]
    assert json.loads(f'"{escaped}"') == text


def test_answers(spark):
    rows = ['{" Yes": 0.0, " No": 0.0}', '{" Yes": -1.0}', '{" Maybe": -1.0}']
    df = spark.createDataFrame([(r,) for r in rows], "r string").withColumn("m", A.top_logprobs(F.col("r")))
    assert [r[0] for r in df.select(A.yes_probability(F.col("m"))).collect()] == [0.5, 1.0, 0.5]
    assert df.select(A.token_probabilities(F.col("m"), (" Yes", " x"))).first()[0] == [1.0, 0.0]
    got = df.limit(1).select(A.probability_list(F.lit("1, 3")), A.probability_list(F.lit("0, 0"))).first()
    assert got[0] == [0.25, 0.75] and got[1] == [None, None]


def test_task_rules(spark):
    from rowscribe.operators import tasks as B

    assert B.task_rule("copa").first_templates == 8
    assert B.task_rule("rte_16", 16) is B.task_rule("rte") and B.task_rule("car_list", 4) is None
    rows = [(1, 1, "test_r2"), (2, 2, "train_r2"), (3, 0, "test_r1")]
    df = spark.createDataFrame(rows, "uid int, label int, split string")
    got = B.read_task(df, B.task_rule("anli-r2"), "validation", "uid").collect()
    assert [(r["idx"], r["label"]) for r in got] == [(1, 1)]
    raft = spark.createDataFrame([("2", "test", 9)], "Label string, split string, ID int")
    assert B.read_task(raft, B.task_rule("overruling"), "validation", "ID").first()["label"] == 1
    assert len(B.TASK_RULES) == 22


def test_model_is_loaded_once_per_task(spark):
    from rowscribe.operators.generate import model_column

    def load():
        calls = []

        def count(texts):
            calls.append(1)
            return [len(t.split()) + 100 * (len(calls) > 1) for t in texts]

        return count

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame([("a b",)] * 6, "t string").coalesce(1)
        got = sorted(r[0] for r in df.select(model_column(load, "int")(F.col("t"))).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == 2 and set(got) <= {2, 102}
