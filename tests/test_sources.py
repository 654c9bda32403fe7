import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe import spec as P
from rowscribe.operators.serialize import feature_template, serialize
from rowscribe.session import cut_lineage, scratch_path
from rowscribe.sources import catalogs as C
from rowscribe.sources import datasets as D
from rowscribe.sources import stores as O
from rowscribe.sources import tables as S
from rowscribe.streaming.notes import append_outputs, prompt_stream

ARFF = """% a comment
@RELATION blood

@ATTRIBUTE V1 numeric
@ATTRIBUTE V2 real
@attribute 'V3' integer
@attribute V4 numeric
@attribute Class {1,2}
@DATA
2,50,12500,98,2
% another

0,13,3250,28,'1'
1,?,4000,35,2
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_arff(spark, tmp_path):
    table = S.read_arff(spark, write(tmp_path, "b.arff", ARFF))
    assert [f.dataType.simpleString() for f in table.schema.fields] == ["double"] * 4 + ["string"]
    rows = table.orderBy("V1").collect()
    assert [r["Class"] for r in rows] == ["1", "2", "2"] and rows[1]["V2"] is None
    with pytest.raises(ValueError):
        S.read_arff(spark, write(tmp_path, "no.arff", "1,2\n"))


def test_arff_head_of_a_long_file(spark, tmp_path):
    head = "\n".join(["% text"] * 700 + ["@attribute a numeric", "@data"])
    path = write(tmp_path, "long.arff", head + "\n" + "\n".join(map(str, range(500))))
    assert S.read_arff(spark, path).count() == 500


def test_blood_dataset(spark, tmp_path):
    table = D.load_dataset(spark, "blood", write(tmp_path, "b.arff", ARFF), split="ordered").orderBy("idx")
    assert table.columns == ["recency", "frequency", "monetary", "time", "label", "idx", "split"]
    rows = table.collect()
    assert [(r["idx"], r["label"], r["split"]) for r in rows] == [(0, 1, "train"), (1, 0, "train"), (2, 1, "test")]
    note = serialize(table, P.dataset_spec("blood").template("list")).orderBy("idx").collect()[2]["note"]
    assert note.splitlines()[1] == "- Frequency - total number of donation:"


def test_income_dataset(spark, tmp_path):
    lines = (
        "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K\n"
        "50, ?, 83311, 9th, 13, Married-civ-spouse, ?, Husband, Other, Male, 0, 0, 13, South, >50K\n"
    )
    more = "38, Private, 1, Unknown, 9, Divorced, Handlers-cleaners, Not-in-family, White, Male, 0, 0, 40, ?, >50K.\n"
    paths = [write(tmp_path, "adult.data", lines), write(tmp_path, "adult.test", more)]
    table = D.load_dataset(spark, "income", paths).orderBy("idx")
    rows = serialize(table, P.dataset_spec("income").template("list")).orderBy("idx").collect()
    assert [r["label"] for r in rows] == [0, 1, 1]
    assert rows[0]["note"].splitlines()[3:6] == ["- Marital status: never married", "- Relation to head of the household: Not-in-family", "- Native country: United States"]
    assert rows[1]["note"].splitlines()[1] == "- Race:" and "South Korea" in rows[1]["note"] and "- Occupation:\n" in rows[1]["note"]
    assert "- Education:\n" in rows[2]["note"] and "- Native country:\n" in rows[2]["note"]


def test_car_dataset_is_strict(spark, tmp_path):
    good = "vhigh,vhigh,2,2,small,low,unacc\nlow,med,5more,more,big,high,vgood\n"
    table = D.load_dataset(spark, "car", write(tmp_path, "car.data", good))
    notes = [r["note"] for r in serialize(table, P.dataset_spec("car").template()).orderBy("idx").collect()]
    assert notes[1] == "The Buying price is low. The Doors is five or more. The Maintenance costs is medium. The Persons is more than four. The Safety score is high. The Trunk size is big."
    bad = D.load_dataset(spark, "car", write(tmp_path, "car2.data", "vhigh,vhigh,2,2,small,low,okay\n"))
    with pytest.raises(Exception, match="no label for label = okay"):
        bad.collect()


def test_wine_header_is_replaced(spark, tmp_path):
    text = '"fixed acidity",b,c,d,e,f,g,h,i,j,k,q\n7.4,0.7,0,1.9,0.076,11,34,0.9978,3.51,0.56,9.4,5\n7.8,0.88,0,2.6,0.098,25,67,0.9968,3.2,0.68,9.8,7\n'
    table = D.load_dataset(spark, "wine", write(tmp_path, "w.csv", text)).orderBy("idx")
    assert [r["label"] for r in table.collect()] == [0, 1]
    note = serialize(table, P.dataset_spec("wine").template("values")).orderBy("idx").first()["note"]
    assert note.splitlines() == ["7.4", "0.700", "0.00", "1.9", "0.076", "11", "34", "0.99780", "3.51", "0.56", "9.4"]


def test_every_spec_is_consistent():
    for name, spec in P.REGISTRY.items():
        stored = {spec.renames.get(f.name, f.name) for f in spec.schema.fields} - set(spec.drops)
        assert "label" in stored
        assert {c for c, _ in spec.features} <= stored - {"label"}
        assert set(spec.categorical) | set(spec.formats) | set(spec.exchanged_by_value) <= stored
        styles = ["text", "list", "values", "shuffled", "importance"] + ["permuted"] * bool(spec.permutation)
        for style in styles:
            assert len(spec.template(style).fields()) == len(spec.features)
    widths = {"income": 13, "car": 7, "heart": 12, "diabetes": 9, "creditg": 21, "blood": 5, "bank": 17, "jungle": 7, "wine": 12, "calhousing": 9}
    assert {n: P.REGISTRY[n].width for n in widths} == widths


def test_spec_lookup_and_options():
    assert P.dataset_spec("car_list_permuted").name == "car"
    with pytest.raises(KeyError):
        P.dataset_spec("unknown")
    assert P.style_of() == "text" and P.style_of(as_list=True, values=True) == "values"
    with pytest.raises(ValueError):
        P.style_of(values=True)
    with pytest.raises(ValueError):
        P.style_of(as_list=True, values=True, permuted=True)
    assert P.dataset_spec("heart").prompt[0] == "heart_disease"
    with pytest.raises(KeyError):
        P.dataset_spec("titanic").prompt


def test_width_check(spark):
    with pytest.raises(ValueError, match="expected 5"):
        D.check_width(spark.range(1), P.dataset_spec("blood"))


def test_debug_sample(spark):
    rows = [(i, "train" if i < 50 else "validation") for i in range(60)]
    df = spark.createDataFrame(rows, "idx bigint, split string")
    assert D.debug_sample(df, "idx", 1).groupBy("split").count().orderBy("split").collect() == [("train", 10), ("validation", 5)]


def test_unknown_variant_of_notes_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "n", 0, "train")], "idx int, note string, label int, split string")
    O.write_notes(df, str(tmp_path / "n"), "car", "list")
    assert O.read_notes(spark, str(tmp_path / "n"), "car", "list", "train").count() == 1
    with pytest.raises(ValueError, match="poem"):
        O.read_notes(spark, str(tmp_path / "n"), "car", "poem")
    assert O.read_notes(spark, str(tmp_path / "n"), "car", "list", "test").count() == 0


def test_scores_are_appended(spark, tmp_path):
    root = tmp_path / "exp"
    for i in range(3):
        record = spark.createDataFrame([(0.5 + i / 10, i)], "AUC double, num_steps long")
        O.append_scores(record, str(root / "m3b_car_numshot4_seed42_ia3"))
    long = root / "m3b_heart_numshot8_seed1_x"
    long.mkdir()
    (long / "dev_scores.json").write_text("".join(f'{{"AUC": {i}, "num_steps": {i}}}\n' for i in range(5000)))
    last = O.last_records(spark, str(root / "*"), "AUC double, num_steps long")
    got = {(r["dataset"], r["num_shot"], r["seed"]): r["num_steps"] for r in last.collect()}
    assert got == {("car", "4", "42"): 2, ("heart", "8", "1"): 4999}


def test_catalogs(spark, tmp_path):
    short = write(tmp_path, "short.json", '{"Acute Pain": "Pain.", "x": "FEVERISH"}')
    assert {tuple(r) for r in C.read_short_names(spark, short).collect()} == {("acute pain", "pain"), ("x", "feverish")}
    assert C.read_permutation(spark, write(tmp_path, "p.json", '{"1": 2}')).first() == (1, 2)
    settings = '{"a": ["f", "g"], "b": ["h"]}\n{"a": "Do a.", "b": "Do b."}\n'
    got = {r["task"]: (r["fields"], r["instruction"]) for r in C.read_field_settings(spark, write(tmp_path, "s.jsonl", settings)).collect()}
    assert got == {"a": (["f", "g"], "Do a."), "b": (["h"], "Do b.")}
    template = '{"task": "t", "template_name": "n", "question": "q?", "choices": ["No", "Yes"], "position": 0, "original_task": true, "metrics": ["accuracy"]}\n'
    assert C.read_templates(spark, write(tmp_path, "t.jsonl", template)).first()["choices"] == ["No", "Yes"]


def test_outputs_keep_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, "0.3, 0.7")], "idx bigint, output0 string")
    O.write_outputs(df.where("idx = 1"), str(tmp_path / "o"))
    O.write_outputs(df.where("idx = 2"), str(tmp_path / "o"))
    assert sorted(map(tuple, O.read_outputs(spark, str(tmp_path / "o")).collect())) == sorted(map(tuple, df.collect()))


def test_stream_restarts_without_repeats(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    template = feature_template((("a", "A"),), "list")
    for batch in range(2):
        spark.createDataFrame([(batch, "x", batch)], "id int, a string, label int").write.mode("append").json(source)
        rows = spark.readStream.schema("id int, a string, label int").json(source)
        prompts = prompt_stream(rows, template, "Good?", "No ||| Yes").select("id", "prompt", "answer")
        append_outputs(prompts, out, mark).awaitTermination()
    got = sorted(map(tuple, spark.read.schema("id int, prompt string, answer string").json(out).collect()))
    assert got == [(0, "- A: x\n\nGood? Answer:", "No"), (1, "- A: x\n\nGood? Answer:", "Yes")]


def test_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = cut_lineage(spark.range(5).withColumn("v", F.lit(1)), "five")
    assert kept.count() == 5 and "parquet" in kept._jdf.queryExecution().toString().lower()


def test_half_written_cache_is_made_again(spark, tmp_path):
    path = tmp_path / "cache"
    path.mkdir()
    (path / "part-0.json").write_text('{"idx": 9}\n')
    made = O.read_or_create(spark, str(path), lambda: spark.range(5).select(F.col("id").alias("idx")), "idx long")
    assert sorted(r["idx"] for r in made.collect()) == [0, 1, 2, 3, 4]
    again = O.read_or_create(spark, str(path), lambda: 1 / 0, "idx long")
    assert again.count() == 5


def test_row_key_is_kept_where_there_is_one(spark):
    df = spark.createDataFrame([(7,)], "idx bigint")
    assert S.add_row_key(df, ["idx"]) is df
    made = S.add_row_key(spark.createDataFrame([("b",), ("a",)], "k string"), ["k"])
    assert sorted(map(tuple, made.collect())) == [("a", 0), ("b", 1)]


def test_binary_and_trim(spark):
    df = spark.createDataFrame([(bytearray(b"x "),)], T.StructType([T.StructField("b", T.BinaryType())]))
    assert S.trim_strings(S.decode_binary(df)).first()["b"] == "x"


def test_denied_tasks_are_left_out(spark, tmp_path):
    csv = "HF_name,subset,task_by_convention,do_train,do_eval,train_size\nhotpot_qa,distractor,qa,BASE,,100\ncopa,,qa,SGLUE,,\nqa,,qa,BASE,,7\n"
    tasks = C.read_tasks(spark, write(tmp_path, "datasets.csv", csv))
    assert {r["HF_name"]: (r["subset"], r["train_size"]) for r in tasks.collect()} == {"hotpot_qa": ("distractor", 100), "copa": (None, 0), "qa": (None, 7)}
    rows = [("hotpot_qa", "distractor", "Generate Question"), ("hotpot_qa", "distractor", "Ask"), ("qa", None, "a"), ("copa", None, "b")]
    templates = spark.createDataFrame(rows, "dataset string, subset string, template_name string")
    got = {r["task"]: r["n_templates"] for r in C.training_tasks(tasks, templates, "BASE").collect()}
    assert got == {"hotpot_qa_distractor_Ask": 2, "qa_a": 1}


def test_probabilities_and_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.25, 0.75])], "idx int, p array<double>")
    O.write_probabilities(df, str(tmp_path / "p"), "idx", "p")
    assert spark.read.parquet(str(tmp_path / "p")).first()["probabilities"] == [0.25, 0.75]
    O.write_features(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["idx", "p"]
    outputs = df.select(*[c.alias(n) for n, c in O.normalised_columns(F.col("p"), ["a", "b"]).items()])
    assert tuple(outputs.first()) == (0.25, 0.75)


def test_quoted_records_over_many_blocks(spark, tmp_path):
    """Records with breaks and quotes inside, cut into blocks at every line."""
    texts = ["plain", 'a "quoted" word', "two\nlines", 'x\n\n"y"\nz', "", "a,b", "ends\n", "\nstarts", None, "é" * 30]
    rows = [(i, t) for i, t in enumerate(texts * 4)]
    path = str(tmp_path / "outputs")
    O.write_outputs(spark.createDataFrame(rows, "idx bigint, output0 string").repartition(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        found = {r["idx"]: r["output0"] for r in O.read_outputs(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {i: t or None for i, t in found.items()} == {i: t or None for i, t in rows}
