import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowscribe.functions import text as X
from rowscribe.operators import serialize as S
from rowscribe.operators.template import NoteTemplate, permute_features


def render(spark, template, values, schema):
    df = spark.createDataFrame([values], schema)
    return df.select(template.render(df).alias("o")).first()["o"]


def test_rules_for_present_and_absent_fields(spark):
    template = NoteTemplate(
        "${a}|${b}|${c}|${missing}|$$|${a}",
        prefixes={"a": "<", "b": "<"},
        suffixes={"a": ">", "b": ">"},
        defaults={"b": "none", "missing": "?"},
        post={"a": F.upper},
        fns=[lambda t: F.replace(t, F.lit("|"), F.lit(";"))],
    )
    got = render(spark, template, ("x", "", None), "a string, b string, c string")
    assert got == "<X>;none;;?;$;<X>"


def test_types(spark):
    template = NoteTemplate("${d} ${t} ${n} ${i} ${f} ${z}", pre={"f": X.fixed_text(1)})
    got = render(
        spark, template,
        (dt.date(2020, 1, 5), dt.datetime(2021, 12, 31, 5), dt.timedelta(days=12, hours=5), 7, float("nan"), True),
        "d date, t timestamp, n interval day to second, i int, f double, z boolean",
    )
    assert got.startswith("January 5, 2020 December 31, 2021 12 7 ")
    assert got.endswith(" True")


def test_nan_is_absent(spark):
    template = NoteTemplate("${f}", defaults={"f": "gone"}, pre={"f": lambda c: F.nullif(c, F.lit(float("nan"))).cast("int")})
    assert render(spark, template, (float("nan"),), "f double") == "gone"


def test_bare_double_is_an_error(spark):
    with pytest.raises(ValueError, match="without a format"):
        render(spark, NoteTemplate("${f}"), (1.0,), "f double")


FEATURES = (("a", "Alpha"), ("b", "Beta"))


def test_styles(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    notes = {
        style: S.serialize(df, S.feature_template(FEATURES, style, permutation=(2, 1))).first()["note"]
        for style in S.STYLES
    }
    assert notes == {
        "text": "The Alpha is x. The Beta is.",
        "list": "- Alpha: x\n- Beta:",
        "values": "x\n",
        "permuted": "- Alpha:\n- Beta: x",
    }


def test_permutation_is_checked():
    assert permute_features(FEATURES, (2, 1)) == [("b", "Alpha"), ("a", "Beta")]
    with pytest.raises(ValueError):
        permute_features(FEATURES, (1, 1))
    with pytest.raises(ValueError):
        S.feature_template(FEATURES, "permuted")
    with pytest.raises(ValueError):
        S.feature_template(FEATURES, "poem")


def test_pairs_and_chunks(spark):
    note = "- A: 1\n- B: x y \n- C (d): 3"
    df = spark.createDataFrame([(1, note), (2, "no list")], "k int, note string")
    pairs = [(r["k"], r["pos"], r["name"], r["value"]) for r in S.explode_pairs(df, "note", ["k"]).collect()]
    assert pairs == [(1, 0, "A", "1"), (1, 1, "B", "x y"), (1, 2, "C (d)", "3")]
    chunks = S.explode_chunks(df, "note", ["k"]).orderBy("pos").collect()
    assert [c["chunk"] for c in chunks] == [
        "Write this information as a sentence: A: 1, B: x y . \n",
        "Write this information as a sentence: C (d): 3. \n",
    ]
    again = S.regroup(S.explode_chunks(df, "note", ["k"]), ["k"], "pos", "chunk").collect()
    assert len(again) == 1 and again[0]["note"].count("sentence") == 2


def test_generated_text(spark):
    df = spark.createDataFrame([("<s> x > some\ntext </s>",), ("plain",)], "t string")
    got = [r[0] for r in df.select(S.generated_between_tags(F.col("t"))).collect()]
    assert got == ["some text", None]
    assert df.select(S.generated_inside_marks(F.lit("<pad> hi</s>"))).first()[0] == "hi"
    assert df.select(S.generated_inside_marks(F.lit("short"))).first()[0] == ""
