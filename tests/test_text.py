import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowscribe.functions import text as X

# A plain-Python statement of note cleaning, written for the tests.
RULES = [
    (r"[ \t]+", " "), ("\n{3,}", "\n\n"), (r"\A[ \t]+", ""), (r"\n[ \t]+", "\n"),
    (r"[ \t](?=\n?\Z)", ""), (r"[ \t]\n", "\n"),
]
DOTS = [(r"\s*\.(?=\n?\Z)", "."), (r"\s*\.\n", ".\n")]
REPEATED = [(r"\.+(?=\n?\Z)", "."), (r"\.+\n", ".\n")]


def cleaned(note):
    for pattern, new in RULES + DOTS + REPEATED + DOTS + RULES[:2]:
        note = re.sub(pattern, new, note)
    if "... " not in note:
        note = re.sub(r"(\s*\.)+ +", ". ", note)
    return note


EXAMPLES = [
    "", " ", ".", "a .", "a . ", "a . .", "a .\n", "a. .\n\n\n\nb ..", "\t x  y\t\n  z .\n",
    "now... then . ", "a .. .b", "one. .  two .", "x\x1f.", "end \n", "a\n \n \n b.",
    "The A is . The B is 1 . ", "dots ........  and", "z . \n . \n", ". . . x", "café  .", "\r\n.",
]


def run(spark, notes, via):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, t string")
    if via == "frame":
        out = X.clean_notes(df, F.col("t"), "o")
    else:
        out = df.withColumn("o", X.clean_note(F.col("t")))
    return [r["o"] for r in out.orderBy("i").collect()]


@pytest.mark.parametrize("via", ["frame", "column"])
def test_cleaning_examples(spark, via):
    assert run(spark, EXAMPLES, via) == [cleaned(n) for n in EXAMPLES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab. \t\n\r  \x1ceé", max_size=40), min_size=20, max_size=60))
def test_cleaning_random(spark, notes):
    assert run(spark, notes, "frame") == [cleaned(n) for n in notes]


def test_cleaning_long_runs(spark):
    note = "contents " + "." * 30000 + "  end" + "\n" * 5000 + " ."
    assert run(spark, [note], "frame") == [cleaned(note)]


def test_every_rare_space_is_seen(spark):
    rare = [chr(c) for c in range(0x3100) if chr(c).isspace() and chr(c) not in "\t\n\x0b\x0c\r "]
    other = [chr(c) for c in range(1, 0x3100) if not chr(c).isspace()] + ["\U0001f600"]
    rows = spark.createDataFrame([(c, True) for c in rare] + [(c, False) for c in other], "c string, want boolean")
    wrong = rows.where(X.has_rare_space(F.concat(F.lit("a"), "c")) != F.col("want"))
    assert wrong.count() == 0


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v")).alias("o")).first()["o"]


def test_numbers(spark):
    assert one(spark, X.integer_text, -2.7, "double") == "-2"
    assert one(spark, X.fixed_text(3), 0.627, "double") == "0.627"
    assert one(spark, X.fixed_text(2), None, "double") is None
    for digits in range(6):  # ties in binary, and numbers next to a tie
        for value in (0.125, 2.675, 1.005, 0.5, 1.5, -0.001, -2.675, 12345678.0625, 0.0, float("nan"), float("-inf")):
            assert one(spark, X.fixed_text(digits), value, "double") == f"{value:.{digits}f}"


def test_phrases(spark):
    codes = {"a": "alpha"}
    assert one(spark, X.phrases(codes), "a") == "alpha"
    assert one(spark, X.phrases(codes), None) is None
    assert one(spark, X.phrases(codes, "null"), "b") is None
    assert one(spark, X.phrases(codes, "keep"), "b") == "b"
    with pytest.raises(Exception, match="no phrase for code b"):
        one(spark, X.phrases(codes), "b")
    with pytest.raises(ValueError):
        X.phrases(codes, "maybe")


def test_two_way_sentinel_absent(spark):
    assert one(spark, X.two_way("M", "male", "female"), "F") == "female"
    assert one(spark, X.two_way("M", "male", "female"), None) is None
    assert one(spark, X.sentinel(-1, "never", X.integer_text), -1.0, "double") == "never"
    assert one(spark, X.sentinel(-1, "never", X.integer_text), 5.0, "double") == "5"
    assert one(spark, X.absent_if("other"), "Other") is None


@pytest.mark.parametrize(
    "long, short",
    [("Chest pain.", "chest pain"), ("ECG", "ECG"), ("FEVER", "fever"), ("X", "X"), ("Ab", "ab"), ("", "")],
)
def test_short_name(spark, long, short):
    assert one(spark, X.short_name, long) == short


def test_strip_and_tokens(spark):
    assert one(spark, X.strip, " \n a b \t") == "a b"
    assert one(spark, X.token_count, " a  b\nc ") == 3
    assert one(spark, lambda c: X.token_cut(c, 2), " a  b\nc ") == "a b"


def test_task_name(spark):
    df = spark.createDataFrame([("super_glue", "wsc.fixed", "a b, c"), ("x", None, "t")], "d string, s string, t string")
    got = [r[0] for r in df.select(X.task_name(F.col("d"), F.col("s"), F.col("t"))).collect()]
    assert got == ["super_glue_wsc.fixed_a_b_c", "x_t"]
