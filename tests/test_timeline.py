import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowscribe.operators import notes as N
from rowscribe.operators import timeline as T

END = "2020-10-01"


def at(day, micros):
    return dt.datetime(2020, *day) + dt.timedelta(microseconds=micros)


def visit(key, kind="Office Visit", start="2020-01-05", duration=0, specialty=None):
    strings = [f"1 - visit id - {key}", f"2 - visit type - {kind}", f"3 - visit start - {start}", f"4 - visit duration - {duration}"]
    return strings + ([f"5 - visit specialty - {specialty}"] if specialty else [])


RECORDS = [
    (
        1,
        [
            visit(11, "Inpatient Visit", "2020-02-01", 3, "Cardiology") + ["100 - condition 2 - x", "101 - condition 1 - x", "101 - condition - x"],
            visit(12, "Office Visit", "2020-03-01", 0, "No matching concept") + ["102 - condition - x", "500 - procedure - x", "501 - procedure - x"],
            ["2 - visit type - Hospice", "5 - visit specialty - Late", "103 - condition 10 - x"],
            ["104 - condition 1 - no id"],
        ],
        [at((2, 1), 11), at((3, 1), 12), at((3, 2), 12), at((4, 1), 13)],
    ),
    (2, [visit(21, "Pharmacy visit", "2019-05-01", 0) + ["900 - drug - x"]], [at((5, 1), 21)]),
]


@pytest.fixture(scope="module")
def parsed(spark):
    records = spark.createDataFrame(RECORDS, "person_id bigint, visits array<array<string>>, dates array<timestamp>")
    return T.parse_entries(T.entries_of(records)).cache()


@pytest.fixture(scope="module")
def visits(parsed):
    return T.visits_of(parsed)


@pytest.fixture(scope="module")
def temporal(parsed):
    return T.unique_concepts(T.temporal_of(parsed))


@pytest.fixture(scope="module")
def persons(spark):
    return spark.createDataFrame([(1, 63, 1, 5), (2, 40, 0, 0)], "person_id bigint, age int, gender int, race int")


@pytest.fixture(scope="module")
def values(spark):
    rows = [(100, "Flu"), (101, "Heart attack"), (102, "ECG finding"), (103, "Cough"), (104, "Lost"), (500, "X ray"), (501, "Scan"), (900, "Pill")]
    return N.concept_phrases(spark.createDataFrame(rows, "concept_id bigint, value string"))


def test_visits(visits):
    got = {r["visit_id"]: r for r in visits.collect()}
    assert set(got) == {11, 12, 21}
    # the entry that comes first wins, a later one fills nothing that is set
    assert (got[12]["type"], got[12]["specialty"]) == ("Office Visit", "No matching concept")
    assert (got[11]["start"], got[11]["duration"]) == (dt.date(2020, 2, 1), 3)


def test_artifacts_and_checks(parsed, visits, persons):
    assert tuple(T.artifact_visits(parsed).first()) == (1, 4)
    assert T.duplicate_visits(visits).count() == 0
    assert T.differing_persons(persons, visits).count() == 0
    only = T.differing_persons(persons, visits.where("person_id = 1")).collect()
    assert [(r["person_id"], r["side"]) for r in only] == [(2, "first")]


def test_unique_concepts(temporal):
    got = {(r["visit_id"], r["concept_id"]): r["concept"] for r in temporal.collect()}
    assert got[11, 101] == "condition 1" and got[12, 102] == "condition none"
    assert got[13, 104] == "condition 1" and got[21, 900] == "drug" and len(got) == 8


def test_unknown_string_fails(spark):
    bad = spark.createDataFrame([(1, [["what - is this"]], [at((1, 1), 1)])], "person_id bigint, visits array<array<string>>, dates array<timestamp>")
    with pytest.raises(Exception, match="unknown concept string: what"):
        T.parse_entries(T.entries_of(bad)).collect()
    uneven = spark.createDataFrame([(1, [["x"]], [])], "person_id bigint, visits array<array<string>>, dates array<timestamp>")
    with pytest.raises(Exception, match="differ in length"):
        T.entries_of(uneven).collect()


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(100, 365, 2.0), (101, 30, 5.0), (101, 365, -1.0), (102, 365, 1.0), (103, 365, -3.0), (500, 365, 4.0), (501, 365, 4.0), (9201, 365, 0.5), (581477, 365, -0.25)]
    return spark.createDataFrame(rows, "concept_id bigint, interval int, weight double")


@pytest.fixture(scope="module")
def weighted(temporal, visits, weights):
    return T.renumber_conditions(T.weigh_concepts(temporal, visits, weights, END)).cache()


@pytest.fixture(scope="module")
def heavy(visits, weights):
    return T.weigh_visits(visits, weights, END).cache()


def test_weights(weighted, heavy):
    got = {r["concept_id"]: r for r in weighted.collect()}
    # 30 days do not reach back to February, 365 do
    assert (got[101]["weight"], got[101]["abs_weight"]) == (-1.0, 1.0)
    # without a visit the date cannot be too early
    assert got[900]["weight"] == 0.0 and got[104]["weight"] == 0.0
    by_visit = {r["visit_id"]: r["weight"] for r in heavy.collect()}
    assert by_visit == {11: 0.5, 12: -0.25, 21: 0.0}
    assert {r["specialty"] for r in heavy.collect()} == {"cardiology", "no matching concept", None}


def test_only_the_latest_visit_of_a_type_has_weight(spark, weights):
    rows = [(1, 5, "Office Visit", dt.date(2020, 5, 1), 0, None), (1, 6, "Office Visit", dt.date(2020, 6, 1), 0, None), (2, 7, "Office Visit", dt.date(2020, 4, 1), 0, None)]
    visits = spark.createDataFrame(rows, "person_id bigint, visit_id bigint, type string, start date, duration int, specialty string")
    got = {r["visit_id"]: r["weight"] for r in T.weigh_visits(visits, weights, END).collect()}
    assert got == {5: 0.0, 6: -0.25, 7: -0.25}
    own = spark.createDataFrame([(581477, 365, 3.0, 1)], "concept_id bigint, interval int, weight double, person_id bigint")
    got = {r["visit_id"]: r["weight"] for r in T.weigh_visits(visits, own, END).collect()}
    assert got == {5: 0.0, 6: 3.0, 7: 0.0}


def test_renumbering(weighted):
    slots = {(r["visit_id"], r["concept_id"]): r["concept"] for r in weighted.collect()}
    assert slots[11, 101] == "condition1" and slots[11, 100] == "condition2"
    # names sort as text: "condition 10" before "condition none"
    assert slots[12, 103] == "condition1" and slots[12, 102] == "condition2"
    assert slots[12, 500] == "procedure"


def test_zero_shot(temporal, visits):
    for mode, want in {
        "most_frequent": {101: 1.0, 500: 1.0}, "least_frequent": {101: 9999.0},
        "oldest": {101: 243.0}, "recent": {101: 9757.0},
        "recent_conditions": {101: 9757.0, 500: 0.0}, "oldest_procedures": {101: 0.0, 500: 214.0},
    }.items():
        got = {r["concept_id"]: r["weight"] for r in T.weigh_zero_shot(temporal, visits, mode, END).collect()}
        assert {c: got[c] for c in want} == want, mode
    with pytest.raises(ValueError):
        T.weigh_zero_shot(temporal, visits, "best", END)


SUMMARY = {1: "Summary: The patient is a 63 year old white man.", 2: "Summary: The patient is a 40 year old women."}
INPATIENT = "On February 1, 2020 the patient stayed in the hospital at cardiology for 3 days with a primary complaint of heart attack. He was also treated for flu."
OFFICE = "On March 1, 2020 the patient saw a doctor with a primary complaint of cough. He was also treated for ECG finding. A x ray and scan were performed."


def notes(method, **tables):
    return {r["person_id"]: r["note"] for r in N.patient_notes(method, **tables).collect()}


def test_important_notes(persons, heavy, weighted, values):
    tables = dict(persons=persons, visits=heavy, temporal=weighted, values=values)
    got = notes("n_important_visits_and_conditions_and_procedures", num_concepts=10, **tables)
    assert got[1] == f"{SUMMARY[1]}\n\n{INPATIENT}\n\n{OFFICE}"
    assert got[2].strip() == SUMMARY[2]
    few = notes("n_important_visits_and_conditions_and_procedures", num_concepts=1, **tables)
    assert few[1] == f"{SUMMARY[1]}\n\nOn March 1, 2020 the patient saw a doctor with a primary complaint of cough. A x ray was performed."
    plain = notes("n_important_visits", num_concepts=10, **tables)
    assert "also treated" not in plain[1] and "performed" not in plain[1]
    listed = notes("list_n_important_visits_and_conditions_and_procedures", num_concepts=10, **tables)
    assert "March 1, 2020: saw a doctor\nConditions:\n- cough\n- ECG finding\nProcedures:\n- x ray\n- scan" in listed[1]


def test_permuted_notes(spark, persons, heavy, weighted, values):
    tables = dict(persons=persons, visits=heavy, temporal=weighted, values=values, num_concepts=10)
    with pytest.raises(ValueError):
        N.patient_notes("permuted_n_important_visits_and_conditions_and_procedures", **tables)
    swap = spark.createDataFrame([(101, 100), (100, 101)], "id bigint, new_id bigint")
    none = spark.createDataFrame([], "id bigint, new_id bigint")
    got = notes("permuted_n_important_visits_and_conditions_and_procedures", permuted=(swap, none), **tables)
    assert "primary complaint of flu. He was also treated for heart attack." in got[1]
    with pytest.raises(KeyError):
        N.patient_notes("poem", **tables)


def test_budget(spark, persons, heavy, weighted, values):
    tables = dict(persons=persons, visits=heavy, temporal=weighted, values=values)
    full = notes("n_important_visits_and_conditions_and_procedures", num_concepts=50, **tables)
    assert full[1].endswith("performed.")
    count = lambda text: len(text.split())
    # The note after each entity, without a limit on tokens; then every limit cuts at the first one too long.
    entities = N.important_entities(heavy, weighted, 50)
    most_ranks = entities.where("person_id = 1").count()
    steps = [notes("n_important_visits_and_conditions_and_procedures", num_concepts=n, **tables)[1] for n in range(1, most_ranks + 1)]
    for most in (5, 35, 45, 1000):
        found = {r["person_id"]: r for r in N.important_concept_notes(num_concepts=50, max_tokens=most, suffix=" a b", **tables).collect()}
        fits = [count(note) + 2 < most * N.SAFETY_MARGIN for note in steps]
        kept = fits.index(False) if False in fits else len(fits)
        assert (found[1]["kept"], found[1]["over"]) == (kept, False in fits)
        assert found[1]["note"] == (steps[kept - 1] if kept else SUMMARY[1] + "\n\n")
        assert (found[2]["kept"], found[2]["over"]) == (0, False)
        tried = N.tried_entities(entities, spark.createDataFrame(list(found.values()), "person_id bigint, note string, kept int, over boolean"))
        assert tried.where("person_id = 1").count() == kept + (False in fits)


def test_budget_with_rare_blanks(spark, persons, heavy, weighted, values):
    """A person with a rare blank is cleaned and counted with the long class, others with the short one."""
    spaced = values.withColumn("value", F.when(F.col("concept_id") == 103, F.lit("cou\u2003gh")).otherwise(F.col("value")))
    tables = dict(persons=persons, visits=heavy, temporal=weighted, values=spaced)
    full = notes("n_important_visits_and_conditions_and_procedures", num_concepts=10, **tables)
    found = {r["person_id"]: r for r in N.important_concept_notes(num_concepts=50, **tables).collect()}
    assert "cou\u2003gh" in full[1] and found[1]["note"] == full[1]
    need = len(full[1].split())
    cut = {r["person_id"]: r["over"] for r in N.important_concept_notes(num_concepts=50, max_tokens=need / N.SAFETY_MARGIN, **tables).collect()}
    assert cut == {1: True, 2: False}


def test_other_forms(spark, persons, heavy, weighted, values):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "person_id bigint, label int")
    leak = notes("label_leakage", persons=persons, labels=labels)
    assert leak[1].strip() == "Summary: The patient is a 63 year old man. he has several severe illnesses and is in a very unhealthy condition."
    assert "she has no complaints" in leak[2]
    lines = notes("all_non_zero_conditions", persons=persons, visits=heavy, temporal=weighted, values=values)
    assert lines[1].endswith("Conditions:\n- 2020: flu\n- 2020: heart attack\n- 2020: ECG finding\n- 2020: cough")
    top = notes("n_important_conditions", persons=persons, visits=heavy, temporal=weighted, values=values, num_concepts=1)
    assert top[1] == f"{SUMMARY[1]}\n\nOn March 1, 2020 the patient saw a doctor with a primary complaint of cough."
    last = notes("last_n_visits", persons=persons, visits=heavy, temporal=weighted, values=values, num_visits=1)
    assert last[1] == top[1] and last[2].strip() == SUMMARY[2]


def test_equal_visit_texts_count_once(spark, persons, values):
    rows = [(1, i, "Office Visit", dt.date(2020, 5, 1 + (i > 2)), 0, None) for i in range(4)]
    visits = spark.createDataFrame(rows, "person_id bigint, visit_id bigint, type string, start date, duration int, specialty string")
    temporal = spark.createDataFrame([(1, i, 100, "condition1") for i in range(4)], "person_id bigint, visit_id bigint, concept_id bigint, concept string")
    got = N.last_visits(visits, temporal, values, 3).orderBy("rank").collect()
    assert [(r["rank"], r["visit_id"]) for r in got] == [(1, 3), (2, 2)]


def test_concept_flags(persons, heavy, weighted, values):
    entities = N.important_entities(heavy, weighted, 2)
    got = {(r["person_id"], r["concept"]): r["selected"] for r in N.concepts_in_notes(persons, entities, weighted, values).collect()}
    assert got[1, "age"] == 63 and got[1, "sex_male"] == 1 and got[2, "sex_female"] == 1
    assert got[1, "race_white"] == 1 and got[2, "race_race_not_recorded"] == 1
    assert got[1, "x ray"] == 1 and got[1, "cough"] == 1 and (1, "flu") not in got


def test_short_phrases(spark):
    values = spark.createDataFrame([(1, "Acute chest pain"), (2, "Other")], "concept_id bigint, value string")
    short = spark.createDataFrame([("acute chest pain", "chest pain")], "long_name string, short_name string")
    got = {r["concept_id"]: r["value"] for r in N.concept_phrases(values, short).collect()}
    assert got == {1: "chest pain", 2: "other"}
