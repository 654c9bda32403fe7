"""Patient timelines over the events table: a user is a person, an event an entry.

Every event becomes an entry of concept strings (visit attributes, conditions,
procedures, drugs) derived from its type, value and props. Some visits come in two
entries, some have no id, some conditions are unnumbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.operators import notes as N
from rowscribe.operators import timeline as T
from rowscribe.phrasebook import RACES, VISIT_CONCEPTS, VISIT_PHRASES
from rowscribe.plans.registry import query, sql_clean, table, text_rows
from rowscribe.session import cut_lineage

END = "2024-01-31"
TYPES = {
    "view": "Office Visit",
    "click": "Outpatient Visit",
    "purchase": "Inpatient Visit",
    "error": "Pharmacy visit",
    "signup": "Hospice",
}
INTERVALS = (10, 25)


# --- Spark side ---------------------------------------------------------------------


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one or two entries of every event, as an array."""
    columns = ("event_id", "ts", "user_id", "event_type", "value", "props")
    events = text_rows(spark, sf_dir, "events", *columns).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    k, key = F.col("k"), T.visit_key(F.col("ts"))
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    first = F.array_compact(
        F.array(
            F.when(k % 20 != 0, _text("1 - visit id - ", key)),
            _text("2 - visit type - ", types[F.col("event_type")]),
            _text("3 - visit start - ", F.date_format("ts", "yyyy-MM-dd")),
            _text("4 - visit duration - ", k % 5),
            F.when(k % 3 == 1, F.lit("5 - visit specialty - No matching concept")),
            F.when(k % 3 == 2, F.lit("5 - visit specialty - Cardiology")),
            _text(100 + k % 37, " - condition ", 1 + k % 2, " - x"),
            F.when(k % 4 == 0, _text(100 + k * 7 % 37, " - condition - x")),
            F.when(k % 2 == 0, _text(140 + k % 11, " - condition 3 - x")),
            F.when(F.col("value") > 100, _text(500 + F.col("event_id") % 23, " - procedure - x")),
            F.when(F.col("value") > 200, _text(530 + F.col("event_id") % 7, " - procedure - x")),
            F.when(k % 11 == 0, F.lit("900 - drug - x")),
        )
    )
    later = F.array(
        F.lit("2 - visit type - Outpatient Visit"),
        F.lit("4 - visit duration - 9"),
        F.lit("5 - visit specialty - Surgery"),
        _text(100 + k % 37, " - condition - x"),
    )
    pieces = F.array_compact(
        F.array(
            F.struct((F.col("event_id") * 2).alias("pos"), first.alias("concepts")),
            F.when(
                k % 5 == 0,
                F.struct((F.col("event_id") * 2 + 1).alias("pos"), later.alias("concepts")),
            ),
        )
    )
    return events.select(F.col("user_id").alias("person_id"), F.col("ts").alias("date"), pieces.alias("pieces"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An event always has an entry. The outer form adds no filter on the size of the array,
    # which would build all strings of an event, and parse its props, a second time.
    return _pieces(spark, sf_dir).select("person_id", "date", F.explode_outer("pieces").alias("e")).select(
        "person_id", "e.pos", "date", "e.concepts"
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records: the entries of an event as arrays of concept strings and dates."""
    return _pieces(spark, sf_dir).select(
        "person_id",
        F.col("pieces.concepts").alias("visits"),
        F.array_repeat("date", F.size("pieces")).alias("dates"),
    )


class Timeline:
    """The tables the timeline queries share. With ``stored`` the visit and concept
    tables, and their weighted forms, are written once: a note reads each several times,
    and parsing the entries anew for every reading would cost more than the write."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.keep = cut_lineage if stored else (lambda df, name: df)
        self.parsed = self.keep(T.parse_entries(entries(spark, sf_dir)), "parsed")
        self.visits = self.keep(T.visits_of(self.parsed), "visits")
        self.temporal = self.keep(T.unique_concepts(T.temporal_of(self.parsed)), "temporal")
        users = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id")).distinct()
        p = F.col("person_id")
        self.persons = users.select(
            "person_id",
            (20 + p % 60).alias("age"),
            (p % 2).cast("int").alias("gender"),
            (p % 7).cast("int").alias("race"),
        )

    def weights(self) -> DataFrame:
        """A weight per concept and interval, a quarter of a whole number."""
        ids = {name: number for number, name in VISIT_CONCEPTS.items()}
        codes = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
        concepts = (
            self.temporal.select("concept_id")
            .unionByName(self.visits.select(codes[F.col("type")].cast("bigint").alias("concept_id")))
            .distinct()
        )
        spread = concepts.withColumn(
            "interval", F.explode(F.array(*[F.lit(i) for i in INTERVALS]))
        )
        points = (F.col("concept_id") * 13 + F.col("interval")) % 17 - 8
        return spread.withColumn("weight", points * F.lit(0.25))

    def long_values(self) -> DataFrame:
        c = F.col("concept_id")
        phrase = (
            F.when(c < 500, _text("Disorder number ", c))
            .when(c < 900, _text("EKG type ", c))
            .otherwise(_text("Drug ", c))
        )
        return self.temporal.select("concept_id").distinct().withColumn("value", phrase)

    def values(self) -> DataFrame:
        return N.concept_phrases(self.long_values())

    def weighted_visits(self) -> DataFrame:
        return self.keep(T.weigh_visits(self.visits, self.weights(), END), "weighted-visits")

    def weighted_concepts(self) -> DataFrame:
        weighed = T.weigh_concepts(self.temporal, self.visits, self.weights(), END)
        return self.keep(T.renumber_conditions(weighed), "weighted-concepts")


# --- SQL side -----------------------------------------------------------------------

_EV = f"""ev AS MATERIALIZED (SELECT event_id, user_id AS person_id, event_type, value, k,
        epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS visit_id, ts::DATE AS start
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
av AS MATERIALIZED (SELECT person_id, visit_id, k,
        CASE event_type {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in TYPES.items())} END AS type, start,
        k % 5 AS duration, CASE WHEN k % 3 = 1 THEN 'No matching concept' WHEN k % 3 = 2 THEN 'Cardiology'
        WHEN k % 5 = 0 THEN 'Surgery' END AS specialty FROM ev),
v AS MATERIALIZED (SELECT * EXCLUDE (k) FROM av WHERE k % 20 <> 0),
tm AS MATERIALIZED (
    SELECT person_id, visit_id, (100 + k % 37)::BIGINT AS concept_id, 'condition ' || (1 + k % 2) AS concept FROM ev
    UNION ALL SELECT person_id, visit_id, 100 + k * 7 % 37, 'condition' FROM ev WHERE k % 4 = 0
    UNION ALL SELECT person_id, visit_id, 140 + k % 11, 'condition 3' FROM ev WHERE k % 2 = 0
    UNION ALL SELECT person_id, visit_id, 500 + event_id % 23, 'procedure' FROM ev WHERE value > 100
    UNION ALL SELECT person_id, visit_id, 530 + event_id % 7, 'procedure' FROM ev WHERE value > 200
    UNION ALL SELECT person_id, visit_id, 900, 'drug' FROM ev WHERE k % 11 = 0
    UNION ALL SELECT person_id, visit_id, 100 + k % 37, 'condition' FROM ev WHERE k % 5 = 0),
u AS MATERIALIZED (SELECT person_id, visit_id, concept_id, min(concept) AS concept FROM
    (SELECT * REPLACE (CASE WHEN concept = 'condition' THEN 'condition none' ELSE concept END AS concept) FROM tm)
    GROUP BY person_id, visit_id, concept_id, CASE WHEN concept LIKE 'condition%' THEN 'condition' ELSE concept END)"""

_VISIT_IDS = "CASE type " + " ".join(
    f"WHEN '{name}' THEN {number}" for number, name in VISIT_CONCEPTS.items()
) + " END"

_W = f"""{_EV},
w AS MATERIALIZED (SELECT concept_id, i AS interval, ((concept_id * 13 + i) % 17 - 8) * 0.25::DOUBLE AS weight
    FROM (SELECT concept_id FROM u UNION SELECT {_VISIT_IDS} FROM v), (SELECT unnest({list(INTERVALS)}) AS i)),
vs AS MATERIALIZED (SELECT v.person_id, visit_id, type, start, duration, lower(specialty) AS specialty,
        sum(CASE WHEN start < DATE '{END}' - interval THEN 0 ELSE weight END) AS ws,
        sum(CASE WHEN start < DATE '{END}' - interval THEN 0 ELSE abs(weight) END) AS aws,
        max(late) AS late
    FROM (SELECT *, row_number() OVER (PARTITION BY person_id, type ORDER BY start DESC, visit_id DESC) AS late FROM v) v
    LEFT JOIN w ON w.concept_id = {_VISIT_IDS} GROUP BY v.person_id, visit_id, type, start, duration, specialty),
vw AS MATERIALIZED (SELECT person_id, visit_id, type, start, duration, specialty,
        CASE WHEN late = 1 THEN coalesce(ws, 0) ELSE 0 END::DOUBLE AS weight,
        CASE WHEN late = 1 THEN coalesce(aws, 0) ELSE 0 END::DOUBLE AS abs_weight FROM vs),
cw AS MATERIALIZED (SELECT u.person_id, u.visit_id, u.concept_id, concept,
        coalesce(sum(CASE WHEN start < DATE '{END}' - interval THEN 0 ELSE weight END), 0)::DOUBLE AS weight,
        coalesce(sum(CASE WHEN start < DATE '{END}' - interval THEN 0 ELSE abs(weight) END), 0)::DOUBLE AS abs_weight
    FROM u LEFT JOIN v ON v.person_id = u.person_id AND v.visit_id = u.visit_id
    LEFT JOIN w ON w.concept_id = u.concept_id GROUP BY ALL),
nc AS MATERIALIZED (SELECT * REPLACE (CASE WHEN concept LIKE 'condition%' THEN 'condition' || row_number() OVER (
        PARTITION BY person_id, visit_id, concept LIKE 'condition%' ORDER BY concept, weight DESC, concept_id)
        ELSE concept END AS concept) FROM cw)"""


def _first_sql(kind: str, weight: str = "abs_weight <> 0") -> str:
    return f"""SELECT person_id, visit_id, concept_id, concept, start, abs_weight AS weight FROM (
        SELECT nc.*, start, row_number() OVER (PARTITION BY nc.person_id, concept_id
            ORDER BY start IS NULL, start, nc.visit_id, concept) AS rn
        FROM nc LEFT JOIN v ON v.person_id = nc.person_id AND v.visit_id = nc.visit_id
        WHERE concept LIKE '{kind}%' AND {weight}) WHERE rn = 1"""


def _entities_sql(n: int) -> str:
    return f"""{_W},
fc AS MATERIALIZED ({_first_sql('condition')}),
fp AS MATERIALIZED ({_first_sql('procedure')}),
al AS (SELECT vw.person_id, vw.visit_id, vw.start, NULL::BIGINT AS concept_id,
        vw.abs_weight + coalesce(fc.weight, 0) AS weight, 0 AS kind FROM vw LEFT JOIN fc
        ON fc.person_id = vw.person_id AND fc.visit_id = vw.visit_id AND fc.concept = 'condition1'
    UNION ALL SELECT person_id, visit_id, start, concept_id, weight, 1 FROM fc WHERE concept <> 'condition1'
    UNION ALL SELECT person_id, visit_id, start, concept_id, weight, 2 FROM fp),
en AS MATERIALIZED (SELECT person_id, rank::INT AS rank, ['v', 'c', 'p'][kind + 1] AS kind, visit_id, concept_id, weight
    FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY weight DESC, kind, start DESC,
        visit_id DESC, concept_id NULLS FIRST) AS rank FROM al WHERE weight <> 0 AND start IS NOT NULL)
    WHERE rank <= {n})"""


_VALUE = """CASE WHEN {c} < 500 THEN 'disorder number ' || {c} WHEN {c} < 900 THEN 'EKG type ' || {c}
    ELSE 'drug ' || {c} END"""


def _value_sql(column: str) -> str:
    return "(" + _VALUE.format(c=column) + ")"


_TYPE_PHRASE = "CASE lower(type) " + " ".join(
    f"WHEN '{t}' THEN '{p}'" for t, p in VISIT_PHRASES.items()
) + " ELSE type END"


def _facts_sql() -> str:
    races = "[" + ", ".join("NULL" if i == 0 else f"'{r}'" for i, r in enumerate(RACES)) + "]"
    return f"""pf AS MATERIALIZED (SELECT *, replace(replace('Summary: The patient is a ' || age || ' year old '
        || coalesce(race, '') || ' ' || gender || '.', ' male', ' man'), ' female', ' women') AS summary,
        replace(replace('Summary: The patient is a ' || age || ' year old  ' || gender || '.', ' male', ' man'),
        ' female', ' women') AS plain_summary FROM (SELECT DISTINCT person_id, 20 + person_id % 60 AS age,
        ['female', 'male'][person_id % 2 + 1] AS gender, {races}[person_id % 7 + 1] AS race FROM ev))"""


def _sentence_sql(c1: str, conditions: str, procedures: str, gender: str) -> str:
    raw = f"""'On ' || strftime(start, '%B %-d, %Y') || ' the patient ' || {_TYPE_PHRASE} || ' '
        || CASE WHEN lower(specialty) <> 'no matching concept' THEN 'at ' || specialty ELSE '' END || ' '
        || CASE WHEN duration <> 0 THEN 'for ' || duration || ' days' ELSE '' END || ' '
        || coalesce('with a primary complaint of ' || {c1}, '') || '.' || {gender} || ' '
        || coalesce('The patient was also treated for ' || {conditions}, '') || '.' || {procedures}"""
    for old, new in (
        (".male The patient", ". He"), (".female The patient", ". She"), (".male ", ". "),
        (".female ", ". "), ("saw a doctor at", "saw a doctor for"),
        ("visited a pharmacy at", "visited a pharmacy for"),
    ):
        raw = f"replace({raw}, '{old}', '{new}')"
    return raw


def _list_sql(c1: str, conditions: str, procedures: str) -> str:
    raw = f"""strftime(start, '%B %-d, %Y') || ': ' || {_TYPE_PHRASE} || ' '
        || CASE WHEN lower(specialty) <> 'no matching concept' THEN 'at ' || specialty ELSE '' END || ' '
        || CASE WHEN duration <> 0 THEN 'for ' || duration || ' days' ELSE '' END
        || coalesce(chr(10) || 'Conditions:' || chr(10) || '- ' || {c1}, '')
        || coalesce(chr(10) || '- ' || {conditions}, '')
        || coalesce(chr(10) || 'Procedures:' || chr(10) || '- ' || {procedures}, '')"""
    for old, new in (
        ("saw a doctor at", "saw a doctor for"), ("visited a pharmacy at", "visited a pharmacy for"),
    ):
        raw = f"replace({raw}, '{old}', '{new}')"
    return raw


_PRIMARY = f"""pr AS MATERIALIZED (SELECT person_id, visit_id, {_value_sql('concept_id')} AS c1 FROM nc
    WHERE concept = 'condition1')"""


def _chosen_sql(entities: str, as_list: bool) -> str:
    glue = "chr(10) || '- '" if as_list else "' and '"
    return f"""ch AS MATERIALIZED (SELECT person_id, visit_id,
        string_agg({_value_sql('concept_id')}, {glue} ORDER BY rank) FILTER (kind = 'c') AS cs,
        string_agg({_value_sql('concept_id')}, {glue} ORDER BY rank) FILTER (kind = 'p') AS ps,
        count(*) FILTER (kind = 'p') AS n_p FROM {entities} GROUP BY person_id, visit_id),
    sn AS MATERIALIZED (SELECT ch.person_id, vw.start, ch.visit_id, {
        _list_sql('c1', 'cs', 'ps') if as_list else _sentence_sql(
            'c1', 'cs',
            "coalesce(' A ' || ps || CASE WHEN n_p > 1 THEN ' were performed.' ELSE ' was performed.' END, '')",
            'gender')} AS sentence
        FROM ch JOIN vw ON vw.person_id = ch.person_id AND vw.visit_id = ch.visit_id
        LEFT JOIN pr ON pr.person_id = ch.person_id AND pr.visit_id = ch.visit_id
        JOIN pf ON pf.person_id = ch.person_id)"""


_GAP = "chr(10) || chr(10) || '    '"
_BODY = "bd AS (SELECT person_id, string_agg(sentence, chr(10) || chr(10) ORDER BY start, visit_id) AS body FROM sn GROUP BY 1)"


def _note_sql(n: int, as_list: bool = False, entities: str = "en", extra: str = "") -> str:
    return f"""WITH {_entities_sql(n)}, {_facts_sql()}, {_PRIMARY}{extra}, {_chosen_sql(entities, as_list)}, {_BODY}
    SELECT pf.person_id, {sql_clean(f"summary || {_GAP} || coalesce(body, '')")} AS note
    FROM pf LEFT JOIN bd ON bd.person_id = pf.person_id"""


# --- queries ------------------------------------------------------------------------


@query("timeline_visits", f"WITH {_EV} SELECT * FROM v")
def timeline_visits(spark, sf_dir):
    return Timeline(spark, sf_dir).visits


@query(
    "timeline_parse",
    f"WITH {_EV} SELECT person_id, visit_id, concept_id, concept FROM tm",
)
def timeline_parse(spark, sf_dir):
    return T.temporal_of(Timeline(spark, sf_dir).parsed)


@query(
    "timeline_person_records",
    f"WITH {_EV} SELECT person_id, visit_id, concept_id, concept FROM tm",
)
def timeline_person_records(spark, sf_dir):
    return T.temporal_of(T.parse_entries(T.entries_of(records(spark, sf_dir))))


@query(
    "timeline_short_names",
    f"""WITH {_EV} SELECT concept_id, CASE WHEN concept_id % 3 = 0 THEN 'no. ' || concept_id ELSE {_value_sql('concept_id')} END AS value
    FROM (SELECT DISTINCT concept_id FROM u)""",
)
def timeline_short_names(spark, sf_dir):
    """Every third concept has a short name, listed under its long name in capitals."""
    long = Timeline(spark, sf_dir).long_values()
    short = long.where("concept_id % 3 = 0").select(
        F.upper("value").alias("long_name"), _text("no. ", F.col("concept_id")).alias("short_name")
    )
    return N.concept_phrases(long, short)


@query(
    "timeline_artifacts",
    f"""WITH {_EV} SELECT sum((k % 20 = 0)::INT)::BIGINT AS artifacts, count(*) AS visits FROM av""",
)
def timeline_artifacts(spark, sf_dir):
    return T.artifact_visits(Timeline(spark, sf_dir).parsed)


@query("timeline_concepts", f"WITH {_EV} SELECT * FROM u")
def timeline_concepts(spark, sf_dir):
    return Timeline(spark, sf_dir).temporal


@query("timeline_weights_visits", f"WITH {_W} SELECT * FROM vw")
def timeline_weights_visits(spark, sf_dir):
    return Timeline(spark, sf_dir, stored=True).weighted_visits()


@query(
    "timeline_person_visit_weights",
    f"""WITH {_EV}, px AS (SELECT *, row_number() OVER (PARTITION BY person_id, type ORDER BY start DESC, visit_id DESC) AS late,
        CASE WHEN ({_VISIT_IDS}) IS NULL OR start < DATE '{END}' - 20 THEN 0 ELSE (person_id % 5 - 2) * 0.5 END::DOUBLE AS ws FROM v)
    SELECT person_id, visit_id, type, start, duration, lower(specialty) AS specialty,
        CASE WHEN late = 1 THEN ws ELSE 0 END::DOUBLE AS weight,
        CASE WHEN late = 1 THEN abs(ws) ELSE 0 END::DOUBLE AS abs_weight FROM px""",
)
def timeline_person_visit_weights(spark, sf_dir):
    """Every person has a weight of their own for each type of visit."""
    visits = Timeline(spark, sf_dir).visits
    codes = F.create_map(*[F.lit(x) for number, name in VISIT_CONCEPTS.items() for x in (name, number)])
    own = visits.select("person_id", codes[F.col("type")].cast("bigint").alias("concept_id")).distinct()
    weights = own.withColumns({"interval": F.lit(20), "weight": (F.col("person_id") % 5 - 2) * F.lit(0.5)})
    return T.weigh_visits(visits, weights, END)


@query("timeline_weights", f"WITH {_W} SELECT * FROM nc")
def timeline_weights(spark, sf_dir):
    return Timeline(spark, sf_dir, stored=True).weighted_concepts()


@query(
    "timeline_person_weights",
    f"""WITH {_W}, pw AS (SELECT person_id, concept_id, 20 AS interval, (person_id % 5 - 2) * 0.5::DOUBLE AS weight
        FROM u GROUP BY 1, 2)
    SELECT u.person_id, u.visit_id, u.concept_id, concept,
        CASE WHEN start < DATE '{END}' - interval THEN 0 ELSE weight END::DOUBLE AS weight,
        CASE WHEN start < DATE '{END}' - interval THEN 0 ELSE abs(weight) END::DOUBLE AS abs_weight
    FROM u LEFT JOIN v ON v.person_id = u.person_id AND v.visit_id = u.visit_id
    JOIN pw ON pw.person_id = u.person_id AND pw.concept_id = u.concept_id""",
)
def timeline_person_weights(spark, sf_dir):
    """Weights that differ by person."""
    t = Timeline(spark, sf_dir, stored=True)
    weights = (
        t.temporal.select("person_id", "concept_id")
        .distinct()
        .select("*", F.lit(20).alias("interval"), ((F.col("person_id") % 5 - 2) * F.lit(0.5)).alias("weight"))
    )
    return T.weigh_concepts(t.temporal, t.visits, weights, END)


_COUNTS = "count(*) OVER (PARTITION BY u.person_id, u.concept_id)"
_AGE = f"date_diff('day', start, DATE '{END}')"


@query(
    "timeline_zero_shot_weights",
    f"""WITH {_EV}, j AS (SELECT u.*, start, {_COUNTS} AS f FROM u LEFT JOIN v
        ON v.person_id = u.person_id AND v.visit_id = u.visit_id),
    m AS (SELECT *, 'most_frequent' AS mode, f::DOUBLE AS weight FROM j UNION ALL
        SELECT *, 'least_frequent', (10000 - f)::DOUBLE FROM j UNION ALL
        SELECT *, 'oldest_procedures', CASE WHEN concept LIKE 'condition%' THEN 0 ELSE {_AGE} END::DOUBLE FROM j UNION ALL
        SELECT *, 'recent_conditions', CASE WHEN concept LIKE 'procedure%' THEN 0 ELSE 10000 - {_AGE} END::DOUBLE FROM j)
    SELECT person_id, visit_id, concept_id, concept, weight, abs(weight) AS abs_weight, mode FROM m""",
)
def timeline_zero_shot_weights(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    modes = ("most_frequent", "least_frequent", "oldest_procedures", "recent_conditions")
    return T.weigh_zero_shot(t.temporal, t.visits, modes, END)


@query(
    "timeline_first_occurrence",
    f"WITH {_W} {_first_sql('condition')}",
)
def timeline_first_occurrence(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    kept = T.use_absolute(t.weighted_concepts()).where(
        F.col("concept").startswith("condition") & (F.col("weight") != 0)
    )
    return T.first_occurrence(kept, t.visits)


@query("timeline_top_concepts", f"WITH {_entities_sql(5)} SELECT * FROM en")
def timeline_top_concepts(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.important_entities(t.weighted_visits(), t.weighted_concepts(), 5)


@query(
    "timeline_checks",
    f"""WITH {_EV} SELECT 'duplicate visits' AS name, count(*) AS n FROM
        (SELECT person_id, visit_id FROM v GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL
    SELECT 'persons without a visit', count(*) FROM (SELECT person_id FROM ev EXCEPT SELECT person_id FROM v)""",
)
def timeline_checks(spark, sf_dir):
    t = Timeline(spark, sf_dir)
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count("duplicate visits", T.duplicate_visits(t.visits)).unionByName(
        count("persons without a visit", T.differing_persons(t.persons, t.visits))
    )


@query("timeline_note", _note_sql(8))
def timeline_note(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.patient_notes(
        "n_important_visits_and_conditions_and_procedures",
        persons=t.persons, visits=t.weighted_visits(), temporal=t.weighted_concepts(),
        values=t.values(), num_concepts=8,
    )


@query("timeline_note_list", _note_sql(6, as_list=True))
def timeline_note_list(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.patient_notes(
        "list_n_important_visits_and_conditions_and_procedures",
        persons=t.persons, visits=t.weighted_visits(), temporal=t.weighted_concepts(),
        values=t.values(), num_concepts=6,
    )


BUDGET = 150
_TOKENS = "len(list_filter(regexp_split_to_array({t}, '[ \\n]+'), lambda x: x <> ''))"
_RAW = f"summary || {_GAP} || coalesce(body, '')"
# Every prefix of a person's entities is a note of its own; the first that reaches the budget ends the person's note.
_BUDGET_SQL = f"""{_entities_sql(30)}, {_facts_sql()}, {_PRIMARY},
    ch AS (SELECT a.person_id, a.rank AS upto, b.visit_id,
        string_agg({_value_sql('b.concept_id')}, ' and ' ORDER BY b.rank) FILTER (b.kind = 'c') AS cs,
        string_agg({_value_sql('b.concept_id')}, ' and ' ORDER BY b.rank) FILTER (b.kind = 'p') AS ps,
        count(*) FILTER (b.kind = 'p') AS n_p
        FROM en a JOIN en b ON b.person_id = a.person_id AND b.rank <= a.rank GROUP BY a.person_id, a.rank, b.visit_id),
    sn AS (SELECT ch.person_id, upto, vw.start, ch.visit_id, {_sentence_sql(
        'c1', 'cs', "coalesce(' A ' || ps || CASE WHEN n_p > 1 THEN ' were performed.' ELSE ' was performed.' END, '')",
        'gender')} AS sentence
        FROM ch JOIN vw ON vw.person_id = ch.person_id AND vw.visit_id = ch.visit_id
        LEFT JOIN pr ON pr.person_id = ch.person_id AND pr.visit_id = ch.visit_id
        JOIN pf ON pf.person_id = ch.person_id),
    bd AS (SELECT person_id, upto, string_agg(sentence, chr(10) || chr(10) ORDER BY start, visit_id) AS body FROM sn GROUP BY 1, 2
        UNION ALL SELECT person_id, 0, NULL FROM pf),
    nt AS MATERIALIZED (SELECT person_id, upto, {sql_clean(_RAW)} AS note FROM bd JOIN pf USING (person_id)),
    ov AS MATERIALIZED (SELECT person_id, max(upto) AS most,
        min(upto) FILTER (upto > 0 AND {_TOKENS.format(t='note')} >= {BUDGET} * 0.95::DOUBLE) AS stop FROM nt GROUP BY 1)"""


@query(
    "timeline_budget",
    f"""WITH {_BUDGET_SQL} SELECT nt.person_id, note, upto AS kept, stop IS NOT NULL AS over
    FROM nt JOIN ov ON ov.person_id = nt.person_id AND upto = coalesce(stop - 1, most)""",
)
def timeline_budget(spark, sf_dir):
    """More than ten concepts: notes stop before they reach the token budget."""
    t = Timeline(spark, sf_dir, stored=True)
    return N.important_concept_notes(
        t.persons, t.weighted_visits(), t.weighted_concepts(), t.values(), 30, max_tokens=BUDGET
    )


_LAST_SQL = f"""{_W}, {_facts_sql()}, {_PRIMARY},
    tx AS (SELECT vw.person_id, vw.visit_id, start, {_sentence_sql('c1', 'NULL::VARCHAR', "''", "''")} AS sentence
        FROM vw JOIN pr ON pr.person_id = vw.person_id AND pr.visit_id = vw.visit_id),
    dd AS (SELECT person_id, sentence, max({{'s': start, 'v': visit_id}}) AS spot FROM tx GROUP BY 1, 2),
    lv AS (SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY spot DESC)::INT AS rank, sentence, spot FROM dd)"""


@query(
    "timeline_last_visits",
    f"""WITH {_LAST_SQL} SELECT person_id, rank, spot.s AS start, spot.v AS visit_id, sentence FROM lv WHERE rank <= 4""",
)
def timeline_last_visits(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.last_visits(t.weighted_visits(), t.weighted_concepts(), t.values(), 4)


@query(
    "timeline_note_last_visits",
    f"""WITH {_LAST_SQL}, bd AS (SELECT person_id, string_agg(sentence, chr(10) || chr(10) ORDER BY rank DESC) AS body
        FROM lv WHERE rank <= 3 GROUP BY 1)
    SELECT pf.person_id, {sql_clean(f"summary || {_GAP} || coalesce(body, '')")} AS note
    FROM pf LEFT JOIN bd ON bd.person_id = pf.person_id""",
)
def timeline_note_last_visits(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.patient_notes(
        "last_n_visits", persons=t.persons, visits=t.weighted_visits(),
        temporal=t.weighted_concepts(), values=t.values(), num_visits=3,
    )


@query(
    "timeline_note_conditions",
    f"""WITH {_W}, {_facts_sql()}, fc AS ({_first_sql('condition', 'abs_weight > 0')}),
    bd AS (SELECT person_id, string_agg('- ' || strftime(start, '%Y') || ': ' || {_value_sql('concept_id')}, chr(10)
        ORDER BY start, visit_id, concept_id) AS body FROM fc GROUP BY 1)
    SELECT pf.person_id, {sql_clean(f"plain_summary || {_GAP} || 'Conditions:' || chr(10) || coalesce(body, '')")} AS note
    FROM pf LEFT JOIN bd ON bd.person_id = pf.person_id""",
)
def timeline_note_conditions(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.patient_notes(
        "all_non_zero_conditions", persons=t.persons, visits=t.visits,
        temporal=t.weighted_concepts(), values=t.values(),
    )


@query(
    "timeline_note_important_conditions",
    f"""WITH {_W}, {_facts_sql()}, {_PRIMARY}, fc AS ({_first_sql('condition')}),
    ic AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id
        ORDER BY weight DESC, start DESC, visit_id DESC, concept_id) AS rank FROM fc) WHERE rank <= 4),
    ex AS (SELECT person_id, visit_id, string_agg({_value_sql('concept_id')}, ' and '
        ORDER BY concept, weight DESC, {_value_sql('concept_id')}) AS cs
        FROM ic WHERE concept <> 'condition1' GROUP BY 1, 2),
    sn AS (SELECT vw.person_id, vw.visit_id, start, {_sentence_sql('c1', 'cs', "''", "''")} AS sentence FROM vw
        LEFT JOIN pr ON pr.person_id = vw.person_id AND pr.visit_id = vw.visit_id
        LEFT JOIN ex ON ex.person_id = vw.person_id AND ex.visit_id = vw.visit_id
        WHERE EXISTS (SELECT 1 FROM ic WHERE ic.person_id = vw.person_id AND ic.visit_id = vw.visit_id)), {_BODY}
    SELECT pf.person_id, {sql_clean(f"summary || {_GAP} || coalesce(body, '')")} AS note
    FROM pf LEFT JOIN bd ON bd.person_id = pf.person_id""",
)
def timeline_note_important_conditions(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    return N.patient_notes(
        "n_important_conditions", persons=t.persons, visits=t.weighted_visits(),
        temporal=t.weighted_concepts(), values=t.values(), num_concepts=4,
    )


@query(
    "timeline_note_leakage",
    f"""WITH {_EV}, {_facts_sql()}
    SELECT person_id, {sql_clean("plain_summary || CASE gender WHEN 'female' THEN ' she' ELSE ' he' END || CASE WHEN person_id % 3 = 0 THEN ' has several severe illnesses and is in a very unhealthy condition' ELSE ' has no complaints and is in a very healthy condition' END || '.' || " + _GAP)} AS note FROM pf""",
)
def timeline_note_leakage(spark, sf_dir):
    t = Timeline(spark, sf_dir)
    labels = t.persons.select("person_id", (F.col("person_id") % 3 == 0).cast("int").alias("label"))
    return N.patient_notes("label_leakage", persons=t.persons, labels=labels)


_RACE_FLAGS = "[" + ", ".join("'race_" + r.replace(" ", "_") + "'" for r in RACES) + "]"


def _flags_sql(entities: str) -> str:
    return f"""pe AS (SELECT DISTINCT person_id FROM ev),
    ph AS (SELECT DISTINCT person_id, concept_id FROM (SELECT person_id, concept_id FROM {entities} WHERE concept_id IS NOT NULL
        UNION ALL SELECT nc.person_id, nc.concept_id FROM nc JOIN {entities} e ON e.person_id = nc.person_id
            AND e.visit_id = nc.visit_id WHERE concept = 'condition1'))
    SELECT person_id, 'age' AS concept, (20 + person_id % 60)::INT AS selected FROM pe
    UNION ALL SELECT person_id, 'sex_male', (person_id % 2)::INT FROM pe
    UNION ALL SELECT person_id, 'sex_female', (1 - person_id % 2)::INT FROM pe
    UNION ALL SELECT person_id, {_RACE_FLAGS}[person_id % 7 + 1], 1 FROM pe
    UNION ALL SELECT person_id, {_value_sql('concept_id')}, 1 FROM ph"""


@query("timeline_concept_flags", f"WITH {_entities_sql(5)}, {_flags_sql('en')}")
def timeline_concept_flags(spark, sf_dir):
    t = Timeline(spark, sf_dir, stored=True)
    concepts = t.weighted_concepts()
    entities = N.important_entities(t.weighted_visits(), concepts, 5)
    return N.concepts_in_notes(t.persons, entities, concepts, t.values())


@query(
    "timeline_budget_flags",
    f"""WITH {_BUDGET_SQL}, eb AS (SELECT en.* FROM en JOIN ov USING (person_id) WHERE rank <= coalesce(stop, most)), {_flags_sql('eb')}""",
)
def timeline_budget_flags(spark, sf_dir):
    """The concepts of notes with a budget, with the one that ended the note."""
    t = Timeline(spark, sf_dir, stored=True)
    visits, concepts = t.weighted_visits(), t.weighted_concepts()
    notes = N.important_concept_notes(t.persons, visits, concepts, t.values(), 30, max_tokens=BUDGET)
    # Read twice; without a write the notes would be folded for each reading.
    entities = t.keep(N.tried_entities(N.important_entities(visits, concepts, 30), notes), "tried")
    return N.concepts_in_notes(t.persons, entities, concepts, t.values())


_PERMUTED = _value_sql("(CASE WHEN concept_id < 500 THEN 100 + (concept_id - 100 + 7) % 51 ELSE concept_id END)")


@query(
    "timeline_note_permuted",
    _note_sql(6).replace(_value_sql("concept_id"), _PERMUTED),
)
def timeline_note_permuted(spark, sf_dir):
    """Conditions exchanged by an id mapping; procedures have no pair and stay."""
    t = Timeline(spark, sf_dir, stored=True)
    c = F.col("concept_id")
    ids = t.temporal.select("concept_id").distinct()
    conditions = ids.where(c < 500).select(c.alias("id"), (100 + (c - 93) % 51).alias("new_id"))
    procedures = ids.where(c > 10000).select(c.alias("id"), c.alias("new_id"))
    values = N.concept_phrases(
        ids.where(c >= 500)
        .unionByName(conditions.select(F.col("new_id").alias("concept_id")))
        .distinct()
        .withColumn(
            "value",
            F.when(c < 500, _text("Disorder number ", c))
            .when(c < 900, _text("EKG type ", c))
            .otherwise(_text("Drug ", c)),
        )
    )
    return N.patient_notes(
        "permuted_n_important_visits_and_conditions_and_procedures",
        persons=t.persons, visits=t.weighted_visits(), temporal=t.weighted_concepts(),
        values=values, num_concepts=6, permuted=(conditions, procedures),
    )
