"""Patient notes from weighted visit and concept tables.

Inputs besides the timeline tables
  persons  person_id, age, gender (code), race (code)
  values   concept_id, value   the phrase of a concept
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscribe import phrasebook as P
from rowscribe.functions.arrays import ordered_join
from rowscribe.functions.text import (
    WS,
    absent_if,
    clean_note,
    clean_notes,
    has_rare_space,
    lower_first_if_second_low,
    phrases,
    replace_all,
    token_count,
)
from rowscribe.operators.template import NoteTemplate
from rowscribe.operators.timeline import (
    VISIT_KEY,
    attach_slot,
    first_occurrence,
    use_absolute,
)

# The wording of the notes.
NOTE_GAP = "\n\n    "
VISIT_GAP = "\n\n"
NAME = "the patient"
SUMMARY = NoteTemplate(
    "Summary: ${name} is a ${age} year old ${race_text} ${gender}.",
    defaults={"name": "The patient"},
    fns=replace_all([(" male", " man"), (" female", " women")]),
)
_PRE = {
    "duration": lambda days: F.nullif(days, F.lit(0)),
    "type": lambda t: F.coalesce(phrases(P.VISIT_PHRASES, "null")(F.lower(t)), t),
    "specialty": absent_if(P.NO_SPECIALTY),
}
_AT_TO_FOR = [
    ("saw a doctor at", "saw a doctor for"),
    ("visited a pharmacy at", "visited a pharmacy for"),
]
VISIT = NoteTemplate(
    "On ${start} ${name} ${type} ${specialty} ${duration} ${condition1}.${gender} "
    "${conditions}.${procedures}",
    prefixes={
        "duration": "for ",
        "specialty": "at ",
        "condition1": "with a primary complaint of ",
        "conditions": "The patient was also treated for ",
        "procedures": " A ",
    },
    suffixes={"duration": " days"},
    defaults={"type": "visit", "name": NAME},
    pre=_PRE,
    fns=replace_all(
        [
            (".male The patient", ". He"),
            (".female The patient", ". She"),
            (".male ", ". "),
            (".female ", ". "),
            *_AT_TO_FOR,
        ]
    ),
)
VISIT_LIST = NoteTemplate(
    "${start}: ${type} ${specialty} ${duration}${condition1}${conditions}${procedures}",
    prefixes={
        "duration": "for ",
        "specialty": "at ",
        "condition1": "\nConditions:\n- ",
        "conditions": "\n- ",
        "procedures": "\nProcedures:\n- ",
    },
    suffixes={"duration": " days"},
    defaults={"type": "visit"},
    pre=_PRE,
    fns=replace_all(_AT_TO_FOR),
)
LEAK_ILL = "has several severe illnesses and is in a very unhealthy condition"
LEAK_WELL = "has no complaints and is in a very healthy condition"
CONDITIONS_HEAD = "Conditions:\n"

# The token budget of a note.
MAX_TOKENS = 1024
SAFETY_MARGIN = 0.95
UNCHECKED_CONCEPTS = 10


def person_facts(persons: DataFrame) -> DataFrame:
    """Codes as words; 'race not recorded' counts as absent."""
    genders = F.array(*[F.lit(g) for g in P.GENDERS])
    races = F.array(*[F.lit(r) for r in P.RACES])
    gender = F.element_at(genders, F.col("gender").cast("int") + 1)
    return persons.select(
        "person_id",
        "age",
        gender.alias("gender"),
        F.nullif(F.element_at(races, F.col("race").cast("int") + 1), F.lit(P.NO_RACE)).alias(
            "race_text"
        ),
        F.when(gender == "female", P.PRONOUNS["female"]).otherwise(P.PRONOUNS["male"]).alias(
            "pronoun"
        ),
    )


def summaries(persons: DataFrame) -> DataFrame:
    """person_id, gender, pronoun, summary."""
    facts = person_facts(persons)
    return facts.select("person_id", "gender", "pronoun", SUMMARY.render(facts).alias("summary"))


def concept_phrases(values: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """Phrases with a lower first letter; (long_name, short_name) pairs replace them."""
    worded = values.select("concept_id", lower_first_if_second_low(F.col("value")).alias("value"))
    if short is None:
        return worded
    pairs = short.select(F.lower("long_name").alias("_long"), F.col("short_name").alias("_short"))
    return worded.join(pairs, F.lower("value") == F.col("_long"), "left").select(
        "concept_id", F.coalesce("_short", "value").alias("value")
    )


def assemble_notes(summary: DataFrame, bodies: DataFrame) -> DataFrame:
    """person_id, note: the summary, then the visit text, for every person."""
    joined = summary.join(bodies, "person_id", "left")
    raw = F.concat("summary", F.lit(NOTE_GAP), F.coalesce("visits", F.lit("")))
    return clean_notes(joined, raw, "note").select("person_id", "note")


def _visit_bodies(sentences: DataFrame) -> DataFrame:
    """Visit texts of a person joined from the earliest to the latest."""
    entry = F.struct(F.struct("start", "visit_id").alias("at"), F.col("sentence").alias("text"))
    return sentences.groupBy("person_id").agg(
        ordered_join(F.collect_list(entry), VISIT_GAP).alias("visits")
    )


def important_entities(
    visits: DataFrame,
    temporal: DataFrame,
    num_concepts: int,
    conditions: bool = True,
    procedures: bool = True,
    abs_weight: bool = True,
    zero_weight: bool = False,
) -> DataFrame:
    """The most important visits, conditions and procedures of each person.

    person_id, rank, kind (v, c, p), visit_id, concept_id, weight. A visit's weight
    includes that of its primary condition, which is not listed on its own. Equal
    weights: visits before conditions before procedures, later ones first.
    """
    weighed = use_absolute(temporal, abs_weight)
    kept = weighed if zero_weight else weighed.where(F.col("weight") != 0)
    first = first_occurrence(
        kept.where(F.col("concept").startswith("condition")), visits
    )
    primary = first.where(F.col("concept") == "condition1").select(
        *VISIT_KEY, F.col("weight").alias("_primary")
    )
    listed = [
        use_absolute(visits, abs_weight)
        .join(primary, list(VISIT_KEY), "left")
        .select(
            *VISIT_KEY,
            "start",
            F.lit(None).cast("bigint").alias("concept_id"),
            (F.col("weight") + F.coalesce("_primary", F.lit(0.0))).alias("weight"),
            F.lit(0).alias("_kind"),
        )
    ]
    if conditions:
        listed.append(
            first.where(F.col("concept") != "condition1").select(
                *VISIT_KEY, "start", "concept_id", "weight", F.lit(1).alias("_kind")
            )
        )
    if procedures:
        listed.append(
            first_occurrence(
                kept.where(F.col("concept").startswith("procedure")), visits
            ).select(*VISIT_KEY, "start", "concept_id", "weight", F.lit(2).alias("_kind"))
        )
    entities = listed[0]
    for part in listed[1:]:
        entities = entities.unionByName(part)
    if not zero_weight:
        entities = entities.where(F.col("weight") != 0)
    order = Window.partitionBy("person_id").orderBy(
        F.desc("weight"), "_kind", F.desc("start"), F.desc("visit_id"), "concept_id"
    )
    # An entity is shown with its visit, so it needs one; the limit on the rank lets
    # Spark trim each person before the shuffle.
    return (
        entities.where(F.col("start").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= num_concepts)
        .select(
            "person_id",
            "rank",
            F.element_at(F.array(F.lit("v"), F.lit("c"), F.lit("p")), F.col("_kind") + 1).alias(
                "kind"
            ),
            "visit_id",
            "concept_id",
            "weight",
        )
    )


def notes_within_budget(
    summary: DataFrame,
    versions: DataFrame,
    max_tokens: int = MAX_TOKENS,
    suffix: str = "",
    tokens: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """person_id, note, kept, over: the longest note that stays below the budget.

    ``versions`` (person_id, rank, start, visit_id, sentence) has the sentence of a visit
    as it stands once the entity of that rank is in. Entities come in one by one; after
    each the whole note is cleaned and counted with the suffix, and the first that reaches
    the budget ends the note. ``kept`` is the rank of the last entity in the note, ``over``
    whether another one was tried. A person has at most as many entities as were ranked,
    so the fold over them is an expression on one row.
    """
    at = F.struct("start", "visit_id")
    entry = F.struct(F.col("rank").cast("int").alias("rank"), at.alias("at"), "sentence")
    entries = versions.groupBy("person_id").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    joined = summary.select("person_id", "summary").join(entries, "person_id", "left")
    kinds = dict(entries.select("person_id", F.transform("_entries", lambda e: F.struct(e["at"], e["sentence"])).alias("s")).dtypes)
    limit = max_tokens * SAFETY_MARGIN

    # The choice of the white-space class is made once per person, over all that can come in.
    texts = F.array_join(F.transform("_entries", lambda e: e["sentence"]), " ")
    parts = F.concat(F.col("summary"), F.coalesce(texts, F.lit("")), F.lit(suffix))
    joined = joined.withColumn("_rare", has_rare_space(parts))

    def state(shown: Column, note: Column, kept: Column, over: bool) -> Column:
        return F.struct(shown.alias("shown"), note.alias("note"), kept.alias("kept"), F.lit(over).alias("over"))

    def folded(space: str) -> Column:
        def text_of(shown: Column) -> Column:
            body = F.array_join(F.transform(shown, lambda e: e["sentence"]), VISIT_GAP)
            return clean_note(F.concat(F.col("summary"), F.lit(NOTE_GAP), body), space)

        def size_of(note: Column) -> Column:
            whole = F.concat(note, F.lit(suffix))
            return token_count(whole, space) if tokens is token_count else tokens(whole)

        def add(done: Column, e: Column) -> Column:
            others = F.filter(done["shown"], lambda x: x["at"] != e["at"])
            shown = F.sort_array(F.concat(others, F.array(F.struct(e["at"].alias("at"), e["sentence"].alias("sentence")))))
            # one-element arrays give the new lists and the cleaned note a name, so that each is made once
            tried = F.transform(F.array(shown), lambda s: F.struct(s.alias("shown"), text_of(s).alias("note")))
            fitted = F.transform(
                tried,
                lambda t: F.when(size_of(t["note"]) < limit, state(t["shown"], t["note"], e["rank"], False)).otherwise(
                    state(done["shown"], done["note"], done["kept"], True)
                ),
            )
            return F.when(done["over"], done).otherwise(F.element_at(fitted, 1))

        none = F.array().cast(kinds["s"])
        start = state(none, text_of(none), F.lit(0), False)
        return F.aggregate(F.coalesce("_entries", F.array().cast(entries.schema["_entries"].dataType)), start, add)

    found = F.when(F.col("_rare"), folded(WS)).otherwise(folded(r"\s"))
    return joined.withColumn("_f", found).select("person_id", "_f.note", "_f.kept", "_f.over")


def tried_entities(entities: DataFrame, budgeted: DataFrame) -> DataFrame:
    """The entities that were tried: those in the note, and the one that ended it."""
    last = budgeted.select("person_id", (F.col("kept") + F.col("over").cast("int")).alias("_last"))
    return entities.join(last, "person_id").where(F.col("rank") <= F.col("_last")).drop("_last")


def important_concept_notes(
    persons: DataFrame,
    visits: DataFrame,
    temporal: DataFrame,
    values: DataFrame,
    num_concepts: int,
    conditions: bool = True,
    procedures: bool = True,
    as_list: bool = False,
    abs_weight: bool = True,
    zero_weight: bool = False,
    permuted: tuple[DataFrame, DataFrame] | None = None,
    max_tokens: int = MAX_TOKENS,
    suffix: str = "",
    tokens: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Notes of the most important concepts, each with its visit, oldest visit first.

    More than ten concepts are held to a token budget, see ``notes_within_budget``; the
    result then has its columns. ``permuted`` are (id, new_id) tables for conditions and
    for procedures.
    """
    entities = important_entities(
        visits, temporal, num_concepts, conditions, procedures, abs_weight, zero_weight
    )
    summary = summaries(persons)
    primary = temporal.where(F.col("concept") == "condition1").select(
        *VISIT_KEY, F.col("concept_id").alias("_primary")
    )
    if permuted is not None:
        primary = _exchange(primary, permuted[0], "_primary")
        entities = _exchange(entities, permuted[0], "concept_id", F.col("kind") != "p")
        entities = _exchange(entities, permuted[1], "concept_id", F.col("kind") == "p")
    worded = entities.join(values.withColumnRenamed("value", "_text"), "concept_id", "left")

    checked = num_concepts > UNCHECKED_CONCEPTS
    texts = lambda kind: F.when(F.col("kind") == kind, F.col("_text"))
    if checked:
        # The phrases of a visit up to each of its entities.
        upto = Window.partitionBy(*VISIT_KEY).orderBy("rank")
        chosen = worded.select(
            *VISIT_KEY, "rank", F.collect_list(texts("c")).over(upto).alias("_c"), F.collect_list(texts("p")).over(upto).alias("_p")
        )
    else:
        ranked = lambda kind: F.transform(
            F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "_text")))), lambda e: e["_text"]
        )
        chosen = worded.groupBy(*VISIT_KEY).agg(ranked("c").alias("_c"), ranked("p").alias("_p"))
    glue = "\n- " if as_list else " and "
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, glue))
    performed = F.when(F.size("_p") > 1, " were performed.").otherwise(" was performed.")
    facts = (
        _with_primary(chosen.join(visits, list(VISIT_KEY)), primary, values)
        .join(summary.select("person_id", "gender"), "person_id")
        .withColumn("conditions", joined(F.col("_c")))
        .withColumn(
            "procedures",
            joined(F.col("_p")) if as_list else F.concat(joined(F.col("_p")), performed),
        )
    )
    sentences = facts.withColumn("sentence", (VISIT_LIST if as_list else VISIT).render(facts))
    if checked:
        return notes_within_budget(summary, sentences, max_tokens, suffix, tokens)
    return assemble_notes(summary, _visit_bodies(sentences))


def _with_primary(rows: DataFrame, primary: DataFrame, values: DataFrame) -> DataFrame:
    """Add the phrase of each visit's primary condition. Phrases are looked up for the
    chosen visits only."""
    named = values.select(F.col("concept_id").alias("_primary"), F.col("value").alias("condition1"))
    return (
        rows.join(primary, list(VISIT_KEY), "left").join(named, "_primary", "left").drop("_primary")
    )


def _exchange(
    df: DataFrame, pairs: DataFrame, column: str, where: Column | None = None
) -> DataFrame:
    """Replace ids by (id, new_id) pairs, in the rows of ``where``; others stay."""
    new = pairs.select(F.col("id").alias("_id"), F.col("new_id").alias("_new"))
    same = F.col(column) == F.col("_id")
    return df.join(new, same if where is None else same & where, "left").select(
        *[F.coalesce("_new", column).alias(c) if c == column else F.col(c) for c in df.columns]
    )


def label_leakage_notes(persons: DataFrame, labels: DataFrame) -> DataFrame:
    """Control notes that state the label: (person_id, label) decides the last sentence."""
    plain = person_facts(persons).drop("race_text")
    state = F.when(F.col("label") == 1, LEAK_ILL).otherwise(LEAK_WELL)
    sentence = F.concat(
        SUMMARY.render(plain), F.lit(" "), F.col("pronoun"), F.lit(" "), state, F.lit(".")
    )
    raw = F.concat(sentence, F.lit(NOTE_GAP))
    return clean_notes(plain.join(labels, "person_id"), raw, "note").select("person_id", "note")


def condition_list_notes(
    persons: DataFrame,
    visits: DataFrame,
    temporal: DataFrame,
    values: DataFrame,
    abs_weight: bool = True,
) -> DataFrame:
    """All conditions with a positive weight as '- year: phrase', by first occurrence."""
    kept = use_absolute(temporal, abs_weight).where(
        F.col("concept").startswith("condition") & (F.col("weight") > 0)
    )
    first = first_occurrence(kept, visits).join(values, "concept_id")
    line = F.concat(F.lit("- "), F.date_format("start", "yyyy"), F.lit(": "), F.col("value"))
    entry = F.struct(F.struct("start", "visit_id", "concept_id").alias("at"), line.alias("text"))
    bodies = first.groupBy("person_id").agg(
        ordered_join(F.collect_list(entry), "\n").alias("_lines")
    )
    plain = person_facts(persons).drop("race_text", "pronoun")
    summary = plain.select("person_id", SUMMARY.render(plain).alias("summary"))
    body = F.concat(F.lit(CONDITIONS_HEAD), F.coalesce("_lines", F.lit("")))
    joined = summary.join(bodies, "person_id", "left")
    raw = F.concat("summary", F.lit(NOTE_GAP), body)
    return clean_notes(joined, raw, "note").select("person_id", "note")


def important_conditions(
    visits: DataFrame, temporal: DataFrame, num_concepts: int, abs_weight: bool = True
) -> DataFrame:
    """Each person's n conditions of highest weight, later ones first among equals."""
    kept = use_absolute(temporal, abs_weight).where(
        F.col("concept").startswith("condition") & (F.col("weight") != 0)
    )
    order = Window.partitionBy("person_id").orderBy(
        F.desc("weight"), F.desc("start"), F.desc("visit_id"), "concept_id"
    )
    return (
        first_occurrence(kept, visits)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= num_concepts)
    )


def important_condition_notes(
    persons: DataFrame,
    visits: DataFrame,
    temporal: DataFrame,
    values: DataFrame,
    num_concepts: int,
    abs_weight: bool = True,
) -> DataFrame:
    """Visits of the n most important conditions, each with those of its conditions that
    were chosen."""
    chosen = important_conditions(visits, temporal, num_concepts, abs_weight)
    # The remaining conditions of a visit are numbered from 2 on.
    slot = Window.partitionBy(*VISIT_KEY).orderBy("concept", F.desc("weight"), "value")
    extra = (
        chosen.where(F.col("concept") != "condition1")
        .join(values, "concept_id")
        .withColumn("_slot", F.row_number().over(slot) + 1)
        .groupBy(*VISIT_KEY)
        .agg(
            ordered_join(
                F.collect_list(
                    F.struct(F.col("_slot").alias("at"), F.col("value").alias("text"))
                ),
                " and ",
            ).alias("conditions")
        )
    )
    shown = attach_slot(
        visits.join(chosen.select(*VISIT_KEY).distinct(), list(VISIT_KEY), "left_semi"),
        temporal,
        "condition1",
    )
    facts = _with_primary_phrase(shown, values).join(extra, list(VISIT_KEY), "left")
    bodies = _visit_bodies(facts.withColumn("sentence", VISIT.render(facts)))
    return assemble_notes(summaries(persons), bodies)


def _with_primary_phrase(visits: DataFrame, values: DataFrame) -> DataFrame:
    phrases_ = values.select(F.col("concept_id").alias("condition1"), F.col("value").alias("_v"))
    return (
        visits.join(phrases_, "condition1", "left")
        .withColumn("condition1", F.col("_v"))
        .drop("_v")
    )


def last_visits(
    visits: DataFrame, temporal: DataFrame, values: DataFrame, num_visits: int
) -> DataFrame:
    """The n latest visits of each person that have a primary condition and whose texts
    differ: person_id, rank (1 = latest), start, visit_id, sentence."""
    primary = attach_slot(visits, temporal, "condition1").where(F.col("condition1").isNotNull())
    facts = _with_primary_phrase(primary, values)
    texts = facts.select(*VISIT_KEY, "start", VISIT.render(facts).alias("sentence"))
    latest = texts.groupBy("person_id", "sentence").agg(
        F.max(F.struct("start", "visit_id")).alias("_at")
    )
    order = Window.partitionBy("person_id").orderBy(F.desc("_at"))
    return (
        latest.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= num_visits)
        .select("person_id", "rank", "_at.start", "_at.visit_id", "sentence")
    )


def last_visit_notes(
    persons: DataFrame,
    visits: DataFrame,
    temporal: DataFrame,
    values: DataFrame,
    num_visits: int,
) -> DataFrame:
    """Notes of the latest visits, oldest first."""
    bodies = _visit_bodies(last_visits(visits, temporal, values, num_visits))
    return assemble_notes(summaries(persons), bodies)


# The names of the forms, and what each switches on.
NOTE_FORMS: dict[str, dict[str, bool]] = {
    "n_important_visits": {"conditions": False, "procedures": False},
    "n_important_visits_and_conditions": {"conditions": True, "procedures": False},
    "n_important_visits_and_conditions_and_procedures": {"conditions": True, "procedures": True},
    "list_n_important_visits_and_conditions_and_procedures": {
        "conditions": True, "procedures": True, "as_list": True,
    },
    "list_permuted_n_important_visits_and_conditions_and_procedures": {
        "conditions": True, "procedures": True, "as_list": True,
    },
    "permuted_n_important_visits_and_conditions_and_procedures": {
        "conditions": True, "procedures": True,
    },
}


def patient_notes(method: str, **tables_and_options) -> DataFrame:
    """Notes by the name of their form. Permuted forms need ``permuted`` tables."""
    if method in NOTE_FORMS:
        if "permuted" in method.split("_") and tables_and_options.get("permuted") is None:
            raise ValueError(f"{method} needs the permuted tables")
        return important_concept_notes(**{**NOTE_FORMS[method], **tables_and_options})
    others = {
        "label_leakage": label_leakage_notes,
        "all_non_zero_conditions": condition_list_notes,
        "n_important_conditions": important_condition_notes,
        "last_n_visits": last_visit_notes,
    }
    if method not in others:
        raise KeyError(f"unknown form {method!r}; known: {', '.join([*NOTE_FORMS, *others])}")
    return others[method](**tables_and_options)


def concepts_in_notes(
    persons: DataFrame, entities: DataFrame, temporal: DataFrame, values: DataFrame
) -> DataFrame:
    """(person_id, concept, selected): age, sex, race and the phrases the chosen entities
    bring into a note, the primary conditions of their visits among them. Of notes with a
    budget, the entities are those of ``tried_entities``."""
    races = F.array(*[F.lit("race_" + r.replace(" ", "_")) for r in P.RACES])
    male = (F.col("gender").cast("int") == P.GENDERS.index("male")).cast("int")
    fixed = persons.select(
        "person_id",
        F.explode(
            F.array(
                F.struct(F.lit("age").alias("concept"), F.col("age").cast("int").alias("selected")),
                F.struct(F.lit("sex_male").alias("concept"), male.alias("selected")),
                F.struct(F.lit("sex_female").alias("concept"), (1 - male).alias("selected")),
                F.struct(
                    F.element_at(races, F.col("race").cast("int") + 1).alias("concept"),
                    F.lit(1).alias("selected"),
                ),
            )
        ).alias("f"),
    ).select("person_id", "f.*")
    own = entities.where(F.col("concept_id").isNotNull()).select("person_id", "concept_id")
    primary = temporal.where(F.col("concept") == "condition1").join(
        entities.select(*VISIT_KEY).distinct(), list(VISIT_KEY), "left_semi"
    )
    chosen = (
        own.unionByName(primary.select("person_id", "concept_id"))
        .join(values, "concept_id")
        .select("person_id", F.col("value").alias("concept"))
        .distinct()
    )
    return fixed.unionByName(chosen.withColumn("selected", F.lit(1)))
