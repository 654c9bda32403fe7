"""Patient timelines: dated concept strings to visit and concept tables, and weights.

Tables
  entries   person_id, pos, date, concepts ARRAY<STRING>  one row per dated entry
  visits    person_id, visit_id, type, start DATE, duration INT (days), specialty
  temporal  person_id, visit_id, concept_id, concept      concept: 'condition 2', ...
  weights   concept_id, interval INT (days), weight [, person_id]

A person may have any number of entries: per-person work is an aggregate with
map-side combining or a top-n window, which Spark trims before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscribe import phrasebook as P
from rowscribe.operators.report import first_per_key

VISIT_KEY = ("person_id", "visit_id")

# The two shapes of a concept string, and the attributes of a visit.
VISIT_STRING = r"^\d+ - visit (\w+) - (.+)"
CONCEPT_STRING = r"^(\d+) - (condition|condition \d+|procedure|drug) - (.+)"
VISIT_ATTRIBUTES = ("id", "type", "start", "duration", "specialty")
UNNUMBERED = "condition none"


def entries_of(records: DataFrame) -> DataFrame:
    """Unnest person records (person_id, visits ARRAY<ARRAY<STRING>>, dates) to entries."""
    same = F.size("visits") == F.size("dates")
    failed = F.raise_error(F.lit("visits and dates differ in length"))
    checked = records.withColumn("visits", F.when(same, F.col("visits")).otherwise(failed))
    # Filters on the arrays, as the check or the one an inner unnesting adds for their size,
    # would make the arrays again.
    unnested = checked.select(
        "person_id",
        F.posexplode_outer(F.arrays_zip(F.col("visits"), F.col("dates"))).alias("pos", "entry"),
    )
    return unnested.where(F.col("pos").isNotNull()).select(
        "person_id",
        "pos",
        F.col("entry.dates").alias("date"),
        F.col("entry.visits").alias("concepts"),
    )


def visit_key(date: Column) -> Column:
    """Microseconds since midnight."""
    at = date.cast("timestamp")
    return F.unix_micros(at) - F.unix_micros(F.date_trunc("day", at))


def parse_entries(entries: DataFrame) -> DataFrame:
    """One row per concept string, split into its parts. An unknown string fails the
    query. ``attr``/``value`` are set for visit data, ``concept_id``/``concept`` else."""
    text, attr = F.col("text"), F.col("attr")
    is_visit = attr != ""
    concept_id = F.regexp_extract(text, CONCEPT_STRING, 1)
    unknown = F.raise_error(F.concat(F.lit("unknown concept string: "), text)).cast("bigint")
    return (
        entries.select(
            "person_id",
            visit_key(F.col("date")).alias("visit_id"),
            "pos",
            F.posexplode("concepts").alias("at", "text"),
        )
        .withColumn("attr", F.regexp_extract(text, VISIT_STRING, 1))
        .select(
            *VISIT_KEY,
            "pos",
            "at",
            F.when(is_visit, attr).alias("attr"),
            F.when(is_visit, F.regexp_extract(text, VISIT_STRING, 2)).alias("value"),
            F.when(is_visit, F.lit(None))
            .when(concept_id != "", concept_id.cast("bigint"))
            .otherwise(unknown)
            .alias("concept_id"),
            F.when(~is_visit, F.regexp_extract(text, CONCEPT_STRING, 2)).alias("concept"),
        )
    )


def unknown_strings(entries: DataFrame) -> DataFrame:
    """(person_id, text) of the strings at which ``parse_entries`` would fail."""
    texts = entries.select("person_id", F.explode("concepts").alias("text"))
    return texts.where(~F.col("text").rlike(VISIT_STRING) & ~F.col("text").rlike(CONCEPT_STRING))


def all_visits(parsed: DataFrame) -> DataFrame:
    """One row per visit key; where entries repeat an attribute the earliest entry wins,
    inside an entry the last string. Visits without an id still are in."""
    rank = F.struct(-F.col("pos"), F.col("at"))
    merged = parsed.groupBy(*VISIT_KEY).agg(
        *[
            F.max_by("value", F.when(F.col("attr") == name, rank)).alias(name)
            for name in VISIT_ATTRIBUTES
        ]
    )
    return merged.select(
        *VISIT_KEY,
        F.col("id").cast("bigint").alias("id"),
        "type",
        F.to_date("start", "yyyy-MM-dd").alias("start"),
        F.col("duration").cast("int").alias("duration"),
        "specialty",
    )


def visits_of(parsed: DataFrame) -> DataFrame:
    """Visits that have an id. Strings without an attribute decide nothing here, so they
    are left out before the sort of the aggregate."""
    return all_visits(parsed.where(F.col("attr").isNotNull())).where(F.col("id").isNotNull()).drop("id")


def artifact_visits(parsed: DataFrame) -> DataFrame:
    """The number of visit keys without an id."""
    return all_visits(parsed).agg(
        F.sum(F.col("id").isNull().cast("int")).cast("bigint").alias("artifacts"),
        F.count(F.lit(1)).alias("visits"),
    )


def temporal_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("concept_id").isNotNull()).select(*VISIT_KEY, "concept_id", "concept")


def unique_concepts(temporal: DataFrame) -> DataFrame:
    """Distinct concepts per visit. Of several conditions with one id the first by name
    stays, and a numbered condition comes before an unnumbered one."""
    concept = F.when(F.col("concept") == "condition", F.lit(UNNUMBERED)).otherwise(F.col("concept"))
    kind = F.when(concept.startswith("condition"), F.lit("condition")).otherwise(concept)
    return (
        temporal.withColumn("concept", concept)
        .groupBy(*VISIT_KEY, "concept_id", kind.alias("_kind"))
        .agg(F.min("concept").alias("concept"))
        .drop("_kind")
    )


def _interval_sums(weights: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of weights per interval of a key, as one array: an entry per distinct
    interval, however many rows a key has."""
    per_interval = weights.groupBy(*keys, "interval").agg(
        F.sum("weight").alias("weight"), F.sum(F.abs("weight")).alias("abs_weight")
    )
    return per_interval.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("interval", "weight", "abs_weight"))).alias("_weights")
    )


def _gated_sum(start: Column, end_date: Column, weight: str) -> Column:
    """Sum of the weights whose interval reaches back to ``start``."""

    def add(total: Column, entry: Column) -> Column:
        too_early = F.coalesce(start < F.date_sub(end_date, entry["interval"]), F.lit(False))
        return total + F.when(too_early, F.lit(0.0)).otherwise(entry[weight])

    return F.coalesce(F.aggregate(F.col("_weights"), F.lit(0.0), add), F.lit(0.0))


def weigh_visits(visits: DataFrame, weights: DataFrame, end_date: str) -> DataFrame:
    """Weight of each visit by its type. Of a person's visits of one type only the latest
    keeps its weight."""
    names = F.create_map(*[F.lit(x) for pair in P.VISIT_CONCEPTS.items() for x in pair])
    person = "person_id" in weights.columns
    keys = ["person_id", "type"] if person else ["type"]
    typed = weights.where(F.col("concept_id").isin(list(P.VISIT_CONCEPTS))).withColumn(
        "type", names[F.col("concept_id").cast("int")]
    )
    table = _interval_sums(typed, keys)
    end = F.lit(end_date).cast("date")
    latest = visits.groupBy("person_id", "type").agg(
        F.max(F.struct("start", "visit_id")).alias("_latest")
    )
    is_latest = F.struct("start", "visit_id") == F.col("_latest")
    weighed = visits.join(table, keys, "left").join(latest, ["person_id", "type"], "left")
    return weighed.select(
        *VISIT_KEY,
        "type",
        "start",
        "duration",
        F.lower("specialty").alias("specialty"),
        *[
            F.when(is_latest, _gated_sum(F.col("start"), end, name)).otherwise(F.lit(0.0)).alias(name)
            for name in ("weight", "abs_weight")
        ],
    )


def weigh_concepts(
    temporal: DataFrame, visits: DataFrame, weights: DataFrame, end_date: str
) -> DataFrame:
    """Weight of each concept: the sum over the intervals that reach its visit."""
    keys = ["concept_id", "person_id"] if "person_id" in weights.columns else ["concept_id"]
    end = F.lit(end_date).cast("date")
    dated = temporal.join(visits.select(*VISIT_KEY, "start"), list(VISIT_KEY), "left")
    weighed = dated.join(_interval_sums(weights, keys), keys, "left")
    return weighed.select(
        *VISIT_KEY,
        "concept_id",
        "concept",
        *[_gated_sum(F.col("start"), end, name).alias(name) for name in ("weight", "abs_weight")],
    )


ZERO_SHOT_MODES = ("most_frequent", "least_frequent", "oldest", "recent")

# Fixed value: weights that fall are counted down from here.
CEILING = 10000


def weigh_zero_shot(
    temporal: DataFrame, visits: DataFrame, modes: str | Sequence[str], end_date: str
) -> DataFrame:
    """Weights without a model: by frequency in the person's record or by age in days.
    The endings '_conditions' and '_procedures' set the other kind to zero. Several modes
    give a row each, with the mode; the counts and dates are looked up once for all."""
    names = [modes] if isinstance(modes, str) else list(modes)
    bases = {m: next((b for b in ZERO_SHOT_MODES if m.startswith(b)), None) for m in names}
    if None in bases.values():
        raise ValueError(f"unknown mode among {names}; known: {', '.join(ZERO_SHOT_MODES)}")
    rows = temporal
    if any(b.endswith("frequent") for b in bases.values()):
        keys = ["person_id", "concept_id"]
        counts = temporal.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_f"))
        rows = rows.join(counts, keys)
    if not all(b.endswith("frequent") for b in bases.values()):
        rows = rows.join(visits.select(*VISIT_KEY, "start"), list(VISIT_KEY), "left")

    def weight(mode: str) -> Column:
        if bases[mode].endswith("frequent"):
            value = F.col("_f") if bases[mode] == "most_frequent" else F.lit(CEILING) - F.col("_f")
        else:
            age = F.datediff(F.lit(end_date).cast("date"), F.col("start")).cast("double")
            value = age if bases[mode] == "oldest" else F.lit(CEILING) - age
        for ending, other in (("_conditions", "procedure"), ("_procedures", "condition")):
            if mode.endswith(ending):
                value = F.when(F.col("concept").startswith(other), F.lit(0.0)).otherwise(value)
        return value

    each = F.array(*[F.struct(F.lit(m).alias("mode"), weight(m).alias("weight")) for m in names])
    found = rows.withColumn("_m", F.explode(each)).select(
        *VISIT_KEY, "concept_id", "concept", F.col("_m.weight").alias("weight"), F.abs("_m.weight").alias("abs_weight"),
        F.col("_m.mode").alias("mode"),
    )
    return found.drop("mode") if isinstance(modes, str) else found


def unweighted_visits(visits: DataFrame) -> DataFrame:
    return visits.withColumns({"weight": F.lit(0.0), "abs_weight": F.lit(0.0)})


def renumber_conditions(temporal: DataFrame) -> DataFrame:
    """Conditions of a visit become condition1, condition2, ... by old number, weight
    (high first) and id. Within a visit a concept id is unique, so the window of a visit
    holds no more rows than there are concepts."""
    is_condition = F.col("concept").startswith("condition")
    order = Window.partitionBy(*VISIT_KEY, is_condition).orderBy(
        "concept", F.desc("weight"), "concept_id"
    )
    return temporal.withColumn(
        "concept",
        F.when(
            is_condition, F.concat(F.lit("condition"), F.row_number().over(order).cast("string"))
        ).otherwise(F.col("concept")),
    )


def use_absolute(df: DataFrame, absolute: bool = True) -> DataFrame:
    """Settle on one weight column."""
    if absolute:
        return df.withColumn("weight", F.col("abs_weight")).drop("abs_weight")
    return df.drop("abs_weight")


def first_occurrence(concepts: DataFrame, visits: DataFrame) -> DataFrame:
    """The earliest record of each concept of a person, with its visit's start."""
    dated = concepts.join(visits.select(*VISIT_KEY, "start"), list(VISIT_KEY), "left")
    return first_per_key(
        dated,
        ["person_id", "concept_id"],
        [F.col("start").isNull(), F.col("start"), F.col("visit_id"), F.col("concept")],
    )


def attach_slot(visits: DataFrame, temporal: DataFrame, slot: str) -> DataFrame:
    """Add the concept id of one slot ('condition1', ...) as a column of that name."""
    side = temporal.where(F.col("concept") == slot).select(
        *VISIT_KEY, F.col("concept_id").alias(slot)
    )
    return visits.join(side, list(VISIT_KEY), "left")


def duplicate_visits(visits: DataFrame) -> DataFrame:
    """Visit keys that occur more than once; empty for a sound table."""
    return visits.groupBy(*VISIT_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def differing_persons(a: DataFrame, b: DataFrame) -> DataFrame:
    """Persons that are in one table only, with the side they are on."""
    left = a.select("person_id").distinct()
    right = b.select("person_id").distinct()
    only_a = left.join(right, "person_id", "left_anti").withColumn("side", F.lit("first"))
    only_b = right.join(left, "person_id", "left_anti").withColumn("side", F.lit("second"))
    return only_a.unionByName(only_b)
