"""Shuffles, few-shot samples, column exchanges and mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscribe.functions.hashing import cyclic_derangement, pick, seeded_hash
from rowscribe.operators.ranking import (
    at_most,
    hash_range,
    nth_key,
    number_by_hash,
    number_by_order,
    sampled_range,
)
from rowscribe.phrasebook import MIXTURE_ROWS
from rowscribe.session import cut_lineage


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The whole table in hash order."""
    return df.orderBy(seeded_hash(seed, "shuffle", F.col(key)), F.col(key))


def first_after_shuffle(df: DataFrame, key: str, seed: int, n: int | str) -> DataFrame:
    """The first n rows of the shuffled table; 'all' keeps every row, 0 none."""
    if n == "all":
        return shuffled(df, key, seed)
    return shuffled(df, key, seed).limit(int(n))


def few_shot_sample(
    df: DataFrame,
    key: str,
    label: str,
    shots: Sequence[int],
    seeds: Sequence[int] | None = None,
    seed_column: str | None = None,
) -> DataFrame:
    """Balanced few-shot draws with replacement for every (shots, seed).

    Each of the L labels gets ``shots // L`` draws, the largest label the remainder.
    A draw is a position among the rows of its label in hash order. Only the hash
    ranges that hold a drawn position are sorted; all other rows are merely counted,
    so the table itself is never shuffled. Give ``seed_column`` when the rows already
    differ by seed, as after a seeded split.

    Result: seed, num_shot, draw_no (0.. in shuffled order), key, label.
    """
    group = [seed_column] if seed_column else []
    rows = df.select(
        *group,
        F.col(key).alias("_key"),
        F.col(label).alias("_label"),
        seeded_hash("order", F.col(key)).alias("_h"),
    ).withColumn("_range", hash_range(df, "_h"))
    counts = rows.groupBy(*group, "_label", "_range").agg(F.count(F.lit(1)).alias("_c"))

    # A bounded number of ranges per (seed, label).
    per_label = Window.partitionBy(*group, "_label")
    ranges = counts.withColumn(
        "_start", F.sum("_c").over(per_label.orderBy("_range")) - F.col("_c")
    ).withColumn("_n", F.sum("_c").over(per_label))
    sizes = ranges.groupBy(*group, "_label").agg(F.max("_n").alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    labelled = sizes.withColumn("_labels", F.count(F.lit(1)).over(whole)).withColumn(
        "_last", F.max("_label").over(whole)
    )
    grid = labelled.withColumn("_shots", F.explode(F.array(*[F.lit(s) for s in shots])))
    if seed_column:
        grid = grid.withColumn("_seed", F.col(seed_column).cast("int"))
    else:
        grid = grid.withColumn("_seed", F.explode(F.array(*[F.lit(s) for s in (seeds or [0])])))
    share = F.floor(F.col("_shots") / F.col("_labels")).cast("int")
    rest = F.col("_shots") - (F.col("_labels") - 1).cast("int") * share
    draws = (
        grid.withColumn("_draws", F.when(F.col("_label") == F.col("_last"), rest).otherwise(share))
        .where(F.col("_draws") > 0)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)))
        .withColumn(
            "_pos",
            pick(F.col("_n"), F.col("_seed"), F.col("_shots"), "draw", F.col("_label"), F.col("_j")),
        )
    )
    located = _locate(draws, ranges, [*group, "_label"])
    wanted = located.select(*group, "_label", "_range").distinct()
    within = Window.partitionBy(*group, "_label", "_range").orderBy("_h", "_key")
    keyed = [*group, "_label", "_range"]
    candidates = (
        rows.join(wanted, keyed, "left_semi")
        .withColumn("_nth", F.row_number().over(within).cast("bigint") - 1)
    )
    drawn = candidates.join(located, [*keyed, "_nth"])
    place = Window.partitionBy("_seed", "_shots").orderBy("_order", "_label", "_j")
    return (
        drawn.withColumn(
            "_order",
            seeded_hash(F.col("_seed"), F.col("_shots"), "place", F.col("_label"), F.col("_j")),
        )
        .withColumn("draw_no", F.row_number().over(place) - 1)
        .select(
            F.col("_seed").alias("seed"),
            F.col("_shots").alias("num_shot"),
            "draw_no",
            F.col("_key").alias(key),
            F.col("_label").alias(label),
        )
    )


def _locate(draws: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range and position inside it for each draw: both lists are merged in order of
    position and each draw takes the last range that started before it."""
    marks = ranges.select(
        *keys,
        F.col("_start").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("_range", "_start").alias("_mark"),
        F.lit(None).cast("int").alias("_seed"),
        F.lit(None).cast("int").alias("_shots"),
        F.lit(None).cast("int").alias("_j"),
    )
    asked = draws.select(
        *keys,
        F.col("_pos").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"),
        "_seed",
        "_shots",
        "_j",
    )
    upto = Window.partitionBy(*keys).orderBy("_at", "_kind")
    return (
        marks.unionByName(asked)
        .withColumn("_mark", F.last("_mark", ignorenulls=True).over(upto))
        .where(F.col("_kind") == 1)
        .select(
            *keys,
            "_seed",
            "_shots",
            "_j",
            F.col("_mark._range").alias("_range"),
            (F.col("_at") - F.col("_mark._start")).alias("_nth"),
        )
    )


def training_sets(
    df: DataFrame, key: str, label: str, shots: Sequence[int | str], seed_column: str = "seed"
) -> DataFrame:
    """The training rows of every number of shots: draws for a number, and for 'all' each
    row once, in the seed's hash order.

    Result: seed, num_shot (text), draw_no, key, label.
    """
    columns = ("seed", "num_shot", "draw_no", key, label)
    # the split behind the rows is made once, for all the counts and joins that read them
    df = cut_lineage(df.select(seed_column, key, label), "training-rows")
    numbers = [s for s in shots if s != "all"]
    parts = []
    if numbers:
        drawn = few_shot_sample(df, key, label, numbers, seed_column=seed_column)
        parts.append(
            drawn.withColumns(
                {"num_shot": F.col("num_shot").cast("string"), "draw_no": F.col("draw_no").cast("bigint")}
            )
        )
    if "all" in shots:
        rows = df.select(F.col(seed_column).cast("int").alias("seed"), key, label).withColumn(
            "_h", seeded_hash(F.col("seed"), "shuffle", F.col(key))
        )
        whole = number_by_hash(rows, "_h", "_rn", [key], ["seed"])
        parts.append(
            whole.withColumns({"num_shot": F.lit("all"), "draw_no": F.col("_rn").cast("bigint") - 1})
        )
    parts = [p.select(*columns) for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def unlabelled_pool(train: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training rows that were not drawn."""
    return train.join(sample.select(*keys).distinct(), list(keys), "left_anti")


def exchange_categories(df: DataFrame, columns: Sequence[str], seed: int) -> DataFrame:
    """Replace every value of a column by another one: distinct values stand in hash
    order and each takes its successor, the last the first. NULL counts as a value;
    a column with one value stays as it is."""
    source = df
    for column in columns:
        pairs = exchange_map(source, column, seed)
        df = df.join(
            pairs, df[column].eqNullSafe(F.col("_old")), "left"
        ).select(
            *[F.col("_new").alias(c) if c == column else F.col(c) for c in df.columns]
        )
    return df


def exchange_map(df: DataFrame, column: str, seed: int) -> DataFrame:
    """(_old, _new) for every distinct value of a column."""
    shown = F.coalesce(F.col("_old").cast("string"), F.lit("<null>"))
    values = (
        df.select(F.col(column).alias("_old"))
        .distinct()
        .withColumn("_h", seeded_hash(seed, "exchange", column, shown))
    )
    ranked = number_by_hash(values, "_h", "_rank")
    n = values.agg(F.count(F.lit(1)).alias("n")).scalar()
    following = ranked.select(F.col("_old").alias("_new"), F.col("_rank").alias("_next"))
    return (
        ranked.withColumn("_n", n)
        .withColumn("_next", F.pmod(F.col("_rank"), F.col("_n")) + 1)
        .join(following, "_next")
        .select("_old", "_new")
    )


BINS = 10


def exchange_numbers(
    df: DataFrame, key: str, columns: Sequence[str], seed: int, bins: int = BINS
) -> DataFrame:
    """Replace every number of the columns by a member of another equal-count bin.

    The sorted column is cut at floor(b*n/bins). A value belongs to the first bin whose
    ends contain it; bins are deranged once; the member is chosen by hash of the row.
    """
    source = df
    for column in columns:
        df = _exchange_number(df, source, key, column, seed, bins)
    return df


def _exchange_number(
    df: DataFrame, source: DataFrame, key: str, column: str, seed: int, bins: int
) -> DataFrame:
    ranked = (
        number_by_order(source.select(key, column), [column, key], "_rn")
        .select(key, F.col(column).alias("_value"), (F.col("_rn") - 1).alias("_pos"))
    )
    per_bin = F.col("n") / F.lit(float(bins))
    low = [F.floor(F.lit(b) * per_bin).cast("bigint") for b in range(bins + 1)]
    edges = (
        source.agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(b).alias("bin"),
                            low[b].alias("low"),
                            F.when(low[b + 1] > low[b], low[b + 1])
                            .otherwise(
                                F.raise_error(F.lit(f"fewer rows than {bins} bins")).cast("bigint")
                            )
                            .alias("high"),
                        )
                        for b in range(bins)
                    ]
                )
            ).alias("e")
        )
        .select("e.*")
    )
    ends = edges.select(
        "bin", F.explode(F.array(F.col("low"), F.col("high") - 1)).alias("_pos")
    ).distinct()
    table = (
        ranked.join(F.broadcast(ends), "_pos")  # two rows per bin
        .groupBy("bin")
        .agg(F.min("_value").alias("first"), F.max("_value").alias("last"))
        .join(F.broadcast(edges), "bin")
        .agg(F.sort_array(F.collect_list(F.struct("bin", "first", "last", "low", "high"))))
        .scalar()
    )
    target = F.lit(None).cast("int")
    for here, there in enumerate(cyclic_derangement(bins, seed, "bins", column)):
        target = F.when(F.col("_bin") == here, F.lit(there)).otherwise(target)
    placed = (
        df.withColumn("_bins", table)
        .withColumn(
            "_bin",
            F.filter(
                F.col("_bins"),
                lambda b: (F.col(column) >= b["first"]) & (F.col(column) <= b["last"]),
            )[0]["bin"],
        )
        .withColumn("_to", F.element_at(F.col("_bins"), target + 1))
        .withColumn(
            "_pos",
            F.col("_to.low")
            + pick(F.col("_to.high") - F.col("_to.low"), seed, "member", column, F.col(key)),
        )
    )
    members = ranked.select("_pos", F.col("_value").alias("_member"))
    return placed.join(members, "_pos", "left").select(
        *[
            F.col("_member").alias(c) if c == column else F.col(c)
            for c in df.columns
        ]
    )


def permute_ids(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace ids by (id, new_id) pairs; ids without a pair stay."""
    pairs = mapping.select(F.col("id").alias(column), F.col("new_id").alias("_new"))
    return df.join(pairs, column, "left").select(
        *[F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in df.columns]
    )


def mixture_caps(
    catalogue: DataFrame, templates: str, train_size: str, total: int = MIXTURE_ROWS
) -> DataFrame:
    """Rows a task may contribute: its size, but no more than total / templates."""
    return catalogue.withColumn(
        "cap",
        F.least(
            F.coalesce(F.col(train_size).cast("bigint"), F.lit(0)),
            F.floor(F.lit(total) / F.col(templates)).cast("bigint"),
        ),
    )


def cap_rows(df: DataFrame, caps: DataFrame, group: str, key: str, cap: str = "cap") -> DataFrame:
    """The first ``cap`` rows of each group along a unique ``key``. Groups without a cap
    drop out.

    Ranges of the key are counted per group to find the last row that stays, and rows
    are compared with it; a group that is most of the table is not sorted as a whole.
    """
    range_ = sampled_range(df, [F.col(key)])
    limits = caps.select(group, cap)
    last = nth_key(df, [key], range_, F.least(cap, "n"), [group], limits)
    edges = last.join(limits, group)
    kept = df.join(edges, group)
    return kept.where(at_most([key], F.col("_edge"))).drop("_edge")


def deny(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Drop rows whose name is on the list."""
    return df.where(~F.col(column).isin(list(names)))


def union_tasks(parts: Mapping[str, DataFrame], out: str = "task") -> DataFrame:
    """All task tables as one, missing columns as NULL."""
    tables = [df.withColumn(out, F.lit(name)) for name, df in parts.items()]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    return union
