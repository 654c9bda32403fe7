"""Mix sources to target weights by a budget that flows down a tree.

The tree's levels are columns, outermost first (domain, language, source). The token
budget of a node is split among its children by their weights. A child can use at most
the tokens below it times ``max_epochs``; what it cannot use goes to its siblings by
their weights, and only what all siblings together cannot use is left to the levels
above. Because a child's limit is the sum of its leaves' limits, filling from the root
down gives exactly that order.

A leaf with budget A and T tokens takes every document A // T times, and in one more
epoch the prefix of its documents, in the md5 order of (seed, epoch, id), whose tokens
fit into the rest. The prefix is found per range of leading hex digits: ranges are
summed first (map-side), and only rows of one range meet in one task, so a leaf that
holds a third of all rows is spread. The result per leaf is a number of whole epochs
and the last hash taken; documents are then chosen by a join with that small table.

Defined cases: null and empty level values are one node ''; a document without tokens
(null, empty or blank text) is not taken; rows that repeat an id share its hash and
are taken together; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowscribe.llm.registry import query, read
from rowscribe.session import cut_lineage

ROWS_PER_RANGE = 1024
WORD = "[^ \\t\\n\\r\\f\\x0B]+"
SEED = 7

# Parameters of the registered query and of the pipeline stage.
LEVELS = ("domain", "lang", "source")
WEIGHTS = ({"web": 5, "forum": 3, "books": 2}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {})
SHARE = 0.6
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def domain_of(source: Column) -> Column:
    """The domain of a source, by the last digit of its name."""
    digit = F.substring(source, -1, 1)
    return F.when(digit.isin("0", "1", "2", "3", "4"), "web").when(digit.isin("5", "6", "7"), "forum").otherwise("books")


def _weight(column: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(column) == value, float(weight)).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: Sequence[str], name: str, weights: Mapping[str, float]) -> DataFrame:
    """Split each parent's ``budget`` over its children (``limit``) into the new ``budget``."""
    nodes = nodes.withColumn("_w", _weight(name, weights))
    order = Window.partitionBy(*parents).orderBy(F.col("limit") / F.col("_w"), name)
    nodes = nodes.withColumn(
        "_used", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    ).withColumn("_rest", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("budget") - F.col("_used")) / F.col("_rest")
    full = F.col("limit") * F.col("_rest") <= (F.col("budget") - F.col("_used")) * F.col("_w")
    level = F.max(F.when(~full, level)).over(Window.partitionBy(*parents))
    given = F.when(full, F.col("limit")).otherwise(F.floor(F.col("_w") * level))
    return nodes.withColumn("_given", given.cast("bigint")).select(*parents, name, "limit", F.col("_given").alias("budget"))


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], share: float, max_epochs: int
) -> DataFrame:
    """The levels, ``tokens`` and ``budget`` of every leaf; ``leaves`` has levels and tokens."""
    leaves = leaves.withColumn("limit", F.col("tokens") * max_epochs)
    budget = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("bigint").alias("budget"))
    parents: list[str] = ["_root"]
    filled = budget.withColumn("_root", F.lit(0))
    rooted = leaves.withColumn("_root", F.lit(0))
    for depth, (name, weight) in enumerate(zip(levels, weights)):
        nodes = rooted.groupBy("_root", *levels[: depth + 1]).agg(F.sum("limit").alias("limit"))
        filled = _fill(nodes.join(filled.select(*parents, "budget"), parents), parents, name, weight)
        parents.append(name)
    return rooted.join(filled.drop("limit"), parents).select(*levels, "tokens", "budget")


def _spot(key: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def mix(
    docs: DataFrame,
    key: str,
    tokens: Column,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping[str, float]],
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The chosen rows of ``docs`` with ``_n_tokens``, the levels as ``_level0`` ... and
    ``_epochs``, how often each row is used. The budget is ``share`` of all tokens."""
    names = [f"_level{i}" for i in range(len(levels))]
    node = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())]
    sized = docs.select(F.col(key).alias("_key"), tokens.alias("_n_tokens"), *node)
    sized = cut_lineage(sized, "mix-sizes").filter("_n_tokens > 0")
    leaves = sized.groupBy(*names).agg(F.sum("_n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, names, weights, share, max_epochs).select(
        *names,
        F.floor(F.col("budget") / F.col("tokens")).cast("bigint").alias("_whole"),
        (F.col("budget") % F.col("tokens")).alias("_rest"),
    )
    plan = cut_lineage(plan, "mix-leaves")
    digits = max(0, math.ceil(math.log(max(1, sized.count()) / ROWS_PER_RANGE, 16)))
    drawn = sized.join(plan, names).withColumn("_spot", _spot(F.col("_key"), F.col("_whole"), seed))
    drawn = drawn.select(*names, "_n_tokens", "_rest", "_spot", F.substring("_spot", 1, digits).alias("_range"))
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy(*names, "_range").agg(F.sum("_n_tokens").alias("_sum"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*names, "_range").orderBy("_spot").rangeBetween(Window.unboundedPreceding, 0)
    through = F.col("_before") + F.col("_inside")
    cuts = (
        drawn.withColumn("_inside", F.sum("_n_tokens").over(inside))
        .join(starts, [*names, "_range"])
        .groupBy(*names)
        .agg(F.coalesce(F.max(F.when(through <= F.col("_rest"), F.col("_spot"))), F.lit("")).alias("_cut"))
    )
    plan = cut_lineage(plan.join(cuts, names).drop("_rest"), "mix-cuts")
    marked = docs.withColumns({"_n_tokens": tokens, **dict(zip(names, [F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()]))})
    marked = marked.filter("_n_tokens > 0").join(plan, names)
    epochs = F.col("_whole") + (_spot(F.col(key), F.col("_whole"), seed) <= F.col("_cut")).cast("bigint")
    return marked.withColumn("_epochs", epochs).filter("_epochs > 0").drop("_whole", "_cut")


def _sql_weight(name: str, weights: Mapping[str, float]) -> str:
    cases = "".join(f" WHEN {name} = '{v}' THEN {float(w)}::DOUBLE" for v, w in weights.items())
    return f"CASE{cases} ELSE 1.0::DOUBLE END" if cases else "1.0::DOUBLE"


def _sql_level(depth: int) -> str:
    """Two CTEs that split the budgets of level ``depth - 1`` over level ``depth``."""
    names, name = LEVELS[: depth + 1], LEVELS[depth]
    parents = LEVELS[:depth]
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    on = f"JOIN got{depth - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN total"
    return f"""
    run{depth} AS (SELECT *, sum(w) OVER ({by} ORDER BY lim / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
        coalesce(sum(lim) OVER ({by} ORDER BY lim / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used
      FROM (SELECT {', '.join(names)}, {_sql_weight(name, WEIGHTS[depth])} AS w, lim, budget FROM
        (SELECT {', '.join(names)}, sum(tokens) * {MAX_EPOCHS} AS lim FROM leaves GROUP BY ALL) {on})),
    got{depth} AS (SELECT {', '.join(names)}, (CASE WHEN lim * rest <= (budget - used) * w THEN lim ELSE
        floor(w * max(CASE WHEN lim * rest > (budget - used) * w THEN (budget - used) / rest END) OVER ({by})) END)::BIGINT AS budget
      FROM run{depth})"""


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens,
    CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' WHEN right(source, 1) IN ('5', '6', '7') THEN 'forum' ELSE 'books' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM sized WHERE n_tokens > 0 GROUP BY ALL),
total AS (SELECT floor(coalesce(sum(tokens), 0) * {SHARE}::DOUBLE)::BIGINT AS budget FROM leaves),
{','.join(_sql_level(d) for d in range(len(LEVELS)))},
plan AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN got2 USING (domain, lang, source)),
ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat_ws('-', '{SEED}', whole::VARCHAR, doc_id::VARCHAR)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized JOIN plan USING (domain, lang, source) WHERE n_tokens > 0)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM ranked WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixing of the registered query and the pipeline, over the documents' columns."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, "doc_id", word_count(F.col("text")), levels, WEIGHTS)


@query("op4_hierarchical_mix", MIX_SQL)
def op4_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select(
        "doc_id", F.col("_level0").alias("domain"), F.col("_level1").alias("lang"), F.col("_level2").alias("source"),
        F.col("_n_tokens").alias("n_tokens"), F.col("_epochs").alias("epochs"),
    )
