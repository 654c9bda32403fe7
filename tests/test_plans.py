"""What the plans of the registered queries look like."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from rowscribe.plans import QUERIES, load_all

load_all()

# Queries that write and read files, or fit models, when they are built.
EAGER = {"grid_search_lr", "few_shot_sweep"}

# Queries that hand text to a model outside.
MODELS = {"notes_from_chunks", "notes_from_pairs"}


def plan_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER - MODELS))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toJSON()


def rows_below_single_partition(plan):
    """Nodes directly below an exchange to a single partition."""
    lines = plan.split("\n")
    below = []
    for i, line in enumerate(lines[:-1]):
        if re.search(r"Exchange SinglePartition", line):
            below.append(lines[i + 1])
    return below


RANKED = ["row_key", "split_ordered", "split_seeded", "stratified_folds", "few_shot_grid", "serialize_shuffled_numeric", "mixture_cap", "batch_pad", "roc_auc", "pr_auc", "label_median"]


@pytest.mark.parametrize("name", RANKED)
def test_only_aggregates_meet_in_one_task(spark, sf_dir, name):
    """Before every exchange to one task stands an aggregate, so what meets there is as
    large as the number of ranges, not the table."""
    for line in rows_below_single_partition(plan_of(QUERIES[name](spark, sf_dir), "simple")):
        assert "HashAggregate" in line, line


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = plan_of(QUERIES["roc_auc"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan and "text:string" not in plan
    ranged = plan_of(QUERIES["row_range"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderkey,100), LessThan(o_orderkey,900)" in ranged


def test_serialization_is_one_stage(spark, sf_dir):
    from rowscribe.operators.serialize import serialize
    from rowscribe.plans.registry import table
    from rowscribe.plans.serialization import PART, PART_FORMATS
    from rowscribe.operators.serialize import feature_template

    part = table(spark, sf_dir, "part")
    plan = plan_of(serialize(part, feature_template(PART, "list", PART_FORMATS)))
    assert "Exchange" not in plan and "codegen id" in plan


def test_seeded_split_does_not_shuffle_the_table(spark, sf_dir):
    plan = plan_of(QUERIES["split_seeded"](spark, sf_dir), "simple")
    main = plan.split("Subquery subquery")[0]
    assert "Exchange" not in main


def test_top_n_notes_trim_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["timeline_top_concepts"](spark, sf_dir), "simple")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_entries_are_built_once_per_scan(spark, sf_dir):
    """A filter on the size of an exploded array would build the strings of an event, and
    parse its props, again."""
    for name in ("timeline_parse", "timeline_person_records"):
        plan = plan_of(QUERIES[name](spark, sf_dir), "simple")
        assert plan.count("get_json_object") == plan.count("FileScan") == 1, name


SEVERAL = ["timeline_weights_visits", "timeline_weights", "timeline_person_weights", "timeline_zero_shot_weights", "timeline_first_occurrence", "timeline_top_concepts"]


@pytest.mark.parametrize("name", SEVERAL)
def test_timelines_that_are_read_several_times_are_parsed_once(spark, sf_dir, name):
    assert "get_json_object" not in plan_of(QUERIES[name](spark, sf_dir), "simple")


def test_visits_group_only_strings_with_an_attribute(spark):
    from rowscribe.operators import timeline as T

    parsed = spark.createDataFrame([(1, 2, 0, 0, "id", "7", None, None)], "person_id bigint, visit_id bigint, pos bigint, at int, attr string, value string, concept_id bigint, concept string")
    assert "isnotnull(attr" in plan_of(T.visits_of(parsed), "simple")


def test_budget_flags_fold_the_notes_once(spark, sf_dir):
    assert "aggregate(" not in plan_of(QUERIES["timeline_budget_flags"](spark, sf_dir), "simple")


def test_sampled_bounds_hash_keys_as_they_are(spark, monkeypatch):
    """Bounds come from a hash of the keys, not from a digest of their text."""
    from rowscribe.operators import ranking as R

    seen = []
    monkeypatch.setattr(R, "range_of", lambda order, bounds, types: seen.append(bounds) or F.lit(0))
    monkeypatch.setattr(F, "md5", lambda *a: 1 / 0)
    rows = spark.range(20000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") / 2).alias("x"))
    R.sampled_range(rows, [F.col("x"), F.col("id")], 16)
    R.sampled_range(rows, [F.col("id")], 16)
    assert [len(b) for b in seen] == [15, 15]
    ends = [0, *[b[0] for b in seen[1]], 20000]
    assert max(b - a for a, b in zip(ends, ends[1:])) < 20000 / 16 * 2


@pytest.mark.parametrize("name", sorted(MODELS))
def test_notes_for_a_model_are_made_after_rows_are_dealt_out(spark, sf_dir, name):
    """A compact table is read by one task; cleaning, requests and the model are not in it."""
    nodes = plan_of(QUERIES[name](spark, sf_dir), "simple").split("\n")
    scan = next(i for i, line in enumerate(nodes) if "FileScan" in line)
    dealt = max(i for i, line in enumerate(nodes) if "hashpartitioning(p_partkey" in line)
    assert "REPARTITION_BY_NUM" in nodes[dealt] and not any("regexp" in line for line in nodes[dealt:scan])
    assert any("MapInArrow" in line for line in nodes[:dealt])


def test_a_grid_is_placed_once(spark):
    from rowscribe.operators import linearize as G

    rows = spark.createDataFrame([("a", "b")], "name string, value string")
    marked = F.array(F.array(F.lit(1), F.lit(0)))
    text = G.linearize(G.feature_grid(F.col("name"), F.col("value")), marked, F.lit(""), F.lit(""))
    assert optimized(rows.select(text)).count("ArrayAggregate") == 1


def test_a_list_is_parsed_and_summed_once(spark):
    """Its sum is bound before the division, and unnesting adds no filter that parses again."""
    from rowscribe.operators import answers as A
    from rowscribe.operators import metrics as M

    rows = spark.createDataFrame([(0, "1, 3")], "label int, text string")
    lists = rows.select("label", A.probability_list(F.col("text")).alias("p"))
    plan = optimized(M.class_scores(lists, "label", "p"))
    assert plan.count("expressions.StringSplit") == plan.count("expressions.ArrayAggregate") == 1


@pytest.mark.parametrize("name", ["zero_shot_score", "roc_auc_ovr", "roc_auc_ovo"])
def test_scores_per_class_are_counted_once(spark, sf_dir, name):
    """What follows reads the histogram, not the rows that it was made of."""
    plan = plan_of(QUERIES[name](spark, sf_dir), "simple")
    assert "orders.parquet" not in plan and "embeddings.parquet" not in plan and "histogram" in plan


def test_two_label_lists_are_parsed_once(spark, sf_dir):
    """Their areas read the stored histogram too, not the lists."""
    from rowscribe.operators import answers as A
    from rowscribe.operators import evaluate as V

    rows = spark.createDataFrame([(0, "3, 1"), (1, "1, 3"), (1, "2, 2")], "label int, text string")
    lists = rows.select("label", A.probability_list(F.col("text")).alias("p"))
    plan = plan_of(V.zero_shot_score(lists, "label", "p"), "simple")
    assert "split(" not in plan and "histogram" in plan
    areas = [line for line in plan_of(QUERIES["metric_record"](spark, sf_dir), "simple").split("\n") if "FileScan" in line and "score#" in line]
    assert areas and all("histogram" in line for line in areas)
