"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of cores. Each query
runs once to warm up the code paths and is then timed until all its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from rowscribe.plans import QUERIES, load_all

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERY_NAMES = os.environ.get("BENCH_QUERIES", "").split() or [
    "customer_prompts",
    "serialize_sentence",
    "serialize_list",
    "serialize_dates",
    "serialize_shuffled_categorical",
    "serialize_shuffled_numeric",
    "clean_text",
    "linearize_spans",
    "label_median",
    "row_key",
    "split_ordered",
    "split_seeded",
    "few_shot_grid",
    "stratified_folds",
    "mixture_cap",
    "perturb_rows",
    "prompt_render",
    "prompt_requests",
    "parse_yes_no",
    "token_lengths",
    "one_hot",
    "ordinal",
    "zscore",
    "choice_scores",
    "choice_predictions",
    "loss_terms",
    "roc_auc",
    "roc_auc_ovr",
    "pr_auc",
    "result_grid",
    "batch_pad",
    "timeline_parse",
    "timeline_weights",
    "timeline_top_concepts",
    "timeline_note",
    "timeline_budget",
    "metric_record",
    "unlabelled_pool",
    "few_shot_all",
    "one_hot_aligned",
    "one_hot_aligned_long",
    "explanation_features",
    "experiment_bundle",
]


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("rowscribe-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.default.parallelism", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    load_all()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERY_NAMES:
        run(spark, name)
        seconds[name] = round(run(spark, name), 3)
        print(f"{name:34s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
