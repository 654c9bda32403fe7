"""Every registered query against its SQL."""

import pytest

from rowscribe.plans import ORACLES, QUERIES, load_all
from tests.oracle import connect, differences

load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_only_fitted_models_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"grid_search_lr", "few_shot_sweep"}


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["c_custkey", "prompt", "answer", "label"]
    assert rows.count() == 150
    assert entry.queries().keys() >= entry.oracle_sql().keys()
