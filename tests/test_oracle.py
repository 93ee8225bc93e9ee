"""Every query with SQL gives what DuckDB gives; the others give rows."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
MODELS = {"train_tabular", "top_importances", "train_board", "score_boards", "search_board"}  # covered by test_models


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - MODELS))
def test_query(spark, connection, name):
    assert check.compare(spark, connection, SF, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
