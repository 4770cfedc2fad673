"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from corpusloom.plans import ORACLES, QUERIES
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "hits", "context"] and frame.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert compare(spark, db, FOLDER, name) is None


def test_only_approximate_and_trained_queries_lack_sql():
    trained = {"ann_ivf", "ann_ivfpq", "ann_lsh", "embed_documents", "index_comparison", "knowledge_search"}
    trained |= {"index_comparison_rows", "stored_ivf_rows", "stored_ivfpq_rows", "stored_lsh_rows"}
    assert set(QUERIES) - set(ORACLES) == trained
