import importlib.util

import pytest

import __spark_entry__ as e
from lexiforge.plans import catalogue
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name], SF) is None


def test_entry(spark):
    assert e.entry(spark).columns == ["place", "id", "source_document", "similarity", "original_similarity", "context"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert ("op1_licenses" in e.queries()) == (importlib.util.find_spec("lexiforge.llm") is not None)


def test_top_k_keeps_k_rows_a_task_and_reads_what_it_needs(spark):
    plan = catalogue.QUERIES["vector_topk_cosine"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.rpartition("ReadSchema")[2]
    glob = catalogue.QUERIES["vector_topk_filtered"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(label" in glob or "GreaterThan(label" in glob
