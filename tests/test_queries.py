import pytest

from pagelode.plans import queries as engine
from tests.oracle import same_rows, tables


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    same_rows(engine.queries()[name](spark, sf), con, engine.oracle_sql()[name])


@pytest.mark.parametrize("name", ["segment_strategies", "coverage_counts", "structural_quality"])
def test_page_queries_have_a_row_for_each_page(spark, sf, name):
    assert engine.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_entry_works_without_the_optional_subpackage(monkeypatch, spark, sf):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else real(name, *a))
    assert set(entry.queries()) == set(engine.queries())
    assert set(entry.oracle_sql()) == set(engine.oracle_sql())
