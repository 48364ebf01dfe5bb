"""Every registered query of the library's own operators runs, and gives the rows of its SQL."""

import pytest

from docloom.plans import case_queries, graph_queries, knowledge_queries, layer_queries, search_queries, sheet_queries, table_queries

MODULES = (search_queries, table_queries, sheet_queries, graph_queries, knowledge_queries, layer_queries, case_queries)
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, agrees):
    agrees(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    from conftest import SMALL

    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
