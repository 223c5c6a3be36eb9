"""Every query with SQL gives the same rows as the SQL; the others run and keep their columns."""

import pytest
import sqlcheck
from symbolake.plans import data_ops, graph_queries, pipeline_queries, text_queries, tool_queries

MODULES = (data_ops, graph_queries, text_queries, pipeline_queries, tool_queries)
SQL = {n: (m.QUERIES[n], s) for m in MODULES for n, s in m.SQL.items()}
REST = {n: q for m in MODULES for n, q in m.QUERIES.items() if n not in m.SQL}


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, data, name):
    sqlcheck.check(spark, data, *SQL[name])


@pytest.mark.parametrize("name", REST)
def test_runs(spark, data, name):
    df = REST[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["node_id", "root_id", "depth"]
    assert set(e.oracle_sql()) <= set(e.queries())
