import pytest
from symbolake.llm import queries


@pytest.mark.parametrize("name", queries.QUERIES)
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.count() > 0
    wanted = {"p3_found": ["repo", "file_path"], "p6_found": ["symbol_id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "band"]}
    assert df.columns == wanted.get(name, df.columns)
