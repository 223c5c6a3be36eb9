"""The queries that search symbols embed the operator's whole text, documentation included."""

import pytest
from symbolake.operators import retrieval as V
from symbolake.plans import pipeline_queries, text_queries


@pytest.mark.parametrize("query", [text_queries.hybrid_search, pipeline_queries.embedded_search_rows])
def test_documentation_is_embedded(spark, data, monkeypatch, query):
    seen, embed = [], V.embed
    monkeypatch.setattr(V, "embed", lambda df, *a: seen.append(df) or embed(df, *a))
    query(spark, data)
    pairs = lambda df: sorted((r.symbol_id, r.text) for r in df.collect())
    assert pairs(seen[0]) == pairs(text_queries.search_text(spark, data))
    assert spark.read.parquet(f"{data}/symbols.parquet").where("docstring is not null").count() > 0
