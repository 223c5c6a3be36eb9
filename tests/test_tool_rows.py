"""A tool's query returns all rows without gathering them on the driver."""

import pytest
from symbolake.plans import graph_queries, tool_queries


@pytest.fixture
def gathered(spark, monkeypatch):
    """Numbers of rows that came to the driver at a time."""
    frame, seen = type(spark.range(1)), []
    collect = frame.collect

    def spy(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(frame, "collect", spy)
    return seen


def test_ripple_gathers_no_dependents(spark, data, gathered):
    df = tool_queries.tool_ripple(spark, data)
    assert max(gathered) <= 1, "the driver held dependents"
    s = tool_queries._session(spark, data)
    whole = s.ripple(tool_queries._id(graph_queries._focus(s.graph()[1])))
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == whole["total_dependents"] > 100
    assert sorted(rows, key=lambda r: r["symbol_id"]) == sorted(whole["dependents"], key=lambda r: r["symbol_id"])


def test_unknown_focus_has_no_dependents(spark, data):
    s = tool_queries._session(spark, data)
    df = s.ripple_rows("no such thing")
    assert df.columns == tool_queries.tool_ripple(spark, data).columns and df.count() == 0


def test_ripple_writes_no_search_rows(spark, data, monkeypatch):
    monkeypatch.setattr(tool_queries, "_SESSIONS", {})
    tool_queries.tool_ripple(spark, data)
    assert tool_queries._session(spark, data).store.read("search").isEmpty()
    assert tool_queries.tool_search(spark, data).count() > 0
