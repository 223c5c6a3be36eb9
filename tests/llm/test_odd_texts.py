"""Every query on empty tables, on nothing but nulls, and among nulls, repeats and clashing columns."""

import odd_tables
import pytest
from symbolake.llm import queries

QUERIES = queries.QUERIES


@pytest.fixture(scope="module", params=["empty", "only nulls", "nulls"])
def odd(request, data, tmp_path_factory):
    return odd_tables.write(data, tmp_path_factory.mktemp("odd") / request.param.replace(" ", "-"), request.param)


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, odd, name):
    assert QUERIES[name](spark, odd).count() >= 0
