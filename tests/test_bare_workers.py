"""Queries with Python stages where workers have no copy of the package."""

import bare_workers
import pytest

STAGES = {
    "symbolake.plans.data_ops": ["p1_found", "p2_found", "p4_found"],
    "symbolake.plans.text_queries": ["hybrid_search"],
    "symbolake.plans.graph_queries": ["ppr_top"],
    "symbolake.plans.pipeline_queries": ["extract_and_resolve", "offline_summaries", "embedded_search_rows"],
}


@pytest.mark.parametrize("module", STAGES)
def test_run_without_the_package(module, data, tmp_path):
    bare_workers.run(module, STAGES[module], data, tmp_path)
