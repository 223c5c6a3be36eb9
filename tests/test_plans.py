"""Plans: only the needed columns are read, filters reach the files, and Python stays out where expressions do."""

import re

import pytest
import sqlcheck
from pyspark.sql import functions as F
from symbolake.operators import dense_counts, orphans, retrieval
from symbolake.plans import graph_queries, text_queries
from symbolake.runtime import table


def read(df) -> set[str]:
    return set(re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString().replace("\n", " ")))


def test_counts_read_two_columns(spark, data):
    df = dense_counts.dense_counts(table(spark, data, "edges"), "dst_id", "cross_repo")
    assert read(df) == {"dst_id:string,cross_repo:boolean"}


def test_references_are_one_scan_a_table(spark, data):
    df = orphans.graph_references(table(spark, data, "edges"), table(spark, data, "enrichment"))
    plan = sqlcheck.plan_of(df)
    assert plan.count("FileScan") == 2 and "confidence" not in "".join(read(df)) and "summary" not in "".join(read(df))


def test_filters_reach_the_files(spark, data):
    plan = sqlcheck.plan_of(graph_queries.edge_summary(spark, data))
    assert "Python" not in plan
    edges = table(spark, data, "edges").where(F.col("kind") == "Contains").select("src_id")
    assert "EqualTo(kind,Contains)" in sqlcheck.plan_of(edges)


@pytest.mark.parametrize("name", ["split_identifier", "query_keywords", "symbol_query_flag", "lexical_overlap", "path_penalty", "name_casing", "search_text", "reply_parse"])
def test_text_operators_are_expressions(spark, data, name):
    plan = sqlcheck.plan_of(text_queries.QUERIES[name](spark, data))
    assert "Python" not in plan and "Arrow" not in plan


def test_top_k_is_no_full_sort(spark, data):
    df = retrieval.vector_topk(table(spark, data, "embeddings"), "vec_id", "embedding", [0.0] * 64, 5)
    assert "TakeOrderedAndProject" in sqlcheck.plan_of(df)
