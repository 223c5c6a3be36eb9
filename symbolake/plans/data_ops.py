"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.operators import dense_counts, hierarchy, incremental_state, orphans
from symbolake.runtime import place, shared_dir, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hot = dense_counts.heavy_pairs(table(spark, d, "edges"), "dst_id", "cross_repo")
    return hot.select("dst_id", F.col("cross_repo").cast("long").alias("cross_flag"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    n = dense_counts.dense_counts(table(spark, d, "edges"), "dst_id", "cross_repo")
    return n.select("dst_id", F.col("cross_repo").cast("long").alias("cross_flag"), "n")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.graph_orphans(*(table(spark, d, t) for t in ("symbols", "edges", "enrichment")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.contains_hierarchy(table(spark, d, "edges"))
    return h.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.contains_hierarchy(table(spark, d, "edges"), paths=True)
    return hierarchy.descendant_counts(h).withColumnRenamed("ancestor", "node_id")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.contains_hierarchy(table(spark, d, "edges"), paths=True)
    return h.select(F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"))


def _kept(spark: SparkSession, name: str, d: str) -> str:
    """A folder of its own for the tables of `d`, the same in every run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{hashlib.md5(d.encode()).hexdigest()}"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental_state.uncovered_changes(table(spark, d, "change_sets"), table(spark, d, "repo_meta"), _kept(spark, "state", d))


def p5_second_run(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: one at the start of the month of the last delivery, and what a second one with all deliveries has to do."""
    sets = table(spark, d, "change_sets")
    now = incremental_state.changed_paths(sets)
    start = sets.select(F.date_trunc("month", F.max("arrived_at")).cast("timestamp_ntz")).first()[0]
    before = incremental_state.changed_paths(sets.where(F.col("arrived_at") < F.lit(None if start is None else str(start)).cast("timestamp_ntz")))
    store = incremental_state.StateStore(spark, place(spark, "runs"), incremental_state.FILE)
    kinds = lambda df: df.select(*incremental_state.FILE, *(F.col(f"at_{c}").isNotNull().alias(c) for c in incremental_state.CHANGES))
    content = list(incremental_state.CHANGES)
    store.commit(store.changes(kinds(before), content))
    return store.changes(kinds(now), content).select(*incremental_state.FILE, "change_type")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_report, p4_found, p4_descendants, p4_paths, p5_found, p5_second_run)}

_ORPHANS = """
refs AS (
  SELECT 'edges' AS ref_table, 'src_id' AS ref_field, ordinal, src_id AS k, indexed_at AS t FROM edges
  UNION ALL SELECT 'edges', 'dst_id', ordinal, dst_id, indexed_at FROM edges
  UNION ALL SELECT 'enrichment', 'symbol_id', ordinal, symbol_id, indexed_at FROM enrichment),
orphans AS (
  SELECT ref_table, ref_field, ordinal, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period FROM refs
  WHERE k IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM symbols s WHERE s.symbol_id = refs.k
      AND (refs.t IS NULL OR (s.indexed_at <= refs.t AND (s.removed_at IS NULL OR refs.t < s.removed_at)))))
"""
_TREE = """
c AS (SELECT DISTINCT src_id AS p, dst_id AS n FROM edges WHERE kind = 'Contains'),
ids AS (SELECT p AS id FROM c UNION SELECT n FROM c),
walk AS (
  SELECT id, id AS root, 0::BIGINT AS depth, [id] AS path FROM ids WHERE id NOT IN (SELECT n FROM c)
  UNION ALL SELECT c.n, walk.root, walk.depth + 1, list_append(walk.path, c.n) FROM walk JOIN c ON c.p = walk.id),
tree AS (SELECT ids.id AS node_id, coalesce(walk.root, '') AS root_id, coalesce(walk.depth, -1) AS depth, walk.path FROM ids LEFT JOIN walk ON walk.id = ids.id)
"""
SQL = {
    "p1_found": """
        SELECT dst_id, cross_repo::INT::BIGINT AS cross_flag FROM edges
        GROUP BY dst_id, cross_repo HAVING count(*) * 100 >= (SELECT count(*) FROM edges)""",
    "p1_counts": "SELECT dst_id, cross_repo::INT::BIGINT AS cross_flag, count(*) AS n FROM edges GROUP BY dst_id, cross_repo",
    "p2_found": f"WITH {_ORPHANS} SELECT * FROM orphans",
    "p2_report": f"WITH {_ORPHANS} SELECT ref_table, ref_field, period, count(*) AS n FROM orphans GROUP BY ALL",
    "p4_found": f"WITH RECURSIVE {_TREE} SELECT node_id, root_id, depth FROM tree",
    "p4_paths": f"WITH RECURSIVE {_TREE} SELECT node_id, array_to_string(path, ' > ') AS path FROM tree",
    "p4_descendants": f"""
        WITH RECURSIVE {_TREE},
        pairs AS (SELECT unnest(path[:-2]) AS node_id, generate_subscripts(path[:-2], 1) - 1 AS pos, depth FROM tree WHERE depth > 0)
        SELECT node_id, count(*) AS descendants, count(*) FILTER (depth - pos = 1) AS children, max(depth - pos) AS height
        FROM pairs GROUP BY node_id""",
    "p5_found": """
        WITH lists AS (
          SELECT repo, "commit", seq, arrived_at, 'added' AS change, unnest(added) AS p FROM change_sets
          UNION ALL SELECT repo, "commit", seq, arrived_at, 'modified', unnest(modified) FROM change_sets
          UNION ALL SELECT repo, "commit", seq, arrived_at, 'deleted', unnest(deleted) FROM change_sets),
        items AS (
          SELECT repo, "commit", replace(p, '\\', '/') AS file_path, change, min(seq) AS seq, min(arrived_at) AS seen
          FROM lists WHERE p IS NOT NULL GROUP BY ALL),
        runs AS (
          SELECT DISTINCT m.repo, c.seq, m.started_at FROM repo_meta m
          JOIN (SELECT repo, "commit", min(seq) AS seq FROM change_sets GROUP BY ALL) c ON c.repo = m.repo AND c."commit" = m."commit"
          WHERE lower(trim(m.status)) = 'ok')
        SELECT repo, "commit", file_path, change FROM items i
        WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.repo = i.repo AND i.seq <= r.seq AND i.seen <= r.started_at)""",
    "p5_second_run": """
        WITH lists AS (
          SELECT repo, "commit", arrived_at, 1 AS n, unnest(added) AS p FROM change_sets
          UNION ALL SELECT repo, "commit", arrived_at, 2, unnest(modified) FROM change_sets
          UNION ALL SELECT repo, "commit", arrived_at, 4, unnest(deleted) FROM change_sets),
        sets AS (
          SELECT repo, "commit", replace(p, '\\', '/') AS file_path, bit_or(n) AS now,
            bit_or(n) FILTER (arrived_at < (SELECT date_trunc('month', max(arrived_at)) FROM change_sets)) AS before
          FROM lists WHERE p IS NOT NULL GROUP BY ALL)
        SELECT repo, "commit", file_path, CASE WHEN before IS NULL THEN 'new' ELSE 'changed' END AS change_type FROM sets WHERE now IS DISTINCT FROM before""",
}
