"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles (problem 4).

Level-wise: the frontier of one level is joined with the parent map to get the next, until it is empty. Only nodes
that are parents themselves take part in the levels; the leaves, most of the nodes, are joined once at the end, so
the loop shuffles each inner node once. Nodes that no root reaches lie on or under a cycle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.runtime import heavy_keys, materialize, materialize_counted, salted


def parent_map(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """One row (node, parent) per node with a container; of several containers the smallest counts."""
    return edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("parent"))


#: With no more rows in the frontier and inner nodes left than this, the last levels are walked inside one task instead of one job each.
REST_ROWS = 100_000
_NODE = "node string, root string, depth long, path array<string>"


def _rest(paths: bool):
    """The remaining levels of a bounded rest: frontier rows (parent null) and unreached (node, parent) rows."""

    def walk(frames: Iterator) -> Iterator:
        children, level = defaultdict(list), []
        for f in frames:
            for node, parent, root, depth, path in zip(f["node"], f["parent"], f["root"], f["depth"], f["path"], strict=True):
                if parent is None:
                    level.append((node, root, int(depth), list(path)))
                else:
                    children[parent].append(node)
        while level := [(c, r, d + 1, [*p, c] if paths else p) for n, r, d, p in level for c in children.get(n, ())]:
            yield pd.DataFrame(level, columns=["node", "root", "depth", "path"])

    return walk


def hierarchy(edges: DataFrame, parent: str, child: str, paths: bool = True, rest_rows: int = REST_ROWS) -> DataFrame:
    """Every id in `parent` or `child` of `edges` once: node, root, depth and, with `paths`, path (array of ids, root first).

    A node on or under a cycle (a self-loop is one) has root `''`, depth -1 and a null path. Repeated rows count once;
    null ids are no nodes, and the id beside a null is a node without that relation. Of several parents the smallest
    id is taken. Empty edges give no rows. Other columns are ignored.
    """
    up = materialize(parent_map(edges, parent, child), "parents")
    both = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull())
    inner = materialize(both.select(F.col(parent).alias("node")).distinct(), "inner")
    # The levels below only look for inner nodes with a container; those already reached are cut away as they grow in number.
    down = materialize(up.join(inner, "node", "left_semi"), "down")
    empty = F.array().cast("array<string>")
    root = inner.join(up, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), (F.array("node") if paths else empty).alias("path"))
    levels, (frontier, n) = [], materialize_counted(root, "level")
    left, seen, gone = down.count(), [], 0
    while n:
        if levels:
            seen, gone = [*seen, frontier.select("node")], gone + n
        levels.append(frontier)
        if 2 * gone >= left > 0:
            down, left = materialize(down.join(_union(seen, root), "node", "left_anti"), "down"), left - gone
            seen, gone = [], 0
        if left > gone and n + left - gone <= rest_rows:
            top = frontier.withColumn("parent", F.lit(None).cast("string"))
            under = down if not seen else down.join(_union(seen, root), "node", "left_anti")
            both = top.unionByName(under, allowMissingColumns=True).select("node", "parent", "root", "depth", "path")
            levels.append(materialize(both.coalesce(1).mapInPandas(_rest(paths), _NODE), "level"))
            break
        # Broadcast only if the planner finds one side, whose size it knows from its files, below its threshold.
        f = frontier.select(F.col("node").alias("parent"), "root", "depth", "path")
        below = down.join(f, "parent").select("node", "root", (F.col("depth") + 1).alias("depth"), (F.concat("path", F.array("node")) if paths else F.col("path")).alias("path"))
        frontier, n = materialize_counted(below, "level")
    reached = _union(levels, root)
    # The leaves hang below reached inner nodes or, like unreached inner nodes, below none. A container may hold very many.
    leaves = up.join(inner, "node", "left_anti")
    lhs, rhs, on = salted(leaves, reached.select(F.col("node").alias("parent"), "root", "depth", "path"), "parent", heavy_keys(up, "parent"))
    lost = lambda c, v: F.coalesce(c, F.lit(v))
    below = lhs.join(rhs, on, "left").select(
        "node", lost(F.col("root"), "").alias("root"), lost(F.col("depth") + 1, -1).cast("long").alias("depth"), (F.concat("path", F.array("node")) if paths else F.col("path")).alias("path")
    )
    cyclic = inner.join(reached.select("node"), "node", "left_anti").select("node", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    out = reached.unionByName(below).unionByName(cyclic)
    # Ids that occur only beside a null are roots by themselves.
    lone = edges.where(F.col(parent).isNull() | F.col(child).isNull()).select(F.coalesce(parent, child).alias("node")).where("node is not null").distinct()
    if not lone.isEmpty():
        lone = lone.join(up, "node", "left_anti").join(inner, "node", "left_anti")
        out = out.unionByName(lone.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.array("node").alias("path")))
    return out if paths else out.drop("path")


def _union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    out = frames[0] if frames else like.limit(0)
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """From `hierarchy(paths=True)`: a row (ancestor, descendant, distance) per node and node above it.

    Each node expands its own path, so the work follows the depth and no group is gathered. Cyclic nodes give none.
    """
    step = F.posexplode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    return nodes.where("path is not null").select(F.col("node").alias("descendant"), "depth", step.alias("pos", "ancestor")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """Per node that has any: number of descendants and of children, height below it."""
    pairs = ancestor_pairs(nodes)
    return pairs.groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"), F.count_if(F.col("distance") == 1).alias("children"), F.max("distance").alias("height"))


def contains_hierarchy(edges: DataFrame, paths: bool = False) -> DataFrame:
    """`hierarchy` of the Contains rows of the graph's edges."""
    return hierarchy(edges.where(F.col("kind") == "Contains").select("src_id", "dst_id"), "src_id", "dst_id", paths)
