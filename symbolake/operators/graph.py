"""The symbol graph: nodes, edges, lookups, traversals, ranks and context packs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symbolake.functions.text import est_tokens
from symbolake.runtime import heavy_keys, materialize, materialize_counted, salted, small

#: Edges up to which a rank is computed by one numpy kernel; beyond, by a join loop.
KERNEL_EDGES = 1_000_000
DAMPING, ITERATIONS = 0.85, 40
DEPTH, BUDGET = 4, 1500
#: Parts in which the items of one size are ordered first.
SALTS = 64
NODE = ["symbol_id", "name", "kind", "package", "descriptor", "file_path", "line_start", "signature", "ordinal"]


def first_per(df: DataFrame, keys: list[str], order: str = "ordinal", last: bool = False) -> DataFrame:
    """The first (or last) row per key by `order`, as a mergeable aggregate: no key's rows are gathered."""
    others = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*others), order)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(*df.columns)


def node_set(symbols: DataFrame) -> DataFrame:
    """One node per symbol id, of several rows the first by ordinal. Null ids are no nodes."""
    return first_per(symbols.select(*NODE).where("symbol_id is not null"), ["symbol_id"])


def attach_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends exist; parallel edges stay."""
    ids = nodes.select("symbol_id")
    cols = edges.columns
    for end in ("src_id", "dst_id"):
        lhs, rhs, on = salted(edges, ids.withColumnRenamed("symbol_id", end), end, heavy_keys(edges, end))
        edges = lhs.join(rhs, on, "left_semi").select(*cols)
    return edges


def dangling_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, attached, dangling. Counted per end before the join, so hot ids cost no more than others."""
    pair = edges.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))
    both = pair.select("n", F.lit(0).cast("long").alias("a")).unionByName(attach_edges(pair, nodes).select(F.lit(0).cast("long").alias("n"), F.col("n").alias("a")))
    sums = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum("a"), F.lit(0)).alias("attached"))
    return sums.withColumn("dangling", F.col("edges") - F.col("attached"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    both = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


def project_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as results show them: repo is the id's package, location is path:line."""
    return nodes.select("symbol_id", "name", "kind", F.col("package").alias("repo"), F.concat_ws(":", "file_path", F.col("line_start").cast("string")).alias("location"), "signature")


def _shortest_first() -> list:
    return [(F.col("kind") == "File").asc(), F.octet_length("descriptor").asc(), F.col("ordinal").asc(), F.col("symbol_id").asc()]


def lookup(nodes: DataFrame, focus: str) -> DataFrame:
    """At most one node: the exact id, else the shortest descriptor that is or contains `focus`, else the exact name."""
    tier = F.when(F.col("symbol_id") == focus, 0).when(F.col("descriptor").contains(focus), 1).when(F.col("name") == focus, 2)
    return nodes.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", *_shortest_first()).limit(1).drop("_tier")


def find(nodes: DataFrame, query: str, limit: int = 30, repo: str | None = None) -> DataFrame:
    """The top nodes whose name or descriptor contains `query`; a repo is filtered before the limit."""
    hit = nodes.where(F.col("name").contains(query) | F.col("descriptor").contains(query))
    if repo is not None:
        hit = hit.where(F.lower("package") == repo.lower())
    return hit.orderBy(*_shortest_first()).limit(limit)


def repos(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("package").alias("repo")).agg(F.count(F.lit(1)).alias("symbols"))


def dependents(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(symbol_id, deps): incoming Calls and Imports, parallel edges counted; with `ids`, 0 for those without."""
    n = edges.where(F.col("kind").isin("Calls", "Imports") & F.col("dst_id").isNotNull()).groupBy(F.col("dst_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("deps"))
    return n if ids is None else ids.select("symbol_id").join(n, "symbol_id", "left").select("symbol_id", F.coalesce("deps", F.lit(0)).alias("deps"))


def _follow(adj: DataFrame, frontier: DataFrame, few: bool) -> DataFrame:
    """The edges that start `at` a node of the frontier. A frontier of few rows goes to the edges; for a large one the nodes that hold much of the edges are salted."""
    if few:
        return adj.join(F.broadcast(frontier), "at")
    lhs, rhs, on = salted(adj, frontier, "at", heavy_keys(adj, "at"))
    return lhs.join(rhs, on).drop("_salt")


def bfs(start: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: list[str], depth: int = DEPTH, reverse: bool = False) -> DataFrame:
    """(symbol_id, depth, via) of every node within `depth` hops of `start` (one column symbol_id), at its least depth.

    via is the kind of the edge from the parent of smallest ordinal, then the smallest kind. The start is not
    returned; depth 0 gives nothing; cycles end. Ids that are no nodes are never passed, so `edges` may have ends that don't
    exist. Each level filters the edges by the frontier and looks only the ids it meets up among the nodes.
    """
    here, there = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    adj = edges.where(F.col("kind").isin(kinds)).select(F.col(here).alias("at"), F.col(there).alias("symbol_id"), "kind")
    ordinal = nodes.groupBy("symbol_id").agg(F.min("ordinal").alias("ordinal"))  # `nodes` may be symbols with several rows an id
    known = lambda ids: ids.join(ordinal.join(ids.select("symbol_id"), "symbol_id", "left_semi"), "symbol_id")
    steps = [materialize(start.select("symbol_id").where("symbol_id is not null").distinct(), "bfs")]
    for _ in range(depth):
        frontier = known(steps[-1]).select(F.col("symbol_id").alias("at"), F.col("ordinal").alias("po"))
        # Known ids are never more than those of the last step, whose size is that of its files.
        step = _follow(adj, frontier, small(steps[-1])).where("symbol_id is not null").groupBy("symbol_id").agg(F.min(F.struct("po", "kind")).alias("m"))
        new, n = materialize_counted(step.join(reduce(DataFrame.unionByName, [x.select("symbol_id") for x in steps]), "symbol_id", "left_anti"), "bfs")
        if not n:
            break
        steps.append(new)
    if len(steps) == 1:
        return start.sparkSession.createDataFrame([], "symbol_id string, depth int, via string")
    met = reduce(DataFrame.unionByName, [x.select("symbol_id", F.lit(d + 1).alias("depth"), F.col("m.kind").alias("via")) for d, x in enumerate(steps[1:])])
    return known(met).drop("ordinal")


def ripple(start: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Transitive dependents: against Calls and Imports."""
    return bfs(start, edges, nodes, ["Calls", "Imports"], depth, reverse=True)


def thread(start: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Forward call trace: along Calls."""
    return bfs(start, edges, nodes, ["Calls"], depth)


def hops(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reached nodes as results show them."""
    met = nodes.join(reached.select("symbol_id"), "symbol_id", "left_semi")  # before a node set is aggregated
    return reached.join(project_nodes(met), "symbol_id").select("symbol_id", "name", "kind", "repo", "location", "depth", "via")


def zoom(focus: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbourhood of one node (one column symbol_id): relation and node; one row per edge.

    relations: container (of several the last by ordinal of the edge), member, caller, callee, importer.
    """
    f = F.broadcast(focus.select(F.col("symbol_id").alias("focus")).limit(1))  # one row
    out = edges.join(f, F.col("src_id") == F.col("focus"))
    into = edges.join(f, F.col("dst_id") == F.col("focus"))
    member = out.where(F.col("kind").isin("Contains", "Calls")).select(F.when(F.col("kind") == "Contains", "member").otherwise("callee").alias("relation"), F.col("dst_id").alias("symbol_id"))
    user = into.where(F.col("kind").isin("Calls", "Imports")).select(F.when(F.col("kind") == "Calls", "caller").otherwise("importer").alias("relation"), F.col("src_id").alias("symbol_id"))
    holder = into.where(F.col("kind") == "Contains").agg(F.max_by("src_id", "ordinal").alias("symbol_id")).where("symbol_id is not null").select(F.lit("container").alias("relation"), "symbol_id")
    return holder.unionByName(member).unionByName(user).join(project_nodes(nodes), "symbol_id").select("relation", "symbol_id", "name", "kind", "repo", "location", "signature")


_RANK = "symbol_id string, rank double"


def _power(seeds: list[str], damping: float, iterations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(frames), ignore_index=True).dropna()
        codes, ids = pd.factorize(pd.concat([both["a"], both["b"], pd.Series(seeds, dtype=object)], ignore_index=True))
        n, m = len(ids), len(both)
        a, b, seed = codes[:m], codes[m : 2 * m], codes[2 * m :]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        degree = np.bincount(src, minlength=n).astype(float)
        start = np.bincount(seed, minlength=n) / len(seeds)
        rank = start.copy()
        share = np.divide(1.0, degree, out=np.zeros(n), where=degree > 0)
        for _ in range(iterations):
            rank = (1 - damping) * start + damping * np.bincount(dst, weights=(rank * share)[src], minlength=n)
        keep = rank > 0
        yield pd.DataFrame({"symbol_id": ids[keep], "rank": rank[keep]})

    return run


def pagerank(seeds: list[str], edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Personalised rank from the seeds over the undirected view of Calls and Imports; rows of rank > 0.

    Parallel edges weigh double, a node without neighbours passes nothing on, the seeds' mass starts at 1. Up to
    `kernel_edges` counted edges one task computes it in arrays; beyond, each iteration is one join and one sum.
    """
    spark = edges.sparkSession
    ab = edges.where(F.col("kind").isin("Calls", "Imports")).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    ab = materialize(ab, "pairs")
    if ab.count() <= kernel_edges:
        mark = spark.createDataFrame([(None, None)], "a string, b string")  # a row even without edges
        return ab.unionByName(mark).coalesce(1).mapInPandas(_power(list(seeds), damping, iterations), _RANK)
    both = ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("degree"))
    link = materialize(both.join(degree, "a").select("a", "b", (F.col("w") / F.col("degree")).alias("p")), "links")
    start = spark.createDataFrame([(s, 1.0 / len(seeds)) for s in seeds], _RANK)
    rank = start
    for i in range(iterations):
        flow = link.join(rank.withColumnRenamed("symbol_id", "a"), "a").groupBy(F.col("b").alias("symbol_id")).agg((damping * F.sum(F.col("rank") * F.col("p"))).alias("rank"))
        rank = flow.unionByName(start.withColumn("rank", F.col("rank") * (1 - damping))).groupBy("symbol_id").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            rank = materialize(rank, "rank")
    return rank.where("rank > 0")


def context_pack(focus: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(position, symbol_id, est_tokens): the focus, then others by rank while they fit; what doesn't fit is skipped.

    Exact without scanning all candidates in one place: of the items of t tokens only the best floor(left / t) can ever be
    taken, about left * ln(left) rows in all, and the scan runs over those. Files, and nodes of rank 0, take no part.
    """
    spark = focus.sparkSession
    schema = "position int, symbol_id string, est_tokens long"
    head = focus.select("symbol_id").join(nodes, "symbol_id").select("symbol_id", est_tokens().alias("t")).first()
    if head is None:
        return spark.createDataFrame([], schema)
    left = budget - head.t
    items = [(0, head.symbol_id, head.t)]
    if left > 0:
        rank = pagerank([head.symbol_id], edges)
        cand = rank.join(nodes, "symbol_id").where((F.col("kind") != "File") & (F.col("symbol_id") != head.symbol_id)).select("symbol_id", F.round("rank", 12).alias("rank"), "ordinal", est_tokens().alias("t")).where(F.col("t") <= left)
        # First among the items of a size in one of SALTS parts, then of all parts: no task orders all items of a size.
        best = lambda *by: F.row_number().over(Window.partitionBy("t", *by).orderBy(F.desc("rank"), "ordinal", "symbol_id"))
        few = cand.withColumn("_salt", F.pmod(F.xxhash64("symbol_id"), F.lit(SALTS))).withColumn("n", best("_salt")).where(F.col("n") * F.col("t") <= left)
        short = few.withColumn("n", best()).where(F.col("n") * F.col("t") <= left).orderBy(F.desc("rank"), "ordinal", "symbol_id")
        for r in short.toLocalIterator():
            if r.t <= left:
                items.append((len(items), r.symbol_id, r.t))
                left -= r.t
    return spark.createDataFrame(items, schema)


def calls(edges: DataFrame) -> DataFrame:
    """(at, symbol_id) of the Calls, each pair once; written, as every level reads it."""
    return materialize(edges.where((F.col("kind") == "Calls") & F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()).select(F.col("src_id").alias("at"), F.col("dst_id").alias("symbol_id")).distinct(), "calls")


def reach(origins: DataFrame, edges: DataFrame, depth: int = DEPTH, adj: DataFrame | None = None) -> DataFrame:
    """(origin, symbol_id, depth): everything each origin reaches along Calls, from all origins at once; as many rows as that is."""
    adj = calls(edges) if adj is None else adj
    levels = [materialize(origins.select(F.col("symbol_id").alias("origin"), "symbol_id").distinct(), "reach")]
    for _ in range(depth):
        step = _follow(adj, levels[-1].select("origin", F.col("symbol_id").alias("at")), small(levels[-1])).select("origin", "symbol_id").distinct()
        for x in levels:
            step = step.join(x.select("origin", "symbol_id"), ["origin", "symbol_id"], "left_anti")
        levels.append(materialize(step, "reach"))
    return reduce(DataFrame.unionByName, [x.select("origin", "symbol_id", F.lit(d + 1).alias("depth")) for d, x in enumerate(levels[1:])])


def walks(adj: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(symbol_id, n): the walks of 1 to `depth` calls from each node, at least as many as the nodes it reaches; one row a node."""
    hot = heavy_keys(adj, "symbol_id")
    n = adj.groupBy(F.col("at").alias("symbol_id")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    for _ in range(depth - 1):
        before = materialize(n, "walks")
        lhs, rhs, on = salted(adj, before, "symbol_id", hot)
        n = lhs.join(rhs, on, "left").groupBy(F.col("at").alias("symbol_id")).agg(F.sum(1 + F.coalesce("n", F.lit(0.0))).alias("n"))
    return n


def load_graph(spark: SparkSession, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and attached edges."""
    nodes = node_set(symbols)
    return nodes, attach_edges(edges, nodes)
