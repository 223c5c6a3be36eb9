"""Reports over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.functions.text import path_penalty
from symbolake.operators.graph import DEPTH, calls, dependents, first_per, project_nodes, reach, walks
from symbolake.runtime import materialize

# Kinds that are definitions worth a summary or a boost.
DEFINITIONS = ["Function", "Method", "Class", "Interface", "Struct", "Enum"]


def newest_enrichment(enrichment: DataFrame) -> DataFrame:
    """One row per symbol id, the last by ordinal; null query lists are empty."""
    e = enrichment.where("symbol_id is not null").select("symbol_id", "summary", F.coalesce("queries", F.array().cast("array<string>")).alias("queries"), "ordinal")
    return first_per(e, ["symbol_id"], last=True).drop("ordinal")


def with_enrichment(nodes: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Result nodes with summary and questions."""
    return nodes.join(newest_enrichment(enrichment), "symbol_id", "left").withColumn("queries", F.coalesce("queries", F.array().cast("array<string>")))


def by_repo(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reached symbols per repo."""
    return reached.join(nodes.select("symbol_id", F.col("package").alias("repo")), "symbol_id").groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"))


def most_depended(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The symbol, no File, with the most dependents; of equals the last by ordinal."""
    return (
        dependents(edges).join(nodes.where(F.col("kind") != "File"), "symbol_id").orderBy(F.desc("deps"), F.desc("ordinal")).limit(1)
        .select("symbol_id", "name", "kind", F.col("package").alias("repo"), F.concat_ws(":", "file_path", F.col("line_start").cast("string")).alias("location"), "deps")
    )


def kind_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """One row of counts in one pass."""
    kinds = [F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("Calls", "Contains", "Imports")]
    return edges.agg(F.count(F.lit(1)).alias("edges"), *kinds, F.count_if(F.coalesce("cross_repo", F.lit(False))).alias("cross_repo"))


def stats_by_repo(nodes: DataFrame, edges: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(repo, kind, symbols, enriched, edges): one row per kind and one for `*` per repo, by one rollup; edges go out of the repo's symbols."""
    known = enrichment.select("symbol_id").where("symbol_id is not null").distinct().withColumn("e", F.lit(1))
    cube = (
        nodes.select("package", "kind", "symbol_id").join(known, "symbol_id", "left").rollup("package", "kind")
        .agg(F.count(F.lit(1)).alias("symbols"), F.count("e").alias("enriched"), F.grouping("package").alias("_all"))
    )
    out = edges.groupBy("src_id").agg(F.count(F.lit(1)).alias("n")).join(nodes.select(F.col("symbol_id").alias("src_id"), "package"), "src_id").groupBy("package").agg(F.sum("n").alias("edges"))
    return cube.where("_all = 0").join(out, "package", "left").select(F.col("package").alias("repo"), F.coalesce("kind", F.lit("*")).alias("kind"), "symbols", "enriched", F.coalesce("edges", F.lit(0)).alias("edges"))


def _cross_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(descriptor, package, importer, n): imports over packages, counted per importer before the ranking."""
    n = edges.where(F.col("kind") == "Imports").groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))
    src = nodes.select(F.col("symbol_id").alias("src_id"), F.col("package").alias("importer"))
    dst = nodes.select(F.col("symbol_id").alias("dst_id"), "descriptor", "package")
    per = n.join(src, "src_id").groupBy("importer", "dst_id").agg(F.sum("n").alias("n"))
    return per.join(dst, "dst_id").where("importer != package").groupBy("descriptor", "importer").agg(F.sum("n").alias("n"), F.min("package").alias("package"))


def _ranked(per: DataFrame, limit: int) -> DataFrame:
    top = per.groupBy("descriptor").agg(F.min("package").alias("defined_in"), F.count(F.lit(1)).alias("repos"), F.sum("n").alias("refs"))
    return top.orderBy(F.desc("repos"), F.desc("refs"), "descriptor").limit(limit)


def cross_repo_targets(edges: DataFrame, nodes: DataFrame, limit: int = 15) -> DataFrame:
    """The imported descriptors that most other repos depend on."""
    return _ranked(_cross_imports(edges, nodes), limit)


def importer_repos(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(descriptor, repo): the repos that import the top target."""
    per = _cross_imports(edges, nodes)
    return per.join(F.broadcast(_ranked(per, 1).select("descriptor")), "descriptor").select("descriptor", F.col("importer").alias("repo"))


def suggest(enrichment: DataFrame, nodes: DataFrame, about: str | None = None, limit: int = 40) -> DataFrame:
    """(question, symbol, location, total) of the pre-generated questions, filtered by a text in question or symbol.

    total counts all that pass the filter, by an action of its own, not in a window over all rows.
    """
    q = newest_enrichment(enrichment).select("symbol_id", F.explode(F.array_distinct("queries")).alias("question")).where("question is not null")
    n = project_nodes(nodes).select("symbol_id", F.col("name").alias("symbol"), "location").join(nodes.select("symbol_id", "ordinal"), "symbol_id")
    hit = q.join(n, "symbol_id")
    if about:
        t = about.lower()
        hit = hit.where(F.lower("question").contains(t) | F.lower("symbol").contains(t))
    total = hit.count()
    return hit.orderBy("symbol", "question", "ordinal").limit(limit).select("question", "symbol", "location", F.lit(total).cast("long").alias("total"))


#: Origins whose reach is counted first, and how many times more in each further round.
ROUND, GROWTH = 256, 16


def flow_candidates(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(symbol_id, score): functions and methods outside penalised paths by how much they reach in four calls, if any; all or the first `limit`.

    With a limit only origins that can be among the first are counted: those with the most walks, which are never fewer
    than the nodes reached, in rounds until no other origin has as many walks as the last of the first reaches nodes.
    """
    origin = nodes.where(F.col("kind").isin("Function", "Method") & (path_penalty("file_path") == 1.0)).select("symbol_id")
    count = lambda ids, adj: reach(ids, edges, DEPTH, adj).groupBy(F.col("origin").alias("symbol_id")).agg(F.count(F.lit(1)).alias("score"))
    if limit is None:
        return count(origin, None)
    adj = calls(edges)
    bound = materialize(origin.join(walks(adj), "symbol_id"), "bounds")
    n = max(ROUND, 4 * limit)
    while True:
        first = materialize(bound.orderBy(F.desc("n"), "symbol_id").limit(n), "first")
        got = materialize(count(first.select("symbol_id"), adj), "scores")
        top = got.orderBy(F.desc("score"), "symbol_id").limit(limit)
        # Nothing is left out if the last of the first is beyond what any origin not counted can reach.
        least, size = top.agg(F.min("score"), F.count(F.lit(1))).first()
        rest = bound.join(first.select("symbol_id"), "symbol_id", "left_anti").agg(F.max("n")).first()[0]
        if rest is None or size == limit and least > rest:
            return top
        n *= GROWTH


def trace_text(hops: DataFrame) -> DataFrame:
    """(origin, trace): what an origin reaches as text lines by depth and name. `hops`: origin, depth, name, location, via."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), F.lit(" ("), F.col("location"), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("depth", "name", line.alias("line"))))
    return hops.groupBy("origin").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("trace"))


def enrich_candidates(nodes: DataFrame, edges: DataFrame, limit: int | None, prior: DataFrame | None = None, stale: DataFrame | None = None) -> DataFrame:
    """The definitions to summarise, all or the first `limit` by dependents, with `deps` and `reuse`: whether a prior row of a symbol that isn't stale can stay."""
    top = dependents(edges, nodes.where(F.col("kind").isin(DEFINITIONS))).join(nodes, "symbol_id")
    if limit is not None:
        top = top.orderBy(F.desc("deps"), "ordinal").limit(limit)
    if prior is None:
        return top.withColumn("reuse", F.lit(False))
    kept = prior.select("symbol_id").distinct()
    if stale is not None:
        kept = kept.join(stale.select("symbol_id"), "symbol_id", "left_anti")
    return top.join(kept.withColumn("_k", F.lit(True)), "symbol_id", "left").withColumn("reuse", F.coalesce("_k", F.lit(False))).drop("_k")


def merge_enrichment(generated: DataFrame, prior: DataFrame, reuse: DataFrame) -> DataFrame:
    """Generated rows without failures (null summary), and the prior rows of the ids in `reuse`."""
    cols = ["symbol_id", "summary", "queries"]
    return generated.where("summary is not null").select(cols).unionByName(prior.join(reuse.select("symbol_id"), "symbol_id", "left_semi").select(cols))


def combine_guides(guides: DataFrame, repo: str | None = None) -> DataFrame:
    """One row: the style guides as one document in order of repo; optionally of one repo, ignoring case."""
    g = guides.where("content is not null")
    if repo is not None:
        g = g.where(F.lower("repo") == repo.lower())
    rows = F.array_sort(F.collect_list(F.struct("repo", "content")))
    return g.agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("# "), r.repo, F.lit("\n\n"), r.content)), "\n\n").alias("guide"))
