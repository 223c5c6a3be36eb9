"""Incremental maintenance of the graph from changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.operators.resolve import dedup_symbols, resolve

FILE = ["repo", "file_path"]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, status) of two snapshots (repo, path, hash): added, modified or deleted; a rename is both. Null paths are ignored."""
    o, n = (x.where("path is not null and repo is not null").groupBy("repo", "path").agg(F.max("hash").alias("hash")).alias(a) for x, a in ((old, "o"), (new, "n")))
    both = o.join(n, (F.col("o.repo") == F.col("n.repo")) & (F.col("o.path") == F.col("n.path")), "full").where(~F.col("o.hash").eqNullSafe(F.col("n.hash")))
    status = F.when(F.col("o.path").isNull(), "added").when(F.col("n.path").isNull(), "deleted").otherwise("modified")
    return both.select(F.coalesce("o.repo", "n.repo").alias("repo"), F.coalesce("o.path", "n.path").alias("path"), status.alias("status"))


def parse_drop(diff: DataFrame) -> DataFrame:
    """Which changed files are to be parsed again and which to be dropped."""
    return diff.select("repo", "path", F.col("status").isin("added", "modified").alias("to_parse"), F.col("status").isin("modified", "deleted").alias("to_drop"))


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("repo", "status").agg(F.count(F.lit(1)).alias("n"))


def change_set_files(change_sets: DataFrame) -> DataFrame:
    """(repo, file_path, change) of all change sets, distinct; `/` for either separator."""
    lists = F.explode(F.array(*(F.struct(F.lit(c).alias("change"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("paths")) for c in ("added", "modified", "deleted"))))
    each = change_sets.where("repo is not null").select("repo", lists.alias("l")).select("repo", "l.change", F.explode("l.paths").alias("p"))
    return each.where("p is not null").select("repo", F.translate("p", "\\", "/").alias("file_path"), "change").distinct()


def stale_symbols(symbols: DataFrame, changes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Distinct ids whose stored enrichment is out of date: their repo was never indexed, or their file was added or modified."""
    changed = changes.where(F.col("change").isin("added", "modified")).select(*FILE).distinct().withColumn("_c", F.lit(1))
    known = indexed.where("repo is not null").select("repo").distinct().withColumn("_k", F.lit(1))
    s = symbols.select("symbol_id", *FILE).join(changed, FILE, "left").join(known, "repo", "left")
    return s.where("_c is not null or _k is null").select("symbol_id").distinct()


def drop_files(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without what comes from `files` (repo, file_path): symbols there, and edges whose source is there."""
    gone = files.select(*FILE).distinct()
    ids = symbols.join(gone, FILE, "left_semi").select(F.col("symbol_id").alias("src_id")).distinct()
    return symbols.join(gone, FILE, "left_anti"), edges.join(ids, "src_id", "left_anti")


def merge(symbols: DataFrame, raw_edges: DataFrame, diff: DataFrame, new_symbols: DataFrame, new_raw_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The graph after a change: (symbols, raw edges, bound edges, statistics).

    Rows of modified and deleted files are dropped, keyed by repo and path; parsed rows are appended; every raw edge,
    kept unbound between runs, is bound again. So the result equals a full rebuild.
    """
    drop = parse_drop(diff).where("to_drop").select("repo", F.col("path").alias("file_path"))
    kept, raw = drop_files(symbols, raw_edges, drop)
    symbols = dedup_symbols(kept.unionByName(new_symbols))
    raw = raw.unionByName(new_raw_edges)
    return symbols, raw, *resolve(symbols, raw)


def refresh_vectors(search: DataFrame, prior: DataFrame, stale: DataFrame, embed) -> DataFrame:
    """`search` (symbol_id, text) with vectors: those of `prior` where not stale, else by `embed`, which sees only the rest."""
    kept = prior.select("symbol_id", "vector").dropDuplicates(["symbol_id"]).join(stale.select("symbol_id"), "symbol_id", "left_anti")
    have = search.join(kept, "symbol_id")
    return have.select("symbol_id", "text", "vector").unionByName(embed(search.join(kept, "symbol_id", "left_anti")).select("symbol_id", "text", "vector"))
