"""Binding of provisional edges to definitions by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolake.functions.text import descriptor_core, provisional_call
from symbolake.operators.graph import first_per, node_set
from symbolake.runtime import heavy_keys, salted

# Confidence of edges by how they came about.
CONFIDENCE = {"Contains": 1.0, "provisional import": 0.5, "provisional call": 0.4, "import": 0.95, "call": 0.8}


def dedup_symbols(symbols: DataFrame) -> DataFrame:
    """One row per id, the last by ordinal."""
    return first_per(symbols, ["symbol_id"], last=True)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, kind), the first by ordinal."""
    return first_per(edges, ["src_id", "dst_id", "kind"])


def provisional(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bound edges as extraction would have left them: imports by core, calls by name. Edges without both ends are dropped."""
    nodes = node_set(symbols)
    s = nodes.select(F.col("symbol_id").alias("src_id"), F.col("package").alias("src_package"))
    t = nodes.select(F.col("symbol_id").alias("dst_id"), F.col("package").alias("_p"), F.col("descriptor").alias("_d"), F.col("name").alias("_n"))
    e = edges.select("src_id", "dst_id", "kind", "confidence", "ordinal")
    for right, key in ((s, "src_id"), (t, "dst_id")):
        lhs, rhs, on = salted(e, right, key, heavy_keys(edges, key))
        e = lhs.join(rhs, on).drop("_salt")
    imp, call = F.col("kind") == "Imports", F.col("kind") == "Calls"
    return e.select(
        "src_id", "src_package", "kind", "ordinal", "confidence",
        F.when(imp | call, F.lit(None)).otherwise(F.col("dst_id")).alias("dst_id"),
        F.when(imp, "?").when(call, F.col("src_package")).otherwise(F.col("_p")).alias("dst_package"),
        F.when(imp, descriptor_core("_d")).when(call, F.concat(F.lit("?/"), "_n", F.lit("()"))).otherwise(F.col("_d")).alias("dst_descriptor"),
    )


def resolve(symbols: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bound edges and one row of statistics.

    raw: src_id, src_package, dst_id (null if provisional), dst_package, dst_descriptor, kind, confidence. An import binds to
    the first definition, by ordinal, of its core in any package; a call to the only definition of its name in the
    package, if there is exactly one. Equal edges come out once with their number `n`. What can't be bound is dropped;
    unbound imports are counted, unbound calls are not.
    """
    nodes = node_set(symbols)
    by_core = nodes.groupBy(descriptor_core("descriptor").alias("dst_descriptor")).agg(F.min_by(F.struct("symbol_id", "package"), "ordinal").alias("def"))
    by_name = nodes.where(F.col("kind") != "File").groupBy(F.col("package").alias("dst_package"), F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("symbol_id").alias("_id")).where("_n = 1").drop("_n")
    # Equal provisional edges are counted before any join: a hot target costs one row per source.
    grouped = raw.groupBy("src_id", "src_package", "dst_id", "dst_package", "dst_descriptor", "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))
    call = provisional_call("dst_descriptor")
    is_import, is_call = F.col("dst_package") == "?", call.isNotNull()
    imports = grouped.where(is_import)
    lhs, rhs, on = salted(imports, by_core, "dst_descriptor", heavy_keys(raw.where(is_import), "dst_descriptor"))
    imported = lhs.join(rhs, on, "left").select("src_id", "src_package", F.col("def.symbol_id").alias("dst_id"), F.col("def.package").alias("dst_package"), "kind", F.lit(CONFIDENCE["import"]).alias("confidence"), "n")
    named = lambda df: df.withColumn("_key", F.xxhash64("dst_package", "_name"))
    calls = named(grouped.where(~F.coalesce(is_import, F.lit(False)) & is_call).withColumn("_name", call))
    lhs, rhs, on = salted(calls, named(by_name), "_key", heavy_keys(named(raw.withColumn("_name", call).where("_name is not null")), "_key"))
    called = lhs.join(rhs, [*on, "dst_package", "_name"]).select("src_id", "src_package", F.col("_id").alias("dst_id"), "dst_package", "kind", F.lit(CONFIDENCE["call"]).alias("confidence"), "n")
    passed = grouped.where(~F.coalesce(is_import, F.lit(False)) & ~is_call).select("src_id", "src_package", "dst_id", "dst_package", "kind", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "n")
    every = imported.withColumn("how", F.lit("import")).unionByName(called.withColumn("how", F.lit("call"))).unionByName(passed.withColumn("how", F.lit("")))
    cross = F.coalesce(F.col("src_package") != F.col("dst_package"), F.lit(False))
    done = every.where("dst_id is not null").withColumn("cross_repo", cross)
    bound = done.groupBy("src_id", "dst_id", "kind", F.round("confidence", 6).alias("confidence"), "cross_repo").agg(F.sum("n").alias("n"))
    have = F.col("dst_id").isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    stats = every.agg(
        total(have & (F.col("how") == "import")).alias("resolved_imports"), total(have & (F.col("how") == "call")).alias("resolved_calls"),
        total(have & cross).alias("cross_repo_edges"), total(~have & (F.col("how") == "import")).alias("unresolved_imports"),
    )
    return bound, stats
