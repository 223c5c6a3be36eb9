"""References to records that do not exist, are gone or come later (problem 2).

A Bloom filter of the parent keys, of bounded size, is broadcast. A reference the filter does not know is an orphan
for certain and meets no parent. The references it knows are verified by an exact anti join on key and time; keys
that hold much of the references are salted. References are read and tested once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.runtime import heavy_keys, salted

#: Bits per parent key, of which ln 2 in so many are probed: about 1 % of unknown keys pass.
BITS_PER_KEY = 10
#: The filter never has more bits than this (64 MB). With more parents fewer bits are probed and more references go to the exact join.
MAX_BITS = 1 << 29
#: Over so many places the definite orphans are spread.
SPREAD = 1 << 16


def _hashes(key: str) -> tuple[Column, Column]:
    """A start below 2^62 and a step below 2^40, so that no probe overflows."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 2), F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(17)), 24)


def size(expected: int) -> tuple[int, int]:
    """Bits of a filter of so many keys, a power of two, and the best number of probes."""
    bits = 1 << 12
    while bits < min(MAX_BITS, BITS_PER_KEY * max(1, expected)):
        bits <<= 1
    return bits, max(1, min(7, round(0.69 * bits / max(1, expected))))


def bloom_words(parents: DataFrame, key: str, bits: int, probes: int):
    """The filter of `parents.key` as a numpy array of 64-bit words, built by a distributed bitwise-or."""
    start, step = _hashes(key)
    at = F.explode(F.array(*((start + F.lit(i) * step) % F.lit(bits) for i in range(probes))))
    words = (
        parents.where(F.col(key).isNotNull()).select(at.alias("at"))
        .select(F.shiftrightunsigned("at", 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    got = words.toArrow()  # at most MAX_BITS / 64 rows
    out[np.asarray(got.column("w"))] = np.asarray(got.column("b")).view(np.uint64)
    return out


def _may_contain(words, probes: int) -> callable:
    """A vectorised test of key hashes against the broadcast filter."""
    bits = len(words.value) * 64

    @F.pandas_udf(T.BooleanType())
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(), h2.to_numpy()
        ok = np.ones(len(a), dtype=bool)
        for i in range(probes):
            at = (a + i * b) % bits
            ok &= (words.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(ok)

    return test


def orphan_references(refs: DataFrame, lives: DataFrame, expected_parents: int | None = None) -> DataFrame:
    """The rows of `refs` whose key is not valid at their own time.

    refs: `key` and `ts` besides any columns. lives: `key`, `since`, `until` (null: still valid), several rows a key.
    A reference with null `ts` is an orphan only if its key occurs in no row of `lives`. A null key is no reference
    and never an orphan. A life that ends before it starts, or starts at null, is valid never but makes its key occur.
    Repeated references each come out; with empty `lives` every reference with a key does.
    """
    spark = refs.sparkSession
    bits, probes = size(expected_parents if expected_parents is not None else lives.count())
    words = spark.sparkContext.broadcast(bloom_words(lives, "key", bits, probes))
    tested = refs.where(F.col("key").isNotNull()).withColumn("_known", _may_contain(words, probes)(*_hashes("key")))
    # One row a key and start, the longest: repeated lives vanish before they are joined.
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    spans = lives.where(F.col("key").isNotNull()).groupBy("key", "since").agg(F.max(F.coalesce(F.col("until"), forever)).alias("until"))
    # Definite orphans pass through the join with no key, spread by a salt that no parent has.
    lhs, rhs, on = salted(tested, spans, "key", heavy_keys(refs, "key"))
    lhs = lhs.withColumn("_key", F.when(F.col("_known"), F.col("key"))).withColumn("_salt", F.when(F.col("_known"), F.col("_salt")).otherwise(-1 - (F.rand(11) * SPREAD).cast("int")))
    l, r = lhs.alias("l"), rhs.withColumnRenamed("key", "_key").alias("r")
    hit = F.col("l.ts").isNull() | ((F.col("r.since") <= F.col("l.ts")) & (F.col("l.ts") < F.col("r.until")))
    return l.join(r, (F.col("l._key") == F.col("r._key")) & (F.col("l._salt") == F.col("r._salt")) & hit, "left_anti").drop("_salt", "_key", "_known")


def graph_references(edges: DataFrame, enrichment: DataFrame) -> DataFrame:
    """The references of the graph tables to symbols: ref_table, ref_field, ordinal, key, ts; one scan a table."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in ("src_id", "dst_id"))))
    a = edges.select("ordinal", F.col("indexed_at").alias("ts"), pair.alias("p")).select(F.lit("edges").alias("ref_table"), "p.ref_field", "ordinal", "p.key", "ts")
    b = enrichment.select(F.lit("enrichment").alias("ref_table"), F.lit("symbol_id").alias("ref_field"), "ordinal", F.col("symbol_id").alias("key"), F.col("indexed_at").alias("ts"))
    return a.unionByName(b)


def graph_orphans(symbols: DataFrame, edges: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Problem 2 on the graph tables: ref_table, ref_field, ordinal, period (`YYYY-MM` or `unknown`)."""
    lives = symbols.select(F.col("symbol_id").alias("key"), F.col("indexed_at").alias("since"), F.col("removed_at").alias("until"))
    bad = orphan_references(graph_references(edges, enrichment), lives)
    return bad.select("ref_table", "ref_field", "ordinal", F.when(F.col("ts").isNull(), "unknown").otherwise(F.format_string("%04d-%02d", F.year("ts"), F.month("ts"))).alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and period."""
    return orphans.groupBy("ref_table", "ref_field", "period").agg(F.count(F.lit(1)).alias("n"))
