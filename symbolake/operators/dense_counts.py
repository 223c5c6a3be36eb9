"""Counts per key when a few keys hold most rows (problem 1).

Dense accumulator arrays: every input split dictionary-encodes its keys and adds its rows up with
``numpy.bincount`` into a dense array over its own dictionary. A split sends one row per distinct key, never one
row per record, so the largest key costs no more rows than others. The blocks of the global dictionary
(keys by hash) are then summed the same way, one dense array a block.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a split's dictionary at which its array is sent on and a new one begun; bounds a task's memory.
MAX_ENTRIES = 500_000


def _merge(parts: list) -> tuple:
    """One dictionary and its (entries x lanes) array out of several."""
    import numpy as np
    import pyarrow as pa

    keys = pa.concat_arrays([k for k, _ in parts])
    enc = keys.dictionary_encode(null_encoding="encode")
    codes = np.asarray(enc.indices)
    blocks = np.concatenate([c for _, c in parts])
    out = np.zeros((len(enc.dictionary), blocks.shape[1]), dtype=np.int64)
    for lane in range(blocks.shape[1]):
        np.add.at(out[:, lane], codes, blocks[:, lane])
    return enc.dictionary, out


def _rows(keys, block):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([keys, *(pa.array(block[:, i]) for i in range(block.shape[1]))], names=["key", "n0", "n1", "n2"])


def _count_split(batches: Iterator) -> Iterator:
    """Rows (key, lane) -> one row per distinct key of the split with a count per lane."""
    import numpy as np
    import pyarrow as pa

    parts: list = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        enc = pa.array(b.column(0)).dictionary_encode(null_encoding="encode")
        n = len(enc.dictionary)
        lane = np.asarray(b.column(1)).astype(np.int64)
        block = np.bincount(np.asarray(enc.indices).astype(np.int64) * 3 + lane, minlength=3 * n).reshape(n, 3)
        parts.append((enc.dictionary, block))
        held += n
        if held >= MAX_ENTRIES:
            parts = [_merge(parts)]
            held = len(parts[0][0])
            if held >= MAX_ENTRIES // 2:
                yield _rows(*parts[0])
                parts, held = [], 0
    if parts:
        yield _rows(*_merge(parts))


def _sum_block(batches: Iterator) -> Iterator:
    """The rows of one block of the global dictionary -> the block's summed array.

    Rows are merged into the array when there are as many new ones as it has entries, so each costs a bounded share.
    """
    import numpy as np

    parts: list = []
    entries = new = 0
    for b in batches:
        if b.num_rows:
            parts.append((b.column(0), np.stack([np.asarray(b.column(i)) for i in (1, 2, 3)], axis=1)))
            new += b.num_rows
            if new >= max(MAX_ENTRIES, entries):
                parts = [_merge(parts)]
                entries, new = len(parts[0][0]), 0
    if parts:
        yield _rows(*_merge(parts))


def dense_counts(df: DataFrame, key: str, lane: str) -> DataFrame:
    """Rows of `df` per (`key`, boolean `lane`): columns `key`, `lane` (boolean) and `n` (long).

    Exact for any distribution: a null key and a null lane are values of their own, repeated rows count each time,
    an empty table gives no rows, other columns are ignored. A split sends a row of a key each time its dictionary
    has grown to MAX_ENTRIES, so a task gets at most one row of a key for so many records, however they are spread.
    """
    kind = df.schema[key].dataType.simpleString()
    lanes = F.when(F.col(lane).isNull(), 2).when(F.col(lane), 1).otherwise(0).cast("int")
    schema = f"key {kind}, n0 long, n1 long, n2 long"
    split = df.select(F.col(key).alias("key"), lanes.alias("lane")).mapInArrow(_count_split, schema)
    total = split.repartition("key").mapInArrow(_sum_block, schema)
    each = F.explode(F.array(*(F.struct(F.lit(v).cast("boolean").alias("lane"), F.col(c).alias("n")) for v, c in ((False, "n0"), (True, "n1"), (None, "n2")))))
    return total.select("key", each.alias("e")).select(F.col("key").alias(key), F.col("e.lane").alias(lane), F.col("e.n").alias("n")).where("n > 0")


def heavy_pairs(df: DataFrame, key: str, lane: str, percent: int = 1) -> DataFrame:
    """The pairs of `dense_counts` that hold at least `percent` % of all rows of `df`."""
    rows = df.select(F.count(F.lit(1))).first()[0]  # answered from the Parquet footers
    return dense_counts(df, key, lane).where(F.col("n") * 100 >= F.lit(rows * percent))
