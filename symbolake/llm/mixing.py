"""Mixing sources to target weights (problem 8).

Pfair: the tokens a source gives are cut into blocks of equal size, documents that lie across a border with them. Of N
blocks in all, block i of a source with n blocks is released at slot floor(i N / n) and due by slot ceil((i + 1) N / n);
each slot serves the released block due first. So at any slot every source is less than one block from its share.
Blocks are a bounded number, so the schedule is made in one place; the documents are placed in it by a join.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symbolake.runtime import materialize

#: Tokens of a block, and the most blocks of a mix: a larger mix has larger blocks. The second bounds the schedule, which is broadcast.
BLOCK_TOKENS, MOST_BLOCKS = 65_536, 1 << 20
#: Rows of a source that one window task orders, about; a source of any size spreads over as many slices as that takes.
SLICE_ROWS = 50_000
#: Default tokenizer file; a parameter of all functions.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text for this family of byte-level tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def _encoding(path: str):
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(path: str):
    """A column function: the tokens of a text by the vocabulary file at `path`; null for null."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for s in texts:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int64")

    return count


def source_name(col: str):
    """A source's name with its spelling mended: blanks off, lower case, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s\-]+", "_")


def largest_total(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The most tokens of a mix in which every source that has documents, share and repeats reaches its share of all such sources' shares."""
    have = {s: (sizes[s] * cap, share) for s, (share, cap) in targets.items() if share > 0 and sizes.get(s, 0) * max(0, cap) > 0}
    return min((most / share for most, share in have.values()), default=0.0) * sum(share for _, share in have.values())


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, tuple[float, float]]:
    """Per source (repeats, tokens) of a mix of `total` tokens, by default the most with which all shares are reached.

    A source gives at most size * max_repeats tokens. With a larger total, sources that cannot reach their share give all
    they may, the others share what is left in proportion to their shares (filling); the total falls short only when every
    source is at its cap. A source without documents, share or repeats takes no part.
    """
    have = {s: (sizes.get(s, 0), share, max(0, cap)) for s, (share, cap) in targets.items() if share > 0}
    have = {s: v for s, v in have.items() if v[0] * v[2] > 0}
    if not have:
        return {}
    total = largest_total(sizes, targets) if total is None else total
    total = min(total, sum(size * cap for size, _, cap in have.values()))
    out: dict[str, float] = {}
    rest, open_ = total, dict(have)
    while open_:
        weight = sum(share for _, share, _ in open_.values())
        full = {s: size * cap for s, (size, share, cap) in open_.items() if size * cap < rest * share / weight}
        if not full:
            out |= {s: rest * share / weight for s, (_, share, _) in open_.items()}
            break
        out |= full
        rest -= sum(full.values())
        open_ = {s: v for s, v in open_.items() if s not in full}
    return {s: (out[s] / have[s][0], out[s]) for s in out}


def pfair(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of all blocks of each source: of those released by a slot, the one due first, then the source first by name."""
    total = sum(blocks.values())
    due = lambda s, i: -(-(i + 1) * total // blocks[s])
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, i), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // blocks[s], s, i + 1))
    return out


def sized(documents: DataFrame, names: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents with text and one of the sources of `names` (bounded, one column source); no others are tokenised."""
    d = documents.where("text is not null and source is not null and doc_id is not null").select("doc_id", source_name("source").alias("source"), "text")
    return d.join(F.broadcast(names), "source", "left_semi").select("doc_id", "source", token_counts(tokenizer)("text").alias("tokens")).where("tokens > 0")


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, seed: int = 0, total: float | None = None, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The mix (slot, source, block, doc_id, pass, from_token, to_token) and the report (source, repeats, tokens, actual_share, ...).

    Every document of a source is taken floor(repeats) times, and those first by hash once more until the source's tokens
    are reached, so by less than a document more; no document more than max_repeats times. A row is the part of a document
    in one block. `total`: tokens of the mix, by default `largest_total`; float("inf") for all that the caps allow.
    Sources without documents get share 0 and the others keep their proportions. Documents with null or blank text or source take no
    part; documents of sources without target don't either. A source repeated in the targets counts once, with any of its rows.
    """
    spark = documents.sparkSession
    # One row a named source: the targets are a parameter of a few rows, checked here.
    want = {r[0]: (float(r[1]), int(r[2])) for r in targets.where("source is not null and target_share is not null").select("source", "target_share", F.coalesce("max_repeats", F.lit(1))).limit(10_001).collect()}
    if len(want) > 10_000:
        raise ValueError("more than 10,000 sources in the targets")
    names = spark.createDataFrame([(s,) for s in want] or [], "source string")
    named = materialize(sized(documents, names, tokenizer), "sized")
    size = {r[0]: (int(r[1]), int(r[2])) for r in named.groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}
    sizes = {s: n for s, (n, _) in size.items()}
    goal = plan(sizes, want, total)
    goals = spark.createDataFrame([(s, float(r), float(g), size[s][0]) for s, (r, g) in goal.items()], "source string, repeats double, goal double, size long")
    # Running size in a source, in two steps: inside hash slices, and over the slices of a source.
    h = F.xxhash64("doc_id", F.lit(seed))
    most = max((n for _, n in size.values()), default=1)
    fine = min(20, max(4, math.ceil(math.log2(max(1, most / SLICE_ROWS)))))  # so many bits of the hash name a slice
    cut = named.join(F.broadcast(goals), "source").withColumn("h", h).withColumn("slice", F.shiftright("h", 64 - fine).cast("int"))
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    slice_size = cut.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))
    before = slice_size.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = cut.join(before, ["source", "slice"]).withColumn("at", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    # Almost-whole repeats are whole: the goal is a sum of floats.
    whole = F.floor(F.col("repeats") + 1e-9).cast("int")
    passes = whole + F.when(F.col("at") < F.col("goal") - whole * F.col("size") - 1e-6 * F.col("goal"), 1).otherwise(0)
    taken = materialize(placed.withColumn("passes", passes).where("passes > 0").select("source", "doc_id", "tokens", "at", "passes", "size"), "taken")
    got = taken.groupBy("source").agg(F.sum("passes").alias("uses"), F.count(F.lit(1)).alias("docs"), F.max("passes").alias("most_repeats"), F.sum(F.col("tokens") * F.col("passes")).alias("tokens"))
    given = {r[0]: int(r[1]) for r in got.select("source", "tokens").collect()}
    all_ = sum(given.values())
    block = max(block_tokens, -(-all_ // max(1, most_blocks - len(given))))
    slots = spark.createDataFrame(pd.DataFrame(pfair({s: -(-n // block) for s, n in given.items()}), columns=["source", "block", "slot"]), "source string, block long, slot long")  # at most most_blocks rows
    at = (F.col("pass") - 1) * F.col("size") + F.col("at")
    parts = taken.withColumn("pass", F.explode(F.sequence(F.lit(1), "passes"))).withColumn("at", at)
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block))))
    first, last = F.greatest(F.lit(0), F.col("block") * block - F.col("at")), F.least(F.col("tokens"), (F.col("block") + 1) * block - F.col("at"))
    mix = parts.join(F.broadcast(slots), ["source", "block"]).select("slot", "source", "block", "doc_id", "pass", first.alias("from_token"), last.alias("to_token"), (F.col("at") + first).alias("at"))
    report = (
        spark.createDataFrame([(s, *v, sizes.get(s, 0)) for s, v in want.items()], "source string, target_share double, max_repeats int, source_tokens long").join(F.broadcast(got), "source", "left").na.fill(0, ["uses", "docs", "most_repeats", "tokens"])
        .withColumn("repeats", F.coalesce(F.round(F.try_divide("tokens", "source_tokens"), 6), F.lit(0.0)))
        .withColumn("actual_share", F.round(F.col("tokens") / F.lit(float(all_ or 1)), 6))
    )
    return mix, report


def interleaved(mix: DataFrame) -> DataFrame:
    """The mix in order of service: by slot, and in a block by the place of its tokens. A global, range-partitioned sort."""
    return mix.orderBy("slot", "at").drop("at")
