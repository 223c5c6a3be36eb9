"""Problems 1, 2, 4 and 5 against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from symbolake.sources.pointer import Stale
from symbolake.operators import dense_counts, hierarchy, incremental_state, orphans

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


# ---- 1


def test_dense_counts_skew_nulls_and_clashing_columns(spark):
    rng = random.Random(1)
    keys = [rng.choice(["hot"] * 6 + [None, "", "a", "b"] + [f"k{i}" for i in range(50)]) for _ in range(5000)]
    lanes = [rng.choice([True, False, None]) for _ in keys]
    df = spark.createDataFrame([(k, x, 1, "z") for k, x in zip(keys, lanes, strict=True)], "dst string, lane boolean, n0 int, key string").repartition(5)
    got = {(r.dst, r.lane): r.n for r in dense_counts.dense_counts(df, "dst", "lane").collect()}
    assert got == Counter(zip(keys, lanes, strict=True))


def test_dense_counts_flushes_full_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(dense_counts, "MAX_ENTRIES", 20)
    df = spark.range(1000).selectExpr("cast(id % 137 as string) k", "id % 2 = 0 f").repartition(3)
    got = {(r.k, r.f): r.n for r in dense_counts.dense_counts(df, "k", "f").collect()}
    assert got == Counter((str(i % 137), i % 2 == 0) for i in range(1000))


def test_dense_counts_empty_and_numeric_keys(spark):
    assert rows(dense_counts.dense_counts(spark.createDataFrame([], "k long, f boolean"), "k", "f")) == []
    df = spark.createDataFrame([(1, True), (1, True), (2, None)], "k long, f boolean")
    assert rows(dense_counts.dense_counts(df, "k", "f")) == [(1, True, 2), (2, None, 1)]


def test_heavy_pairs_ties_at_the_limit(spark):
    df = spark.createDataFrame([("a", True)] * 2 + [("b", False)] * 198, "k string, f boolean")
    assert rows(dense_counts.heavy_pairs(df, "k", "f").select("k")) == [("a",), ("b",)]
    assert dense_counts.heavy_pairs(df.limit(0), "k", "f").count() == 0


# ---- 2


def brute_orphans(refs, lives):
    out = []
    for key, ts, n in refs:
        if key is None:
            continue
        mine = [x for x in lives if x[0] == key]
        ok = bool(mine) if ts is None else any(s is not None and s <= ts and (u is None or ts < u) for _, s, u in mine)
        if not ok:
            out.append((key, ts, n))
    return sorted(out, key=repr)


def test_orphans_against_brute_force(spark):
    rng = random.Random(2)
    lives = [(f"k{rng.randrange(40)}", day(rng.choice([None, *range(20)])), day(rng.choice([None, *range(5, 25)]))) for _ in range(90)]
    refs = [(rng.choice(["k1"] * 30 + [None] + [f"k{i}" for i in range(60)]), day(rng.choice([None, *range(30)])), n) for n in range(800)]
    r = spark.createDataFrame(refs, "key string, ts timestamp_ntz, n long")
    x = spark.createDataFrame(lives + lives[:20], "key string, since timestamp_ntz, until timestamp_ntz")
    assert rows(orphans.orphan_references(r, x)) == brute_orphans(refs, lives)


def test_orphans_without_parents_or_references(spark):
    none = spark.createDataFrame([], "key string, since timestamp_ntz, until timestamp_ntz")
    r = spark.createDataFrame([("a", None, 1), (None, None, 2), ("a", None, 1)], "key string, ts timestamp_ntz, n long")
    assert rows(orphans.orphan_references(r, none).select("n")) == [(1,), (1,)]
    assert orphans.orphan_references(r.limit(0), none).count() == 0


def test_full_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(orphans, "MAX_BITS", 1 << 12)  # nearly every key passes: the exact join decides
    lives = spark.range(3000).selectExpr("concat('p', id) key", "timestamp_ntz'2024-01-01' since", "cast(null as timestamp_ntz) until")
    refs = spark.range(6000).selectExpr("concat('p', id) key", "timestamp_ntz'2024-02-01' ts", "id n")
    assert orphans.orphan_references(refs, lives).count() == 3000


# ---- 4


def brute_tree(pairs):
    up = {}
    for p, c in pairs:
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    nodes = {x for pair in pairs for x in pair if x is not None}
    out = {}
    for n in nodes:
        path, seen = [n], {n}
        while path[-1] in up:
            nxt = up[path[-1]]
            if nxt in seen:
                path = None
                break
            path.append(nxt)
            seen.add(nxt)
        out[n] = (path[-1], len(path) - 1, path[::-1]) if path else ("", -1, None)
    return out


@pytest.mark.parametrize("rest", [0, 100_000])
def test_hierarchy_against_brute_force(spark, rest):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 120)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    pairs += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x2", "y"), ("y", "z"), ("s", "s"), (None, "lone"), ("lone2", None), (None, None), ("n1", None), ("q", "n5"), ("a", "hub"), *((("hub"), f"h{i}") for i in range(300))]
    df = spark.createDataFrame([(*p, "kind", 1) for p in pairs + pairs[:40]], "p string, c string, node string, depth int")
    got = {r.node: (r.root, r.depth, r.path) for r in hierarchy.hierarchy(df, "p", "c", rest_rows=rest).collect()}
    assert got == brute_tree(pairs)


def test_hierarchy_empty_and_all_cyclic(spark):
    empty = spark.createDataFrame([], "p string, c string")
    assert hierarchy.hierarchy(empty, "p", "c").count() == 0
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "p string, c string")
    assert rows(hierarchy.hierarchy(loop, "p", "c", paths=False)) == [("a", "", -1), ("b", "", -1)]


def test_descendants(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("x", "x")], "p string, c string")
    h = hierarchy.hierarchy(df, "p", "c")
    assert rows(hierarchy.ancestor_pairs(h)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]
    assert rows(hierarchy.descendant_counts(h)) == [("a", 3, 2, 2), ("b", 1, 1, 1)]


# ---- 5


def test_state_swap_and_failure(spark, tmp_path):
    store = incremental_state.StateStore(spark, f"file://{tmp_path}/s", ["k"])
    v1 = spark.createDataFrame([("a", "1"), ("b", None), (None, "n")], "k string, v string")
    first = store.changes(v1, ["v"])
    assert first.count() == 3 and {r.change_type for r in first.collect()} == {"new"}
    store.stage(first)  # a run that dies here leaves the old state current
    assert store.version == 0 and store.changes(v1, ["v"]).count() == 3
    other = incremental_state.StateStore(spark, f"file://{tmp_path}/s", ["k"])
    assert store.commit(first) == 1
    with pytest.raises(Stale):  # a run that started from the same state
        other.commit(first)
    assert incremental_state.StateStore(spark, f"file://{tmp_path}/s", ["k"]).changes(v1, ["v"]).where("k is not null").count() == 0
    assert store.changes(v1, ["v"]).where("k is not null").count() == 0
    v2 = spark.createDataFrame([("a", "2"), ("b", ""), ("c", "x")], "k string, v string")
    assert rows(store.changes(v2, ["v"]).select("k", "change_type")) == [("a", "changed"), ("b", "changed"), ("c", "new")]
    store.commit(store.changes(v2, ["v"]))
    assert store.changes(v2, ["v"]).count() == 0


def test_many_small_commits_are_written_as_one_at_times(spark, tmp_path, monkeypatch):
    from pyspark.sql import types as T

    monkeypatch.setattr(incremental_state, "PARTS", 3)
    store = incremental_state.StateStore(spark, f"file://{tmp_path}/s", ["k"], T.StructType([T.StructField("x", T.IntegerType())]))
    for i in range(7):
        now = spark.createDataFrame([("a", i), (f"k{i}", i), (f"k{i}", i)], "k string, x int")
        assert store.changes(now.select("k", F.col("x").alias("y")), ["y"]).count() == 3
        store.commit(now.withColumn("content_hash", incremental_state.content_hash("x")), note=i)
        assert len(store._record()["parts"]) < 3 and store.note() == i
    assert rows(store.read(now).select("k", "x")) == sorted([("a", 6), *((f"k{i}", i) for i in range(7))])


def test_content_hash_keeps_columns_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("a", None)], "x string, y string")
    assert df.select(incremental_state.content_hash("x", "y").alias("h")).distinct().count() == 5


def brute_uncovered(sets, runs):
    items, seqs = {}, {}
    for repo, commit, seq, arrived, *lists in sets:
        seqs.setdefault((repo, commit), seq)
        for change, paths in zip(("added", "modified", "deleted"), lists, strict=True):
            for p in paths or []:
                if p is not None:
                    k = (repo, commit, p.replace("\\", "/"), change)
                    items[k] = min(items.get(k, (seq, arrived)), (seq, arrived), key=lambda x: x[1])
    done = [(r, seqs[r, c], t) for r, c, t, s in runs if s is not None and s.strip().lower() == "ok" and (r, c) in seqs]
    return sorted(k for k, (seq, seen) in items.items() if not any(r == k[0] and seq <= s and seen <= t for r, s, t in done))


@pytest.mark.parametrize("block", [4096, 3])
def test_uncovered_changes(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(incremental_state, "BLOCK", block)
    rng = random.Random(5)
    paths = ["a/b.py", "a\\b.py", "c.ts", "d e.js", None]
    lists = lambda: rng.choice([None, [], [rng.choice(paths) for _ in range(3)]])
    sets = [(f"r{rng.randrange(3)}", f"c{s}", s, day(s + rng.randrange(9)), lists(), lists(), lists()) for s in [rng.randrange(20) for _ in range(120)]]
    runs = [(f"r{rng.randrange(3)}", rng.choice([None, "gone", *(f"c{i}" for i in range(20))]), day(rng.randrange(4, 28)), rng.choice(["ok", " OK", "not ok", None, "failed"])) for _ in range(14)]
    cs = spark.createDataFrame(sets, "repo string, commit string, seq int, arrived_at timestamp_ntz, added array<string>, modified array<string>, deleted array<string>")
    rm = spark.createDataFrame(runs, "repo string, commit string, started_at timestamp_ntz, status string")
    assert rows(incremental_state.uncovered_changes(cs, rm, f"file://{tmp_path}/state")) == brute_uncovered(sets, runs)
    again = incremental_state.StateStore(spark, f"file://{tmp_path}/state", incremental_state.FILE)
    assert rows(incremental_state.uncovered_changes(cs, rm, f"file://{tmp_path}/state")) == brute_uncovered(sets, runs)
    assert again.pointer.number() == again.version == 1  # the same log: the state is used as it is
    fewer = rm.where("started_at < '2024-01-10'")
    assert set(rows(incremental_state.uncovered_changes(cs, fewer, f"file://{tmp_path}/state"))) >= set(brute_uncovered(sets, runs)) and again.pointer.number() == 2


def test_uncovered_without_runs_or_changes(spark, tmp_path):
    cs = spark.createDataFrame([("r", "c", 1, T0, ["a"], None, [])], "repo string, commit string, seq int, arrived_at timestamp_ntz, added array<string>, modified array<string>, deleted array<string>")
    rm = spark.createDataFrame([], "repo string, commit string, started_at timestamp_ntz, status string")
    assert rows(incremental_state.uncovered_changes(cs, rm, f"file://{tmp_path}/a")) == [("r", "c", "a", "added")]
    assert incremental_state.uncovered_changes(cs.limit(0), rm, f"file://{tmp_path}/b").count() == 0
