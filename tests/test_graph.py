"""Graph operators against plain Python, on random multigraphs and small fixed cases."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from symbolake.operators import graph as G
from symbolake.operators import incremental as I
from symbolake.operators import reports as R
from symbolake.operators import resolve as D
from symbolake.operators import retrieval as V

NODES = "symbol_id string, name string, kind string, package string, descriptor string, file_path string, line_start int, signature string, ordinal long"
EDGES = "src_id string, dst_id string, kind string, confidence float, cross_repo boolean, ordinal long"


def graph(spark, n=30, m=90, seed=1):
    rng = random.Random(seed)
    nodes = [(f"s{i}", f"name{i % 7}", rng.choice(["Function", "Class", "File"]), f"p{i % 3}", f"p/m/name{i}().", f"f{i % 4}.py", i, rng.choice([None, "def f(x)" * rng.randrange(1, 9)]), i) for i in range(n)]
    edges = [(f"s{rng.randrange(n + 3)}", f"s{rng.randrange(n)}", rng.choice(["Calls", "Imports", "Contains"]), 1.0, False, k) for k in range(m)]
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def walk(start, edges, kinds, depth, reverse):
    adj = defaultdict(set)
    for s, d, k, *_ in edges:
        if k in kinds:
            adj[d if reverse else s].add((s if reverse else d, k))
    seen, out, level = {start: 0}, {}, [start]
    for d in range(1, depth + 1):
        nxt = defaultdict(list)
        for p in level:
            for c, k in adj[p]:
                if c not in seen:
                    nxt[c].append((int(p[1:]), k))
        for c, ways in nxt.items():
            seen[c] = d
            out[c] = (d, min(ways)[1])
        level = list(nxt)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals(spark, seed):
    _, edges, n, e = graph(spark, seed=seed)
    att = G.attach_edges(e, n)
    known = [x for x in edges if int(x[0][1:]) < 30]
    assert att.count() == len(known)
    at = spark.createDataFrame([("s1",)], "symbol_id string")
    got = {r.symbol_id: (r.depth, r.via) for r in G.ripple(at, att, n, 3).collect()}
    assert got == walk("s1", known, {"Calls", "Imports"}, 3, True)
    got = {r.symbol_id: (r.depth, r.via) for r in G.thread(at, att, n, 4).collect()}
    assert got == walk("s1", known, {"Calls"}, 4, False)
    assert G.ripple(at, att, n, 0).count() == 0
    counts = G.dangling_count(e, n).first()
    assert tuple(counts) == (90, len(known), 90 - len(known))
    reach = {}
    for r in G.reach(n.select("symbol_id"), att, 2).collect():
        reach.setdefault(r.origin, {})[r.symbol_id] = r.depth
    assert reach == {o: {c: d for c, (d, _) in w.items()} for o in (f"s{i}" for i in range(30)) if (w := walk(o, known, {"Calls"}, 2, False))}


def brute_rank(seed, edges, damping=0.85, steps=40):
    adj = defaultdict(list)
    for s, d, k, *_ in edges:
        if k != "Contains":
            adj[s].append(d)
            adj[d].append(s)
    rank = {seed: 1.0}
    for _ in range(steps):
        new = defaultdict(float)
        new[seed] += 1 - damping
        for n, r in rank.items():
            for c in adj[n]:
                new[c] += damping * r / len(adj[n])
        rank = dict(new)
    return rank


def test_rank_by_both_strategies(spark):
    _, edges, n, e = graph(spark, 12, 30)
    att = G.attach_edges(e, n)
    known = [x for x in edges if int(x[0][1:]) < 12]
    want = brute_rank("s2", known, steps=8)
    for cap in (10**9, 0):
        got = {r.symbol_id: r["rank"] for r in G.pagerank(["s2"], att, iterations=8, kernel_edges=cap).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(want.values()) <= 1 + 1e-9
    alone = G.pagerank(["x"], att.limit(0), iterations=3).first()
    assert alone.symbol_id == "x" and math.isclose(alone["rank"], 0.15)


@pytest.mark.parametrize("budget", [1, 40, 90, 10_000])
def test_pack(spark, budget):
    nodes, edges, n, e = graph(spark, 30, 80, seed=4)
    att = G.attach_edges(e, n)
    rank = brute_rank("s2", [x for x in edges if int(x[0][1:]) < 30])
    est = {x[0]: (len(x[7] or "") + len(x[5]) + 24) // 4 for x in nodes}
    left, want = budget - est["s2"], ["s2"]
    order = {x[0]: x[8] for x in nodes}
    for i in sorted((x[0] for x in nodes if x[2] != "File" and x[0] != "s2" and rank.get(x[0], 0) > 0), key=lambda i: (-round(rank[i], 12), order[i])):
        if est[i] <= left:
            want.append(i)
            left -= est[i]
    got = G.context_pack(spark.createDataFrame([("s2",)], "symbol_id string"), att, n, budget).orderBy("position").collect()
    assert [r.symbol_id for r in got] == want
    assert G.context_pack(spark.createDataFrame([("none",)], "symbol_id string"), att, n).count() == 0


def test_lookup_order_and_find(spark):
    rows = [("i1", "a", "File", "p", "long/retry", "x.py", 1, None, 0), ("i2", "b", "Function", "p", "long/retry/b().", "x.py", 1, None, 1), ("i3", "retry", "Class", "q", "z#", "x.py", 1, None, 2), ("i3", "dup", "Class", "q", "zz#", "x.py", 1, None, 9)]
    n = G.node_set(spark.createDataFrame(rows, NODES))
    assert n.count() == 3
    assert G.lookup(n, "i1").first().symbol_id == "i1"
    assert G.lookup(n, "retry").first().symbol_id == "i2"  # a File comes after others; descriptors before names
    assert [r.symbol_id for r in G.find(n, "retry").collect()] == ["i3", "i2", "i1"]
    assert [r.symbol_id for r in G.find(n, "retry", repo="Q").collect()] == ["i3"]
    assert G.lookup(n, "nothing").count() == 0


def test_zoom_relations(spark):
    _, _, n, _ = graph(spark)
    e = spark.createDataFrame([("s0", "s1", "Contains", 1.0, False, 1), ("s3", "s1", "Contains", 1.0, False, 2), ("s1", "s2", "Contains", 1.0, False, 3), ("s4", "s1", "Calls", 1.0, False, 4), ("s4", "s1", "Calls", 1.0, False, 5), ("s1", "s5", "Calls", 1.0, False, 6), ("s6", "s1", "Imports", 1.0, False, 7)], EDGES)
    got = sorted((r.relation, r.symbol_id) for r in G.zoom(spark.createDataFrame([("s1",)], "symbol_id string"), e, n).collect())
    assert got == [("callee", "s5"), ("caller", "s4"), ("caller", "s4"), ("container", "s3"), ("importer", "s6"), ("member", "s2")]


def _symbols(spark, rows):
    return spark.createDataFrame([(i, n, k, p, d, "f.py", 1, None, o) for o, (i, n, k, p, d) in enumerate(rows)], NODES)


RAW = "src_id string, src_package string, dst_id string, dst_package string, dst_descriptor string, kind string, confidence double"


def test_import_binds_across_repos(spark):
    s = _symbols(spark, [("L", "Settings", "Class", "lib", "acme/const/Settings#"), ("L2", "Settings", "Class", "lib2", "acme/const/Settings#")])
    bound, stats = D.resolve(s, spark.createDataFrame([("a", "app", None, "?", "acme/const/Settings", "Imports", 0.5)], RAW))
    r = bound.first()
    assert (r.dst_id, r.cross_repo, r.n) == ("L", True, 1) and math.isclose(r.confidence, 0.95)
    assert tuple(stats.first()) == (1, 0, 1, 0)


def test_unknown_import_is_counted_not_bound(spark):
    s = _symbols(spark, [("L", "x", "Class", "lib", "x#")])
    bound, stats = D.resolve(s, spark.createDataFrame([("a", "app", None, "?", "third/party", "Imports", 0.5)] * 2, RAW))
    assert bound.count() == 0 and tuple(stats.first()) == (0, 0, 0, 2)


def test_calls_bind_only_if_unique(spark):
    s = _symbols(spark, [("1", "f", "Function", "p", "m/f()."), ("2", "g", "Function", "p", "m/g()."), ("3", "g", "Function", "p", "n/g()."), ("4", "f", "Function", "q", "m/f().")])
    bound, stats = D.resolve(s, spark.createDataFrame([("2", "p", None, "p", "?/f()", "Calls", 0.4), ("1", "p", None, "p", "?/g()", "Calls", 0.4), ("0", "p", "1", "p", "m/f().", "Contains", 1.0)], RAW))
    assert sorted((r.src_id, r.dst_id, r.kind) for r in bound.collect()) == [("0", "1", "Contains"), ("2", "1", "Calls")]
    assert tuple(stats.first()) == (0, 1, 0, 0)
    empty, none = D.resolve(s.limit(0), spark.createDataFrame([], RAW))
    assert empty.count() == 0 and tuple(none.first()) == (0, 0, 0, 0)


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "1"), ("r", "gone", "1"), ("q", "mod", "1"), ("r", None, "1")], "repo string, path string, hash string")
    b = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "2"), ("r", "new", "1"), ("q", "mod", "1")], "repo string, path string, hash string")
    assert sorted(tuple(x) for x in I.snapshot_diff(a, b).collect()) == [("r", "gone", "deleted"), ("r", "mod", "modified"), ("r", "new", "added")]
    assert I.snapshot_diff(a.limit(0), b.limit(0)).count() == 0


def test_vector_index_recall(spark):
    rng = random.Random(9)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    df = spark.createDataFrame([(i, vec()) for i in range(2000)] + [(-1, None)], "id long, v array<float>")
    index, centre = V.ivf_index(df, "id", "v", cells=16)
    assert index.count() == 2000
    hits = total = 0
    for _ in range(5):
        q = vec()
        exact = {r.id for r in V.vector_topk(df, "id", "v", q, 10).collect()}
        near = {r.id for r in V.ivf_topk(index, centre, "id", "v", q, 10, probes=8).collect()}
        hits, total = hits + len(exact & near), total + len(exact)
    assert hits / total >= 0.9


def test_search_prefers_the_named_definition(spark):
    _, _, n, _ = graph(spark)
    search = spark.createDataFrame([("s1", "name1 does parsing"), ("s8", "name1 again"), ("s2", "other")], "symbol_id string, text string")
    cand = V.rrf([V.bm25(search, "symbol_id", "text", "name1")], "symbol_id")
    none = spark.createDataFrame([], "symbol_id string, summary string, queries array<string>, ordinal long")
    top = V.rerank(cand, n, spark.createDataFrame([("s8", 40)], "symbol_id string, deps long"), none, "name1", 5).collect()
    assert {r.symbol_id for r in top} == {"s1", "s8"} and top[0].deps == 40
    assert V.bm25(search, "symbol_id", "text", "?!").count() == 0
    assert V.bm25(search.limit(0), "symbol_id", "text", "name1").count() == 0


def test_suggest_counts_before_the_limit(spark):
    _, _, n, _ = graph(spark)
    e = spark.createDataFrame([("s1", "x", ["how a", "how b", None], 1), ("s2", None, None, 2), ("s3", "y", ["how c"], 3), ("gone", "z", ["how d"], 4)], "symbol_id string, summary string, queries array<string>, ordinal long")
    got = R.suggest(e, n, "HOW", 2).collect()
    assert len(got) == 2 and {r.total for r in got} == {3}
