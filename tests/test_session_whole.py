"""The tools return all rows, however many a node has."""

from symbolake.session import Session


def test_hub_is_whole(spark, tmp_path):
    n = 2100
    names = ["box", "hub", *(f"f{i}" for i in range(n))]
    nodes = spark.createDataFrame([(x, x, "Function", f"r{k}", "a.py", 1, None, f"{x}().", k) for k, x in enumerate(names)], "symbol_id string, name string, kind string, package string, file_path string, line_start int, signature string, descriptor string, ordinal long")
    rows = [(f"f{i}", "hub", kind, i) for i in range(n) for kind in ("Calls", "Imports")] + [("hub", f"f{i}", "Calls", n + i) for i in range(n)] + [("box", "hub", "Contains", 0)]
    edges = spark.createDataFrame(rows, "src_id string, dst_id string, kind string, ordinal long")
    s = Session(spark, f"file://{tmp_path}/none")
    s.graph = lambda: (nodes, edges)
    z = s.zoom("hub")
    assert z["container"]["symbol_id"] == "box" and [len(z[k]) for k in ("callers", "callees", "importers")] == [n, n, n]
    assert len(s.ripple("hub")["dependents"]) == n and len(s.thread("hub")["trace"]) == n and len(s.repos()["repos"]) == n + 2
