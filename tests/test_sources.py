"""Extraction, source trees, store, session, tools and streaming, on repositories written here."""

from __future__ import annotations

import io
import json
import shutil
import subprocess
from datetime import datetime

import pytest
from symbolake import cli, config, rpc
from symbolake.providers import Offline
from symbolake.session import Session
from symbolake.sources import extract as extraction
from symbolake.sources import manifests, repo_walk
from symbolake.sources.extract import extract
from symbolake.sources.repo_walk import parse, read_trees, walk
from symbolake.sources.store import GraphStore
from symbolake.sources.pointer import Stale
from symbolake.streaming import maintain as M

LIB = {
    "lib/__init__.py": "from lib.settings import Settings\n",
    "lib/settings.py": '"""s"""\nclass Settings:\n    def load(self):\n        return read_all(self)\n\n\ndef read_all(x):\n    return x\n',
    ".gitignore": "ignored/\n*.skip.py\n",
    "ignored/x.py": "def no(): pass\n",
    "a.skip.py": "def no(): pass\n",
    ".hidden/h.py": "def hidden():\n    pass\n",
    "_private.py": "def _p():\n    pass\n",
}
APP = {
    "app/main.py": "import os.path as p\nfrom lib.settings import Settings as S, read_all\nfrom . import x\nfrom lib import *\n\n\n@deco(1)\nasync def run(a=make()):\n    def inner():\n        obj.method()\n    return read_all(S().load())\n",
    "web/ui.ts": "import { a } from 'lib/ui';\nimport './local';\nexport * from \"@scope/pkg\";\n// function fake() {}\nconst t = `function no() { ${call()} }`;\nexport class View extends Base {\n  private async draw(x: number): Promise<void> {\n    if (x) { this.paint(helper(x)); }\n  }\n  go = () => { other(); };\n}\ninterface Shape { area(): number; }\nfunction helper(n: string): { a: number } { return new Thing(n); }\nabstract class Abs { m() { x(); } }\n",
    "odd/broken.py": "def ok():\n    go()\n\nclass C(:\n    def m(self):\n        stop(\n",
    "odd/empty.py": "",
    "odd/ümlaut.js": "const s = 'é'; function größe() { return rufe(); }\n",
}


def write(root, files):
    for p, text in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)


@pytest.fixture
def repos(tmp_path):
    write(tmp_path / "lib", LIB)
    write(tmp_path / "app", APP)
    return [str(tmp_path / "lib"), str(tmp_path / "app")]


def test_walk_keeps_hidden_and_drops_ignored(repos):
    assert walk(repos[0]) == [".hidden/h.py", "_private.py", "lib/__init__.py", "lib/settings.py"]


def _facts(path, text):
    o = extract("r", path, text)
    short = lambda i: i and i.split(" ", 4)[4]
    return [(s[5], s[7]) for s in o.symbols], [(short(e[0]), short(e[2]) or e[4], e[5]) for e in o.edges], o


def test_python_extraction():
    symbols, edges, o = _facts("app/main.py", APP["app/main.py"])
    assert symbols == [("app/main", "File"), ("app/main/run().", "Function"), ("app/main/run/inner().", "Function")]
    assert [e for e in edges if e[2] == "Imports"] == [("app/main", "os/path", "Imports"), ("app/main", "lib/settings/Settings", "Imports"), ("app/main", "lib/settings/read_all", "Imports")]
    calls = [(a, b) for a, b, k in edges if k == "Calls"]
    assert ("app/main", "?/deco()") in calls and ("app/main/run().", "?/make()") in calls and ("app/main/run/inner().", "?/method()") in calls
    assert {b for a, b in calls if a == "app/main/run()."} == {"?/make()", "?/read_all()", "?/load()", "?/S()"}
    run = o.symbols[1]
    assert run[15] == "async def run(a=make()):" and run[11:15] == (8, 0, 11, 31)


def test_script_extraction():
    symbols, edges, _ = _facts("web/ui.ts", APP["web/ui.ts"])
    assert symbols == [("web/ui", "File"), ("web/ui/View#", "Class"), ("web/ui/View/draw().", "Method"), ("web/ui/Shape#", "Interface"), ("web/ui/helper().", "Function"), ("web/ui/m().", "Method")]
    assert [b for _, b, k in edges if k == "Imports"] == ["lib/ui", "@scope/pkg"]
    calls = [(a, b) for a, b, k in edges if k == "Calls"]
    assert calls == [("web/ui/View/draw().", "?/paint()"), ("web/ui/View/draw().", "?/helper()"), ("web/ui", "?/other()"), ("web/ui/m().", "?/x()")]


def test_broken_empty_and_non_ascii_files():
    symbols, edges, o = _facts("odd/broken.py", APP["odd/broken.py"])
    assert o.broken and ("odd/broken/ok().", "Function") in symbols and ("odd/broken/C/m().", "Function") in symbols
    assert ("odd/broken/ok().", "?/go()", "Calls") in edges
    assert _facts("odd/empty.py", "")[0] == [("odd/empty", "File")]
    symbols, edges, o = _facts("odd/ümlaut.js", APP["odd/ümlaut.js"])
    assert o.symbols[1][12] == len("const s = 'é'; ".encode()) and o.symbols[1][6].startswith("gr")
    assert extract("r", "x.go", "package x") is None


def test_parse_tree(spark, repos):
    symbols, edges = parse(read_trees(spark, repos))
    names = {r.name for r in symbols.where("kind != 'File'").collect()}
    assert {"Settings", "load", "read_all", "hidden", "_p", "run", "draw"} <= names and "no" not in names
    assert edges.groupBy("src_id", "dst_package", "dst_descriptor", "kind").count().where("count > 1").count() == 0


def test_store_is_atomic_and_keeps_versions(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    assert not store.exists() and store.read("symbols").count() == 0
    meta = spark.createDataFrame([("r", "1")], "repo string, commit string")
    assert store.commit(repo_meta=meta) == 1
    assert store.commit(repo_meta=store.with_commits({"q": "2", "r": "3"}), flows=store.read("flows")) == 2
    assert store.repo_commits() == {"q": "2", "r": "3"}
    assert [tuple(r) for r in store.read("repo_meta", 1).collect()] == [("r", "1")]
    with pytest.raises(ValueError, match="no version"):
        store.read("repo_meta", 9)
    store.pointer.number = lambda: 1  # a writer that began before the second commit
    with pytest.raises(Stale):
        store.commit(repo_meta=meta)
    del store.pointer.number
    for k in range(120):
        store.pointer.put(store.version(), store.pointer.read(2))
    assert store.version() == 122 and store.read("repo_meta", 3).count() == 2  # no version is forgotten


@pytest.fixture
def session(spark, repos, tmp_path):
    s = Session(spark, f"file://{tmp_path}/index", provider=Offline)
    s.link(repos, enrich=True, flows=True, guide=True)
    return s


def test_session_tools(session):
    settings = session.find("Settings")["results"][0]
    assert settings["kind"] == "Class" and settings["summary"] and settings["queries"]
    z = session.zoom(settings["symbol_id"])
    assert z["found"] and [m["name"] for m in z["members"]] == ["load"] and "app/main.py" in {n["name"] for n in z["importers"]}
    r = session.ripple("lib/settings/read_all().")
    assert r["found"] and {h["name"] for h in r["dependents"]} >= {"load", "app/main.py"} and {x["repo"] for x in r["by_repo"]} == {"lib", "app"}
    assert session.thread("lib/settings/Settings/load().")["trace"][0]["name"] == "read_all"
    pack = session.context_pack(settings["symbol_id"], 1)
    assert [i["symbol_id"] for i in pack["items"]] == [settings["symbol_id"]]
    assert len(session.context_pack(settings["symbol_id"])["items"]) >= 2
    assert session.search("read_all")["results"][0]["name"] == "read_all"
    assert session.suggest(limit=3)["total"] > 3 and len(session.suggest(limit=3)["suggestions"]) == 3
    assert {r["repo"] for r in session.repos()["repos"]} == {"lib", "app"}
    assert session.guide()["found"] and session.guide("LIB")["found"] and not session.guide("none")["found"]
    assert any(r["kind"] == "*" and r["enriched"] for r in session.stats()["stats"])
    for tool in (session.zoom, session.ripple, session.flow, session.context_pack):
        assert tool("no such thing")["found"] is False
    assert session.thread("no such thing")["trace"] == []


def test_rpc_and_cli(session, spark, repos, tmp_path, capsys):
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "repos"}}, {"id": 4, "method": "tools/call", "params": {"name": "zoom"}}, {"id": 5, "method": "nothing"}]
    out = io.StringIO()
    rpc.serve(session, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 10
    assert "lib" in got[2]["result"]["content"][0]["text"] and "focus" in got[3]["error"]["message"]
    at = ["--index-dir", f"file://{tmp_path}/index"]
    assert cli.main(["find", "Settings", *at], spark) == 0 and "Settings" in capsys.readouterr().out
    assert cli.main(["explore", "read_all", *at], spark) == 0 and "ripple" in capsys.readouterr().out
    assert cli.main(["repos", "--index-dir", f"file://{tmp_path}/none"], spark) == 1


def _state(s):
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    return key(s.store.read("symbols"), "symbol_id", "line_start", "signature"), sorted(set(key(s.store.read("edges"), "src_id", "dst_id", "kind", "cross_repo"))), key(s.store.read("search"), "symbol_id", "text")


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_incremental_equals_rebuild(spark, repos, tmp_path):
    lib = repos[0]
    git = lambda *a: subprocess.run(["git", "-C", lib, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "1")
    s = Session(spark, f"file://{tmp_path}/inc")
    s.link(repos)
    (tmp_path / "lib/lib/extra.py").write_text("def added():\n    return read_all(1)\n")
    (tmp_path / "lib/lib/settings.py").write_text("class Settings:\n    pass\n")
    (tmp_path / "lib/_private.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "2")
    assert s.index_incremental(lib)["changed"] == 3
    assert s.index_incremental(lib)["changed"] == 0
    full = Session(spark, f"file://{tmp_path}/full")
    full.link(repos)
    assert _state(s) == _state(full)
    before = len(_state(s)[0])
    s.index(repos[1])  # one repo again leaves the other as it is
    assert len(_state(s)[0]) == before
    assert s.changed(lib)["added"] == []


def test_config(tmp_path, monkeypatch):
    at = config.init(str(tmp_path / "c.toml"))
    with pytest.raises(FileExistsError):
        config.init(at)
    (tmp_path / "c.toml").write_text('format = "json"\nembed = false\n')
    c = config.Config.load(at)
    assert (c.get("format"), c.get("embed"), c.get("guide"), c.get("format", "md")) == ("json", False, True, "md")
    monkeypatch.setenv("SYMBOLAKE_FORMAT", "md")
    assert c.get("format") == "md"
    (tmp_path / "c.toml").write_text("= broken")
    with pytest.warns(UserWarning):
        assert config.Config.load(at).values == {}
    assert (config.step(True, True, True), config.step(True, False, False), config.step(False, False, True)) == (False, True, True)
    assert config.gate_model_steps({"embed": True, "enrich": True}, None) == {"embed": True, "enrich": False}


def test_ignore_rules(tmp_path):
    paths = ["a.py", "b/a.py", "b/c/a.py", "build/x.py", "b/build/y.py", "docs/k/z.py", "docs/z.py", "keep/no.py", "keep/yes.py", "x1.py", "x12.py", "sp ace.py", "sub/only.py", "only.py", "deep/p/q/r.ts", "deep/r.ts"]
    write(tmp_path, {**dict.fromkeys(paths, "x = 1\n"), ".gitignore": "# no\n\n/build/\ndocs/*.py\n*/no.py\n!yes.py\nx?.py\nb/**/a.py\ndeep/**/r.ts\nsub/\n", "sub/.gitignore": "!only.py\n", "keep/.ignore": "*\n!yes.py\n"})
    assert repo_walk.walk(str(tmp_path)) == ["a.py", "b/build/y.py", "docs/k/z.py", "keep/yes.py", "only.py", "sp ace.py", "x12.py"]


def test_only_listed_files_are_read(spark, tmp_path):
    write(tmp_path, {"r/a.py": "def a(): pass\n", "r/b.py": "def b(): pass\n", "r/c.txt": "x"})
    (tmp_path / "r/b.py").chmod(0)  # reading it would lose it
    s, _ = repo_walk.parse_files(spark, [f"{tmp_path}/r"], [("r", "a.py"), ("r", "gone.py"), ("r", "c.txt")])
    assert {x.name for x in s.collect()} == {"a.py", "a"}


def test_script_scan_takes_linear_time_and_knows_templates():
    import time

    def took(n):
        js = "class A {\n" + "".join(f"  m{i}(x) {{ return f(x, {{ a: `${{g(`}}`)}}` }}) }}\n" for i in range(n)) + "}\n"
        began = time.perf_counter()
        out = extraction.extract("r", "a.ts", js)
        assert len(out.symbols) == n + 2
        return time.perf_counter() - began

    took(500)
    assert took(4000) < 8 * 4 * max(took(500), 0.005)
    out = extraction.extract("r", "a.js", "export function a(s) { return /`{/.test(s); }\nconst o = { b(x) { new x.y.Z(1); call(2); } };\nfunction c() {}")
    assert [s[6] for s in out.symbols] == ["a.js", "a", "b", "c"] and not any("Z" in str(e) for e in out.edges)


def test_chat_provider(spark):
    import http.server
    import threading

    from symbolake import providers

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body["model"], body["max_tokens"]))
            text = body["messages"][1]["content"]
            code = 503 if len(asked) == 1 else 400 if text == "bad" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": text.upper()}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    make = providers.provider_of("m", f"http://127.0.0.1:{server.server_port}/v1/", "k")
    client = make()
    assert client.complete("s", "hello", 7) == "HELLO" and client.used == {"prompt": 5, "reply": 2, "calls": 1}
    assert asked == [("/v1/chat/completions", "Bearer k", "m", 7)] * 2  # the first attempt failed
    rows = spark.createDataFrame([("a", "x"), ("b", "bad")], "k string, p string")
    assert {r.k: r.reply for r in providers.complete_all(rows, "k", "p", "summary", make).collect()} == {"a": "X", "b": None}
    server.shutdown()
    assert providers.provider_of("offline", None) is providers.Offline and providers.provider_of("none", None) is None
    with pytest.raises(ValueError, match="llm_base_url"):
        providers.provider_of("m", None)


def test_manifests(tmp_path):
    write(tmp_path, {"pyproject.toml": '[project]\ndependencies = ["numpy>=2", "x"]\n', "package.json": '{"dependencies": {"react": "^18", "odd": 1}}', ".editorconfig": "indent_size = 4\n"})
    assert manifests.dependencies(str(tmp_path)) == ["numpy>=2", "x", "react ^18", "odd"]
    assert manifests.declared(str(tmp_path)).startswith("Declared dependencies:\n- numpy>=2") and manifests.formatting(str(tmp_path)) == "editorconfig: indent_size = 4"
    write(tmp_path, {"pyproject.toml": "= no", "package.json": "[]"})
    assert manifests.dependencies(str(tmp_path)) == [] and manifests.dependencies(str(tmp_path / "none")) == [] and manifests.declared(str(tmp_path)) == manifests.formatting(str(tmp_path / "none")) == ""


def test_streaming(spark, tmp_path, monkeypatch):
    schema = "repo string, commit string, seq int, arrived_at timestamp_ntz, added array<string>, modified array<string>, deleted array<string>"
    row = lambda c, n, day: ("r", c, n, datetime(2024, 1, day), [f"{c}.py", None], ["a\\b.py"], None)
    src, out, state, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "state", "ck"))
    spark.createDataFrame([row("c1", 1, 1), row("c1", 1, 2)], schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    run = lambda: M.maintain(stream(), f"file://{state}", out, ck).awaitTermination()
    seen = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{out}/batch=*").collect())
    run()
    assert seen() == [("r", "c1", "a/b.py", "modified"), ("r", "c1", "c1.py", "added")]
    spark.createDataFrame([row("c1", 1, 3), row("c2", 2, 4)], schema).write.mode("append").parquet(src)
    with monkeypatch.context() as m:  # a run that dies between writing and committing
        m.setattr(M.StateStore, "commit", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    run()
    assert len(seen()) == 4 and len(set(seen())) == 4
    shutil.rmtree(f"{ck}/commits")  # a run that dies between committing and the stream's own mark
    run()
    assert len(seen()) == 4
    q = M.changes_per_window(stream()).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("w").collect()) >= 4
