"""Machine-made files on a small corpus, with hand-written ones that only look the part."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from symbolake.llm import source_kinds as K

VERBS = "load sort bind fold scan trim route queue merge prune walk rank".split()
NOUNS = "record parser ledger token window bucket header cursor folder digest".split()
SYM = "repo string, file_path string, language string, kind string, name string, descriptor string, signature string, line_start int, line_end int, ordinal long, bits double, copied double"


def corpus():
    rng, rows, docs, want = random.Random(6), [], [], {}
    order = iter(range(10**6))

    def add(repo, path, names, text, lines=40, reason=None, owners=None):
        rows.append((repo, path, "Python", "File", path, path[:-3], None, 1, lines, next(order), None, None))
        for k, n in enumerate(names):
            own = owners[k] if owners else ""
            rows.append((repo, path, "Python", "Function", n, f"{path[:-3]}/{own + '/' if own else ''}{n}().", f"def {n}(x):", 2 + 3 * k, 4 + 3 * k, next(order), None, None))
        if text is not None:
            docs.append((repo, path, text, len(docs)))
        if reason:
            want[repo, path] = reason

    hand = lambda n=9: [f"{rng.choice(VERBS)}_{rng.choice(NOUNS)}_{rng.choice(NOUNS)}" for _ in range(n)]
    body = lambda names: "\n".join(f"def {n}(x):\n    return {rng.choice(NOUNS)}(x)\n" for n in names)
    for i in range(30):
        names = hand()
        add(f"r{i % 4}", f"src/file{i}.py", names, body(names))
    names = hand()
    add("r0", "src/vendors/deal.py", names, "# Helpers for vendor contracts. Reads generated files; do not edit the order.\n" + body(names))
    names = hand(3)
    add("r0", "src/defaults.py", names, "D = {\n" + "\n".join(f'    "a{i}": {i},' for i in range(9)) + "\n}\n" + body(names))
    add("r1", "dist/app.py", [chr(97 + i) for i in range(20)], None, reason="minified")
    gen = [f"{v}_{rng.choice(NOUNS)}" for _ in range(4) for v in ("get", "set", "has")]
    add("r1", "gen/x_pb2.py", gen, None, reason="generated", owners=[f"C{k // 3}" for k in range(12)])
    copy = hand()
    for r in ("r2", "r3"):
        add(r, f"lib/{r}_util.py", copy, body(copy), reason="vendored")
    names = hand()
    add("r2", "lib/one.py", names, "# Vendored from loom 1.2.0, local changes: none\n" + body(names), reason="vendored")
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(64))
    add("r3", "assets/blob.py", [], "B = (\n" + "\n".join(f'    "{hexes()}"' for _ in range(40)) + "\n)\n", reason="data")
    add("r3", "assets/nums.py", [], "N = [\n" + "\n".join("    " + ", ".join(str(rng.randrange(99999)) for _ in range(9)) + "," for _ in range(40)) + "\n]\n", reason="data")
    add("r3", "assets/unread.py", [], None, lines=90, reason="data")
    add("r3", "src/__init__.py", [], "from src.file1 import a\n", lines=1)
    add("r3", "src/blank.py", [], "  \n", lines=1)
    return rows, docs, want


@pytest.mark.parametrize("repeat", [1, 2])
def test_machine_files(spark, repeat):
    rows, docs, want = corpus()
    s = spark.createDataFrame((rows + [(None, *rows[0][1:]), ("r9", None, *rows[0][2:])]) * repeat, SYM)
    d = spark.createDataFrame(docs + [(None, "src/file1.py", "x", 98), ("r1", None, "x", 99), ("r1", "src/file1.py", None, 97)] + docs[: repeat - 1], "repo string, file_path string, text string, doc_id long")
    got = {(r.repo, r.file_path): r.reason for r in K.machine_files(s, d).collect()}
    assert got == want


def test_empty(spark):
    s, d = spark.createDataFrame([], SYM), spark.createDataFrame([], "repo string, file_path string, text string")
    assert K.machine_files(s, d).count() == 0


def test_cross_entropy_against_a_loop(spark):
    names = pd.Series(["load_record", "sort", "a", "Ab9$é"])
    codes, owner = K._trigrams(names)
    code = lambda c: int(K._CLASS[min(ord(c), 255)])
    want = [(i, code(p[0]) * 1024 + code(p[1]) * 32 + code(p[2])) for i, n in enumerate(names) for p in zip("\0\0" + n, "\0" + n + "\0", n + "\0", strict=False) if len(p) == 3]
    assert sorted(zip(owner.tolist(), codes.tolist(), strict=True)) == sorted((i, c) for i, c in want)
    flat = np.full((1, K.CODES), 5.0)
    assert np.allclose(K.cross_entropy(flat, names, np.zeros(4, dtype=int)), 5.0)


def test_each_language_has_its_own_model(spark, monkeypatch):
    rows = [(n, x) for x, ns in {"Python": ["load_rows", "load_keys"], "KOTLIN": ["zzyzx"], "kotlin": ["zzyzy"], "c": ["qqqq"]}.items() for n in ns] + [("nameless", None)]
    df = spark.createDataFrame(rows, "name string, language string")
    slot, model = K.identifier_models(df)
    assert slot == {"kotlin": 0, "python": 1, "c": 2} and model.shape == (5, K.CODES)
    bits = K.cross_entropy(model, pd.Series(["zzyzx", "zzyzx", "zzyzx", "zzyzx"]), np.array([0, 1, 3, 4]))
    assert bits[0] < bits[3] < bits[1] and bits[1] > 3 and bits[2] > 3
    monkeypatch.setattr(K, "MODELS", 1)
    slot, model = K.identifier_models(df)
    assert slot == {"kotlin": 0} and K._slots(pd.Series(["Kotlin", "python", None]), slot).tolist() == [0, 1, 1]


def test_release_names():
    assert K.release_names('__version__ = "2.5.2"\n__project__ = "nibbleset"\ndef f(): pass\n', "r") == ["nibbleset"]
    assert K.release_names("/*\n * tansy-js 2.8.3\n * Copyright\n */\nimport a\n", "r") == ["tansy-js"]
    assert K.release_names('__version__ = "1.0.0"\n', "r") == [] and K.release_names("# about tansyjs\n", "r") == []
    assert K.release_names("# own-repo 1.2.3\n", "own-repo") == [] and K.release_names("def f():\n    # loom 1.2.3\n    g()\n", "r") == []
    licence = "".join(f"# line {i} of a licence\n" for i in range(40))
    assert K.release_names(f"{licence}# loom 1.2.3\n", "r") == ["loom"] and K.release_names("def f(): pass\n\n// from loom v1.2.3\n", "r") == ["from", "loom"]
    assert K.release_names("", "r") == []


def test_a_fork_is_not_vendored(spark):
    rng, order = random.Random(3), iter(range(10**6))
    rows = []
    for i in range(12):
        names = [f"{rng.choice(VERBS)}_{rng.choice(NOUNS)}_{rng.choice(NOUNS)}" for _ in range(8)]
        for repo in ("main", "fork") if i < 10 else ("main",):
            rows.append((repo, f"f{i}.py", "Python", "File", "f", f"f{i}", None, 1, 30, next(order), None, None))
            rows += [(repo, f"f{i}.py", "Python", "Function", n, f"f{i}/{n}().", f"def {n}(x):", 2 + 3 * k, 4 + 3 * k, next(order), None, None) for k, n in enumerate(names)]
    assert K.machine_files(spark.createDataFrame(rows, SYM), spark.createDataFrame([], "repo string, file_path string, text string")).count() == 0


def test_literal_share():
    assert K.literal_share("") == (0.0, 0.0, 0)
    assert K.literal_share("x = a\n" * 100_000)[0] == 0.0
    share, digits, count = K.literal_share("B = [\n" + '  "0a1b2c3d4e5f", 12.5,\n' * 50 + "]\n# a remark\n")
    assert share > 0.99 and digits > 0.85 and count == 100
