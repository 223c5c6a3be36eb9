"""Documentation: what says something, and finding it in source text."""

from __future__ import annotations

import pytest
from symbolake.llm import docs_pairs as P
from symbolake.llm.lexer import definitions

NOTHING = [
    None, "", "  ", '""', "''''''", '"""   """', "/** */", "/**\n *\n */", "...", "-", "_", "???", "TODO", "TODO: document", "todo(me)", "FIXME write docs", "XXX", "TBD.", "N/A", "n/a", "[summary]", "Add description",
    "Description goes here.", "Insert documentation here", "Missing documentation.", "Auto-generated stub.", "pylint: disable=all", "noqa", "type: ignore", "eslint-disable", "eslint-disable-next-line complexity",
    "istanbul ignore next", "pragma: no cover", "See above.", "Same as above.", "See base class.", "{@inheritDoc}", "Inherited.", "Private", "Internal.", "Deprecated.", "Helper", "Helper function.", "Getter.", "Wrapper",
    ":param value:\n:return:", "@param value\n@returns", ":param value: the record\n:returns: the page", "Args:\n    x: the record\n\nReturns:\n    a page", "@see other",
    "Loads user record.", "Load the user records", "load_user_record method", "Function load_user_record().", "The load_user_record function.", "Docstring for load_user_record.", "Loading of user records", "loadUserRecord",
    '"""Loads the user record."""', "r'''load user record'''",
]
SOMETHING = [
    "Never raises, falls back to local tables.", "Ties go to the ordered token seen first.", "Skips shared users and logs them.", "Loads the user record from the cache.", '"""It keeps the map.\n\n:param x: y\n"""',
    "/**\n * Safe to call twice.\n * @param x\n */", "See the list of users for what is kept here and why it is sorted.", "TODO: document\n\nThe record is read once and then kept.", "Internal. Sorts ties by age.", "加载用户并缓存。",
]


@pytest.mark.parametrize("doc", NOTHING)
def test_says_nothing(doc):
    assert P.description(doc, "load_user_record") is None


@pytest.mark.parametrize("doc", SOMETHING)
def test_says_something(doc):
    assert P.description(doc, "load_user_record")


PY = '''"""Module text."""
import x

@deco("def fake(): pass")
def one(a: dict = {"k": "def no():"}, b="):") -> "dict[str, int]":
    # a remark
    r"""Says one."""
    s = "def inner_fake(): 'x'"
    def two():
        'Says two.'
    return s

class C(Base):
    """Class text."""
    async def three(
        self,
        x,
    ):

        """Says
        three."""
    def four(self): return "not documentation"
    def five(self):
        f"no {x}"
    def six(self):
        "a" + "b"

def seven():
    """Says seven."""; pass
'''
TS = """/** File text. */
import { a } from 'b';

/** Says one. */
export async function one(x = { y: '}' }): Promise<void> {
  // function fake() {}
  const s = `function ${x}() { fake }`; const r = /[{}/"]+/g;
  /** Says two. */
  function two() { return "/** no */"; }
}

/** Says C. */
@Dec({ a: 1 })
export class C {
  /**
   * Says three.
   */
  // eslint-disable-next-line complexity
  public static three<T>(a: Map<string, T>): { b: number } { if (a) { call(a); } return x; }
  /** Lost. */
  field = 1;
  four() {}
  /* no documentation */
  get five(): number { return 1; }
}
/** Says I. */
interface I { m(): void; }
/** Far. */
const z = 1;
function six() {}
"""


def said(text, path):
    return {q: P.strip_marks(d).split("\n")[0].strip() if d else None for q, _, _, d, _ in definitions(text, path)}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_python_definitions(end):
    got = said("﻿" + PY.replace("\n", end), "a/b.py")
    assert got == {"one": "Says one.", "one/two": "Says two.", "C": "Class text.", "C/three": "Says", "C/four": None, "C/five": None, "C/six": None, "seven": "Says seven."}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_script_definitions(end):
    got = said(TS.replace("\n", end), "a/b.ts")
    assert got == {"one": "Says one.", "one/two": "Says two.", "C": "Says C.", "C/three": "Says three.", "C/four": None, "C/five": None, "I": "Says I.", "six": None}


def code(text, path):
    return {q: c for q, _, _, _, c in definitions(text, path)}


def test_extent_of_definitions():
    got = code(PY, "a/b.py")
    assert got["one"].startswith('@deco("def fake(): pass")\ndef one(') and got["one"].endswith("return s") and got["one/two"] == "    def two():\n        'Says two.'"
    assert got["C/four"] == '    def four(self): return "not documentation"' and got["C"].endswith('"a" + "b"') and got["seven"].endswith("; pass")
    assert code("def a():\n    x = (1,\n2)\n    # end\n\n\n# far\ny = 1\n", "x.py") == {"a": "def a():\n    x = (1,\n2)\n    # end\n\n\n# far"}
    assert code("@a\n@b(\n  1)\nasync def f(): \\\n  pass\n@c\ndef g(): pass", "x.py") == {"f": "@a\n@b(\n  1)\nasync def f(): \\\n  pass", "g": "@c\ndef g(): pass"}
    got = code(TS, "a/b.ts")
    assert got["one"].startswith("export async function one(") and got["one"].endswith('return "/** no */"; }\n}') and got["one/two"] == 'function two() { return "/** no */"; }'
    assert got["C"].startswith("@Dec({ a: 1 })\nexport class C {") and got["C/five"] == "get five(): number { return 1; }" and got["six"] == "function six() {}" and got["C/four"] == "four() {}"
    assert got["C/three"].startswith("// eslint-disable-next-line complexity\n  public static three<T>")


def test_patterns_and_nested_templates():
    js = "/** Says a. */\nfunction a(s) { return /`/.test(s); }\n/** Says b. */\nfunction b(x) { return `${x.map((y) => `<${y ? '}' : \"`\"}>`).join(`{`)} it's {`; }\n/** Says c. */\nfunction c() { const q = a / b / c; case /[/`]/: }\nclass D { m() { throw /{/; }\n /** Says n. */ static async *n() {} }"
    assert said(js, "x.js") == {"a": "Says a.", "b": "Says b.", "c": "Says c.", "D": None, "D/m": None, "D/n": "Says n."}
    got = code(js, "x.js")
    assert got["a"] == "function a(s) { return /`/.test(s); }" and got["b"].endswith("it's {`; }") and got["D/n"] == "static async *n() {}"
    assert said("function a() { `${ `", "x.js") == {"a": None}


def test_long_lines_take_linear_time():
    import time

    def took(n):
        js = "class A { " + "".join(f"m{i}(x) {{ return f(x, {{ a: 1 }}) }} " for i in range(n)) + "}"
        began = time.perf_counter()
        assert len(definitions(js, "x.js")) == n + 1
        return time.perf_counter() - began

    took(500)
    assert took(8000) < 16 * 4 * max(took(500), 0.002)


def test_broken_and_odd_source():
    assert said("def a(:\n  'x y'\ndef b():\n  'says'\n", "x.py")["b"] == "says"
    assert said("class A { f( { }", "x.js") == {"A": None, "A/f": None}
    assert said("", "x.py") == {} and said("def f(): pass", "x.go") == {}


def test_documented_functions(spark):
    sym = "symbol_id string, name string, kind string, signature string, docstring string, repo string, file_path string, descriptor string, text string, description string"
    row = lambda i, n, d, path="a/b.py", tail=None, kind="Function", repo="r": (i, n, kind, None, d, repo, path, f"a/b/{tail or n}().", "x", "y")
    s = spark.createDataFrame([row("1", "one", None), row("1", "one", None), row("2", "two", None, tail="one/two"), row("3", "three", "", tail="C/three"), row("4", "four", "TODO"), row("5", "seven", None), row("6", "six", "Keeps ties.", kind="Method"), row("7", "C", "A class.", kind="Class"), row("8", "one", None, repo=None), row(None, "one", "Text."), row("9", "one", None, path="no/such.py"), row("1", "one", "Other life speaks.")], sym)
    d = spark.createDataFrame([("r", "a/b.py", PY, 1), ("r", "a/b.py", PY, 2), (None, "a/b.py", PY, 3), ("r", None, PY, 4), ("r", "x.py", None, 5)], "repo string, file_path string, text string, doc_id long")
    got = {r.symbol_id: r.description for r in P.documented_functions(s, d).collect()}
    assert got == {"1": "Other life speaks.", "2": "Says two.", "5": "Says seven.", "6": "Keeps ties."}
    pairs = {r.symbol_id: (r.description, r.code) for r in P.documented_functions(s, d, code=True).collect()}
    assert {i: x for i, (x, _) in pairs.items()} == got and pairs["6"][1] is None or "six" in pairs["6"][1]
    assert pairs["1"][1].endswith("return s") and pairs["2"][1].strip().startswith("def two")
    assert P.documented_functions(s.limit(0), d).count() == 0 and P.documented_functions(s, d.limit(0)).count() == 2
