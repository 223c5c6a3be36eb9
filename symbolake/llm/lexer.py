"""Definitions with their documentation and their extent out of source text (problem 6), without a grammar.

A state machine over regular-expression tokens: it knows strings, nested template strings, patterns, comments and nested
brackets, so braces and keywords inside them are never taken for code. Matched braces, or in Python the indentation,
delimit a definition. Broken source gives what can be read of it.
"""

from __future__ import annotations

import re

from symbolake.sources.scan import template_end

#: File extensions by language.
EXTENSIONS = {"py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript"}

_PY = re.compile(
    r"""(?P<str>[rRuUbBfF]{0,2}(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|"(?:[^\\"\n]|\\.)*"|'(?:[^\\'\n]|\\.)*'))"""
    r"""|(?P<com>\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<colon>:)"""
    r"""|\\\n|\n(?P<ind>[ \t]*)(?:async[ \t]+)?(?P<kw>def|class)[ \t]+(?P<name>\w+)|\n(?P<line>[ \t]*)(?=[^\s\#])""",
    re.S,
)
_PY_HEAD = re.compile(r"""(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*(?P<doc>[rRuU]?(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|"(?:[^\\"\n]|\\.)*"|'(?:[^\\'\n]|\\.)*'))[ \t]*(?:;|\#|\n|\Z)""", re.S)
_JS = re.compile(
    r"""(?P<doc>/\*.*?\*/)|(?P<com>//[^\n]*)|(?P<str>"(?:[^\\"\n]|\\.)*"|'(?:[^\\'\n]|\\.)*')|(?P<tick>`)"""
    r"""|(?P<rx>(?:(?<=[=(,:!&|?\[{};+*%~^<>])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=\bthrow)|(?<=\bawait)|(?<=\byield)|(?<=\belse)|(?<=\bdelete)|(?<=\bvoid)|(?<=\bof)|(?<=\bin)|(?<=\bdo)|\A)\s*/(?![/*])(?:[^\\/\n\[]|\\.|\[(?:[^\\\]\n]|\\.)*\])+/[a-z]*)"""
    r"""|\b(?P<kw>function|class|interface)\b\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"""
    r"""|(?P<meth>[A-Za-z_$\#][\w$]*)\s*(?:<[^<>()]*>)?\(|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>;)""",
    re.S,
)
#: Between a documentation comment and its definition: line comments, decorators and modifiers.
_JS_GAP = re.compile(r"(?:\s+|//[^\n]*\n|@[\w$.]+(?:\([^()]*\))?|\b(?:export|default|async|static|public|private|protected|readonly|override|abstract|declare|get|set)\b|\*)*\Z")
#: Between the last brace, semicolon or line end and the name of a method: decorators and modifiers.
_JS_LEAD = re.compile(r"\s*(?:@[\w$.]+(?:\([^()\n]*\))?\s*)*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*")
_NO_METHOD = frozenset("if for while switch catch function return await typeof new".split())


def normal(text: str) -> str:
    """Line ends as LF, without a byte order mark."""
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


class _Found:
    """Definitions in the order they begin: scope path, name, kind, raw documentation or None, start, end."""

    def __init__(self, text: str):
        self.text, self.rows = text, []

    def begin(self, scope: str, name: str, kind: str, doc: str | None, start: int) -> int:
        self.rows.append([scope, name, kind, doc, start, len(self.text)])
        return len(self.rows) - 1

    def end(self, row: int, at: int) -> None:
        self.rows[row][5] = self.rows[row][4] + len(self.text[self.rows[row][4] : at].rstrip())


def _python(text: str) -> list:
    text = "\n" + text
    found = _Found(text)
    stack: list[tuple[int, str, int]] = []  # indentation, name, row
    depth, pending, decorated = 0, None, None
    for m in _PY.finditer(text):
        kind = m.lastgroup
        if kind == "name" or kind == "line" and not depth:
            depth = 0  # an unclosed bracket of broken source ends at the next definition
            indent = len(m["ind" if kind == "name" else "line"].expandtabs(8))
            while stack and stack[-1][0] >= indent:
                found.end(stack.pop()[2], m.start() if decorated is None else decorated)
            if kind == "line":
                decorated = (m.start() + 1 if decorated is None else decorated) if text.startswith("@", m.end()) else None
                continue
            scope = "/".join([*(n for _, n, _ in stack), m["name"]])
            stack.append((indent, m["name"], found.begin(scope, m["name"], m["kw"], None, m.start() + 1 if decorated is None else decorated)))
            pending, decorated = stack[-1][2], None
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "colon" and pending is not None and not depth:
            head = _PY_HEAD.match(text, m.end())
            found.rows[pending][3] = head["doc"] if head else None
            pending = None
    while stack:
        found.end(stack.pop()[2], len(text))
    return [(*r[:4], text[r[4] : r[5]]) for r in found.rows]


def _braces(text: str) -> list:
    found = _Found(text)
    stack: list[tuple[str, str, str, int]] = []  # bracket, kind of scope, name, row
    doc, pending, height = None, None, 0
    edge, at = 0, 0  # behind the last brace, semicolon or comment
    while m := _JS.search(text, at):
        at, kind = m.end(), m.lastgroup
        if kind == "tick":
            at = template_end(text, at)
        elif kind == "doc":
            doc = m if m["doc"].startswith("/**") and len(m["doc"]) > 4 else doc
            edge = at
        elif kind == "com":
            edge = at
        elif kind in ("name", "meth"):
            line = max(edge, text.rfind("\n", edge, m.start()) + 1)
            if kind == "meth":
                inside = stack and stack[-1][0] == "{" and stack[-1][1] == "class" and not pending
                if not inside or m["meth"] in _NO_METHOD or not _JS_LEAD.fullmatch(text, line, m.start()):
                    stack.append(("(", "", "", -1))
                    continue
            name, what = (m["name"], m["kw"]) if kind == "name" else (m["meth"], "method")
            own = doc if doc and _JS_GAP.match(text, doc.end(), m.start()) else None
            start = own.end() if own else line
            row = found.begin("/".join([n for _, _, n, _ in stack if n] + [name]), name, what, own["doc"] if own else None, start + len(text[start : m.start()]) - len(text[start : m.start()].lstrip()))
            doc, pending, height = None, (what, name, row), len(stack)
            if kind == "meth":
                stack.append(("(", "", "", -1))
        elif kind == "open":
            if m["open"] == "{" and pending and len(stack) == height:
                stack.append(("{", *pending))
                pending = None
            else:
                stack.append((m["open"], "", "", -1))
            edge = at if m["open"] == "{" else edge
        elif kind == "close":
            if stack and (row := stack.pop()[3]) >= 0:
                found.end(row, at)
            edge = at if m["close"] == "}" else edge
        elif kind == "end":
            if pending and len(stack) == height:
                found.end(pending[2], at)  # a declaration without a body
                pending = None
            edge = at
    return [(*r[:4], text[r[4] : r[5]]) for r in found.rows]


def definitions(text: str, path: str) -> list:
    """(scope path, name, kind, raw documentation or None, source text) of each definition, by the language of `path`'s extension.

    The source text is the definition's own with its decorators and modifiers, line ends as LF; of a definition without end, all that follows.
    """
    language = EXTENSIONS.get(path.rpartition(".")[2].lower())
    if language == "Python":
        return _python(normal(text))
    return _braces(normal(text)) if language else []
