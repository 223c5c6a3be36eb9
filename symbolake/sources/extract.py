"""Source text to symbols and provisional edges (Python, TypeScript, JavaScript).

Python is parsed with the standard library; a file it rejects is read by a tolerant line scanner instead. TypeScript
and JavaScript are scanned over a copy of the text in which strings, comments and patterns are blanked out, so that
brackets can be matched and definitions, calls and imports be told apart.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from symbolake.sources.scan import template_end

# The scheme of extracted ids, and what their descriptors end with by kind.
SCHEME = "tsindex"
SUFFIX = {"Class": "#", "Interface": "#", "Struct": "#", "Enum": "#", "Trait": "#", "Function": "().", "Method": "()."}
# File extensions by language.
EXTENSIONS = {"py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript"}
CALLABLE = ("Function", "Method")


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else None


def module_of(path: str) -> str:
    return re.sub(r"/__init__$", "", re.sub(r"\.[^./]*$", "", path))


def render(package: str, descriptor: str) -> str:
    return f"{SCHEME} . {package} . {descriptor}"


@dataclass
class Out:
    """What a file gives, in order: symbol rows and raw edge rows."""

    package: str
    path: str
    language: str
    symbols: list = field(default_factory=list)
    edges: list = field(default_factory=list)
    broken: bool = False

    def symbol(self, descriptor: str, name: str, kind: str, span: tuple, signature: str | None) -> str:
        i = render(self.package, descriptor)
        self.symbols.append((i, SCHEME, ".", self.package, ".", descriptor, name, kind, self.language, self.package, self.path, *span, signature, None))
        return i

    def contains(self, src: str, dst: str, descriptor: str) -> None:
        self.edges.append((src, self.package, dst, self.package, descriptor, "Contains", 1.0))

    def calls(self, src: str, name: str) -> None:
        self.edges.append((src, self.package, None, self.package, f"?/{name}()", "Calls", 0.4))

    def imports(self, src: str, core: str) -> None:
        self.edges.append((src, self.package, None, "?", core, "Imports", 0.5))


@dataclass
class Scope:
    core: str
    id: str
    caller: str


def _enter(out: Out, scope: Scope, name: str, kind: str, span: tuple, signature: str) -> Scope:
    core = f"{scope.core}/{name}"
    i = out.symbol(core + SUFFIX[kind], name, kind, span, signature.rstrip())
    out.contains(scope.id, i, core + SUFFIX[kind])
    return Scope(core, i, i if kind in CALLABLE else scope.caller)


# ---- Python


def _python(out: Out, root: Scope, text: str) -> None:
    tree, lines = ast.parse(text), text.encode().split(b"\n")

    def visit(node: ast.AST, scope: Scope) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            for d in node.decorator_list:
                visit(d, scope)
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            first = lines[node.lineno - 1][node.col_offset :].decode(errors="replace")
            inner = _enter(out, scope, node.name, kind, (node.lineno, node.col_offset, node.end_lineno, node.end_col_offset), first)
            for c in ast.iter_child_nodes(node):
                if c not in node.decorator_list:
                    visit(c, inner)
            return
        if isinstance(node, ast.ImportFrom):
            if not node.level and node.module and node.module != "__future__":
                for a in node.names:
                    if a.name != "*":
                        out.imports(scope.id, f"{node.module}/{a.name}".replace(".", "/"))
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                out.imports(scope.id, a.name.replace(".", "/"))
            return
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.calls(scope.caller, name)
        for c in ast.iter_child_nodes(node):
            visit(c, scope)

    visit(tree, root)


_PY_NOISE = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*", re.S)
_PY_KEYWORDS = frozenset("if elif while for return and or not in is lambda with assert yield await print del raise except def class".split()) - {"print"}


def _blank(text: str, noise: re.Pattern) -> str:
    """The text with noise replaced by blanks; line breaks stay."""
    return noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _python_lines(out: Out, root: Scope, text: str) -> None:
    """Definitions, calls and imports of a broken file, line by line and by indentation."""
    clean, raw = _blank(text, _PY_NOISE).split("\n"), text.split("\n")
    stack: list[tuple[int, Scope]] = [(-1, root)]
    ends: list[tuple[int, int]] = []
    for n, line in enumerate(clean):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while len(stack) > 1 and stack[-1][0] >= indent:
            stack.pop()
        scope = stack[-1][1]
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line):
            last = next((k for k in range(n + 1, len(clean)) if clean[k].strip() and len(clean[k]) - len(clean[k].lstrip()) <= indent), len(clean))
            while last > n + 1 and not raw[last - 1].strip():
                last -= 1
            ends.append((n, last))
            scope = _enter(out, scope, m[2], "Class" if m[1] == "class" else "Function", (n + 1, indent, last, len(raw[last - 1].encode())), raw[n].strip())
            stack.append((indent, scope))
            line = line[m.end() :].partition(":")[2]
        elif m := re.match(r"\s*from\s+([\w.]+)\s+import\s+([\w\s,.*()]+)", line):
            if not m[1].startswith(".") and m[1] != "__future__":
                for part in m[2].strip(" ()").split(","):
                    if (name := part.split(" as ")[0].strip()) and name != "*":
                        out.imports(scope.id, f"{m[1]}/{name}".replace(".", "/"))
            continue
        elif m := re.match(r"\s*import\s+(.+)", line):
            for part in m[1].split(","):
                if name := part.split(" as ")[0].strip():
                    out.imports(scope.id, name.replace(".", "/"))
            continue
        for m in re.finditer(r"(\w+)\s*\(", line):
            if m[1] not in _PY_KEYWORDS and not m[1].isdigit():
                out.calls(scope.caller, m[1])


# ---- TypeScript and JavaScript

_JS_NOISE = re.compile(
    r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?P<tick>`)"
    r"|(?:(?<=[=(,:!&|?;\[{}])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=\bthrow)|(?<=\bawait)|(?<=\byield)|(?<=\belse)|(?<=\bof)|(?<=\bin))\s*/(?![/*])(?:[^\\/\n\[]|\\.|\[(?:[^\\\]\n]|\\.)*\])+/[a-z]*",
    re.S,
)
_JS_TOKEN = re.compile(
    r"(?P<imp>\bimport\b(?!\s*[(.]))|(?P<exp>\bexport\s*(?:\*|\{|type\s*\{))"
    r"|(?P<fn>(?:\basync\s+)?\bfunction\b\s*\*?\s*(?P<fname>[A-Za-z_$][\w$]*))|(?P<abs>\babstract\s+)?\b(?P<cls>class|interface)\s+(?P<cname>[A-Za-z_$][\w$]*)"
    r"|(?P<id>[A-Za-z_$\#][\w$]*)\s*(?P<gen><[^<>()=;]*>)?\s*(?P<opt>\?\.)?\("
)
_MODIFIERS = frozenset("public private protected static async readonly override abstract get set declare".split())
_NO_CALL = frozenset("if for while switch catch function return typeof await void delete in of instanceof do else case throw yield super import new constructor with".split())


def _blank_script(text: str) -> str:
    """`_blank` of script noise, template strings with all that is inserted in them included."""
    out, at = [], 0
    while m := _JS_NOISE.search(text, at):
        end = template_end(text, m.end()) if m["tick"] else m.end()
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join([*out, text[at:]])


class _Text:
    """A text with blanked noise, its bracket pairs, and positions as (line, byte column)."""

    def __init__(self, text: str):
        self.raw, self.clean = text, _blank_script(text)
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.clean):
            if m[0] in "([{":
                stack.append(m.start())
            elif stack:
                self.pair[stack.pop()] = m.start()
        for i in stack:
            self.pair[i] = len(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, i: int) -> tuple[int, int]:
        line = bisect_right(self.starts, i)
        return line, len(self.raw[self.starts[line - 1] : i].encode())

    def token(self, i: int) -> tuple[int, str]:
        """Start and text of the word or character that ends before i, blanks apart; '' at the text's start."""
        while i > 0 and self.clean[i - 1].isspace():
            i -= 1
        k = i
        while k > 0 and (self.clean[k - 1].isalnum() or self.clean[k - 1] in "_$"):
            k -= 1
        return (k, self.clean[k:i]) if k < i else (max(i - 1, 0), self.clean[max(i - 1, 0) : i])

    def before(self, i: int) -> str:
        """The last character that isn't blank before i."""
        return self.token(i)[1][-1:]

    def lead(self, i: int) -> int:
        """Where the modifiers of a method begin whose name stands at i."""
        while (t := self.token(i))[1] == "*" or t[1] in _MODIFIERS:
            i = t[0]
        return i

    def starts_statement(self, i: int) -> bool:
        """Whether a `function` at i stands on a line of its own or behind a word of an export."""
        k, word = self.token(i)
        return word in ("export", "default", "declare") or "\n" in self.clean[k + len(word) : i]

    def is_new(self, i: int) -> bool:
        """Whether `new` and names with dots stand before i."""
        k, word = self.token(i)
        while word == ".":
            k, word = self.token(self.token(k)[0])
        return word == "new"

    def body(self, i: int) -> int | None:
        """The opening brace of a body after position i (behind a parameter list or head); None for a declaration."""
        m = re.compile(r"\s*:\s*").match(self.clean, i)
        if m and self.clean[m.end() : m.end() + 1] == "{":
            i = self.pair.get(m.end(), m.end()) + 1
        while i < len(self.clean):
            c = self.clean[i]
            if c == "{":
                return i
            if c in ";})]":
                return None
            i = self.pair[i] + 1 if c in "([" and i in self.pair else i + 1
        return None


def _script(out: Out, root: Scope, text: str) -> None:
    t = _Text(text)
    stack: list[tuple[int, Scope]] = [(len(text) + 1, root)]
    shapes: set[int] = set()  # braces of interfaces, whose entries are declarations
    members: dict[int, int] = {}  # braces whose direct entries may be methods, and where they end

    def define(start: int, name: str, kind: str, brace: int) -> None:
        end = min(t.pair.get(brace, len(text)) + 1, len(text))
        first = text[start:end].split("\n", 1)[0]
        a, b = t.at(start), t.at(end)
        stack.append((end, _enter(out, stack[-1][1], name, kind, (*a, *b), first)))

    holders, seen, around = sorted(i for i in t.pair if t.clean[i] == "{"), 0, []  # braces, how many were met, and those still open
    for m in _JS_TOKEN.finditer(t.clean):
        i = m.start()
        while stack[-1][0] <= i:
            stack.pop()
        scope = stack[-1][1]
        if m["imp"] or m["exp"]:
            stop = re.compile(r";|\n\s*\n|\n(?=\s*(?:import|export|const|let|var|function|class)\b)").search(t.clean, m.end())
            part = text[i : stop.start() if stop else len(text)]
            s = re.search(r"(?:\bfrom\s*|\A\s*import\s*)([\"'])([^\"'\n]*)\1", part)
            if s and s[2] and not s[2].startswith("."):
                out.imports(scope.id, s[2])
        elif m["fn"]:
            lead = t.before(i)
            brace = t.body(t.pair.get(t.clean.find("(", m.end()), m.end()) + 1)
            statement = lead in ("", "{", "}", ";") or t.starts_statement(i) and lead not in "=(,:?!&|["
            if brace is not None and statement:
                define(i, m["fname"], "Function", brace)
        elif m["cls"]:
            brace = t.clean.find("{", m.end())
            if brace < 0:
                continue
            if m["cls"] == "class":
                members[brace] = t.pair.get(brace, len(text))
            else:
                shapes.add(brace)
            if m["cls"] == "interface" and out.language == "TypeScript" or m["cls"] == "class" and not m["abs"] and t.before(i) not in ("=", "(", ",", ":", "?"):
                define(m.start("cls"), m["cname"], "Class" if m["cls"] == "class" else "Interface", brace)
        elif m["id"]:
            name, open_ = m["id"], m.end() - 1
            while seen < len(holders) and holders[seen] <= i:
                around.append(holders[seen])
                seen += 1
            while around and t.pair[around[-1]] < i:
                around.pop()
            brace = around[-1] if around else -1
            if brace in shapes:
                continue
            lead = max(t.lead(i), brace + 1)
            mark = t.before(lead)
            literal = brace >= 0 and brace not in members and t.before(brace) in ("=", "(", ",", ":", "[", "?", "n")
            if name not in _NO_CALL - {"constructor", "delete", "get", "set"} and (brace in members and mark in ("{", "}", ";", ")") or literal and mark in ("{", ",")):
                inner = t.body(t.pair.get(open_, open_) + 1)
                gap = t.clean[t.pair.get(open_, open_) + 1 : inner] if inner is not None else ""
                if inner is not None and re.fullmatch(r"\s*(?::[^;=]*)?\s*", gap):
                    define(lead, name, "Method", inner)
                    continue
                if inner is None and brace in members:
                    continue  # a declaration
            if name not in _NO_CALL and not t.is_new(i) and not m["opt"] or m["opt"] and name not in _NO_CALL:
                out.calls(stack[-1][1].caller, name)


def extract(package: str, path: str, text: str) -> Out | None:
    """Symbols and raw edges of one file; None if its language isn't supported. Ids use `package`, the repo's name."""
    language = language_of(path)
    if language is None:
        return None
    out = Out(package, path, language)
    lines = text.split("\n")
    end = (len(lines), len(lines[-1].encode()))
    core = module_of(path)
    i = out.symbol(core, path, "File", (1, 0, *end), None)
    root = Scope(core, i, i)
    if language == "Python":
        mark = len(out.symbols), len(out.edges)
        try:
            _python(out, root, text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            del out.symbols[mark[0] :], out.edges[mark[1] :]
            out.broken = True
            _python_lines(out, root, text)
    else:
        _script(out, root, text)
    return out
