"""Functions paired with their documentation (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.llm.lexer import definitions
from symbolake.runtime import materialize

# Texts that take the place of documentation, as whole texts.
PLACEHOLDERS = re.compile(
    r"(?ix)\W* (?: (?:todo|fixme|xxx|tbd|tba|hack|wip|n\s*/\s*a|none|nil|null|empty|placeholder|stub) \b .{0,24}"
    r"| (?:please\s+)? (?:add|insert|write|enter|provide|put) \s+ (?:a\s+|the\s+|some\s+|your\s+)? (?:short\s+|brief\s+)? (?:description|documentation|docs?|docstring|summary|comment|text) (?:\s+here)?"
    r"| (?:description|documentation|docs?|docstring|summary|comment) \s+ (?:goes|comes|to\s+come|pending|missing|needed|here)(?:\s+here)?"
    r"| (?:missing|no|needs|undocumented|lacks) \s* (?:description|documentation|docs?|docstring|summary|comment)?"
    r"| auto-?\s?generated (?:\s+\w+){0,3} | generated \s+ (?:stub|code|method|function)"
    r"| (?:summary|description|docstring|documentation|short\s+description) ) \W*"
)
# Pointers to documentation elsewhere, as whole texts.
POINTERS = re.compile(r"(?ix)\W* (?: (?:see|same\s+as|as|like|refer\s+to|cf\.?|ditto) \b (?:\s+\S+){0,4} | \{?@(?:inherit_?doc|see|link|copydoc)\b.* | inherit(?:ed|s|doc)? (?:\s+\S+){0,4} | (?:overrides?|implements?) (?:\s+\S+){0,4} ) \W*")
# Labels that say no more than what kind of thing it is, as whole texts.
LABELS = re.compile(
    r"(?ix)\W* (?: (?:a|an|the|simple|small|main|basic|generic|this\s+is\s+an?)? \s* (?: (?:internal|private|public|protected|deprecated|experimental|helper|utility|util|wrapper|getter|setter|accessor|constructor|destructor|initiali[sz]er|callback|handler"
    r"|hook|factory|static|abstract|override|legacy|unused|example|function|method|class|module|property|api|test|ignore|unstable|stable|beta|alpha) (?:\s+(?:use|only|function|method|helper|api|class|for|internal|private))* )+ ) \W*"
)
# Directives to tools, anywhere in a text.
DIRECTIVES = re.compile(
    r"(?im)(?:pylint|flake8|mypy|ruff|isort|yapf|fmt|black|pyright|pytype|tslint|jshint|jscs|eslint(?:-(?:disable|enable)(?:-next)?(?:-line)?)?|prettier-ignore|istanbul|c8|v8|webpack\w*|nosec|nosonar|noinspection|spell-?checker|cspell|type|pragma|coverage)"
    r"\s*:?\s*(?:disable|enable|ignore|skip|off|on|no cover|no branch|noqa|next|file|todo)?(?:[-=: ]+[\w,./-]+)*\s*$|\bnoqa\b(?::\s*[\w, ]+)?|@ts-(?:ignore|expect-error|nocheck)\b.*$|eslint-(?:disable|enable)[\w-]*(?:\s+[\w/,-]+)*"
)
# Heads of parameter lists in the usual documentation styles.
_TAG = re.compile(r"^\s*(?:[:@\\](?:param|parameter|arg|argument|type|rtype|returns?|raises?|throws?|yields?|property|prop|template|see|since|version|author|example|todo|deprecated|internal|private|public|override|kwarg|keyword|exception|except|var|ivar|typedef|async|memberof|module|class|function|method|name)\b|>>>|\.\.\s)", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters?|params|returns?|yields?|raises?|throws|examples?|attributes|keyword args|other parameters|notes?|see also|references|todo)\s*:?\s*$", re.I)
_STOP = frozenset("a an the this that of for to in on and or it its is be by with from into as at function method class docstring doc documentation func def fn helper implementation wrapper routine procedure does do performs perform will".split())
_OPEN = re.compile(r"(?s)^[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')(.*?)(?:\1)?\s*$")
_WORDS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_A-Za-z]+")


def stem(word: str) -> str:
    """A word without its inflection."""
    w = word.lower()
    for end in ("ings", "ing", "ied", "ies", "ers", "er", "ors", "or", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)] + ("y" if end in ("ied", "ies") else "")
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] in "ey" else w


def strip_marks(raw: str) -> str:
    """Documentation without quotes, comment marks and leading stars."""
    text = raw.strip().lstrip("﻿").strip()
    if text.startswith("/*"):
        text = re.sub(r"\A/\*+|\*+/\Z", "", text)
        text = re.sub(r"(?m)^[ \t]*\*(?!\*)[ \t]?", "", text)
    elif m := _OPEN.match(text):
        text = m[2]
    elif text.startswith(("//", "#")):
        text = re.sub(r"(?m)^[ \t]*(?://+|#+)[ \t]?", "", text)
    return text.strip()


def description(raw: str | None, name: str) -> str | None:
    """The describing part of a documentation, or None if it says nothing of its own about `name`.

    Nothing are: blanks, placeholders, tool directives, pointers elsewhere, bare labels, lists of parameters or tags,
    and the name again in other words or inflections.
    """
    if not raw:
        return None
    kept, listed = [], False
    for line in strip_marks(raw).split("\n"):
        if _SECTION.match(line) or set(line.strip()) in ({"-"}, {"="}):
            if set(line.strip()) == {"-"} and not kept and not listed:
                continue
            listed = True
        elif _TAG.match(line):
            listed = True
        elif not line.strip():
            listed = False
            kept.append("")
        elif not listed:
            kept.append(line.strip())
    text = DIRECTIVES.sub(" ", "\n".join(kept)).strip()
    flat = re.sub(r"\s+", " ", text)
    if PLACEHOLDERS.fullmatch(flat) or POINTERS.fullmatch(flat) or LABELS.fullmatch(flat):
        return None
    own = {stem(p) for p in _PARTS.findall(name)} | {name.lower()}
    news = [w for w in _split(flat) if w not in _STOP and w not in own and stem(w) not in own]
    return flat if news else None


def _split(flat: str) -> list[str]:
    return [p.lower() for w in _WORDS.findall(flat) for p in _PARTS.findall(w)]


def scope_tail(descriptor: Column, file_path: Column) -> Column:
    """The definition's path inside its file: the descriptor without its module part and suffix."""
    module = F.size(F.split(file_path, "/")) - F.when(file_path.rlike(r"/__init__\.[^./]+$"), 1).otherwise(0)
    parts = F.split(F.regexp_replace(descriptor, r"(\(\)\.|#)$", ""), "/")
    return F.array_join(F.slice(parts, module + 1, F.greatest(F.size(parts) - module, F.lit(0))), "/")


_FOUND = "repo string, file_path string, tail string, description string, code string"


def _extract(code: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for repo, path, text in zip(f["repo"], f["file_path"], f["text"], strict=True):
                if code or "/**" in text or '"' in text or "'" in text:
                    for tail, name, kind, doc, source in definitions(text, path):
                        said = description(doc, name) if doc and kind not in ("class", "interface") else None
                        if said or code and kind not in ("class", "interface"):
                            rows.append((repo, path, tail, said, source if code else None))
            yield pd.DataFrame(rows, columns=["repo", "file_path", "tail", "description", "code"])

    return run


def source_definitions(documents: DataFrame, code: bool = False) -> DataFrame:
    """One row (repo, file_path, tail, description, code) per documented function of the source documents; with `code` of every function, description null where undocumented.

    Documents without repo, path or text give none; copies of a file and repeated definitions give one row.
    """
    src = documents.where("repo is not null and file_path is not null and text is not null").select("repo", "file_path", "text")
    each = src.mapInPandas(_extract(code), _FOUND)
    least = F.min(F.when(F.col("description").isNotNull() | F.lit(code), F.struct(F.col("description").isNull(), "description", "code"))).alias("m")
    return each.groupBy("repo", "file_path", "tail").agg(least).select("repo", "file_path", "tail", "m.description", "m.code")


@F.pandas_udf(T.StringType())
def _described(docs: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([description(d, n or "") for d, n in zip(docs, names, strict=True)], dtype=object)


def documented_functions(symbols: DataFrame, documents: DataFrame, code: bool = False) -> DataFrame:
    """Problem 6: (symbol_id, name, signature, description, and with `code` the function's source), one row per id of kind Function or Method that is documented.

    A docstring that is not null decides by itself, even if blank; else the source document of the symbol's repo and
    path is asked. Of several lives of an id the one with the smallest (description, name, signature) speaks; its code is null if
    no document has it. Symbols with null id, and files without document, give none. Empty tables give no rows.
    """
    fn = symbols.where(F.col("kind").isin("Function", "Method") & F.col("symbol_id").isNotNull()).select("symbol_id", "name", "signature", "docstring", "repo", "file_path", "descriptor")
    fn = fn.withColumn("tail", scope_tail(F.col("descriptor"), F.col("file_path"))).drop("descriptor")
    own = fn.where("docstring is not null").withColumn("description", _described("docstring", "name")).where("description is not null")
    bare = fn.where("docstring is null and repo is not null and file_path is not null")
    bare = bare.select("symbol_id", "name", "signature", "repo", "file_path", "tail").distinct()  # many lives of a symbol are one row
    place, said = ["repo", "file_path", "tail"], ["symbol_id", "description", "name", "signature"]
    source = source_definitions(documents, code)
    if code:
        source = materialize(source, "definitions")
        own = own.select(*said, *place).distinct().join(source.select(*place, "code"), place, "left")
    else:
        own = own.withColumn("code", F.lit(None).cast("string"))
    read = bare.join(source.where("description is not null"), place)
    both = own.select(*said, "code").unionByName(read.select(*said, "code"))
    least = F.min(F.struct("description", "name", "signature", F.col("code").isNull().alias("none"), "code")).alias("m")
    return both.groupBy("symbol_id").agg(least).select("symbol_id", "m.name", "m.signature", "m.description", *(["m.code"] if code else []))
