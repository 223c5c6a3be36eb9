"""Scalar text operators as Column expressions: identifiers, descriptors, paths, casing. All lengths are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of query keywords.
STOP_WORDS = ["the", "a", "an", "of", "to", "in", "and", "or", "for", "is", "how", "do", "does", "get", "that", "this", "with", "on", "by"]
# Path patterns and their penalties; the first tier that matches counts.
TEST_PATHS = ["/test", "test_", "_test.", ".test.", ".spec.", "/tests/", "/spec/", "__tests__"]
SIDE_PATHS = ["/examples", "/legacy", "/compat", "/migration", "/revision"]
GLUE_SUFFIXES = ["/__init__.py", "package-info.java", "mod.rs"]
# File extensions by language.
EXTENSIONS = {"Python": ["py", "pyi"], "TypeScript": ["ts", "tsx"], "JavaScript": ["js", "jsx", "mjs", "cjs"]}
#: Borders inside an identifier: lower to upper, the last upper of an acronym, letter to other and back.
_BORDER = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})|(?<=\p{IsAlphabetic})(?=\P{IsAlphabetic})|(?<=\P{IsAlphabetic})(?=\p{IsAlphabetic})"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_camel(x: Column | str) -> Column:
    """The words of a camelCase run."""
    return F.filter(F.split(_c(x), _BORDER), lambda p: p != "")


def split_identifier(x: Column | str) -> Column:
    """Lower-case compound first, then its snake and camel parts of at least two bytes, distinct, in order."""
    parts = F.flatten(F.transform(F.split(_c(x), "_"), split_camel))
    kept = F.filter(F.transform(parts, F.lower), lambda p: F.octet_length(p) >= 2)
    return F.array_distinct(F.concat(F.array(F.lower(_c(x))), kept))


def query_keywords(q: Column | str) -> Column:
    """Sorted distinct keywords of a question: sub-tokens over two bytes that are no stop words."""
    words = F.filter(F.split(_c(q), r"[^\p{L}\p{N}_]"), lambda w: w != "")
    parts = F.flatten(F.transform(words, split_identifier))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: (F.octet_length(w) > 2) & ~w.isin(STOP_WORDS))))


def is_symbol_query(q: Column | str) -> Column:
    """Whether a query looks like a symbol: path marks, or one word that is short or has an upper-case letter."""
    t = F.trim(_c(q))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    one = (F.size(words) == 1) & (t.rlike(r"\p{Lu}") | (F.octet_length(t) <= 24))
    return t.rlike(r"::|[._/]") | one


def semantic_weight(q: Column | str) -> Column:
    """Weight of the vector signal for a query (offered, not used by the default ranking)."""
    return F.when(is_symbol_query(q), 0.3).otherwise(0.5)


def lexical_score(keywords: Column | str, name: Column | str, tail: Column | str) -> Column:
    """Share of the keywords among the sub-tokens of name and tail; from four bytes on a prefix is enough."""
    k, tokens = _c(keywords), F.array_union(split_identifier(name), split_identifier(tail))
    hit = F.filter(k, lambda w: F.array_contains(tokens, w) | ((F.octet_length(w) >= 4) & F.exists(tokens, lambda t: t.startswith(w))))
    return F.when(F.size(k) == 0, 0.0).otherwise(F.size(hit) / F.size(k))


def _any(hits: list[Column]) -> Column:
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def path_penalty(path: Column | str) -> Column:
    """0.3 for tests and side paths, 0.5 for glue files, 0.7 for type declarations, else 1."""
    p = F.lower(_c(path))
    low = _any([p.contains(x) for x in TEST_PATHS + SIDE_PATHS])
    return F.when(low, 0.3).when(_any([p.endswith(x) for x in GLUE_SUFFIXES]), 0.5).when(p.endswith(".d.ts"), 0.7).otherwise(1.0)


def casing(name: Column | str) -> Column:
    """SCREAMING_SNAKE, snake_case, PascalCase, camelCase or other, by ASCII letters."""
    core = F.regexp_replace(_c(name), "^_+|_+$", "")
    up, low = core.rlike("[A-Z]"), core.rlike("[a-z]")
    return (
        F.when(core == "", "other").when(~low & up, "SCREAMING_SNAKE").when(core.contains("_") & low, "snake_case")
        .when(core.rlike("^[A-Z]") & low, "PascalCase").when(core.rlike("^[a-z]") & up, "camelCase").otherwise("snake_case")
    )


def search_text(name="name", signature="signature", descriptor="descriptor", docstring="docstring") -> Column:
    """Text of a symbol for the search index; null parts are left out."""
    return F.concat_ws("  ", _c(name), _c(signature), F.translate(_c(descriptor), "/_.", "   "), _c(docstring))


def est_tokens(signature="signature", path="file_path") -> Column:
    """Estimated tokens of a symbol in a context pack."""
    return F.floor((F.octet_length(F.coalesce(_c(signature), F.lit(""))) + F.octet_length(_c(path)) + 24) / 4).cast("long")


def descriptor_core(d: Column | str) -> Column:
    """A descriptor without one call suffix or else one type suffix."""
    c = _c(d)
    return F.when(c.endswith("()."), F.substring(c, F.lit(1), F.length(c) - 3)).when(c.endswith("#"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def is_external_import(package: Column | str) -> Column:
    return _c(package) == "?"


def provisional_call(d: Column | str) -> Column:
    """The called name of an unbound call's descriptor, else null."""
    return F.when(_c(d).rlike(r"^\?/.*\(\)$"), F.regexp_extract(_c(d), r"^\?/(.*)\(\)$", 1))


def module_path(path: Column | str) -> Column:
    """A file's module: without extension and trailing package file."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"\.[^./]*$", ""), r"/__init__$", "")


def descriptor_suffix(kind: Column | str) -> Column:
    """What a descriptor ends with, by kind."""
    k = _c(kind)
    return F.when(k.isin("Class", "Interface", "Struct", "Enum", "Trait"), "#").when(k.isin("Function", "Method"), "().").otherwise("")


def symbol_id(scheme, manager, package, version, descriptor) -> Column:
    """The rendered global id of its five parts."""
    return F.concat_ws(" ", *(_c(x) for x in (scheme, manager, package, version, descriptor)))


def parse_symbol_id(i: Column | str) -> Column:
    """The five parts of a rendered id as a struct; a missing part is a dot."""
    parts = F.split(_c(i), " ", 5)
    names = ("scheme", "package_manager", "package", "version", "descriptor")
    return F.struct(*(F.coalesce(F.get(parts, F.lit(n)), F.lit(".")).alias(x) for n, x in enumerate(names)))


def is_package_managed(manager: Column | str) -> Column:
    return _c(manager) != "."


def detect_language(path: Column | str) -> Column:
    """Language of a path by extension, null if unsupported."""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))
    out = None
    for name, exts in EXTENSIONS.items():
        out = F.when(ext.isin(exts), name) if out is None else out.when(ext.isin(exts), name)
    return out


def edge_label(kind: Column | str) -> Column:
    """Display label of an edge kind: lower snake case."""
    return F.lower(F.regexp_replace(_c(kind), "(?<=[a-z])(?=[A-Z])", "_"))


def truncate(x: Column | str, n: int) -> Column:
    """At most n characters, an ellipsis in place of the rest."""
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, max(0, n)), F.lit("…"))).otherwise(c)


def short_sha(x: Column | str) -> Column:
    return F.substring(_c(x), 1, 8)


def compact_number(n: Column | str) -> Column:
    """1234 as 1.2k."""
    c = _c(n)
    return F.when(c >= 1000, F.concat(F.format_number(c / 1000, 1), F.lit("k"))).otherwise(c.cast("string"))


def summary_reply(raw: Column | str) -> Column:
    """(summary, queries) of a model's reply: the last SUMMARY line, the last QUERIES line split at bars; without summary the first line that isn't blank."""
    lines = F.transform(F.split(_c(raw), r"\r?\n"), _strip)
    said = F.filter(lines, lambda x: x.startswith("SUMMARY:"))
    last = _strip(F.substring(F.element_at(said, -1), F.lit(9), F.length(_c(raw))))
    asked = F.filter(lines, lambda x: x.startswith("QUERIES:"))
    fallback = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    summary = F.when((F.size(said) > 0) & (last != ""), last).otherwise(fallback)
    return F.struct(summary.alias("summary"), F.when(F.size(asked) > 0, _bars(F.substring(F.element_at(asked, -1), F.lit(9), F.length(_c(raw))))).otherwise(F.array().cast("array<string>")).alias("queries"))


def narration_reply(raw: Column | str) -> Column:
    """(narration, queries) of a model's reply, split at the first QUERIES marker; without narration the whole text."""
    text = _c(raw)
    at = F.instr(text, "QUERIES:")
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    told = F.trim(F.regexp_replace(_strip(head), "^(?:NARRATION:)+", ""))
    rest = F.when(at > 0, F.substring(text, at + 8, F.length(text))).otherwise("")
    return F.struct(F.when(_strip(told) == "", _strip(text)).otherwise(_strip(told)).alias("narration"), _bars(rest).alias("queries"))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _bars(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\|"), _strip), lambda q: q != "")
