"""Evidence for style guides: aggregates over symbols, edges and file texts, per repo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symbolake.functions.text import casing
from symbolake.operators.graph import first_per, load_graph, node_set
from symbolake.runtime import heavy_keys, materialize, salted

#: Longest evidence of a section, lines of an excerpt and of a documentation excerpt.
SECTION_CHARS, EXCERPT_LINES, DOC_LINES = 9000, 22, 30
# Markers that files of a section hold.
TYPE_MARKERS = ["BaseModel", "@dataclass", "TypedDict", "z.object(", "interface ", "z.infer"]
DECORATOR_MARKERS = ["@contextmanager", "@property", "@staticmethod", "@classmethod", "Depends(", "@inject"]
ERROR_MARKERS = ["except ", "logger", "getLogger", "raise ", "get_config", "Settings("]
# Names entry points end with, and what test files are called.
ENTRY_SUFFIXES = ["main.py", "app.py", "cli.py", "index.ts", "index.tsx", "__main__.py", "server.py"]
TEST_PARTS, TEST_SUFFIXES = ["test_", "/tests/"], ["_test.py", ".test.ts", ".spec.ts", "conftest.py"]


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def texts(documents: DataFrame) -> DataFrame:
    """One row (repo, file_path, text) per file; of several texts the smallest."""
    return _named(documents).groupBy("repo", "file_path").agg(F.min("text").alias("text"))


def _named(documents: DataFrame) -> DataFrame:
    return documents.where("repo is not null and file_path is not null and text is not null").select("repo", "file_path", "text")


def texts_of(documents: DataFrame, files: DataFrame) -> DataFrame:
    """`texts` of some files (repo, file_path); no others are shuffled."""
    return texts(_named(documents).join(files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi"))


def file_flags(documents: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(repo, file_path, flags...) of `texts`, each flag a boolean over `text`, found in the scan: only files with several different texts are shuffled as a whole."""
    cols = [c.alias(n) for n, c in flags.items()]
    each = _named(documents).select("repo", "file_path", F.xxhash64("text").alias("_h"), *cols)
    one = materialize(each.groupBy("repo", "file_path").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"), *(F.max(n).alias(n) for n in flags)), "flags")
    several = one.where("_a != _b")
    out = one.where("_a = _b").select("repo", "file_path", *flags)
    return out if several.isEmpty() else out.unionByName(texts_of(documents, several).select("repo", "file_path", *cols))


def _top(df: DataFrame, by: list, order: list, n: int | None) -> DataFrame:
    return df if n is None else df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def file_paths(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "File").select(F.col("package").alias("repo"), "file_path").distinct()


def module_of(descriptor: str) -> Column:
    """The module a descriptor belongs to: its first segment, or scope and name."""
    p = F.split(descriptor, "/")
    return F.when(F.col(descriptor).startswith("@") & (F.size(p) >= 2), F.concat_ws("/", F.get(p, F.lit(0)), F.get(p, F.lit(1)))).otherwise(F.get(p, F.lit(0)))


def _imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, module, file_path) of imports, distinct; equal edges are folded before the joins."""
    e = edges.where(F.col("kind") == "Imports").select("src_id", "dst_id").distinct()
    src = nodes.select(F.col("symbol_id").alias("src_id"), F.col("package").alias("repo"), "file_path")
    dst = nodes.select(F.col("symbol_id").alias("dst_id"), module_of("descriptor").alias("module"))
    used = e.join(src, "src_id").select("repo", "file_path", "dst_id").distinct()
    lhs, rhs, on = salted(used, dst, "dst_id", heavy_keys(e, "dst_id"))
    return lhs.join(rhs, on).where("module != ''").select("repo", "module", "file_path").distinct()


def import_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Importing files per module."""
    return _imports(edges, nodes).groupBy("repo", "module").agg(F.count(F.lit(1)).alias("files"))


def layout_dirs(nodes: DataFrame) -> DataFrame:
    return file_paths(nodes).groupBy("repo", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("dir")).agg(F.count(F.lit(1)).alias("files"))


def entry_points(nodes: DataFrame, limit: int = 4) -> DataFrame:
    f = file_paths(nodes).where(_any([F.col("file_path").endswith(s) for s in ENTRY_SUFFIXES]))
    return _top(f, ["repo"], ["file_path"], limit)


def _groups() -> Column:
    return F.when(F.col("kind").isin("Function", "Method"), "functions").when(F.col("kind").isin("Class", "Interface"), "types")


def casing_vote(nodes: DataFrame) -> DataFrame:
    """(repo, group, casing, n, total): the dominant casing of functions and types; of equals the last alphabetically."""
    n = nodes.select(F.col("package").alias("repo"), _groups().alias("group"), casing("name").alias("casing")).where("`group` is not null").groupBy("repo", "group", "casing").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("repo", "group").agg(F.max(F.struct("n", "casing")).alias("m"), F.sum("n").alias("total")).select("repo", "group", "m.casing", "m.n", "total")


def naming_examples(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """(repo, group, examples): the first names of functions and types in input order, joined by commas."""
    named = nodes.select(F.col("package").alias("repo"), _groups().alias("group"), "name", "ordinal").where("`group` is not null and name is not null")
    first = F.array_sort(F.collect_list(F.struct("ordinal", "name")))  # at most `limit`
    return _top(named, ["repo", "group"], ["ordinal", "name"], limit).groupBy("repo", "group").agg(F.array_join(F.transform(first, lambda r: r["name"]), ", ").alias("examples"))


def signature_samples(nodes: DataFrame, limit: int = 30) -> DataFrame:
    s = nodes.where(F.octet_length("signature") > 6).select(F.col("package").alias("repo"), "signature", "ordinal")
    return _top(s, ["repo"], ["ordinal"], limit).select("repo", "signature")


def largest_classes(symbols: DataFrame, limit: int = 4) -> DataFrame:
    n = node_set(symbols).where(F.col("kind") == "Class").select("symbol_id", "ordinal", F.col("package").alias("repo"))
    span = n.join(symbols.select("symbol_id", "ordinal", "line_start", "line_end"), ["symbol_id", "ordinal"]).withColumn("span", F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)))
    return _top(span, ["repo"], [F.desc("span"), "ordinal"], limit).select("repo", "symbol_id", "span")


def test_files(nodes: DataFrame, limit: int | None = 3) -> DataFrame:
    p = F.lower("file_path")
    f = file_paths(nodes).where(_any([p.contains(x) for x in TEST_PARTS] + [p.endswith(x) for x in TEST_SUFFIXES]))
    return _top(f, ["repo"], ["file_path"], limit)


def marker_files(documents: DataFrame, limit: int = 4) -> DataFrame:
    """(repo, file_path, section): the first files with markers of types, decorators, or errors, logging and settings; one scan."""
    kinds = {"types": TYPE_MARKERS, "decorators": DECORATOR_MARKERS, "errors": ERROR_MARKERS}
    flags = file_flags(documents, {k: _any([F.contains("text", F.lit(m)) for m in ms]) for k, ms in kinds.items()})
    have = F.filter(F.array(*(F.when(F.col(k), k) for k in kinds)), lambda x: x.isNotNull())
    return _top(flags.select("repo", "file_path", F.explode(have).alias("section")), ["repo", "section"], ["file_path"], limit)


def docstring_style(documents: DataFrame, files: int | None = None) -> DataFrame:
    """(repo, google, numpy, rest, jsdoc, style) by votes of all files, or of the first `files` by path; of equals the later style, null without votes."""
    c = lambda x: F.contains("text", F.lit(x))
    styles = {"google": c("Args:") | c("Returns:"), "numpy": c("Parameters\n"), "rest": c(":param "), "jsdoc": c("@param") | c("/**")}
    v = _top(file_flags(documents, styles), ["repo"], ["file_path"], files).groupBy("repo").agg(*(F.count_if(n).alias(n) for n in styles))
    ranked = F.array_max(F.array(*(F.struct(F.col(x).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (x, name) in enumerate((("google", "Google"), ("numpy", "NumPy"), ("rest", "reST"), ("jsdoc", "JSDoc"))))))
    return v.withColumn("m", ranked).select("repo", "google", "numpy", "rest", "jsdoc", F.when(F.col("m.n") > 0, F.col("m.name")).alias("style"))


def excerpt(text: Column, start: Column, lines: int = EXCERPT_LINES) -> Column:
    """`lines` lines from a 1-based line; null if all are blank."""
    part = F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.lit(lines))
    return F.when(F.exists(part, lambda x: F.trim(x) != ""), F.array_join(part, "\n"))


def call_sites(edges: DataFrame, nodes: DataFrame, modules: int = 10) -> DataFrame:
    """(repo, module, file_path): the first file that imports each of a repo's top modules."""
    return _sites(_imports(edges, nodes), modules)


def _sites(imports: DataFrame, modules: int = 10) -> DataFrame:
    n = imports.groupBy("repo", "module").agg(F.count(F.lit(1)).alias("files"), F.min("file_path").alias("file_path"))
    return _top(n, ["repo"], [F.desc("files"), "module"], modules).select("repo", "module", "file_path")


def _lines(df: DataFrame, section: str, line: Column, order: list[str], limit: int) -> DataFrame:
    """The first `limit` lines per repo as one evidence text; limits keep each group small."""
    kept = df.withColumn("_line", line).withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("_n") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    return kept.groupBy("repo").agg(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n").alias("evidence")).select("repo", F.lit(section).alias("section"), "evidence")


def guide_evidence(symbols: DataFrame, edges: DataFrame, documents: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(repo, section, evidence): up to twelve sections per repo, blank ones left out, cut at SECTION_CHARS characters.

    `declared` (repo, section, evidence): what manifests and settings state; it comes first in the stack section and last in any other.
    """
    nodes, att = load_graph(symbols.sparkSession, symbols, edges)
    nodes = materialize(nodes, "nodes")
    named = lambda files, lines=EXCERPT_LINES: files.join(texts_of(documents, files), ["repo", "file_path"]).select("*", excerpt(F.col("text"), F.lit(1), lines).alias("x")).where("x is not null")
    block = F.concat(F.lit("### "), F.col("file_path"), F.lit("\n```\n"), F.col("x"), F.lit("\n```"))
    imports = materialize(_imports(att, nodes), "imports")
    hist = imports.groupBy("repo", "module").agg(F.count(F.lit(1)).alias("files"))
    marks = materialize(marker_files(documents), "marks")
    pick = lambda s: marks.where(F.col("section") == s).drop("section")
    big = largest_classes(symbols).join(symbols.select("symbol_id", "file_path", "line_start", "ordinal"), "symbol_id")
    big = first_per(big, ["symbol_id"]).drop("ordinal")
    big = big.join(texts_of(documents, big), ["repo", "file_path"]).withColumn("x", excerpt(F.col("text"), F.col("line_start"))).where("x is not null")
    votes = casing_vote(nodes).join(naming_examples(nodes), ["repo", "group"], "left")
    parts = [
        _lines(hist, "stack", F.concat_ws("", F.lit("- "), "module", F.lit(" ("), "files", F.lit(" files)")), [F.desc("files"), "module"], 20),
        _lines(layout_dirs(nodes), "layout", F.concat_ws("", "dir", F.lit("/ ("), "files", F.lit(")")), ["dir"], 40),
        _lines(votes, "naming", F.concat_ws("", "group", F.lit(": "), "casing", F.lit(" "), "n", F.lit("/"), "total", F.lit(". examples: "), "examples"), ["group"], 10),
        _lines(signature_samples(nodes), "signatures", F.col("signature"), ["signature"], 30),
        _lines(named(pick("types")), "types", block, ["file_path"], 4),
        _lines(named(entry_points(nodes)), "entry points", block, ["file_path"], 4),
        _lines(named(pick("decorators")), "decorators", block, ["file_path"], 2),
        _lines(big, "classes", block, [F.desc("span"), "file_path"], 4),
        _lines(named(_sites(imports)), "libraries", block, ["file_path"], 7),
        _lines(named(pick("errors")), "errors", block, ["file_path"], 4),
        _lines(named(test_files(nodes)), "tests", block, ["file_path"], 3),
        _lines(docstring_style(documents).where("style is not null"), "docstrings", F.concat(F.lit("style: "), F.col("style")), ["style"], 1),
    ]
    every = reduce(DataFrame.unionByName, parts).withColumn("_o", F.lit(1))
    if declared is not None:
        every = every.unionByName(declared.select("repo", "section", "evidence", F.when(F.col("section") == "stack", 0).otherwise(2).alias("_o")))
    rows = F.array_sort(F.collect_list(F.struct("_o", "evidence")))  # two at most
    every = every.where(F.trim("evidence") != "").groupBy("repo", "section").agg(F.array_join(F.transform(rows, lambda r: r["evidence"]), "\n").alias("evidence"))
    return every.withColumn("evidence", F.substring("evidence", 1, SECTION_CHARS))
