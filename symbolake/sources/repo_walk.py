"""Source trees as tables: a Python data source for files, and their extraction."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symbolake.operators.resolve import dedup_symbols
from symbolake.runtime import materialize
from symbolake.sources.extract import extract, language_of
from symbolake.sources.ignore import Rules

#: Files of one input partition.
CHUNK = 256
#: A file's rows are numbered within this many places, so that ordinals follow file order without a global sort.
PLACES = 1 << 22


def walk(root: str) -> list[str]:
    """Relative paths of the supported files under `root`, in path order; hidden ones too, ignored ones not."""
    base, out, rules = Path(root), [], Rules()
    for folder, dirs, files in os.walk(base):
        rel = "" if Path(folder) == base else Path(folder).relative_to(base).as_posix()
        below = lambda name: f"{rel}/{name}" if rel else name
        for name in (".gitignore", ".ignore"):
            if name in files:
                rules.add(rel, (Path(folder) / name).read_text(errors="replace").splitlines())
        dirs[:] = sorted(d for d in dirs if d != ".git" and not rules.ignores(below(d), True))
        out += [below(f) for f in files if language_of(f) and (Path(folder) / f).is_file() and not rules.ignores(below(f), False)]
    return sorted(out)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["path"].split(os.pathsep)
        self.only = {(repo, path) for repo, path in json.loads(options["only"])} if "only" in options else None

    def partitions(self) -> list[_Files]:
        files = [(os.path.basename(os.path.abspath(r)), r, p, 0) for r in self.roots for p in walk(r)]
        files = [(repo, r, p, n) for n, (repo, r, p, _) in enumerate(files) if self.only is None or (repo, p) in self.only]
        return [_Files(files[i : i + CHUNK]) for i in range(0, len(files), CHUNK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for repo, root, path, n in partition.files:
            try:
                raw = (Path(root) / path).read_bytes()
            except OSError:
                continue
            yield repo, path, n, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()


class SourceTree(DataSource):
    """`spark.read.format("source_tree").load(roots)`: (repo, path, file_no, content, hash), one partition per CHUNK files.

    Several roots are joined by the system's path separator; a repo is named by its folder. Option `only`: a JSON list of
    [repo, path] of the files to read; no other file is opened.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, path string, file_no long, content string, hash string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_trees(spark: SparkSession, roots: list[str], only: list[tuple[str, str]] | None = None) -> DataFrame:
    """The files of the trees, or only the listed (repo, path) among them; a file's number is its place among all."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree")
    return (reader if only is None else reader.option("only", json.dumps(only))).load(os.pathsep.join(roots))


_SYMBOL = "symbol_id string, scheme string, package_manager string, package string, version string, descriptor string, name string, kind string, language string, repo string, file_path string, line_start int, col_start int, line_end int, col_end int, signature string, docstring string"
_EDGE = "src_id string, src_package string, dst_id string, dst_package string, dst_descriptor string, kind string, confidence double"
_BOTH = f"{_SYMBOL}, {_EDGE.replace('kind string', 'edge_kind string')}, ordinal long, broken boolean"


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _BOTH.split(", ")]
    for f in frames:
        rows = []
        for repo, path, n, text in zip(f["repo"], f["path"], f["file_no"], f["content"], strict=True):
            out = extract(repo, path, text)
            if out is None:
                continue
            place = int(n) * PLACES
            rows += [(*s, *[None] * 7, place + k, out.broken) for k, s in enumerate(out.symbols)]
            rows += [(*[None] * 17, *e, place + k, out.broken) for k, e in enumerate(out.edges)]
        yield pd.DataFrame(rows, columns=names)


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (one per id, the last) and raw edges (one per source, target and kind, the first) of the files' contents."""
    both = materialize(files.select("repo", "path", "file_no", "content").mapInPandas(_extract, _BOTH), "parsed")
    symbols = both.where("symbol_id is not null").select(*[c.split()[0] for c in _SYMBOL.split(", ")], "ordinal")
    e = both.where("src_id is not null").select(*[("edge_kind" if c.startswith("kind ") else c.split()[0]) for c in _EDGE.split(", ")], "ordinal").withColumnRenamed("edge_kind", "kind")
    keys = ["src_id", "dst_package", "dst_descriptor", "kind"]
    first = e.groupBy(*keys).agg(F.min_by(F.struct("src_package", "dst_id", "confidence", "ordinal"), "ordinal").alias("r"))
    edges = first.select("src_id", "r.src_package", "r.dst_id", "dst_package", "dst_descriptor", "kind", "r.confidence", "r.ordinal")
    return dedup_symbols(symbols), edges


def parse_files(spark: SparkSession, roots: list[str], wanted: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """`parse` of the listed (repo, path) alone; missing and unsupported ones are skipped and no others are read."""
    return parse(read_trees(spark, roots, wanted))
