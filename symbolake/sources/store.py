"""Versioned Parquet tables of a graph under one folder.

A commit writes new files for the tables it changes and then replaces one pointer, so symbols and edges, and all else
in the commit, become visible together. Older versions stay readable by number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolake.runtime import shed_shuffles
from symbolake.sources.pointer import Pointer

_s = lambda n, null=False: T.StructField(n, T.StringType(), null)
_i = lambda n: T.StructField(n, T.IntegerType(), False)
#: Schemas of the stored tables; `ordinal` is the input order.
SCHEMAS = {
    "symbols": T.StructType(
        [_s(c) for c in ("symbol_id", "scheme", "package_manager", "package", "version", "descriptor", "name", "kind", "language", "repo", "file_path")]
        + [_i(c) for c in ("line_start", "col_start", "line_end", "col_end")] + [_s("signature", True), _s("docstring", True), T.StructField("ordinal", T.LongType(), False)]
    ),
    "edges": T.StructType([_s("src_id"), _s("dst_id"), _s("kind"), T.StructField("confidence", T.FloatType(), False), T.StructField("cross_repo", T.BooleanType(), False), T.StructField("ordinal", T.LongType(), True)]),
    "raw_edges": T.StructType([_s("src_id"), _s("src_package"), _s("dst_id", True), _s("dst_package"), _s("dst_descriptor"), _s("kind"), T.StructField("confidence", T.DoubleType(), False), T.StructField("ordinal", T.LongType(), True)]),
    "search": T.StructType([_s("symbol_id"), _s("text"), T.StructField("vector", T.ArrayType(T.FloatType()), False)]),
    "enrichment": T.StructType([_s("symbol_id"), _s("summary", True), T.StructField("queries", T.ArrayType(T.StringType()), True), T.StructField("ordinal", T.LongType(), True)]),
    "flows": T.StructType([_s("symbol_id"), _s("narration", True), T.StructField("queries", T.ArrayType(T.StringType()), True)]),
    "style_guide": T.StructType([_s("repo"), _s("content", True)]),
    "repo_meta": T.StructType([_s("repo"), _s("commit", True)]),
}
#: Tables that are laid out by package, so that a repo's rows are read alone.
BY_PACKAGE = {"symbols": "package"}
#: Rows of a package per file, about; and packages up to which their numbers of files are broadcast.
FILE_ROWS, FEW = 500_000, 100_000


class GraphStore:
    """The tables under `path`: `commit` to write, `read` to read, `version` of the last commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = Pointer(spark, f"{self.path}/_graph")

    def _tables(self, version: int) -> dict:
        said = self.pointer.read(version)
        if said is None and version:
            raise ValueError(f"no version {version} in {self.path}")
        return json.loads(said) if said else {}

    def version(self) -> int:
        """Number of the current version, 0 before the first commit."""
        return self.pointer.number()

    def commit(self, **tables: DataFrame) -> int:
        """Writes the given tables, empty ones too, and makes them current together; returns the version. Others stay.

        `pointer.Stale` if another commit came in between; nothing has changed then.
        """
        version = self.version()
        where = self._tables(version)
        for name, df in tables.items():
            schema = SCHEMAS[name]
            cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
            at = f"{name}/{uuid.uuid4().hex}"
            out = df.select(*cols)
            if name in BY_PACKAGE:
                sizes = out.groupBy(BY_PACKAGE[name]).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))  # a large package spreads over files
                out = out.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, BY_PACKAGE[name]).repartition(F.col(BY_PACKAGE[name]), F.pmod(F.xxhash64("symbol_id"), "_files")).select(*schema.names)
            with shed_shuffles(self.spark):
                (out.write.partitionBy(BY_PACKAGE[name]) if name in BY_PACKAGE else out.write).parquet(f"{self.path}/_graph/{at}")
            where[name] = at
        self.pointer.put(version, json.dumps(where))
        return version + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the current (or a past) version; an absent one is empty."""
        at = self._tables(self.version() if version is None else version).get(name)
        schema = SCHEMAS[name]
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/_graph/{at}").select(*schema.names)

    def exists(self) -> bool:
        return self.version() > 0

    def counts(self) -> tuple[int, int]:
        """Rows of symbols and edges, from the files' footers."""
        return self.read("symbols").count(), self.read("edges").count()

    def repo_commits(self) -> dict[str, str]:
        """Commit by repo; one row a repo."""
        return {r.repo: r.commit for r in self.read("repo_meta").toLocalIterator()}

    def with_commits(self, commits: dict[str, str]) -> DataFrame:
        """repo_meta with the given repos' commits put in: an upsert."""
        new = self.spark.createDataFrame(list(commits.items()) or [], SCHEMAS["repo_meta"])
        return self.read("repo_meta").join(new.select("repo"), "repo", "left_anti").unionByName(new)
