"""Queries of extraction, store, streaming and model stages and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.functions import text as X
from symbolake.operators import graph as G
from symbolake.operators import incremental as I
from symbolake.operators import reports as R
from symbolake.operators import retrieval as V
from symbolake.operators import style as S
from symbolake.operators.resolve import resolve
from symbolake.plans.text_queries import search_text
from symbolake.providers import complete_all
from symbolake.runtime import place, table
from symbolake.sources.repo_walk import parse
from symbolake.sources.store import SCHEMAS, GraphStore
from symbolake.streaming import maintain as M


ITEMS = "repo string, commit string, file_path string, change string"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The source documents as files of a tree, numbered by path."""
    t = S.texts(table(spark, d, "documents"))
    return t.select("repo", F.col("file_path").alias("path"), F.pmod(F.xxhash64("repo", "file_path"), F.lit(1 << 40)).alias("file_no"), F.regexp_replace(F.ltrim(F.col("text"), F.lit("\ufeff")), "\r\n?", "\n").alias("content"))


def extracted_symbols(spark, d):
    return parse(_sources(spark, d))[0].select("symbol_id", "name", "kind", "language", "repo", "file_path", "line_start", "line_end")


def extracted_definitions(spark, d):
    """Every definition found in the source documents and where it stands."""
    found = parse(_sources(spark, d))[0].where(F.col("kind") != "File")
    return found.select("repo", "file_path", "name", "kind", "line_start", "line_end")


def extracted_files(spark, d):
    files = parse(_sources(spark, d))[0].where(F.col("kind") == "File")
    return files.select("repo", "file_path", "language", "line_end")


def extract_and_resolve(spark, d):
    return resolve(*parse(_sources(spark, d)))[1]


def store_roundtrip(spark, d):
    """Rows per table after two commits, and of the first version again."""
    store = GraphStore(spark, place(spark, "store"))
    s, e = table(spark, d, "symbols"), table(spark, d, "edges")
    keep = s.where("symbol_id is not null").select(*[c.name for c in SCHEMAS["symbols"]])
    store.commit(symbols=keep, edges=e)
    store.commit(edges=e.where("kind = 'Calls'"), enrichment=table(spark, d, "enrichment"))
    part = lambda n, v: store.read(n, v).groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), F.lit(v).alias("version"), "rows")
    return part("symbols", 2).unionByName(part("edges", 2)).unionByName(part("edges", 1)).unionByName(part("enrichment", 2)).unionByName(part("flows", 2))


def streamed_changes(spark, d):
    """The change sets read as a stream and maintained batch by batch; every item comes out once."""
    at, out = f"{d}/change_sets.parquet", place(spark, "stream-out")
    schema = spark.read.parquet(at).schema
    source = spark.readStream.schema(schema)
    M.maintain(source.parquet(at) if os.path.isdir(at) else source.option("pathGlobFilter", "change_sets.parquet").parquet(d), place(spark, "stream-state"), out, place(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema(ITEMS).parquet(f"{out}/batch=*")


def offline_summaries(spark, d):
    """A report of the 100 definitions with the most dependents; `all_summaries` is the operator."""
    return _summaries(spark, d, 100)


def all_summaries(spark, d):
    """A summary of every definition."""
    return _summaries(spark, d, None)


def _summaries(spark, d, limit):
    nodes, edges = G.load_graph(spark, table(spark, d, "symbols"), table(spark, d, "edges"))
    top = R.enrich_candidates(nodes, edges, limit).withColumn("prompt", F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "signature", "file_path")).select("symbol_id", "prompt")
    said = complete_all(top, "symbol_id", "prompt", "summary").select("symbol_id", X.summary_reply("reply").alias("r"))
    return said.select("symbol_id", "r.summary", F.array_join("r.queries", "|").alias("queries"))


def embedded_search_rows(spark, d):
    v = V.embed(search_text(spark, d), "text")
    return v.select("symbol_id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm"))


def changed_counts(spark, d):
    c = I.change_set_files(table(spark, d, "change_sets")).withColumnRenamed("change", "status").withColumnRenamed("file_path", "path")
    return I.status_counts(c)


QUERIES = {f.__name__: f for f in (extracted_symbols, extracted_definitions, extracted_files, extract_and_resolve, store_roundtrip, streamed_changes, offline_summaries, all_summaries, embedded_search_rows, changed_counts)}

_NODES = "nodes AS (SELECT * FROM symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal) = 1)"
_LISTS = """lists AS (SELECT repo, "commit", 'added' AS change, unnest(added) AS p FROM change_sets UNION ALL SELECT repo, "commit", 'modified', unnest(modified) FROM change_sets UNION ALL SELECT repo, "commit", 'deleted', unnest(deleted) FROM change_sets)"""
SQL = {
    "extracted_definitions": """WITH f AS (SELECT DISTINCT repo, file_path FROM documents WHERE repo IS NOT NULL AND file_path IS NOT NULL AND text IS NOT NULL),
        newest AS (SELECT * FROM symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at DESC, ordinal DESC) = 1)
        SELECT repo, file_path, name, kind, line_start, line_end FROM newest JOIN f USING (repo, file_path) WHERE kind <> 'File'""",
    "extracted_files": """WITH t AS (SELECT repo, file_path, replace(replace(ltrim(min(text), chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE repo IS NOT NULL AND file_path IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
        SELECT repo, file_path, CASE WHEN regexp_matches(lower(file_path), '\\.pyi?$') THEN 'Python' WHEN regexp_matches(lower(file_path), '\\.tsx?$') THEN 'TypeScript' ELSE 'JavaScript' END AS language, len(string_split(text, chr(10)))::INT AS line_end
        FROM t WHERE regexp_matches(lower(file_path), '\\.(pyi?|tsx?|jsx?|mjs|cjs)$')""",
    "store_roundtrip": """SELECT 'symbols' AS name, 2 AS version, count(*) AS rows FROM symbols WHERE symbol_id IS NOT NULL UNION ALL SELECT 'edges', 2, count(*) FROM edges WHERE kind = 'Calls'
        UNION ALL SELECT 'edges', 1, count(*) FROM edges UNION ALL SELECT 'enrichment', 2, count(*) FROM enrichment UNION ALL SELECT 'flows', 2, 0""",
    "streamed_changes": f"""WITH {_LISTS} SELECT DISTINCT repo, "commit", replace(p, '\\', '/') AS file_path, change FROM lists WHERE p IS NOT NULL""",
    "offline_summaries": f"""WITH {_NODES}, att AS (SELECT * FROM edges WHERE src_id IN (SELECT symbol_id FROM nodes) AND dst_id IN (SELECT symbol_id FROM nodes)), d AS (SELECT dst_id, count(*) AS deps FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1),
        t AS (SELECT n.symbol_id, n.kind || ' ' || n.name AS x FROM nodes n LEFT JOIN d ON d.dst_id = n.symbol_id WHERE n.kind IN ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Enum') ORDER BY coalesce(d.deps, 0) DESC, n.ordinal LIMIT 100)
        SELECT symbol_id, x AS summary, 'what is ' || x || '|where is ' || x || ' used|how does ' || x || ' work' AS queries FROM t""",
    "all_summaries": f"""WITH {_NODES}, t AS (SELECT symbol_id, kind || ' ' || name AS x FROM nodes WHERE kind IN ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Enum'))
        SELECT symbol_id, x AS summary, 'what is ' || x || '|where is ' || x || ' used|how does ' || x || ' work' AS queries FROM t""",
    "embedded_search_rows": f"WITH {_NODES} SELECT symbol_id, 64 AS width, 1.0::DOUBLE AS norm FROM nodes WHERE kind <> 'File'",
    "changed_counts": f"""WITH {_LISTS} SELECT repo, change AS status, count(DISTINCT replace(p, '\\', '/')) AS n FROM lists WHERE p IS NOT NULL AND repo IS NOT NULL GROUP BY ALL""",
}
