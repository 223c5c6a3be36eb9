"""The tools of a session as queries: the test tables are committed to a store, a session answers from it, its results come out as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.operators import retrieval as V
from symbolake.plans import graph_queries
from symbolake.plans.text_queries import QUESTION, search_text
from symbolake.runtime import place, table
from symbolake.session import Session
from symbolake.sources.store import SCHEMAS

#: Sessions by application and folder; their stores are written once.
_SESSIONS: dict[tuple[str, str], Session] = {}


def _session(spark: SparkSession, d: str, search: bool = False) -> Session:
    """A session over the tables; the rows to search are put in for the tool that reads them."""
    key = spark.sparkContext.applicationId, d
    if key not in _SESSIONS or not _SESSIONS[key].store.exists():
        s = Session(spark, place(spark, "tools"))
        symbols = table(spark, d, "symbols").where("symbol_id is not null")
        needed = [f.name for f in SCHEMAS["symbols"] if not f.nullable]
        symbols = symbols.select(*(F.coalesce(F.col(c), F.lit("" if t == "string" else -1).cast(t)).alias(c) if c in needed else F.col(c) for c, t in symbols.dtypes))
        edges = table(spark, d, "edges").where("src_id is not null and dst_id is not null and kind is not null")
        edges = edges.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("cross_repo", F.coalesce("cross_repo", F.lit(False)))
        s.store.commit(symbols=symbols, edges=edges, enrichment=table(spark, d, "enrichment").where("symbol_id is not null"))
        _SESSIONS[key] = s
    s = _SESSIONS[key]
    if search and s.store.read("search").isEmpty():
        s.store.commit(search=V.embed(search_text(spark, d), "text"))
    return s


def _id(df: DataFrame) -> str:
    row = df.first()
    return row.symbol_id if row else ""


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def tool_zoom(spark, d):
    s = _session(spark, d)
    got = s.zoom(_id(graph_queries._focus(s.graph()[1])))
    groups = {"member": got["members"], "caller": got["callers"], "callee": got["callees"], "importer": got["importers"], "container": [got["container"]] if got["container"] else []}
    return _table(spark, [{"relation": k, **n} for k, ns in groups.items() for n in ns], "relation string, symbol_id string, name string, location string")


def tool_ripple(spark, d):
    s = _session(spark, d)
    return s.ripple_rows(_id(graph_queries._focus(s.graph()[1])))


def tool_thread(spark, d):
    s = _session(spark, d)
    return _table(spark, s.thread(_id(graph_queries._caller(s.graph()[1])))["trace"], "symbol_id string, depth int, via string")


def tool_flow(spark, d):
    s = _session(spark, d)
    return _table(spark, s.flow(_id(graph_queries._caller(s.graph()[1])))["trace"], "symbol_id string, depth int, via string")


def tool_context_pack(spark, d):
    s = _session(spark, d)
    got = s.context_pack(_id(graph_queries._focus(s.graph()[1])))
    return _table(spark, [{"position": n, **i} for n, i in enumerate(got["items"])], "position int, symbol_id string, est_tokens long")


def tool_find(spark, d):
    return _table(spark, _session(spark, d).find("queue_", 30)["results"], "symbol_id string, name string, kind string")


def tool_repos(spark, d):
    return _table(spark, _session(spark, d).repos()["repos"], "repo string, symbols long")


def tool_suggest(spark, d):
    got = _session(spark, d).suggest("parser", 40)
    return _table(spark, [{**r, "total": got["total"]} for r in got["suggestions"]], "question string, symbol string, location string, total long")


def tool_search(spark, d):
    return _table(spark, _session(spark, d, search=True).search(QUESTION)["results"], "symbol_id string, name string, repo string, location string, deps long")


def tool_guide(spark, d):
    """Two guides put in and combined again."""
    s = _session(spark, d)
    s.store.commit(style_guide=spark.createDataFrame([("b", "Second."), ("a", "First.")], "repo string, content string"))
    return spark.createDataFrame([(s.guide()["guide"], s.guide("A")["guide"])], "everything string, one string")


QUERIES = {f.__name__: f for f in (tool_search, tool_repos, tool_suggest, tool_find, tool_zoom, tool_ripple, tool_guide, tool_thread, tool_flow, tool_context_pack)}

_G = graph_queries.SQL
SQL = {
    "tool_repos": _G["repos_overview"],
    "tool_suggest": _G["suggest_questions"],
    "tool_find": _G["find_symbols"],
    "tool_zoom": _G["zoom_focus"],
    "tool_ripple": _G["ripple_focus"],
    "tool_thread": _G["thread_focus"],
    "tool_flow": _G["thread_focus"],
    "tool_context_pack": _G["context_pack_focus"],
    "tool_guide": "SELECT '# a' || chr(10) || chr(10) || 'First.' || chr(10) || chr(10) || '# b' || chr(10) || chr(10) || 'Second.' AS everything, '# a' || chr(10) || chr(10) || 'First.' AS one",
}
