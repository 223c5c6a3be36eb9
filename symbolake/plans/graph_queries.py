"""Queries of the graph operators and their SQL. The focus of focused queries is the most depended-on symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.functions import text as X
from symbolake.operators import graph as G
from symbolake.operators import incremental as I
from symbolake.operators import reports as R
from symbolake.operators import resolve as D
from symbolake.runtime import table


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.load_graph(spark, table(spark, d, "symbols"), table(spark, d, "edges"))


def _focus(edges: DataFrame) -> DataFrame:
    return G.dependents(edges).orderBy(F.desc("deps"), "symbol_id").limit(1).select("symbol_id")


def _at(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, d)
    return _focus(edges), edges, nodes


def nodes_dedup(spark, d):
    return G.node_set(table(spark, d, "symbols")).select("symbol_id", "name", "kind", "descriptor", "ordinal")


def symbols_last(spark, d):
    return D.dedup_symbols(table(spark, d, "symbols")).select("symbol_id", "name", "ordinal", "line_start")


def edges_first(spark, d):
    return D.dedup_edges(table(spark, d, "edges")).select("src_id", "dst_id", "kind", "ordinal")


def edges_attach(spark, d):
    return _graph(spark, d)[1].select("src_id", "dst_id", "kind", "ordinal")


def dangling_count(spark, d):
    return G.dangling_count(table(spark, d, "edges"), G.node_set(table(spark, d, "symbols")))


def graph_counts(spark, d):
    return G.graph_counts(*_graph(spark, d))


def node_projection(spark, d):
    return G.project_nodes(G.node_set(table(spark, d, "symbols")))


def token_estimate(spark, d):
    return G.node_set(table(spark, d, "symbols")).select("symbol_id", X.est_tokens().alias("est_tokens"))


def repos_overview(spark, d):
    return G.repos(G.node_set(table(spark, d, "symbols")))


def lookup_focus(spark, d):
    return G.lookup(G.node_set(table(spark, d, "symbols")), "retry").select("symbol_id", "name", "kind")


def find_symbols(spark, d):
    return G.find(G.node_set(table(spark, d, "symbols")), "queue_", 30).select("symbol_id", "name", "kind")


def find_in_repo(spark, d):
    return G.find(G.node_set(table(spark, d, "symbols")), "load", 30, repo="ATLAS-mono").select("symbol_id", "name")


def dependents_count(spark, d):
    nodes, edges = _graph(spark, d)
    return G.dependents(edges, nodes)


def most_depended(spark, d):
    nodes, edges = _graph(spark, d)
    return R.most_depended(nodes, edges)


def ripple_focus(spark, d):
    # Walks look up what they meet, so they read the tables as they are.
    symbols, edges = table(spark, d, "symbols"), table(spark, d, "edges")
    return G.hops(G.ripple(_focus(_graph(spark, d)[1]), edges, symbols), G.node_set(symbols)).select("symbol_id", "name", "kind", "repo", "location", "depth", "via")


def ripple_by_repo(spark, d):
    symbols, edges = table(spark, d, "symbols"), table(spark, d, "edges")
    return R.by_repo(G.ripple(_focus(_graph(spark, d)[1]), edges, symbols), G.node_set(symbols))


def _caller(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'Calls'").groupBy(F.col("src_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol_id").limit(1).select("symbol_id")


def thread_focus(spark, d):
    return G.thread(_caller(_graph(spark, d)[1]), table(spark, d, "edges"), table(spark, d, "symbols"))


def zoom_focus(spark, d):
    return G.zoom(*_at(spark, d)).select("relation", "symbol_id", "name", "location")


def ppr_top(spark, d):
    focus, edges, _ = _at(spark, d)
    rank = G.pagerank([r[0] for r in focus.collect()], edges)
    return rank.select("symbol_id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "symbol_id").limit(50)


def ppr_joined(spark, d):
    """`ppr_top` by the join loop that large graphs take."""
    focus, edges, _ = _at(spark, d)
    rank = G.pagerank([r[0] for r in focus.collect()], edges, kernel_edges=-1)
    return rank.select("symbol_id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "symbol_id").limit(50)


def context_pack_focus(spark, d):
    return G.context_pack(*_at(spark, d))


def flow_reach_top(spark, d):
    nodes, edges = _graph(spark, d)
    return R.flow_candidates(nodes, edges, 20)


def kind_histogram(spark, d):
    return R.kind_histogram(G.node_set(table(spark, d, "symbols")))


def edge_summary(spark, d):
    return R.edge_summary(table(spark, d, "edges"))


def stats_by_repo(spark, d):
    nodes, edges = _graph(spark, d)
    return R.stats_by_repo(nodes, edges, table(spark, d, "enrichment"))


def cross_repo_targets(spark, d):
    nodes, edges = _graph(spark, d)
    return R.cross_repo_targets(edges, nodes, 15)


def importer_repos(spark, d):
    nodes, edges = _graph(spark, d)
    return R.importer_repos(edges, nodes)


def suggest_questions(spark, d):
    return R.suggest(table(spark, d, "enrichment"), G.node_set(table(spark, d, "symbols")), "parser", 40)


def enrich_select(spark, d):
    """A report of the 100 definitions with the most dependents; `enrich_all` gives all to summarise."""
    nodes, edges = _graph(spark, d)
    return R.enrich_candidates(nodes, edges, 100).select("symbol_id", "deps")


def enrich_all(spark, d):
    nodes, edges = _graph(spark, d)
    return R.enrich_candidates(nodes, edges, None).select("symbol_id", "deps")


def node_cards(spark, d):
    nodes = G.node_set(table(spark, d, "symbols"))
    return R.with_enrichment(G.project_nodes(nodes), table(spark, d, "enrichment")).select("symbol_id", "summary", F.array_join("queries", " | ").alias("queries"))


def resolve_edges(spark, d):
    s, e = table(spark, d, "symbols"), table(spark, d, "edges")
    return D.resolve(s, D.provisional(e, s))[0].select("src_id", "dst_id", "kind", F.col("confidence").cast("double").alias("confidence"), "cross_repo", "n")


def incremental_index(spark, d):
    """The graph after the files of all change sets were read again or dropped: what `incremental.merge` binds."""
    s, e = table(spark, d, "symbols"), table(spark, d, "edges")
    raw = D.provisional(e, s)
    changed = I.change_set_files(table(spark, d, "change_sets")).where(F.col("change") != "added")
    diff = changed.groupBy("repo", F.col("file_path").alias("path")).agg(F.min("change").alias("status"))  # deleted before modified
    again = s.join(diff.where("status = 'modified'").select("repo", F.col("path").alias("file_path")), I.FILE, "left_semi")
    parsed = raw.join(again.select(F.col("symbol_id").alias("src_id")).distinct(), "src_id", "left_semi")
    bound = I.merge(s, raw, diff, again, parsed)[2]
    return bound.select("src_id", "dst_id", "kind", F.col("confidence").cast("double").alias("confidence"), "cross_repo", "n")


def resolve_stats(spark, d):
    s, e = table(spark, d, "symbols"), table(spark, d, "edges")
    return D.resolve(s, D.provisional(e, s))[1]


QUERIES = {
    f.__name__: f
    for f in (
        nodes_dedup, symbols_last, edges_first, edges_attach, dangling_count, graph_counts, node_projection, token_estimate, repos_overview, lookup_focus, find_symbols, find_in_repo,
        dependents_count, most_depended, ripple_focus, ripple_by_repo, thread_focus, zoom_focus, ppr_top, ppr_joined, context_pack_focus, flow_reach_top, kind_histogram, edge_summary, stats_by_repo,
        cross_repo_targets, importer_repos, suggest_questions, enrich_select, enrich_all, node_cards, resolve_edges, incremental_index, resolve_stats,
    )
}

_NODES = "nodes AS (SELECT * FROM symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal) = 1)"
_GRAPH = f"{_NODES}, att AS (SELECT * FROM edges WHERE src_id IN (SELECT symbol_id FROM nodes) AND dst_id IN (SELECT symbol_id FROM nodes))"
_FOCUS = f"{_GRAPH}, focus AS (SELECT dst_id AS id FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_SHORT = "(kind = 'File'), strlen(descriptor), ordinal, symbol_id"
_LOC = "n.file_path || ':' || n.line_start AS location"


def _walk(start: str, here: str, there: str, kinds: str, depth: int = 4) -> str:
    return f"""
        adj AS (SELECT DISTINCT {here} AS a, {there} AS b, kind FROM att WHERE kind IN ({kinds})),
        w AS (SELECT {start} AS id, 0 AS depth UNION SELECT adj.b, w.depth + 1 FROM w JOIN adj ON adj.a = w.id WHERE w.depth < {depth}),
        r AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
        v AS (SELECT c.id AS symbol_id, c.depth, arg_min(adj.kind, (p.ordinal, adj.kind)) AS via FROM r c JOIN adj ON adj.b = c.id JOIN r q ON q.id = adj.a AND q.depth = c.depth - 1
              JOIN nodes p ON p.symbol_id = q.id GROUP BY c.id, c.depth)"""


_RIPPLE = f"WITH RECURSIVE {_FOCUS}, {_walk('(SELECT id FROM focus)', 'dst_id', 'src_id', chr(39) + 'Calls' + chr(39) + ',' + chr(39) + 'Imports' + chr(39))}"
_PROV = """
prov AS (
  SELECT e.src_id, s.package AS src_package, e.kind, e.ordinal,
    CASE WHEN e.kind = 'Imports' THEN '?' WHEN e.kind = 'Calls' THEN s.package ELSE t.package END AS dst_package,
    CASE WHEN e.kind = 'Imports' THEN regexp_replace(t.descriptor, '(\\(\\)\\.|#)$', '') WHEN e.kind = 'Calls' THEN '?/' || t.name || '()' ELSE t.descriptor END AS dst_descriptor,
    e.dst_id, e.confidence
  FROM edges e JOIN nodes s ON s.symbol_id = e.src_id JOIN nodes t ON t.symbol_id = e.dst_id),
bycore AS (SELECT regexp_replace(descriptor, '(\\(\\)\\.|#)$', '') AS core, arg_min(symbol_id, ordinal) AS id, arg_min(package, ordinal) AS package FROM nodes GROUP BY 1),
byname AS (SELECT package, name, min(symbol_id) AS id FROM nodes WHERE kind <> 'File' GROUP BY 1, 2 HAVING count(*) = 1),
imp AS (SELECT p.src_id, p.src_package, c.id AS dst_id, c.package AS dst_package, p.kind, 0.95::FLOAT AS confidence, p.ordinal FROM prov p LEFT JOIN bycore c ON c.core = p.dst_descriptor WHERE p.kind = 'Imports'),
cal AS (SELECT p.src_id, p.src_package, n.id AS dst_id, p.src_package AS dst_package, p.kind, 0.8::FLOAT AS confidence, p.ordinal FROM prov p JOIN byname n ON n.package = p.dst_package AND n.name = regexp_extract(p.dst_descriptor, '^\\?/(.*)\\(\\)$', 1) WHERE p.kind = 'Calls'),
bound AS (SELECT * FROM imp WHERE dst_id IS NOT NULL UNION ALL SELECT * FROM cal
  UNION ALL SELECT src_id, src_package, dst_id, dst_package, kind, confidence, ordinal FROM prov WHERE kind NOT IN ('Imports', 'Calls'))
"""
_RANKS = f"""WITH RECURSIVE {_FOCUS}, e AS (SELECT src_id AS a, dst_id AS b FROM att WHERE kind IN ('Calls', 'Imports')), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        deg AS (SELECT a, count(*) AS d FROM u GROUP BY a), l AS (SELECT u.a, u.b, count(*) / any_value(d) AS p FROM u JOIN deg ON deg.a = u.a GROUP BY u.a, u.b),
        lnk AS (SELECT a, b, 0.85 * p AS p, 0 AS base FROM l UNION ALL SELECT '!', id, 0.15, 1 FROM focus UNION ALL SELECT '!', '!', 1.0, 1),
        pr AS (SELECT 0 AS i, id, 1.0::DOUBLE AS r FROM focus UNION ALL SELECT 0, '!', 1.0::DOUBLE
          UNION ALL SELECT pr.i + 1, lnk.b, sum(pr.r * lnk.p) FROM pr JOIN lnk ON lnk.a = pr.id WHERE pr.i < 40 GROUP BY pr.i, lnk.b)"""
_TOP_RANKS = "SELECT id AS symbol_id, round(r, 9) AS rank FROM pr WHERE i = 40 AND id <> '!' AND r > 0 ORDER BY rank DESC, symbol_id LIMIT 50"
SQL = {
    "nodes_dedup": f"WITH {_NODES} SELECT symbol_id, name, kind, descriptor, ordinal FROM nodes",
    "symbols_last": "SELECT symbol_id, name, ordinal, line_start FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal DESC) = 1",
    "edges_first": "SELECT src_id, dst_id, kind, ordinal FROM edges QUALIFY row_number() OVER (PARTITION BY src_id, dst_id, kind ORDER BY ordinal) = 1",
    "edges_attach": f"WITH {_GRAPH} SELECT src_id, dst_id, kind, ordinal FROM att",
    "dangling_count": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM att) AS attached, (SELECT count(*) FROM edges) - (SELECT count(*) FROM att) AS dangling",
    "graph_counts": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM att) AS edges",
    "node_projection": f"WITH {_NODES} SELECT symbol_id, name, kind, package AS repo, {_LOC}, signature FROM nodes n",
    "token_estimate": f"WITH {_NODES} SELECT symbol_id, (strlen(coalesce(signature, '')) + strlen(file_path) + 24) // 4 AS est_tokens FROM nodes",
    "repos_overview": f"WITH {_NODES} SELECT package AS repo, count(*) AS symbols FROM nodes GROUP BY 1",
    "lookup_focus": f"""WITH {_NODES} SELECT symbol_id, name, kind FROM (SELECT *, CASE WHEN symbol_id = 'retry' THEN 0 WHEN contains(descriptor, 'retry') THEN 1 WHEN name = 'retry' THEN 2 END AS tier FROM nodes)
        WHERE tier IS NOT NULL ORDER BY tier, {_SHORT} LIMIT 1""",
    "find_symbols": f"WITH {_NODES} SELECT symbol_id, name, kind FROM nodes WHERE contains(name, 'queue_') OR contains(descriptor, 'queue_') ORDER BY {_SHORT} LIMIT 30",
    "find_in_repo": f"WITH {_NODES} SELECT symbol_id, name FROM nodes WHERE (contains(name, 'load') OR contains(descriptor, 'load')) AND lower(package) = 'atlas-mono' ORDER BY {_SHORT} LIMIT 30",
    "dependents_count": f"WITH {_GRAPH} SELECT n.symbol_id, count(a.dst_id) AS deps FROM nodes n LEFT JOIN (SELECT * FROM att WHERE kind IN ('Calls', 'Imports')) a ON a.dst_id = n.symbol_id GROUP BY 1",
    "most_depended": f"""WITH {_GRAPH} SELECT n.symbol_id, n.name, n.kind, n.package AS repo, {_LOC}, d.deps FROM
        (SELECT dst_id, count(*) AS deps FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1) d JOIN nodes n ON n.symbol_id = d.dst_id WHERE n.kind <> 'File' ORDER BY d.deps DESC, n.ordinal DESC LIMIT 1""",
    "ripple_focus": f"{_RIPPLE} SELECT v.symbol_id, n.name, n.kind, n.package AS repo, {_LOC}, v.depth, v.via FROM v JOIN nodes n USING (symbol_id) WHERE v.depth > 0",
    "ripple_by_repo": f"{_RIPPLE} SELECT n.package AS repo, count(*) AS symbols FROM v JOIN nodes n USING (symbol_id) WHERE v.depth > 0 GROUP BY 1",
    "thread_focus": f"""WITH RECURSIVE {_GRAPH}, {_walk("(SELECT src_id FROM att WHERE kind = 'Calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", 'src_id', 'dst_id', chr(39) + 'Calls' + chr(39))}
        SELECT symbol_id, depth, via FROM v WHERE depth > 0""",
    "zoom_focus": f"""WITH {_FOCUS}, z AS (
        SELECT * FROM (SELECT 'container' AS relation, src_id AS symbol_id FROM att, focus WHERE dst_id = id AND kind = 'Contains' ORDER BY ordinal DESC LIMIT 1)
        UNION ALL SELECT 'member', dst_id FROM att, focus WHERE src_id = id AND kind = 'Contains' UNION ALL SELECT 'callee', dst_id FROM att, focus WHERE src_id = id AND kind = 'Calls'
        UNION ALL SELECT 'caller', src_id FROM att, focus WHERE dst_id = id AND kind = 'Calls' UNION ALL SELECT 'importer', src_id FROM att, focus WHERE dst_id = id AND kind = 'Imports')
        SELECT relation, symbol_id, n.name, {_LOC} FROM z JOIN nodes n USING (symbol_id)""",
    "ppr_top": f"{_RANKS} {_TOP_RANKS}",
    "ppr_joined": f"{_RANKS} {_TOP_RANKS}",
    "context_pack_focus": f"""{_RANKS},
        size AS (SELECT symbol_id, kind, ordinal, (strlen(coalesce(signature, '')) + strlen(file_path) + 24) // 4 AS t FROM nodes),
        cand AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round(pr.r, 12) DESC, n.ordinal, n.symbol_id) AS rn, n.symbol_id, n.t FROM pr JOIN size n ON n.symbol_id = pr.id
          WHERE pr.i = 40 AND pr.r > 0 AND n.kind <> 'File' AND n.symbol_id <> (SELECT id FROM focus) AND n.t <= 1500 - (SELECT t FROM size JOIN focus ON symbol_id = id)),
        pack AS (SELECT 0::BIGINT AS rn, symbol_id, t, 1500 - t AS room, 0 AS position, true AS taken FROM size JOIN focus ON symbol_id = id
          UNION ALL SELECT c.rn, c.symbol_id, c.t, CASE WHEN c.t <= p.room THEN p.room - c.t ELSE p.room END, p.position + (c.t <= p.room)::INT, c.t <= p.room FROM pack p JOIN cand c ON c.rn = p.rn + 1)
        SELECT position, symbol_id, t AS est_tokens FROM pack WHERE taken""",
    "flow_reach_top": f"""WITH RECURSIVE {_GRAPH}, adj AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM att WHERE kind = 'Calls'),
        o AS (SELECT symbol_id FROM nodes WHERE kind IN ('Function', 'Method') AND NOT regexp_matches(lower(file_path), '/test|test_|_test\\.|\\.test\\.|\\.spec\\.|/tests/|/spec/|__tests__|/examples|/legacy|/compat|/migration|/revision|/__init__\\.py$|package-info\\.java$|mod\\.rs$|\\.d\\.ts$')),
        w AS (SELECT symbol_id AS origin, symbol_id AS id, 0 AS d FROM o UNION SELECT w.origin, adj.b, w.d + 1 FROM w JOIN adj ON adj.a = w.id WHERE w.d < 4)
        SELECT origin AS symbol_id, count(DISTINCT id) AS score FROM w WHERE id <> origin GROUP BY 1 ORDER BY score DESC, symbol_id LIMIT 20""",
    "kind_histogram": f"WITH {_NODES} SELECT kind, count(*) AS n FROM nodes GROUP BY 1",
    "edge_summary": "SELECT count(*) AS edges, count(*) FILTER (kind = 'Calls') AS calls, count(*) FILTER (kind = 'Contains') AS contains, count(*) FILTER (kind = 'Imports') AS imports, count(*) FILTER (cross_repo) AS cross_repo FROM edges",
    "stats_by_repo": f"""WITH {_GRAPH}, en AS (SELECT DISTINCT symbol_id FROM enrichment WHERE symbol_id IS NOT NULL),
        s AS (SELECT n.package, coalesce(n.kind, '*') AS kind, count(*) AS symbols, count(en.symbol_id) AS enriched FROM nodes n LEFT JOIN en ON en.symbol_id = n.symbol_id GROUP BY n.package, n.kind
              UNION ALL SELECT n.package, '*', count(*), count(en.symbol_id) FROM nodes n LEFT JOIN en ON en.symbol_id = n.symbol_id GROUP BY n.package),
        o AS (SELECT n.package, count(*) AS edges FROM att a JOIN nodes n ON n.symbol_id = a.src_id GROUP BY 1)
        SELECT s.package AS repo, kind, symbols, enriched, coalesce(o.edges, 0) AS edges FROM s LEFT JOIN o ON o.package = s.package""",
    "cross_repo_targets": f"""WITH {_GRAPH} SELECT t.descriptor, min(t.package) AS defined_in, count(DISTINCT s.package) AS repos, count(*) AS refs FROM att a
        JOIN nodes s ON s.symbol_id = a.src_id JOIN nodes t ON t.symbol_id = a.dst_id WHERE a.kind = 'Imports' AND s.package <> t.package GROUP BY 1 ORDER BY repos DESC, refs DESC, descriptor LIMIT 15""",
    "importer_repos": f"""WITH {_GRAPH}, x AS (SELECT t.descriptor, s.package FROM att a JOIN nodes s ON s.symbol_id = a.src_id JOIN nodes t ON t.symbol_id = a.dst_id WHERE a.kind = 'Imports' AND s.package <> t.package),
        top AS (SELECT descriptor FROM x GROUP BY 1 ORDER BY count(DISTINCT package) DESC, count(*) DESC, descriptor LIMIT 1) SELECT DISTINCT descriptor, package AS repo FROM x JOIN top USING (descriptor)""",
    "suggest_questions": f"""WITH {_NODES}, q AS (SELECT DISTINCT e.symbol_id, unnest(e.queries) AS question FROM (SELECT * FROM enrichment QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal DESC) = 1) e),
        x AS (SELECT q.question, n.name AS symbol, {_LOC}, n.ordinal FROM q JOIN nodes n USING (symbol_id) WHERE contains(lower(q.question), 'parser') OR contains(lower(n.name), 'parser'))
        SELECT question, symbol, location, count(*) OVER () AS total FROM x ORDER BY symbol, question, ordinal LIMIT 40""",
    "enrich_select": f"""WITH {_GRAPH}, d AS (SELECT dst_id, count(*) AS deps FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1)
        SELECT n.symbol_id, coalesce(d.deps, 0) AS deps FROM nodes n LEFT JOIN d ON d.dst_id = n.symbol_id WHERE n.kind IN ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Enum') ORDER BY 2 DESC, n.ordinal LIMIT 100""",
    "enrich_all": f"""WITH {_GRAPH}, d AS (SELECT dst_id, count(*) AS deps FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1)
        SELECT n.symbol_id, coalesce(d.deps, 0) AS deps FROM nodes n LEFT JOIN d ON d.dst_id = n.symbol_id WHERE n.kind IN ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Enum')""",
    "node_cards": f"""WITH {_NODES}, e AS (SELECT * FROM enrichment QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal DESC) = 1)
        SELECT n.symbol_id, e.summary, array_to_string(coalesce(e.queries, []), ' | ') AS queries FROM nodes n LEFT JOIN e ON e.symbol_id = n.symbol_id""",
    "resolve_edges": f"WITH {_NODES}, {_PROV} SELECT src_id, dst_id, kind, round(confidence::DOUBLE, 6) AS confidence, coalesce(src_package <> dst_package, false) AS cross_repo, count(*) AS n FROM bound GROUP BY ALL",
    "incremental_index": f"""WITH {_NODES},
        lists AS (SELECT repo, 'modified' AS status, unnest(modified) AS p FROM change_sets UNION ALL SELECT repo, 'deleted', unnest(deleted) FROM change_sets),
        diff AS (SELECT repo, replace(p, '\\', '/') AS file_path, min(status) AS status FROM lists WHERE p IS NOT NULL AND repo IS NOT NULL GROUP BY ALL),
        gone AS (SELECT s.symbol_id FROM symbols s JOIN diff USING (repo, file_path)),
        again AS (SELECT s.symbol_id FROM symbols s JOIN diff USING (repo, file_path) WHERE status = 'modified'),
        left_over AS (SELECT s.* FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM diff d WHERE d.repo = s.repo AND d.file_path = s.file_path AND d.status = 'deleted')),
        last AS (SELECT * FROM left_over WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal DESC) = 1),
        {_PROV.replace("FROM nodes", "FROM last").replace("ON t.symbol_id = e.dst_id)", "ON t.symbol_id = e.dst_id WHERE e.src_id NOT IN (SELECT symbol_id FROM gone WHERE symbol_id IS NOT NULL) OR e.src_id IN (SELECT symbol_id FROM again))")}
        SELECT src_id, dst_id, kind, round(confidence::DOUBLE, 6) AS confidence, coalesce(src_package <> dst_package, false) AS cross_repo, count(*) AS n FROM bound GROUP BY ALL""",
    "resolve_stats": f"""WITH {_NODES}, {_PROV} SELECT (SELECT count(*) FROM imp WHERE dst_id IS NOT NULL) AS resolved_imports, (SELECT count(*) FROM cal) AS resolved_calls,
        (SELECT count(*) FROM bound WHERE src_package <> dst_package) AS cross_repo_edges, (SELECT count(*) FROM imp WHERE dst_id IS NULL) AS unresolved_imports""",
}
