"""Queries of the text, retrieval, style and maintenance operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.functions import text as X
from symbolake.operators import graph as G
from symbolake.operators import incremental as I
from symbolake.operators import reports as R
from symbolake.operators import retrieval as V
from symbolake.operators import style as S
from symbolake.runtime import table

QUESTION = "How does the parser queue a pending record?"
NAME_QUERY = "load_bucket_header"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.node_set(table(spark, d, "symbols"))


def _joined(c) -> F.Column:
    return F.array_join(c, "|")


def split_identifier(spark, d):
    return _nodes(spark, d).select("name").distinct().select("name", _joined(X.split_identifier("name")).alias("parts"))


def query_keywords(spark, d):
    q = table(spark, d, "enrichment").select(F.explode("queries").alias("q")).where("q is not null").distinct()
    return q.select("q", _joined(X.query_keywords("q")).alias("keywords"))


def symbol_query_flag(spark, d):
    names = _nodes(spark, d).select(F.col("name").alias("q"))
    asked = table(spark, d, "enrichment").select(F.explode("queries").alias("q")).where("q is not null")
    return names.union(asked).distinct().select("q", X.is_symbol_query("q").alias("symbolic"), X.semantic_weight("q").alias("weight"))


def lexical_overlap(spark, d):
    words = F.array(*(F.lit(w) for w in ("load", "record", "pars")))
    return _nodes(spark, d).select("symbol_id", F.round(X.lexical_score(words, "name", F.lit("")), 6).alias("score"))


def path_penalty(spark, d):
    return _nodes(spark, d).select("file_path").distinct().select("file_path", X.path_penalty("file_path").alias("penalty"))


def name_casing(spark, d):
    return _nodes(spark, d).select("name").distinct().select("name", X.casing("name").alias("casing"))


def descriptor_core(spark, d):
    return _nodes(spark, d).select("symbol_id", X.descriptor_core("descriptor").alias("core"))


def file_modules(spark, d):
    files = _nodes(spark, d).select("file_path").distinct()
    return files.select("file_path", X.module_path("file_path").alias("module"), X.detect_language("file_path").alias("language"))


def id_parts(spark, d):
    p = X.parse_symbol_id("src_id")
    ids = table(spark, d, "edges").select("src_id").distinct().select("src_id", p.alias("p")).select("src_id", "p.*")
    return ids.withColumn("rendered", X.symbol_id("scheme", "package_manager", "package", "version", "descriptor")).withColumn("managed", X.is_package_managed("package_manager"))


def search_text(spark, d):
    return V.search_rows(_nodes(spark, d).join(table(spark, d, "symbols").select("symbol_id", "ordinal", "docstring"), ["symbol_id", "ordinal"]))


def reply_parse(spark, d):
    s = table(spark, d, "documents").where(F.col("source") == "summary").select("doc_id", X.summary_reply("text").alias("r"))
    return s.select("doc_id", "r.summary", _joined("r.queries").alias("queries"))


def postings_df(spark, d):
    return V.build_text_index(table(spark, d, "documents"), "doc_id", "text")["term_df"]


def doc_lengths(spark, d):
    return V.build_text_index(table(spark, d, "documents"), "doc_id", "text")["doc_len"]


def bm25_topk(spark, d):
    return V.bm25(table(spark, d, "documents"), "doc_id", "text", QUESTION, 20).select("doc_id", F.round("score", 6).alias("score"))


def bm25_indexed(spark, d):
    index = V.build_text_index(table(spark, d, "documents"), "doc_id", "text")
    return V.bm25_indexed(index, "doc_id", ["parser", "queue", "record"], 20).select("doc_id", F.round("score", 6).alias("score"))


def _first_vector(spark, d) -> list[float]:
    row = table(spark, d, "embeddings").where("embedding is not null and vec_id is not null").orderBy("vec_id").first()
    return [float(x) for x in row.embedding] if row else [0.0]


def vector_topk(spark, d):
    return V.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 20).select("vec_id", F.round("score", 6).alias("score"))


def rrf_fusion(spark, d):
    lex = V.bm25(table(spark, d, "documents"), "doc_id", "text", QUESTION).withColumnRenamed("doc_id", "id")
    vec = V.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d)).withColumnRenamed("vec_id", "id")
    return V.rrf([lex, vec], "id", 40).select("id", F.round("score", 9).alias("score"))


def hybrid_rerank(spark, d):
    nodes, edges = G.load_graph(spark, table(spark, d, "symbols"), table(spark, d, "edges"))
    docs = V.search_rows(nodes.join(table(spark, d, "symbols").select("symbol_id", "ordinal", "docstring"), ["symbol_id", "ordinal"]))
    lex = V.bm25(docs, "symbol_id", "text", NAME_QUERY)
    hits = V.rerank(V.rrf([lex], "symbol_id"), nodes, G.dependents(edges), table(spark, d, "enrichment"), NAME_QUERY)
    return hits.select("symbol_id", "name", "repo", "location", F.round("score", 9).alias("score"), "deps", "summary")


def hybrid_search(spark, d):
    nodes, edges = G.load_graph(spark, table(spark, d, "symbols"), table(spark, d, "edges"))
    search = V.embed(search_text(spark, d), "text")
    return V.hybrid(spark, search, nodes, G.dependents(edges), table(spark, d, "enrichment"), QUESTION).drop("score")


def import_histogram(spark, d):
    nodes, edges = G.load_graph(spark, table(spark, d, "symbols"), table(spark, d, "edges"))
    return S.import_histogram(edges, nodes)


def layout_dirs(spark, d):
    return S.layout_dirs(_nodes(spark, d))


def casing_vote(spark, d):
    return S.casing_vote(_nodes(spark, d))


def signature_samples(spark, d):
    return S.signature_samples(_nodes(spark, d), 30)


def largest_classes(spark, d):
    return S.largest_classes(table(spark, d, "symbols"), 4)


def testfile_filter(spark, d):
    return S.test_files(_nodes(spark, d), None)


def marker_files(spark, d):
    return S.marker_files(table(spark, d, "documents"), 4)


def docstyle_vote(spark, d):
    """The vote of the first 400 files of a repo, as in the reference; `docstyle_all` counts all."""
    return S.docstring_style(table(spark, d, "documents"), 400)


def docstyle_all(spark, d):
    return S.docstring_style(table(spark, d, "documents"))


def guide_evidence(spark, d):
    return S.guide_evidence(table(spark, d, "symbols"), table(spark, d, "edges"), table(spark, d, "documents")).select("repo", "section", F.length("evidence").alias("chars"))


def changeset_status(spark, d):
    return I.snapshot_diff(*_snapshots(spark, d)).select("repo", "path", "status")


def changeset_parse_drop(spark, d):
    return I.parse_drop(I.snapshot_diff(*_snapshots(spark, d)))


def _snapshots(spark, d):
    """Files of the symbols as of a month's start, and of all time: path and a hash over what the rows say."""
    s = table(spark, d, "symbols").where("repo is not null and file_path is not null")
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    fold = lambda df: df.groupBy("repo", F.col("file_path").alias("path")).agg(F.max("ordinal").cast("string").alias("hash"))
    return fold(s.where((F.col("indexed_at") <= at) & (F.col("removed_at").isNull() | (F.col("removed_at") > at)))), fold(s.where("removed_at is null"))


def stale_symbols(spark, d):
    changes = I.change_set_files(table(spark, d, "change_sets"))
    indexed = table(spark, d, "repo_meta").where(F.lower(F.trim("status")) == "ok").select("repo").distinct()
    return I.stale_symbols(_nodes(spark, d).join(table(spark, d, "symbols").select("symbol_id", "ordinal", "repo"), ["symbol_id", "ordinal"]), changes, indexed)


def incremental_merge(spark, d):
    s, e = table(spark, d, "symbols"), table(spark, d, "edges")
    drop = I.change_set_files(table(spark, d, "change_sets")).where(F.col("change").isin("modified", "deleted")).select("repo", "file_path").distinct()
    kept, edges = I.drop_files(s, e, drop)
    return G.graph_counts(kept, edges)


def json_roundtrip(spark, d):
    q = F.coalesce(F.from_json(F.to_json("queries"), "array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "enrichment").select("ordinal", _joined(q).alias("queries"), F.size(q).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        split_identifier, query_keywords, symbol_query_flag, lexical_overlap, path_penalty, name_casing, descriptor_core, file_modules, id_parts, search_text, reply_parse, postings_df, doc_lengths,
        bm25_topk, bm25_indexed, vector_topk, rrf_fusion, hybrid_rerank, hybrid_search, import_histogram, layout_dirs, casing_vote, signature_samples, largest_classes, testfile_filter, marker_files,
        docstyle_vote, docstyle_all, guide_evidence, changeset_status, changeset_parse_drop, stale_symbols, incremental_merge, json_roundtrip,
    )
}

_NODES = "nodes AS (SELECT * FROM symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal) = 1)"
_ATT = "att AS (SELECT * FROM edges WHERE src_id IN (SELECT symbol_id FROM nodes) AND dst_id IN (SELECT symbol_id FROM nodes))"
_QS = "qs AS (SELECT DISTINCT q FROM (SELECT unnest(queries) AS q FROM enrichment) WHERE q IS NOT NULL)"
_STOP = "['the','a','an','of','to','in','and','or','for','is','how','do','does','get','that','this','with','on','by']"


def _parts(x: str) -> str:
    camel = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1_\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1_\\2', 'g'), '(\\p{{L}})([^\\p{{L}}_])', '\\1_\\2', 'g'), '([^\\p{{L}}_])(\\p{{L}})', '\\1_\\2', 'g')"
    return f"list_concat([lower({x})], list_filter(list_transform(string_split({camel}, '_'), lambda p: lower(p)), lambda p: strlen(p) >= 2))"


def _uniq(x: str) -> str:
    """Distinct elements in order of first occurrence."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _keywords(q: str) -> str:
    words = f"list_filter(regexp_split_to_array({q}, '[^\\p{{L}}\\p{{N}}_]'), lambda w: w <> '')"
    return f"list_sort(list_distinct(list_filter(flatten(list_transform({words}, lambda w: {_parts('w')})), lambda w: strlen(w) > 2 AND NOT list_contains({_STOP}, w))))"


_SYMBOLIC = "(regexp_matches(trim(q), '::|[._/]') OR (len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) = 1 AND (regexp_matches(trim(q), '\\p{Lu}') OR strlen(trim(q)) <= 24)))"
_PENALTY = """CASE WHEN regexp_matches(lower(file_path), '/test|test_|_test\\.|\\.test\\.|\\.spec\\.|/tests/|/spec/|__tests__|/examples|/legacy|/compat|/migration|/revision') THEN 0.3
    WHEN regexp_matches(lower(file_path), '(/__init__\\.py|package-info\\.java|mod\\.rs)$') THEN 0.5 WHEN lower(file_path) LIKE '%.d.ts' THEN 0.7 ELSE 1.0 END"""
_CASING = """CASE WHEN trim(name, '_') = '' THEN 'other' WHEN NOT regexp_matches(trim(name, '_'), '[a-z]') AND regexp_matches(trim(name, '_'), '[A-Z]') THEN 'SCREAMING_SNAKE'
    WHEN contains(trim(name, '_'), '_') AND regexp_matches(trim(name, '_'), '[a-z]') THEN 'snake_case'
    WHEN regexp_matches(trim(name, '_'), '^[A-Z]') AND regexp_matches(trim(name, '_'), '[a-z]') THEN 'PascalCase'
    WHEN regexp_matches(trim(name, '_'), '^[a-z]') AND regexp_matches(trim(name, '_'), '[A-Z]') THEN 'camelCase' ELSE 'snake_case' END"""
_TEXT = "concat_ws('  ', name, signature, translate(descriptor, '/_.', '   '), docstring)"


def _bm25(docs: str, terms: list[str], limit: int, name: str = "lex") -> str:
    t = "[" + ", ".join(f"'{x}'" for x in terms) + "]"
    return f"""
        {name}_t AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({docs})),
        {name}_n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS m FROM {name}_t),
        {name}_p AS (SELECT id, len(w) AS l, unnest({t}) AS term, w FROM {name}_t),
        {name}_f AS (SELECT id, l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM {name}_p),
        {name}_d AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM {name}_f GROUP BY 1),
        {name} AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) AS score
          FROM {name}_f JOIN {name}_d USING (term), {name}_n GROUP BY id HAVING sum(tf) > 0 ORDER BY score DESC, id LIMIT {limit})"""


_Q_TERMS = ["a", "does", "how", "parser", "pending", "queue", "record", "the"]
_VEC = """q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
    vec AS (SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * q.e[i]::DOUBLE)) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT {})"""
_FILES = """lists AS (SELECT repo, 'added' AS change, unnest(added) AS p FROM change_sets UNION ALL SELECT repo, 'modified', unnest(modified) FROM change_sets UNION ALL SELECT repo, 'deleted', unnest(deleted) FROM change_sets),
    cf AS (SELECT DISTINCT repo, replace(p, '\\', '/') AS file_path, change FROM lists WHERE p IS NOT NULL AND repo IS NOT NULL)"""
_SNAP = """a AS (SELECT repo, file_path AS path, max(ordinal)::VARCHAR AS hash FROM symbols WHERE repo IS NOT NULL AND file_path IS NOT NULL AND indexed_at <= TIMESTAMP '2024-06-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-06-01') GROUP BY ALL),
    b AS (SELECT repo, file_path AS path, max(ordinal)::VARCHAR AS hash FROM symbols WHERE repo IS NOT NULL AND file_path IS NOT NULL AND removed_at IS NULL GROUP BY ALL),
    diff AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
      FROM a FULL JOIN b ON a.repo = b.repo AND a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash)"""
def _hashed(name: str, texts: str) -> str:
    """The default embedding in SQL: (id, k, x) of the places that aren't zero."""
    digit = lambda i: f"(instr('0123456789abcdef', substr(h, {i}, 1)) - 1)"
    return f"""{name}_w AS (SELECT id, md5(w) AS h FROM (SELECT id, unnest(list_filter(regexp_split_to_array(replace(lower(text), '_', ' '), '\\s+'), lambda w: w <> '')) AS w FROM ({texts}))),
        {name}_d AS (SELECT id, ({digit(1)} * 16 + {digit(2)}) % 64 AS k, sum(CASE WHEN {digit(3)} >= 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM {name}_w GROUP BY ALL),
        {name} AS (SELECT id, k, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {name}_d WHERE x <> 0)"""


SQL = {
    "split_identifier": f"WITH {_NODES}, x AS (SELECT DISTINCT name, {_parts('name')} AS p FROM nodes) SELECT name, array_to_string({_uniq('p')}, '|') AS parts FROM x",
    "query_keywords": f"WITH {_QS} SELECT q, array_to_string({_keywords('q')}, '|') AS keywords FROM qs",
    "symbol_query_flag": f"WITH {_NODES}, {_QS} SELECT q, {_SYMBOLIC} AS symbolic, CASE WHEN {_SYMBOLIC} THEN 0.3 ELSE 0.5 END::DOUBLE AS weight FROM (SELECT name AS q FROM nodes UNION SELECT q FROM qs)",
    "lexical_overlap": f"WITH {_NODES} SELECT symbol_id, round(len(list_filter(['load', 'record', 'pars'], lambda k: len(list_filter({_parts('name')}, lambda t: starts_with(t, k))) > 0)) / 3, 6) AS score FROM nodes",
    "path_penalty": f"WITH {_NODES} SELECT DISTINCT file_path, ({_PENALTY})::DOUBLE AS penalty FROM nodes",
    "name_casing": f"WITH {_NODES} SELECT DISTINCT name, {_CASING} AS casing FROM nodes",
    "descriptor_core": f"WITH {_NODES} SELECT symbol_id, regexp_replace(descriptor, '(\\(\\)\\.|#)$', '') AS core FROM nodes",
    "file_modules": f"""WITH {_NODES} SELECT DISTINCT file_path, regexp_replace(regexp_replace(file_path, '\\.[^./]*$', ''), '/__init__$', '') AS module,
        CASE WHEN regexp_matches(lower(file_path), '\\.pyi?$') THEN 'Python' WHEN regexp_matches(lower(file_path), '\\.tsx?$') THEN 'TypeScript' WHEN regexp_matches(lower(file_path), '\\.(jsx?|mjs|cjs)$') THEN 'JavaScript' END AS language FROM nodes""",
    "id_parts": """SELECT DISTINCT src_id, split_part(src_id, ' ', 1) AS scheme, split_part(src_id, ' ', 2) AS package_manager, split_part(src_id, ' ', 3) AS package, split_part(src_id, ' ', 4) AS version,
        regexp_extract(src_id, '^\\S+ \\S+ \\S+ \\S+ (.*)$', 1) AS descriptor, src_id AS rendered, split_part(src_id, ' ', 2) <> '.' AS managed FROM edges""",
    "search_text": f"WITH {_NODES} SELECT symbol_id, {_TEXT} AS text FROM nodes WHERE kind <> 'File'",
    "reply_parse": """WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x)) AS ls, text FROM documents WHERE source = 'summary'),
        x AS (SELECT doc_id, list_filter(ls, lambda x: starts_with(x, 'SUMMARY:')) AS s, list_filter(ls, lambda x: starts_with(x, 'QUERIES:')) AS q, list_filter(ls, lambda x: x <> '') AS f FROM l)
        SELECT doc_id, CASE WHEN len(s) > 0 AND trim(s[-1][9:]) <> '' THEN trim(s[-1][9:]) ELSE coalesce(f[1], '') END AS summary,
          array_to_string(CASE WHEN len(q) > 0 THEN list_filter(list_transform(string_split(q[-1][9:], '|'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END, '|') AS queries FROM x""",
    "postings_df": "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY 1",
    "doc_lengths": "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS len FROM documents",
    "bm25_topk": f"WITH {_bm25('SELECT doc_id AS id, text FROM documents', _Q_TERMS, 20)} SELECT id AS doc_id, round(score, 6) AS score FROM lex",
    "bm25_indexed": f"WITH {_bm25('SELECT doc_id AS id, text FROM documents', ['parser', 'queue', 'record'], 20)} SELECT id AS doc_id, round(score, 6) AS score FROM lex",
    "vector_topk": f"WITH {_VEC.format(20)} SELECT id AS vec_id, round(score, 6) AS score FROM vec",
    "rrf_fusion": f"""WITH {_bm25('SELECT doc_id AS id, text FROM documents', _Q_TERMS, 80)}, {_VEC.format(80)},
        r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM lex UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM vec)
        SELECT id, round(sum(s), 9) AS score FROM r GROUP BY id ORDER BY sum(s) DESC, id LIMIT 40""",
    "hybrid_rerank": f"""WITH {_NODES}, {_ATT}, {_bm25(f"SELECT symbol_id AS id, {_TEXT} AS text FROM nodes WHERE kind <> 'File'", ['bucket', 'header', 'load'], 80)},
        f AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS fused FROM lex),
        d AS (SELECT dst_id, count(*) AS deps FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1),
        e AS (SELECT * FROM enrichment QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal DESC) = 1),
        kw AS (SELECT ['bucket', 'header', 'load', 'load_bucket_header'] AS k),
        s AS (SELECT n.symbol_id, n.name, n.package AS repo, n.file_path || ':' || n.line_start AS location, coalesce(d.deps, 0) AS deps, e.summary, fused,
          fused * CASE WHEN n.kind IN ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Enum') THEN 1.2 ELSE 1.0 END * CASE WHEN lower(n.name) = 'load_bucket_header' THEN 2.5 ELSE 1.0 END
          * ({_PENALTY})::DOUBLE * (1 + 0.15 * ln(1 + coalesce(d.deps, 0))) * (1 + 0.4 * coalesce(list_max(list_transform(e.queries, lambda t: len(list_intersect(kw.k, {_keywords('t')})) / len(kw.k))), 0)) AS score
          FROM f JOIN nodes n ON n.symbol_id = f.id LEFT JOIN d ON d.dst_id = n.symbol_id LEFT JOIN e ON e.symbol_id = n.symbol_id, kw)
        SELECT symbol_id, name, repo, location, round(score, 9) AS score, deps, summary FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name, location ORDER BY score DESC, fused DESC, symbol_id) = 1)
        ORDER BY s.score DESC, fused DESC, symbol_id LIMIT 12""".replace("ORDER BY s.score DESC, fused", "ORDER BY 5 DESC, fused"),
    "import_histogram": f"""WITH {_NODES}, {_ATT}, x AS (SELECT s.package AS repo, s.file_path, CASE WHEN starts_with(t.descriptor, '@') AND contains(t.descriptor, '/')
          THEN split_part(t.descriptor, '/', 1) || '/' || split_part(t.descriptor, '/', 2) ELSE split_part(t.descriptor, '/', 1) END AS module
          FROM att a JOIN nodes s ON s.symbol_id = a.src_id JOIN nodes t ON t.symbol_id = a.dst_id WHERE a.kind = 'Imports')
        SELECT repo, module, count(DISTINCT file_path) AS files FROM x WHERE module <> '' GROUP BY repo, module""",
    "hybrid_search": f"""WITH {_NODES}, {_ATT}, txt AS MATERIALIZED (SELECT symbol_id AS id, {_TEXT} AS text FROM nodes WHERE kind <> 'File'), {_bm25("SELECT * FROM txt", _Q_TERMS, 80)},
        {_hashed('dv', 'SELECT id, text FROM txt')}, {_hashed('qv', "SELECT 0 AS id, '" + QUESTION + "' AS text")},
        vec AS (SELECT txt.id, round(coalesce(v.score, 0), 12) AS score FROM txt LEFT JOIN (SELECT dv.id, sum(dv.x::FLOAT::DOUBLE * qv.x) AS score FROM dv JOIN qv USING (k) GROUP BY 1) v ON v.id = txt.id ORDER BY score DESC, txt.id LIMIT 80),
        both_ AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM lex UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM vec),
        f AS (SELECT id, sum(s) AS fused FROM both_ GROUP BY id ORDER BY fused DESC, id LIMIT 80),
        d AS (SELECT dst_id, count(*) AS deps FROM att WHERE kind IN ('Calls', 'Imports') GROUP BY 1),
        e AS (SELECT * FROM enrichment QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal DESC) = 1),
        kw AS (SELECT ['parser', 'pending', 'queue', 'record'] AS k),
        s AS (SELECT n.symbol_id, n.name, n.kind, n.signature, n.package AS repo, n.file_path || ':' || n.line_start AS location, coalesce(d.deps, 0) AS deps, e.summary, fused,
          fused * CASE WHEN n.kind IN ('Function', 'Method', 'Class', 'Interface', 'Struct', 'Enum') THEN 1.2 ELSE 1.0 END
          * ({_PENALTY})::DOUBLE * (1 + 0.15 * ln(1 + coalesce(d.deps, 0))) * (1 + 0.4 * coalesce(list_max(list_transform(e.queries, lambda t: len(list_intersect(kw.k, {_keywords('t')})) / len(kw.k))), 0)) AS score
          FROM f JOIN nodes n ON n.symbol_id = f.id LEFT JOIN d ON d.dst_id = n.symbol_id LEFT JOIN e ON e.symbol_id = n.symbol_id, kw)
        SELECT symbol_id, name, kind, repo, location, signature, deps, summary FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name, location ORDER BY score DESC, fused DESC, symbol_id) = 1)
        ORDER BY score DESC, fused DESC, symbol_id LIMIT 12""",
    "import_histogram": f"""WITH {_NODES}, {_ATT}, x AS (SELECT s.package AS repo, s.file_path, CASE WHEN starts_with(t.descriptor, '@') AND contains(t.descriptor, '/')
          THEN split_part(t.descriptor, '/', 1) || '/' || split_part(t.descriptor, '/', 2) ELSE split_part(t.descriptor, '/', 1) END AS module
          FROM att a JOIN nodes s ON s.symbol_id = a.src_id JOIN nodes t ON t.symbol_id = a.dst_id WHERE a.kind = 'Imports')
        SELECT repo, module, count(DISTINCT file_path) AS files FROM x WHERE module <> '' GROUP BY repo, module""",
    "layout_dirs": f"WITH {_NODES} SELECT package AS repo, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT file_path) AS files FROM nodes WHERE kind = 'File' GROUP BY ALL",
    "casing_vote": f"""WITH {_NODES}, g AS (SELECT package AS repo, CASE WHEN kind IN ('Function', 'Method') THEN 'functions' WHEN kind IN ('Class', 'Interface') THEN 'types' END AS grp, {_CASING} AS casing FROM nodes),
        c AS (SELECT repo, grp, casing, count(*) AS n FROM g WHERE grp IS NOT NULL GROUP BY ALL)
        SELECT repo, grp AS "group", arg_max(casing, (n, casing)) AS casing, max(n) AS n, sum(n)::BIGINT AS total FROM c GROUP BY ALL""",
    "signature_samples": f"WITH {_NODES} SELECT package AS repo, signature FROM nodes WHERE strlen(signature) > 6 QUALIFY row_number() OVER (PARTITION BY package ORDER BY ordinal) <= 30",
    "largest_classes": """WITH n AS (SELECT * FROM symbols WHERE symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY ordinal) = 1)
        SELECT package AS repo, symbol_id, greatest(line_end - line_start, 0) AS span FROM n WHERE kind = 'Class' QUALIFY row_number() OVER (PARTITION BY package ORDER BY greatest(line_end - line_start, 0) DESC, ordinal) <= 4""",
    "testfile_filter": f"WITH {_NODES} SELECT DISTINCT package AS repo, file_path FROM nodes WHERE kind = 'File' AND regexp_matches(lower(file_path), 'test_|/tests/|(_test\\.py|\\.test\\.ts|\\.spec\\.ts|conftest\\.py)$')",
    "marker_files": """WITH t AS (SELECT repo, file_path, min(text) AS text FROM documents WHERE repo IS NOT NULL AND file_path IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
        m AS (SELECT repo, file_path, 'types' AS section FROM t WHERE regexp_matches(text, 'BaseModel|@dataclass|TypedDict|z\\.object\\(|interface |z\\.infer')
          UNION ALL SELECT repo, file_path, 'decorators' FROM t WHERE regexp_matches(text, '@contextmanager|@property|@staticmethod|@classmethod|Depends\\(|@inject')
          UNION ALL SELECT repo, file_path, 'errors' FROM t WHERE regexp_matches(text, 'except |logger|getLogger|raise |get_config|Settings\\('))
        SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repo, section ORDER BY file_path) <= 4""",
    "docstyle_vote": """WITH t AS (SELECT repo, file_path, min(text) AS text FROM documents WHERE repo IS NOT NULL AND file_path IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
        f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_path) <= 400),
        v AS (SELECT repo, count(*) FILTER (contains(text, 'Args:') OR contains(text, 'Returns:')) AS google, count(*) FILTER (contains(text, 'Parameters' || chr(10))) AS numpy,
          count(*) FILTER (contains(text, ':param ')) AS rest, count(*) FILTER (contains(text, '@param') OR contains(text, '/**')) AS jsdoc FROM f GROUP BY 1)
        SELECT *, CASE greatest(google, numpy, rest, jsdoc) WHEN 0 THEN NULL WHEN jsdoc THEN 'JSDoc' WHEN rest THEN 'reST' WHEN numpy THEN 'NumPy' ELSE 'Google' END AS style FROM v""",
    "docstyle_all": """WITH t AS (SELECT repo, file_path, min(text) AS text FROM documents WHERE repo IS NOT NULL AND file_path IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
        v AS (SELECT repo, count(*) FILTER (contains(text, 'Args:') OR contains(text, 'Returns:')) AS google, count(*) FILTER (contains(text, 'Parameters' || chr(10))) AS numpy,
          count(*) FILTER (contains(text, ':param ')) AS rest, count(*) FILTER (contains(text, '@param') OR contains(text, '/**')) AS jsdoc FROM t GROUP BY 1)
        SELECT *, CASE greatest(google, numpy, rest, jsdoc) WHEN 0 THEN NULL WHEN jsdoc THEN 'JSDoc' WHEN rest THEN 'reST' WHEN numpy THEN 'NumPy' ELSE 'Google' END AS style FROM v""",
    "changeset_status": f"WITH {_SNAP} SELECT * FROM diff",
    "changeset_parse_drop": f"""WITH {_SNAP} SELECT repo, path, status IN ('added', 'modified') AS to_parse, status IN ('modified', 'deleted') AS to_drop FROM diff""",
    "stale_symbols": f"""WITH {_NODES}, {_FILES} SELECT DISTINCT symbol_id FROM nodes n WHERE n.repo IS NULL OR n.repo NOT IN (SELECT repo FROM repo_meta WHERE lower(trim(status)) = 'ok' AND repo IS NOT NULL)
        OR EXISTS (SELECT 1 FROM cf WHERE cf.repo = n.repo AND cf.file_path = n.file_path AND cf.change IN ('added', 'modified'))""",
    "incremental_merge": f"""WITH {_FILES}, gone AS (SELECT DISTINCT repo, file_path FROM cf WHERE change IN ('modified', 'deleted')),
        k AS (SELECT s.*, EXISTS (SELECT 1 FROM gone g WHERE g.repo = s.repo AND g.file_path = s.file_path) AS dropped FROM symbols s)
        SELECT (SELECT count(*) FROM k WHERE NOT dropped) AS nodes, (SELECT count(*) FROM edges WHERE src_id NOT IN (SELECT symbol_id FROM k WHERE dropped)) AS edges""",
    "json_roundtrip": "SELECT ordinal, array_to_string(coalesce(queries, []), '|') AS queries, len(coalesce(queries, []))::INT AS n FROM enrichment",
}
