"""Lexical and vector retrieval, fusion and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symbolake.functions import text as X
from symbolake.operators.reports import DEFINITIONS, newest_enrichment
from symbolake.runtime import materialize

K1, B = 1.2, 0.75
#: Candidates of each list before fusion, and the constant of reciprocal rank fusion.
POOL, RRF_K = 80, 60
#: Rows from which a vector index is built.
INDEX_ROWS = 10_000
# Factors of the reranking.
DEFINITION_BOOST, NAME_BOOST, CENTRALITY, QUESTIONS = 1.2, 2.5, 0.15, 0.4
WORD = r"[\p{L}\p{N}]+"


def tokens(text: str):
    """Lower-case words of a text column; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0)


def build_text_index(docs: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """The tables of a BM25 index: postings (term, key, tf), doc_len (key, len), term_df (term, df).

    Words are counted per document before they are shuffled, so a frequent term costs one row a document. Documents
    with null key are left out; the rows of a repeated key count as one document.
    """
    t = docs.where(F.col(key).isNotNull()).select(key, tokens(text).alias("_t"))
    postings = t.select(key, F.explode("_t").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    length = t.groupBy(key).agg(F.sum(F.size("_t")).alias("len"))
    return {"postings": postings, "doc_len": length, "term_df": postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))}


def _idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _equals(term: str):
    return lambda w: w == F.lit(term)


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int = POOL) -> DataFrame:
    """Top (key, score) of a query without an index: one scan of the texts, which are not shuffled.

    The scan leaves a row of counts per document: its words and the query's terms. Statistics and scores come from those.
    Equal scores go by key; documents with null key are left out.
    """
    spark = docs.sparkSession
    terms = sorted({str(w) for w in spark.range(1).select(F.explode(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(WORD), 0))).toPandas().iloc[:, 0]})
    kind = docs.schema[key].dataType
    if not terms:
        return spark.createDataFrame([], T.StructType([T.StructField(key, kind), T.StructField("score", T.DoubleType())]))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    one_of = rf"(?<![\p{{L}}\p{{N}}])({'|'.join(terms)})(?![\p{{L}}\p{{N}}])"
    read = docs.where(F.col(key).isNotNull()).select(key, F.regexp_count(low, F.lit(WORD)).alias("len"), F.regexp_extract_all(low, F.lit(one_of), 1).alias("_t"))
    counted = materialize(read.select(key, "len", *(F.size(F.filter("_t", _equals(x))).alias(f"t{i}") for i, x in enumerate(terms))), "counted")
    s = counted.agg(F.count(F.lit(1)), F.avg("len"), *(F.count_if(F.col(f"t{i}") > 0) for i in range(len(terms)))).first()
    n, mean = s[0], s[1] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        f = F.col(f"t{i}")
        score = score + _idf(F.lit(float(n)), F.lit(float(s[2 + i]))) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(mean))))
    return counted.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def bm25_indexed(index: dict[str, DataFrame], key: str, terms: list[str], limit: int = POOL) -> DataFrame:
    """Top (key, score) of the terms from the tables of `build_text_index`: only the postings of the terms are read."""
    s = index["doc_len"].agg(F.count(F.lit(1)), F.avg("len")).first()
    df = {r.term: r.df for r in index["term_df"].where(F.col("term").isin(terms)).collect()}  # at most len(terms) rows
    if not df:
        return index["doc_len"].select(key, F.lit(0.0).alias("score")).limit(0)
    idf = F.create_map(*[x for t, d in df.items() for x in (F.lit(t), _idf(F.lit(float(s[0])), F.lit(float(d))))])
    p = index["postings"].where(F.col("term").isin(list(df))).join(index["doc_len"], key)
    part = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(s[1]))))
    return p.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def dot(a: str, vector: list[float]):
    """Dot product of an array column with a constant vector, in double."""
    return F.aggregate(F.zip_with(F.col(a), F.array(*(F.lit(float(x)) for x in vector)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def vector_topk(rows: DataFrame, key: str, embedding: str, vector: list[float], limit: int = POOL) -> DataFrame:
    """Exact nearest rows by dot product: (key, score), to twelve digits, so that ties don't hang on the order of a sum. Null vectors, and vectors of another width, are left out."""
    fit = rows.where(F.col(embedding).isNotNull() & (F.size(embedding) == len(vector)))
    return fit.select(key, F.round(dot(embedding, vector), 12).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def ivf_index(rows: DataFrame, key: str, embedding: str, cells: int = 32, sample: int = 20_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """Vector index for INDEX_ROWS rows and more: centres fitted on at most `sample` rows, and every row with its cell.

    The sample is those of smallest key hash; all rows are assigned and none is lost. Search with `ivf_topk`.
    """
    got = rows.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(embedding).toPandas()[embedding]
    if got.empty:
        return rows.select(key, embedding, F.lit(0).alias("cell")), np.zeros((1, 1))
    x = np.stack([np.asarray(v, dtype=float) for v in got])
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(12):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            if (own == c).any():
                m = x[own == c].mean(axis=0)
                centre[c] = m / max(np.linalg.norm(m), 1e-12)
    held = rows.sparkSession.sparkContext.broadcast(centre)

    @F.pandas_udf(T.IntegerType())
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack([np.asarray(a, dtype=float) for a in v]) @ held.value.T).argmax(axis=1).astype(np.int32), index=v.index) if len(v) else pd.Series([], dtype=np.int32)

    return rows.where(F.col(embedding).isNotNull()).select(key, embedding, cell(embedding).alias("cell")), centre


def ivf_topk(indexed: DataFrame, centre: np.ndarray, key: str, embedding: str, vector: list[float], limit: int = POOL, probes: int = 8) -> DataFrame:
    """Approximate nearest rows: exact scores in the `probes` cells nearest to the query. More probes, more recall."""
    near = np.argsort(-(centre @ np.asarray(vector, dtype=float)))[:probes]
    return vector_topk(indexed.where(F.col("cell").isin([int(c) for c in near])), key, embedding, vector, limit)


def rrf(lists: list[DataFrame], key: str, limit: int = POOL, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of short (key, score) lists: (key, score). Ranks count from 1; ties by key."""
    parts = []
    for one in lists:
        # Each list is a top-k result of a bounded number of rows, so one window over it is one small task.
        parts.append(one.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("r")).select(key, (1.0 / (k + F.col("r"))).alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def rerank(candidates: DataFrame, nodes: DataFrame, deps: DataFrame, enrichment: DataFrame, query: str, limit: int = 12, repo: str | None = None) -> DataFrame:
    """Final hits of (symbol_id, score) candidates: (symbol_id, name, kind, repo, location, signature, score, deps, summary).

    The score is multiplied by boosts for definitions, exact names of symbol-like queries, centrality and matching
    generated questions, and by the path penalty. Candidates without node are dropped; of equal (name, location) the best
    stays; ties go by the candidate's score, then id. A repo is filtered before the limit.
    """
    n = nodes if repo is None else nodes.where(F.lower("package") == repo.lower())
    c = materialize(candidates.withColumnRenamed("score", "fused"), "candidates")  # a top-k list, read by each side
    ids = F.broadcast(c.select("symbol_id"))
    # Nodes, dependents and enrichment are aggregates by id: only the candidates' rows go into them.
    some = lambda df: df.join(ids, "symbol_id", "left_semi")
    hit = some(n).join(F.broadcast(c), "symbol_id").join(some(deps), "symbol_id", "left").join(newest_enrichment(some(enrichment)), "symbol_id", "left")
    q = F.lit(query)
    words = X.query_keywords(q)
    overlap = F.coalesce(F.array_max(F.transform("queries", lambda t: F.size(F.array_intersect(words, X.query_keywords(t))) / F.size(words))), F.lit(0.0))
    score = (
        F.col("fused") * F.when(F.col("kind").isin(DEFINITIONS), DEFINITION_BOOST).otherwise(1.0)
        * F.when(X.is_symbol_query(q) & (F.lower("name") == F.lower(F.trim(q))), NAME_BOOST).otherwise(1.0)
        * X.path_penalty("file_path") * (1 + CENTRALITY * F.log(1.0 + F.coalesce("deps", F.lit(0))))
        * (1 + QUESTIONS * F.when(F.size(words) > 0, overlap).otherwise(0.0))
    )
    location = F.concat_ws(":", "file_path", F.col("line_start").cast("string"))
    scored = hit.select("symbol_id", "name", "kind", F.col("package").alias("repo"), location.alias("location"), "signature", score.alias("score"), "fused", F.coalesce("deps", F.lit(0)).alias("deps"), "summary")
    best = Window.partitionBy("name", "location").orderBy(F.desc("score"), F.desc("fused"), "symbol_id")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").orderBy(F.desc("score"), F.desc("fused"), "symbol_id").limit(limit).drop("_n", "fused")


#: Width of the default embedding.
DIM = 64


def hashed_vectors(texts: pd.Series, dim: int = DIM) -> np.ndarray:
    """Deterministic unit vectors of texts: signed hashed sub-tokens (of a token's MD5 the first byte names the place, the next bit the sign). The offline default of the embedder."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in (t or "").lower().replace("_", " ").split():
            h = hashlib.md5(w.encode()).digest()
            out[i, h[0] % dim] += 1.0 if h[1] >> 7 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1.0)


def embed(df: DataFrame, text: str, embedder=hashed_vectors) -> DataFrame:
    """`df` with `vector` (array of float) by an embedder: a function from a Series of texts to a matrix, run on Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.asarray(embedder(s), dtype=np.float32)), index=s.index)

    return df.withColumn("vector", vec(text))


def search_rows(symbols: DataFrame) -> DataFrame:
    """(symbol_id, text) of every symbol but Files."""
    return symbols.where(F.col("kind") != "File").select("symbol_id", X.search_text().alias("text"))


def hybrid(spark: SparkSession, search: DataFrame, nodes: DataFrame, deps: DataFrame, enrichment: DataFrame, query: str, limit: int = 12, repo: str | None = None, embedder=hashed_vectors) -> DataFrame:
    """Hybrid search over `search` (symbol_id, text, vector): lexical and vector lists, fused, reranked."""
    if repo is not None:
        search = search.join(nodes.where(F.lower("package") == repo.lower()).select("symbol_id"), "symbol_id", "left_semi")
    v = np.asarray(embedder(pd.Series([query])))[0].tolist()
    fused = rrf([bm25(search, "symbol_id", "text", query), vector_topk(search, "symbol_id", "vector", v)], "symbol_id")
    return rerank(fused, nodes, deps, enrichment, query, limit, repo)
