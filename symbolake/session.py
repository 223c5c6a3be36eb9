"""The engine's facade: build an index of source trees and ask it.

`Session.tables` give DataFrames for further queries; the tool methods give plain dictionaries, whole unless they have a limit.
"""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolake.functions import text as X
from symbolake.operators import graph as G
from symbolake.operators import incremental as I
from symbolake.operators import reports as R
from symbolake.operators import retrieval as V
from symbolake.operators import style as S
from symbolake.operators.resolve import resolve
from symbolake.providers import complete_all
from symbolake.runtime import materialize, scope, shed_shuffles
from symbolake.sources import git, manifests
from symbolake.sources.repo_walk import parse, parse_files, read_trees
from symbolake.sources.store import GraphStore


def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]


def _scoped(method):
    """A method whose result is no frame: what it writes on the way is deleted when it ends."""

    @wraps(method)
    def run(self, *args, **kw):
        with scope(self.spark):
            return method(self, *args, **kw)

    return run


class Session:
    """A graph under `path` and the tools over it."""

    def __init__(self, spark: SparkSession, path: str, provider=None, embedder=V.hashed_vectors):
        self.spark, self.store, self.provider, self.embedder = spark, GraphStore(spark, path), provider, embedder
        self._loaded: tuple | None = None

    # ---- building

    @_scoped
    def link(self, roots: list[str], embed: bool = True, enrich: bool = False, flows: bool = False, guide: bool = False, max_enrich: int | None = None, max_flows: int | None = None) -> dict:
        """Indexes the trees together and commits all tables at once; returns counts."""
        files = read_trees(self.spark, roots)
        symbols, raw = parse(files)
        commits = {repo_name(r): c for r in roots if (c := git.head_commit(r))}
        return self._finish(symbols, raw, commits, files, embed, enrich, flows, guide, max_enrich, max_flows, roots=roots)

    @_scoped
    def index(self, root: str, **steps) -> dict:
        """Indexes one tree; other repos of the index stay as they are."""
        files = read_trees(self.spark, [root])
        symbols, raw = parse(files)
        name = repo_name(root)
        old_s, old_r = self.store.read("symbols").where(F.col("package") != name), self.store.read("raw_edges").where(F.col("src_package") != name)
        return self._finish(_after(old_s, symbols), _after(old_r, raw), _commit(root), files, roots=[root], **steps)

    @_scoped
    def index_incremental(self, root: str, since: str | None = None, **steps) -> dict:
        """Re-reads only files that changed since the recorded (or given) commit; the result equals a full rebuild."""
        name = repo_name(root)
        base = since or self.store.repo_commits().get(name)
        if base is None:
            return self.index(root, **steps)
        change = git.changed_files(root, base)
        if not change.total():
            return {"changed": 0, "version": self.store.version()}
        diff = self.spark.createDataFrame([(name, p, s) for s in ("added", "modified", "deleted") for p in getattr(change, s)], "repo string, path string, status string")
        files = read_trees(self.spark, [root])
        symbols, raw = parse_files(self.spark, [root], [(name, p) for p in [*change.added, *change.modified]])
        old_s, old_r = self.store.read("symbols"), self.store.read("raw_edges")
        kept, edges = I.drop_files(old_s, old_r, diff.where(F.col("status") != "added").select("repo", F.col("path").alias("file_path")))
        stale = I.stale_symbols(symbols, diff.select("repo", F.col("path").alias("file_path"), F.col("status").alias("change")), self.store.read("repo_meta"))
        return {"changed": change.total(), **self._finish(_after(kept, symbols), _after(edges, raw), _commit(root), files, stale=stale, roots=[root], **steps)}

    def _finish(self, symbols, raw, commits, files, embed=True, enrich=False, flows=False, guide=False, max_enrich=None, max_flows=None, stale=None, roots=None) -> dict:
        symbols, raw = materialize(symbols, "symbols"), materialize(raw, "raw")
        bound, stats = resolve(symbols, raw)
        order = raw.groupBy("src_id", "kind").agg(F.min("ordinal").alias("ordinal"))
        edges = materialize(bound.join(order, ["src_id", "kind"], "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n"), "edges")
        tables = {"symbols": symbols, "edges": edges, "raw_edges": raw, "repo_meta": self.store.with_commits(commits)}
        nodes = G.node_set(symbols)
        gone = stale if stale is not None else symbols.select("symbol_id")
        if embed:
            search = V.search_rows(symbols)
            tables["search"] = I.refresh_vectors(search, self.store.read("search"), gone, lambda df: V.embed(df, "text", self.embedder))
        if enrich and self.provider:
            tables["enrichment"] = self._enrich(nodes, edges, gone, max_enrich)
        if flows and self.provider:
            tables["flows"] = self._flows(nodes, edges, max_flows)
        if guide and self.provider:
            tables["style_guide"] = self._guide(symbols, edges, files, roots or [])
        version = self.store.commit(**tables)
        self._loaded = None
        n, m = self.store.counts()
        return {"version": version, "symbols": n, "edges": m, **stats.first().asDict()}

    def _enrich(self, nodes, edges, stale, limit) -> DataFrame:
        prior = self.store.read("enrichment")
        top = R.enrich_candidates(nodes, edges, limit or None, prior, stale)
        ask = top.where(~F.col("reuse")).withColumn("prompt", F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "signature", "file_path"))
        said = complete_all(ask, "symbol_id", "prompt", "summary", self.provider).where("reply is not null").select("symbol_id", X.summary_reply("reply").alias("r")).select("symbol_id", "r.summary", "r.queries")
        return materialize(R.merge_enrichment(said, prior, top.where("reuse")), "enrichment").withColumn("ordinal", F.lit(0).cast("long"))

    def _flows(self, nodes, edges, limit) -> DataFrame:
        top = materialize(R.flow_candidates(nodes, edges, limit), "flows")
        hops = G.reach(top, edges).join(G.project_nodes(nodes), "symbol_id").select("origin", "depth", "name", "location")
        said = complete_all(R.trace_text(hops), "origin", "trace", "flow", self.provider).where("reply is not null").select(F.col("origin").alias("symbol_id"), X.narration_reply("reply").alias("r"))
        return materialize(said.select("symbol_id", "r.narration", "r.queries"), "flows")

    def _guide(self, symbols, edges, files, roots) -> DataFrame:
        texts = files.select("repo", F.col("path").alias("file_path"), F.col("content").alias("text"))
        declared = [(repo_name(r), x, t) for r in roots for x, t in (("stack", manifests.declared(r)), ("naming", manifests.formatting(r))) if t]
        declared = self.spark.createDataFrame(declared, "repo string, section string, evidence string")
        ev = S.guide_evidence(symbols, edges, texts, declared).withColumn("key", F.concat_ws("\n", "repo", "section"))
        said = complete_all(ev, "key", "evidence", "guide", self.provider).where(F.col("reply").isNotNull() & ~F.lower("reply").contains("no convention"))
        part = F.split("key", "\n")
        rows = F.array_sort(F.collect_list(F.struct(part[1].alias("s"), "reply")))  # at most ten sections
        return materialize(said.groupBy(part[0].alias("repo")).agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("## "), r.s, F.lit("\n\n"), r.reply)), "\n\n").alias("content")), "guide")

    # ---- reading

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges), written once per index version for the following queries."""
        version = self.store.version()
        if not version:
            raise FileNotFoundError(f"no index in {self.store.path}; build one with `link` or `index`")
        if self._loaded is None or self._loaded[0] != version:
            with shed_shuffles(self.spark):
                nodes = materialize(G.node_set(self.store.read("symbols")), "nodes", keep=True)
                self._loaded = version, nodes, materialize(G.attach_edges(self.store.read("edges"), nodes), "adjacency", keep=True)
        return self._loaded[1:]

    def _cards(self, nodes: DataFrame, limit: int | None = None) -> list[dict]:
        return _rows(R.with_enrichment(G.project_nodes(nodes), self.store.read("enrichment")), limit)

    def _focus(self, focus: str):
        nodes, edges = self.graph()
        found = G.lookup(nodes, focus).collect()
        return nodes, edges, (self.spark.createDataFrame([(found[0].symbol_id,)], "symbol_id string") if found else None)

    @_scoped
    def search(self, query: str, limit: int = 12, repo: str | None = None) -> dict:
        if self.store.read("search").isEmpty():
            return {"query": query, "results": [], "note": "the index was built without embeddings"}
        nodes, edges = self.graph()
        hits = V.hybrid(self.spark, self.store.read("search"), nodes, G.dependents(edges), self.store.read("enrichment"), query, limit, repo, self.embedder)
        return {"query": query, "results": _rows(hits, limit)}

    def repos(self) -> dict:
        return {"repos": _rows(G.repos(self.graph()[0]).orderBy("repo"))}

    @_scoped
    def suggest(self, about: str | None = None, limit: int = 40) -> dict:
        rows = _rows(R.suggest(self.store.read("enrichment"), self.graph()[0], about, limit), limit)
        return {"total": rows[0]["total"] if rows else 0, "suggestions": [{k: r[k] for k in ("question", "symbol", "location")} for r in rows]}

    @_scoped
    def find(self, query: str, limit: int = 20, repo: str | None = None) -> dict:
        nodes, _ = self.graph()
        top = G.find(nodes, query, limit, repo)
        order = {r.symbol_id: n for n, r in enumerate(top.select("symbol_id").collect())}
        return {"query": query, "results": sorted(self._cards(top, limit), key=lambda n: order[n["symbol_id"]])}

    @_scoped
    def zoom(self, focus: str) -> dict:
        nodes, edges, at = self._focus(focus)
        empty = {"query": focus, "found": False, "focus": None, "container": None, "members": [], "callers": [], "callees": [], "importers": []}
        if at is None:
            return empty
        around = _rows(R.with_enrichment(G.zoom(at, edges, nodes), self.store.read("enrichment")))
        by = lambda r: sorted(({k: v for k, v in x.items() if k != "relation"} for x in around if x["relation"] == r), key=lambda n: n["symbol_id"])
        box = by("container")
        return {**empty, "found": True, "focus": self._cards(nodes.join(at, "symbol_id"))[0], "container": box[0] if box else None, "members": by("member"), "callers": by("caller"), "callees": by("callee"), "importers": by("importer")}

    @_scoped
    def ripple(self, focus: str, depth: int = G.DEPTH) -> dict:
        nodes, edges, at = self._focus(focus)
        if at is None:
            return {"focus": focus, "found": False, "total_dependents": 0, "by_repo": [], "dependents": []}
        reached = materialize(G.ripple(at, edges, nodes, depth), "ripple")
        return {"focus": focus, "found": True, "total_dependents": reached.count(), "by_repo": _rows(R.by_repo(reached, nodes).orderBy(F.desc("symbols"), "repo")), "dependents": self._hops(reached, nodes)}

    def ripple_rows(self, focus: str, depth: int = G.DEPTH) -> DataFrame:
        """The dependents of `ripple` as a frame, which the driver never holds: a hub's can be a large part of all symbols."""
        nodes, edges, at = self._focus(focus)
        if at is None:
            return G.hops(self.spark.createDataFrame([], "symbol_id string, depth int, via string"), nodes)
        with shed_shuffles(self.spark):
            return G.hops(G.ripple(at, edges, nodes, depth), nodes)

    def _hops(self, reached, nodes) -> list[dict]:
        return _rows(G.hops(reached, nodes).orderBy("depth", "repo", "name", "symbol_id"))

    @_scoped
    def thread(self, focus: str, depth: int = G.DEPTH) -> dict:
        nodes, edges, at = self._focus(focus)
        return {"focus": focus, "trace": [] if at is None else self._hops(G.thread(at, edges, nodes, depth), nodes)}

    @_scoped
    def flow(self, focus: str, depth: int = G.DEPTH) -> dict:
        nodes, edges, at = self._focus(focus)
        if at is None:
            return {"focus": focus, "found": False, "narration": None, "queries": [], "trace": []}
        told = _rows(self.store.read("flows").join(at, "symbol_id"), 1)
        return {"focus": focus, "found": True, "narration": told[0]["narration"] if told else None, "queries": (told[0]["queries"] or []) if told else [], "trace": self._hops(G.thread(at, edges, nodes, depth), nodes)}

    @_scoped
    def context_pack(self, focus: str, token_budget: int = G.BUDGET) -> dict:
        nodes, edges, at = self._focus(focus)
        if at is None:
            return {"focus": focus, "found": False, "est_total_tokens": 0, "token_budget": token_budget, "items": []}
        pack = G.context_pack(at, edges, nodes, token_budget)
        cards = R.with_enrichment(G.project_nodes(nodes), self.store.read("enrichment"))
        items = _rows(pack.join(cards, "symbol_id").orderBy("position").select("symbol_id", "name", "location", "est_tokens", "summary"))
        return {"focus": focus, "found": True, "est_total_tokens": sum(i["est_tokens"] for i in items), "token_budget": token_budget, "items": items}

    def guide(self, repo: str | None = None) -> dict:
        text = R.combine_guides(self.store.read("style_guide"), repo).first().guide
        return {"found": bool(text), "guide": text or None}

    @_scoped
    def stats(self) -> dict:
        nodes, edges = self.graph()
        return {"stats": _rows(R.stats_by_repo(nodes, edges, self.store.read("enrichment")).orderBy("repo", "kind"))}

    def explore(self, focus: str) -> dict:
        return {"zoom": self.zoom(focus), "ripple": self.ripple(focus), "context_pack": self.context_pack(focus)}

    def changed(self, root: str, since: str | None = None) -> dict:
        base = since or (self.store.repo_commits().get(repo_name(root)) if self.store.exists() else None)
        if base is None:
            return {"base": None, "added": [], "modified": [], "deleted": []}
        c = git.changed_files(root, base)
        return {"base": base, "added": c.added, "modified": c.modified, "deleted": c.deleted}


def repo_name(root: str) -> str:
    """A repo's name: its folder's."""
    return os.path.basename(os.path.abspath(root))


def _commit(root: str) -> dict[str, str]:
    c = git.head_commit(root)
    return {repo_name(root): c} if c else {}


def _after(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows behind the old ones in input order."""
    last = old.agg(F.max("ordinal")).first()[0]
    return old.unionByName(new.withColumn("ordinal", F.col("ordinal") + (0 if last is None else last + 1)))
