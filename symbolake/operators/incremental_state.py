"""Processing only new or changed records (problem 5).

`StateStore` keeps the key and content hash of every record that a successful run has processed, in numbered versions
of which the last is current. A run hashes its rows, joins them with the current version, works on what is new or
changed and then commits: its rows are written beside the older ones and one record makes them part of the state. A run
that dies before leaves the old version current, and the next run selects the same records again; of two runs at once
the second to commit is told that its state is stale.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symbolake.sources.pointer import Pointer


def content_hash(*cols: str) -> Column:
    """128 bits over the columns; nulls differ from empty values and columns do not run into each other."""
    framed = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat(*framed)) if cols else F.lit("")


#: Parts of a state at which a commit writes it anew as one.
PARTS = 16


class StateStore:
    """Versions of (keys..., content_hash, and `also`, columns kept with them) under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], also: T.StructType | None = None):
        self.spark, self.path, self.keys, self.also = spark, path.rstrip("/"), list(keys), list(also or [])
        self.pointer = Pointer(spark, self.path)
        self.version = self.pointer.number()

    def _record(self) -> dict:
        return json.loads(self.pointer.read(self.version) or '{"parts": [], "note": null}')

    def note(self):
        """What the last commit said of itself."""
        return self._record()["note"]

    def read(self, like: DataFrame) -> DataFrame:
        """The state as this store has seen it last: of each key the part written last. Before the first commit an empty one with the key types of `like`."""
        own = [T.StructField(k, like.schema[k].dataType) for k in self.keys] + [T.StructField("content_hash", T.StringType()), *self.also]
        parts, schema = self._record()["parts"], T.StructType(own)
        if not parts:
            return self.spark.createDataFrame([], schema)
        if len(parts) == 1:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{parts[0]}")
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{p}").withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        return _last(reduce(DataFrame.unionByName, each), self.keys, schema.names)

    def changes(self, rows: DataFrame, content: list[str]) -> DataFrame:
        """The rows that are new or whose content differs from the state, with `content_hash`, `change_type` and what the state has of `also`.

        Null keys compare equal to null keys. Rows repeated under a key each come out. Rows gone from `rows` don't.
        """
        now = rows.withColumn("content_hash", content_hash(*content)).alias("n")
        old = self.read(rows).alias("o")
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys]
        kind = F.when(F.col("o.content_hash").isNull(), "new").otherwise("changed")
        joined = now.join(old, reduce(Column.__and__, same), "left").where(F.col("o.content_hash").isNull() | (F.col("o.content_hash") != F.col("n.content_hash")))
        return joined.select("n.*", kind.alias("change_type"), *(F.col(f"o.{f.name}") for f in self.also))

    def stage(self, rows: DataFrame) -> str:
        """Writes a part (one row a key, the greatest hash of repeated keys) without making it current."""
        name = f"part-{uuid.uuid4().hex}"
        rest = [f.name for f in self.also]
        most = rows.groupBy(*self.keys).agg(F.max(F.struct("content_hash", *rest)).alias("m"))
        most.select(*self.keys, *(F.col(f"m.{c}").alias(c) for c in ["content_hash", *rest])).write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, processed: DataFrame, note=None, anew: bool = False) -> int:
        """Puts processed rows (keys, `content_hash`, `also`) into the state, or with `anew` makes them all of it; returns the version.

        Only they are written, but every PARTS commits the whole. `pointer.Stale` if the state is no longer the one seen:
        nothing has changed then, and a new store selects what is left.
        """
        parts = [] if anew else self._record()["parts"]
        done = processed.select(*self.keys, "content_hash", *(f.name for f in self.also))
        if len(parts) + 1 >= PARTS:
            both = self.read(processed).withColumn("_part", F.lit(0)).unionByName(done.withColumn("_part", F.lit(1)))
            done, parts = _last(both, self.keys, done.columns), []
        self.pointer.put(self.version, json.dumps({"parts": [*parts, self.stage(done)], "note": note}))
        self.version += 1
        return self.version


def _last(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("_part", *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


ITEM = ["repo", "commit", "file_path", "change"]
FILE = ITEM[:3]
#: What can happen to a path in a commit; a set of them is a sum of the numbers.
CHANGES = {"added": 1, "modified": 2, "deleted": 4}


def changed_paths(change_sets: DataFrame) -> DataFrame:
    """One row per (repo, commit, file_path): seq, and for each kind of change the first arrival of a delivery that has it (at_added, ...), null without.

    Either separator becomes `/`. Null and empty lists hold nothing, null paths are dropped, repeated paths and
    deliveries fall together. The lists are aggregated before they are shuffled.
    """
    lists = F.explode(F.array(*(F.struct(F.lit(c).alias("change"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("paths")) for c in CHANGES)))
    each = change_sets.select("repo", "commit", "seq", "arrived_at", lists.alias("l")).select("repo", "commit", "seq", "arrived_at", "l.change", F.explode("l.paths").alias("p"))
    path = F.translate("p", "\\", "/").alias("file_path")
    first = [F.min(F.when(F.col("change") == c, F.coalesce("arrived_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")))).alias(f"at_{c}") for c in CHANGES]
    return each.where("p is not null").select("repo", "commit", "seq", "arrived_at", "change", path).groupBy(*FILE).agg(F.min("seq").alias("seq"), *first)


def _mask(test) -> Column:
    """The set of the changes of which `test` of the first arrival holds."""
    return reduce(Column.__add__, [F.when(test(F.col(f"at_{c}")), n).otherwise(0) for c, n in CHANGES.items()])


def successful_runs(repo_meta: DataFrame, change_sets: DataFrame) -> DataFrame:
    """Per repo and position that a successful run reached: the latest start. Unknown commits and null starts reach nothing."""
    ok = repo_meta.where((F.lower(F.trim("status")) == "ok") & F.col("started_at").isNotNull()).groupBy("repo", "commit").agg(F.max("started_at").alias("started_at"))
    known = change_sets.where("seq is not null").groupBy("repo", "commit").agg(F.min("seq").alias("seq"))
    return ok.join(known, ["repo", "commit"]).groupBy("repo", "seq").agg(F.max("started_at").alias("started_at"))


#: Positions of a repo's history that one window task handles; a long history spreads over tasks.
BLOCK = 4096


def coverage(items: DataFrame, runs: DataFrame) -> DataFrame:
    """`items` with `covered_to`: the latest start of a successful run at or beyond the item's position in its repo.

    A suffix maximum in two steps, inside blocks of positions and over blocks, so no task holds a repo's whole history.
    """
    points = items.select("repo", "seq").distinct().withColumn("started_at", F.lit(None).cast("timestamp_ntz")).unionByName(runs.select("repo", "seq", "started_at"))
    points = points.groupBy("repo", "seq").agg(F.max("started_at").alias("started_at")).withColumn("block", F.floor(F.col("seq") / BLOCK))
    inside = Window.partitionBy("repo", "block").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("repo").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = points.groupBy("repo", "block").agg(F.max("started_at").alias("m")).select("repo", "block", F.max("m").over(later).alias("beyond"))
    at = points.select("repo", "seq", "block", F.max("started_at").over(inside).alias("within")).join(blocks, ["repo", "block"])
    upto = at.select("repo", "seq", F.greatest("within", "beyond").alias("covered_to"))
    return items.join(upto, ["repo", "seq"], "left")


def uncovered_changes(change_sets: DataFrame, repo_meta: DataFrame, state_dir: str) -> DataFrame:
    """Problem 5: the items (repo, commit, file_path, change) that no successful run covers.

    The state holds a path of a commit with the set of its changes that runs have covered; a delivery that completes or corrects
    a commit changes the set. The log of successful runs is replayed into the state, unless the state is of the
    same log and deliveries; today's paths are hashed and joined with it, and of those new or changed the changes
    come out that the state doesn't have.
    """
    store = StateStore(change_sets.sparkSession, state_dir, FILE, T.StructType([T.StructField("covered", T.IntegerType())]))
    log = repo_meta.select("repo", "commit", "started_at", "status"), change_sets.select("repo", "commit", "seq", "arrived_at", *CHANGES)
    digest = [str(x) for df in log for x in df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()]
    paths = changed_paths(change_sets)
    if store.note() != digest:
        covered = _mask(lambda at: at <= F.col("covered_to"))
        seen = coverage(paths, successful_runs(repo_meta, change_sets)).withColumn("covered", covered.cast("int")).where("covered > 0")
        store.commit(seen.withColumn("content_hash", content_hash("covered")), digest, anew=True)
    todo = store.changes(paths.select(*FILE, _mask(lambda at: at.isNotNull()).cast("int").alias("changes")), ["changes"])
    left = F.filter(F.array(*(F.when(F.col("changes").bitwiseAND(n) > F.coalesce(F.col("covered"), F.lit(0)).bitwiseAND(n), c) for c, n in CHANGES.items())), lambda c: c.isNotNull())
    return todo.select(*FILE, F.explode(left).alias("change"))
