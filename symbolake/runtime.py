"""Session helpers shared by all operators: table loading, reliable materialisation, heavy keys.

Nothing here keeps data on an executor only: `materialize` writes to the folder that the session names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, on one machine only, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.symbolake.sharedDir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='symbolake-')}"
        spark.conf.set("spark.symbolake.sharedDir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Folders of this process in the shared folder, for `clear`; the first for `scope`, too.
_WRITTEN: list[str] = []
_KEPT: list[str] = []


def _delete(spark: SparkSession, paths: list[str], down_to: int = 0) -> int:
    path, conf, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while len(paths) > down_to:
        at = path(paths.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def clear(spark: SparkSession) -> int:
    """Deletes what this process wrote in the shared folder so far; frames made from it can't be read any more. Returns the number of folders."""
    return _delete(spark, _WRITTEN) + _delete(spark, _KEPT)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what `materialize` wrote in it, for work whose result is no frame."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        _delete(spark, _WRITTEN, before)


@contextmanager
def shed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write or other action in it are deleted as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def place(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; `clear` deletes it."""
    _KEPT.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _KEPT[-1]


def materialize(df: DataFrame, label: str = "t", keep: bool = False) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back, so its size is known to the planner; with `keep` beyond the `scope` it is written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_KEPT if keep else _WRITTEN).append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str = "t") -> tuple[DataFrame, int]:
    """`materialize`, and the number of rows, counted as they are written."""
    rows = Observation()
    out = materialize(df.observe(rows, F.count(F.lit(1)).alias("n")), label)
    return out, int(rows.get["n"])


#: Estimated bytes below which no key is heavy: all rows of such a table are one task's work.
LIGHT_BYTES = 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; of files it is their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> bool:
    """Whether the planner's estimate of a frame is below what it broadcasts by itself."""
    return estimated_bytes(df) <= int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def heavy_keys(df: DataFrame, key: str, share: float = 0.005) -> list:
    """Every value of `key` holding at least `share` of the rows, and at most 1/share values in all; none in a light table.

    One pass with a bounded frequency sketch per partition (no row is shuffled); values slightly below the
    share may be among them, which only costs a little replication.
    """
    if estimated_bytes(df) < LIGHT_BYTES:
        return []
    row = df.select(F.col(key).alias("k")).where("k is not null").stat.freqItems(["k"], share).first()
    return list(row[0]) if row and row[0] else []


def salted(left: DataFrame, right: DataFrame, key: str, hot: list, salts: int = 16) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt column so that the rows of the hot keys of `left` spread over `salts` tasks.

    `right` is repeated `salts` times for the hot keys only (at most 1/share of them). Returns the join columns.
    """
    if not hot:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0)), [key, "_salt"]
    is_hot = F.col(key).isin(hot)
    lhs = left.withColumn("_salt", F.when(is_hot, (F.rand(7) * salts).cast("int")).otherwise(F.lit(0)))
    rhs = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return lhs, rhs, [key, "_salt"]
