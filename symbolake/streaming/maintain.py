"""Change sets as a stream: items seen for the first time, and exactly-once maintenance per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolake.operators.incremental_state import ITEM, StateStore, content_hash


def _each(change_sets: DataFrame) -> DataFrame:
    lists = F.explode(F.array(*(F.struct(F.lit(c).alias("change"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("paths")) for c in ("added", "modified", "deleted"))))
    each = change_sets.select("repo", "commit", "seq", F.col("arrived_at").cast("timestamp").alias("at"), lists.alias("l"))
    each = each.select("repo", "commit", "seq", "at", "l.change", F.explode("l.paths").alias("p")).where("p is not null")
    return each.select("repo", "commit", F.translate("p", "\\", "/").alias("file_path"), "change", "seq", "at")


def stream_items(change_sets: DataFrame, lateness: str = "30 days") -> DataFrame:
    """The changed paths of a stream of change sets; repeated deliveries within `lateness` are dropped with bounded state."""
    return _each(change_sets).withWatermark("at", lateness).dropDuplicatesWithinWatermark(ITEM)


def changes_per_window(change_sets: DataFrame, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Changed paths per repo, kind and time window; late rows beyond the watermark are dropped."""
    items = stream_items(change_sets, lateness)
    return items.groupBy(F.window("at", width), "repo", "change").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "repo", "change", "n")


def maintain(change_sets: DataFrame, state_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Writes the items of a stream of change sets under `out_dir` (Parquet, a folder a batch), each item once however often and late it is delivered.

    A batch's new items are those the state doesn't hold. They are written over whatever a failed attempt of the same
    batch left, and then the state is committed under the batch's number: a batch that is repeated before its commit selects and
    writes the same items again, one repeated after it is passed over. The stream itself keeps no state.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = StateStore(batch.sparkSession, state_dir, ITEM)
        if store.version and store.note() >= batch_id:
            return
        new = store.changes(batch.select(*ITEM).distinct(), ITEM).select(*ITEM)
        at = f"{out_dir.rstrip('/')}/batch={batch_id}"
        new.write.mode("overwrite").parquet(at)
        done = batch.sparkSession.read.schema(new.schema).parquet(at)
        store.commit(done.withColumn("content_hash", content_hash(*ITEM)), batch_id)

    return _each(change_sets).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
