"""The store of the newest records, as an idempotent sink of a stream.

The store holds at most `cap` records, newest first. Each micro-batch adds its own newest ones: both
sides are cut to their head before they meet, so what is merged has 2 * cap rows at most, however long
the stream and its batches are. A store that would exceed `most_bytes` drops its images; if it still
exceeds them, the batch isn't saved and the store stays as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimworks.streaming import versions

RECORD = "id string, text string, submitted_at timestamp, verdict string, image string"
#: About what a browser keeps for a site.
MOST_BYTES = 5_000_000


def head(records: DataFrame, cap: int) -> DataFrame:
    """The newest `cap` records; of those with one time the larger ids. Null times come last."""
    return records.orderBy(F.desc_nulls_last("submitted_at"), F.desc_nulls_last("id")).limit(cap)


def merged(kept: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """The head of both; a record of `new` takes the place of one with its id, and of several new ones
    with one id the newest counts."""
    newest = F.max_by(F.struct(*[F.col(c) for c in new.columns]), F.struct(F.coalesce(F.col("submitted_at").cast("long"), F.lit(-(1 << 62))), F.coalesce(F.hash(*new.columns), F.lit(0))))
    once = new.groupBy("id").agg(newest.alias("r")).select("r.*") if new.columns else new
    top = head(once, cap)
    return head(kept.join(F.broadcast(top.select("id")), "id", "left_anti").select(*kept.columns).unionByName(top.select(*kept.columns)), cap)


def fitted(table: DataFrame, most_bytes: int) -> tuple[DataFrame | None, str]:
    """The table as it may be saved, and how: whole, without-images, or refused (None). Its size is that
    of its texts."""
    texts = [c for c, t in table.dtypes if t == "string"]
    size = F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))), F.lit(0))
    bare = table.withColumn("image", F.lit(None).cast("string"))
    if table.agg(size).first()[0] <= most_bytes:
        return table, "whole"
    if bare.agg(size).first()[0] <= most_bytes:
        return bare, "without-images"
    return None, "refused"


def saved(records: DataFrame, cap: int = 200, most_bytes: int = MOST_BYTES) -> tuple[DataFrame | None, str]:
    """What a store that was empty holds once all records have come, and how it was saved."""
    return fitted(head(records, cap), most_bytes)


def writer(path: str, cap: int = 200, most_bytes: int = MOST_BYTES, told: Callable[[int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps the store in `path`. told(batch, how) hears how a batch
    was saved. Batches that are replayed change nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = versions.current(spark, path, RECORD, batch_id)
        table, how = fitted(merged(kept, batch.select(*kept.columns), cap), most_bytes)
        versions.commit(kept if table is None else table, path, batch_id)
        if told is not None:
            told(batch_id, how)

    return write


def start(records: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Keeps the store in `path` from a stream of records (RECORD); ends when all is read."""
    return records.writeStream.foreachBatch(writer(path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
