"""Resumable ingest: new files are taken once, in batches whose output replaces itself when a batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.records import RAW_PAGE

#: Errors after which a page isn't asked for again.
PERMANENT = ("missing", "too-short", "invalid")


def pending(listed: DataFrame, done: DataFrame, errors: DataFrame) -> DataFrame:
    """(title, ord) of listed that is neither done nor failed for good; of doubled titles the first place."""
    first = listed.groupBy("title").agg(F.min("ord").alias("ord"))
    closed = done.select("title").union(errors.where(F.col("error").isin(*PERMANENT)).select("title"))
    return first.join(closed, "title", "left_anti")


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 100) -> None:
    """Take what is new in the folder of raw page lines, clean it, and stop. Each batch has a folder of its own under the sink, written over if it is repeated."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    pages = spark.readStream.schema(RAW_PAGE).option("maxFilesPerTrigger", files).json(source).where("title is not null")
    query = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A15 over time: done and failed in each window; a stream drops what is later than `late`."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    failed = F.sum((F.col("event_type") == "error").cast("long"))
    out = timed.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("total"), failed.alias("failed"))
    return out.select(F.col("w.start").alias("start"), "total", "failed")
