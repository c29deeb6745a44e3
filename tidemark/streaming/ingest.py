"""Streams: news that arrives in micro-batches, and counts by time. Both are additions for rows that come as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_day
from ..sources.tables import write_feed


def first_by_url(stream: DataFrame, event_time: str, late: str = "1 day") -> DataFrame:
    """Each address once; state is kept for as long as rows may come late."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["url"])


def in_batches(stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that gives each micro-batch to sink with its number as batch_id; a batch that is repeated has the same one."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, epoch: sink(rows.withColumn("batch_id", F.lit(epoch + 1).cast("long")))).start()


def counts_by_window(stream: DataFrame, event_time: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def not_late(stream: DataFrame, raw_time: Column, day: Column) -> DataFrame:
    """Rows whose raw time lies on the day; later ones than that, and rows without a readable time, are dropped."""
    return stream.filter(is_day(raw_time, day))


def refreshing_feed(stream: DataFrame, history: str, feed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *order: Column):
    """Starts a query that appends each micro-batch to the table `history` and writes the feed over all of it anew.

    A batch that is repeated replaces itself, as each has a folder of its own.
    """

    def sink(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("batch_id", F.lit(epoch + 1).cast("long")).write.mode("overwrite").parquet(f"{history}/batch={epoch + 1}")
        write_feed(feed(rows.sparkSession.read.parquet(history)), path, *order)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
