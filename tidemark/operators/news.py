"""News rows: batches and their queues, feeds, admission of crawled rows, deduplication by address.

A news row has id, batch_id, status, is_useful, publish_time (raw text, compared as text), score and url.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import settled


def newest_batch(news: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows of the greatest batch. It is one number, so joining it costs no shuffle of news."""
    return news.join(F.broadcast(news.agg(F.max(batch).alias("_newest"))), F.col(batch) == F.col("_newest")).drop("_newest")


def newest_by_score(news: DataFrame, at: str, limit: int = 20) -> DataFrame:
    """Of the rows with the greatest time those with the best score."""
    return newest_batch(news, at).orderBy(F.desc("score"), F.desc("id")).limit(limit)


def recent(news: DataFrame, at: str, limit: int = 20) -> DataFrame:
    return news.orderBy(F.desc(at), F.desc("id")).limit(limit)


def created_since(news: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days, for a review."""
    return news.filter(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def with_sectors(news: DataFrame, sectors: str = "sectors") -> DataFrame:
    """Rows that name a sector."""
    return news.filter(F.col(sectors) != "")


def next_batch_id(news: DataFrame, batch: str = "batch_id") -> DataFrame:
    return news.agg((F.coalesce(F.max(batch), F.lit(0)) + 1).cast("long").alias("next_batch_id"))


def queue(news: DataFrame, condition: Column, limit: int | None = None) -> DataFrame:
    """What is to be done in the newest batch, latest first."""
    rows = newest_batch(news).filter(condition).orderBy(F.desc("publish_time"), F.desc("id"))
    return rows.limit(limit) if limit else rows


def top(news: DataFrame, limit: int, since: str | None = None, least: int | None = None) -> DataFrame:
    """The feed: best score first, then the latest. since compares raw times as text."""
    rows = news if since is None else news.filter(F.col("publish_time") >= since)
    rows = rows if least is None else rows.filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), F.desc("publish_time"), F.desc("id")).limit(limit)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their rank from 1; for rows that a limit has made few."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def first_of_each(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows a task before it shuffles."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).filter(F.col("nth") <= n)


def unknown_urls(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose address is not known yet; rows without an address stay."""
    return rows.join(known.select("url").filter("url is not null and url <> ''").distinct(), "url", "left_anti")


def insert_or_ignore(rows: DataFrame, known: DataFrame, arrival: str) -> DataFrame:
    """What an insert adds: of each new address the first to arrive."""
    return unknown_urls(first_of_each(rows, ["url"], [F.asc(arrival)]).drop("nth"), known)


def admitted(rows: DataFrame, group: str, order: str, is_today: Column, has_date: Column, most: int, stop_after: int) -> DataFrame:
    """Rows of each source until `most` rows have been read or stop_after dated ones in a row are not of today.

    No more than `most` rows of a source are read, so no task holds more of it. Rows of today and rows without a date are admitted. Islands between rows of today have running counts; the first row
    that reaches the count is the last that is read.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = first_of_each(rows, [group], [F.asc(order)], most).withColumnRenamed("nth", "_nth").withColumns({"_today": is_today & has_date, "_old": has_date & ~is_today})
    rows = rows.withColumn("_island", F.sum(F.col("_today").cast("int")).over(w))
    rows = rows.withColumn("_run", F.sum(F.col("_old").cast("int")).over(Window.partitionBy(group, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("_run") >= stop_after, F.col("_nth"))).over(Window.partitionBy(group))
    return rows.withColumn("_stop", stop).filter((F.col("_stop").isNull() | (F.col("_nth") <= F.col("_stop"))) & ~F.col("_old")).drop("_today", "_old", "_nth", "_island", "_run", "_stop")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in the order, from 0.

    They are numbered within ranges of the order, each of which begins where the ones before it end. The ranges are
    settled, since another sampling could draw them otherwise; only their counts go through the driver.
    """
    held = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = sorted(tuple(x) for x in held.groupBy("_range").count().collect())
    ends = list(accumulate(n for _, n in counts))
    before = rows.sparkSession.createDataFrame([(r, end - n) for (r, n), end in zip(counts, ends, strict=True)], "_range int, _before long")
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return held.join(F.broadcast(before), "_range").withColumn("place", nth).drop("_range", "_before")


def chunks(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows with the number of their fixed-size batch in the order."""
    return placed(rows, order).withColumn("chunk", F.floor(F.col("place") / size).cast("long")).drop("place")


def numbered(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Rows with their batch (chunk) and their ordinal in it (nth, from 1), as a model's request lists them."""
    return placed(rows, order).withColumns({"chunk": F.floor(F.col("place") / size).cast("long"), "nth": F.col("place") % size + 1}).drop("place")


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of changes where it has the key and a value."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return rows.join(new, key, "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def upserted(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows and changes by name; of equal keys the changed row stays."""
    both = rows.withColumn("_age", F.lit(0)).unionByName(changes.withColumn("_age", F.lit(1)))
    return first_of_each(both, [key], [F.desc("_age")]).drop("nth", "_age")


def judged(queue_rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies (chunk, nth, useful) aligned to numbered rows by batch and ordinal: state useful, rejected or, without a reply, failed.

    They are never broadcast: a reply tells of a whole batch, so there are far more of them than a plan guesses from the requests.
    """
    return queue_rows.join(replies.hint("merge"), ["chunk", "nth"], "left").withColumn("state", F.when(F.col("useful").isNull(), "failed").when(F.col("useful"), "useful").otherwise("rejected"))


def important(scored: DataFrame) -> DataFrame:
    """What an insert of scored news adds: news that a reply (struct) says will move, with the reply's fields."""
    return scored.filter("reply.will_flunctuate").select("id", "title", "url", "reply.*").drop("will_flunctuate")
