"""Readers and sinks: tables, source configuration, feed snapshots, reports, and a model's judgements."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG = "sources array<struct<name: string, is_flash: boolean, url: string, contentExtract: string, publishTimeExtract: struct<pattern: string, fallbackPattern: string, selector: struct<css: string, mode: string>, description: string>>>, crawNumPerSource int, maxConsecutiveNonToday int, llmBatchSize int"
#: The fields of a model's reply on relevance and on scoring.
RELEVANCE = "id int, will_flunctuate boolean"
SCORING = "will_flunctuate boolean, summary string, related_sectors string, importance_score int, reason string, direction string, intensity double, expected_change double, duration double, expectation_level string, market_mode string"
#: So many rows of a model's answers are given on together.
GATHERED = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a JSON configuration, with the limits that hold for all."""
    whole = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    return whole.select(F.inline("sources"), F.col("crawNumPerSource").alias("most"), F.col("maxConsecutiveNonToday").alias("stop_after"))


def with_source(config: DataFrame, name: str, url: str, is_flash: bool = False) -> DataFrame:
    """The configuration with one more source; a name that it has already changes nothing."""
    new = config.sparkSession.createDataFrame([(name, url, is_flash)], "name string, url string, is_flash boolean").join(config.select("name"), "name", "left_anti")
    return config.unionByName(new, allowMissingColumns=True)


def without_source(config: DataFrame, name: str) -> DataFrame:
    return config.filter(~F.col("name").eqNullSafe(name))


def listed_sources(config: DataFrame) -> DataFrame:
    """What a list of sources says of each: whether its bodies and its times have a pattern."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return config.select("name", F.coalesce("is_flash", F.lit(False)).alias("is_flash"), "url", has(F.col("contentExtract")).alias("has_content"), has(F.col("publishTimeExtract.pattern")).alias("has_time"))


def body_or_title(rows: DataFrame, config: DataFrame) -> DataFrame:
    """rows (source_name, title, subtitle, body): for flash sources the subtitle or title is the body."""
    flash = config.select(F.col("name").alias("source_name"), "is_flash")
    short = F.coalesce(F.nullif("subtitle", F.lit("")), "title")
    return rows.join(flash, "source_name", "left").withColumn("body", F.when(F.coalesce("is_flash", F.lit(False)), short).otherwise(F.col("body"))).drop("is_flash")


def feed_snapshot(feed: DataFrame, *order: Column) -> DataFrame:
    """A feed as one row: data (its rows in the order given), batch_time (when the first was created) and count.

    A feed is what a limit has made few (the largest has 50 rows), so one list holds it.
    """
    placed = feed.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    rows = placed.agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*feed.columns).alias("row")))).alias("found")).select(F.transform("found", lambda x: x["row"]).alias("data"))
    at = next((c for c in ("created_at", "publish_time") if c in feed.columns), None)
    return rows.withColumns({"batch_time": F.get("data", F.lit(0))[at] if at else F.lit(None).cast("string"), "count": F.size("data").cast("long")})


def write_feed(feed: DataFrame, path: str, *order: Column) -> None:
    feed_snapshot(feed, *order).write.mode("overwrite").json(path)


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a feed's snapshot (schema: of its rows), in order by place. A snapshot that is there counts, however old."""
    whole = spark.read.schema(f"data array<struct<{schema}>>, batch_time string, count long").json(path)
    return whole.select("batch_time", F.posexplode("data").alias("place", "row")).select("place", "batch_time", "row.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report_id"), F.col("value").alias("text"))


def report_text(rows: DataFrame, at: Column) -> DataFrame:
    """A report of few ranked rows (rank, title, source, publish_time, score, summary, sectors: array, mean_change, reason) as one text.

    Fixed values: what its lines say. Titles are cut at 50 characters, summaries at 80.
    """
    rule, na = "=" * 70, F.lit("N/A")
    short = F.when(F.length("summary") > 80, F.concat(F.left("summary", F.lit(80)), F.lit("..."))).otherwise(F.coalesce(F.nullif("summary", F.lit("")), na))
    lines = [
        F.lit(""), F.format_string("【%s】%s", F.col("rank").cast("string"), F.left(F.coalesce("title", F.lit("")), F.lit(50))), F.format_string("  来源: %s | 时间: %s", "source", "publish_time"), F.format_string("  评分: %s 分", F.col("score").cast("string")),
        F.concat(F.lit("  摘要: "), short), F.concat(F.lit("  关联板块: "), F.when(F.size("sectors") > 0, F.array_join("sectors", ", ")).otherwise(na)), F.concat(F.lit("  发布至今涨跌幅: "), "mean_change"), F.concat(F.lit("  理由: "), F.coalesce(F.nullif("reason", F.lit("")), na)),
    ]
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", F.array_join(F.array(*lines), "\n").alias("text")))).alias("found"))
    head = F.concat(F.lit(f"{rule}\n新闻采集分析报告 - "), at, F.lit(f"\n{rule}\n"))
    body = F.array_join(F.transform("found", lambda x: x["text"]), "\n")
    return told.select(F.concat(head, body, F.lit(f"\n\n{rule}\n共 "), F.col("n").cast("string"), F.lit(" 条高评分新闻")).alias("text"))


def report_json(rows: DataFrame, at: Column) -> DataFrame:
    """The same report as one JSON text: status, generated_at and top_news by rank."""
    told = rows.agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*rows.columns).alias("row")))).alias("found"))
    return told.select(F.to_json(F.struct(F.lit("success").alias("status"), at.alias("generated_at"), F.transform("found", lambda x: x["row"]).alias("top_news"))).alias("text"))


def write_text(report: DataFrame, path: str) -> None:
    """A report (text) as a text file of its own."""
    report.select("text").write.mode("overwrite").text(path)


def missing_tables(spark: SparkSession, required: list[str]) -> list[str]:
    return sorted({*required} - {t.name for t in spark.catalog.listTables()})


def to_score(rows: DataFrame, least: int = 20) -> DataFrame:
    """Rows whose body is long enough to be scored."""
    return rows.filter(F.length(F.btrim(F.coalesce("content", F.lit("")))) >= least)


def scored(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 50, tries: int = 3, wait: float = 1.0, in_flight: int = 1) -> DataFrame:
    """rows judged by a model that takes and gives data frames, at most `batch` rows a call; the column error is null.

    A failing call is tried again after wait, 2 * wait, 4 * wait seconds. When it fails for the last time, its rows come back
    with what they have of schema's columns and the message as error: a table of dead letters, to be judged again later.
    in_flight: so many calls of a task run at once, each with its own waiting; no more calls than that are held.
    Calls of one row are dealt to tasks by number, however few files the rows lie in; calls of several take them as they lie, so
    that none has fewer rows than it may. A task's answers leave it some GATHERED rows at a time.
    """
    kinds = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("error", T.StringType())])
    names = [f.name for f in kinds.fields]

    def judged(part: pd.DataFrame) -> tuple[pd.DataFrame, bool]:
        for turn in range(tries):
            try:
                told = model(part)
                return told if list(told.columns) == names[:-1] else told[names[:-1]], True
            except Exception as problem:  # noqa: BLE001 - whatever a model raises
                failed = problem
                if turn + 1 < tries:
                    time.sleep(wait * 2**turn)
        return part[[n for n in names[:-1] if n in part]].assign(error=str(failed)), False

    def answers(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
        if in_flight <= 1:
            yield from map(judged, parts)
            return
        with ThreadPoolExecutor(in_flight) as pool:
            calls = deque(pool.submit(judged, part) for part in islice(parts, in_flight))
            while calls:
                yield calls.popleft().result()
                calls.extend(pool.submit(judged, part) for part in islice(parts, 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows_held = [], 0
        for answer in answers(frame.iloc[i : i + batch] for frame in frames for i in range(0, len(frame), batch)):
            held.append(answer)
            rows_held += len(answer[0])
            if rows_held >= GATHERED:
                yield _together(held, names)
                held, rows_held = [], 0
        if held:
            yield _together(held, names)

    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism) if batch == 1 else rows
    return dealt.mapInPandas(run, kinds)


def _together(answers: list[tuple[pd.DataFrame, bool]], names: list[str]) -> pd.DataFrame:
    """Calls' answers (frame, whether it is a model's) as one frame, in their order."""
    good, bad = ([(i, frame) for i, (frame, told) in enumerate(answers) if told == kind] for kind in (True, False))
    kinds = []
    for calls in (good, bad):
        if calls:
            columns = {n: pd.concat([frame[n] for _, frame in calls], ignore_index=True) for n in calls[0][1].columns}
            kinds.append(pd.DataFrame(columns).set_index(np.repeat([i for i, _ in calls], [len(frame) for _, frame in calls])))
    if len(kinds) > 1:  # numbers stay what they are beside rows that lack them
        kinds = [one.astype({n: object for n, t in one.dtypes.items() if t.kind in "iub"}) for one in kinds]
    out = pd.concat(kinds).sort_index(kind="stable")
    return out.assign(**{n: None for n in names if n not in out})[names]


def dead_letters(judged: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows that no model has judged, to be given to one again."""
    return rows.join(judged.filter("error is not null").select(key).distinct(), key, "left_semi")
