"""Named queries that run whole jobs over the driver's tables: sources by pages, configurations, tables that are written, streams.

What a job writes lies in a folder of its own in the session's shared one (spark.checkpoint.dir), or of this machine for a local master.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyarrow import fs
from pyarrow import json as arrow_json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, values
from ..operators import news, social
from ..sources import paged, patterns, stored, tables
from ..sources.tables import table
from ..streaming import ingest, stateful
from .registry import REFUSED_SQL, query


def scratch(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/job-{uuid.uuid4().hex}"


def page_reader(folder: str) -> Callable[[int, int], list[dict]]:
    """Reads a page's file as a source's answer is read: by the task that needs it."""

    def fetch(page: int, size: int) -> list[dict]:
        files, root = fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), folder)
        found = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True)) if f.base_name.endswith(".json") and f.size]
        rows = [row for path in sorted(found) for row in arrow_json.read_json(files.open_input_stream(path)).to_pylist()]
        return sorted(rows, key=lambda r: r["code"])

    return fetch


@query("SELECT CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 100 + 1 AS INTEGER) AS page, CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 100 AS INTEGER) AS place, p_partkey AS code, p_name AS name FROM part")
def market_by_pages(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a source that answers by pages of 100: planned from its count, read by tasks, landed once."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    folder = scratch(spark)
    news.chunks(parts, [F.asc("code")], 100).select("code", "name", (F.col("chunk") + 1).alias("page")).repartition("page").write.partitionBy("page").json(f"{folder}/answers")
    rows = parts.count()
    source = paged.paged_source("parts_by_pages", "code long, name string", lambda: rows, page_reader(f"{folder}/answers"))
    return paged.landed(spark, source, f"{folder}/landed", per_page=100, most_pages=10**6)


@query("""WITH {news}, n AS (SELECT id, score, status FROM news) SELECT id, CASE WHEN id % 32 < 31 THEN score * 2 END AS judged, id % 32 = 31 AS failed FROM n WHERE status = 'P'""")
def judged_in_flight(spark: SparkSession, d: str) -> DataFrame:
    """News in calls of 50, four of a task at once; calls that fail leave dead letters."""
    from .catalogue import news_rows

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame.id % 32 == 31).any():
            raise ValueError("not this one")
        return frame.assign(judged=frame.score * 2)[["id", "judged"]]

    rows = news_rows(spark, d).filter("status = 'P'").select("id", "score")
    parts = [tables.scored(rows.filter(which), model, "id long, judged int", tries=2, wait=0.0, in_flight=4) for which in ("id % 32 <> 31", "id % 32 = 31")]
    return parts[0].unionByName(parts[1]).select("id", "judged", F.col("error").isNotNull().alias("failed"))


@query(r"""WITH p AS (SELECT page_id, page_id % 5 AS kind, html FROM pages)
SELECT page_id, kind = 3 AS wrong, CASE WHEN kind = 3 THEN NULL WHEN kind = 4 THEN '' ELSE regexp_replace(trim(replace(replace(regexp_replace(CASE kind WHEN 0 THEN regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) WHEN 1 THEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) ELSE regexp_extract(html, '(?s)<h1>.*?</h1>') END, '<[^>]+>', '', 'g'), '&amp;', '&'), '&quot;', '"')), '\s+', ' ', 'g') END AS body FROM p""")
def patterns_checked(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their sources' own patterns, of which one is wrong and one is missing."""
    kind = F.col("page_id") % 5
    own = F.when(kind == 0, "<h1>(.*?)</h1>").when(kind == 1, "(?P<empty>)<title>(?P<body>.*?)</title>").when(kind == 2, "<h1>.*?</h1>").when(kind == 3, "<h1>(.*?</h1>")
    pages = table(spark, d, "pages").select("page_id", "html", own.alias("pattern"))
    return pages.select("page_id", patterns.problem(F.col("pattern")).isNotNull().alias("wrong"), patterns.body_by(F.col("html"), F.col("pattern")).alias("body"))


@query(r"""WITH c AS (SELECT p_type AS source, p_partkey AS place, p_size % 3 = 0 AS wrong, CASE WHEN p_size % 3 = 0 THEN '<div>(' || p_brand WHEN p_size % 3 = 1 THEN '<div id="' || p_brand || '">(.*?)</div>' ELSE '<div class="' || p_brand || ' content">(.*?)</div>' END AS pattern FROM part),
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, pattern) AS nth FROM c),
best AS (SELECT source, first(pattern ORDER BY pattern NOT LIKE '%content%', CASE WHEN pattern LIKE '%content%' THEN 0 ELSE length(pattern) END, place, pattern) AS pattern FROM s WHERE nth <= 5 AND NOT wrong GROUP BY source)
SELECT source, coalesce(best.pattern, 'old') AS pattern, (SELECT count(*) FROM s WHERE s.source = x.source AND nth <= 5 AND wrong) AS n_wrong FROM (SELECT DISTINCT source FROM c) AS x LEFT JOIN best USING (source)""")
def patterns_learned(spark: SparkSession, d: str) -> DataFrame:
    """A new version of a configuration: of candidates from five pages of a source the best that is right; wrong ones are kept apart."""
    size = F.col("p_size") % 3
    made = F.when(size == 0, F.concat(F.lit("<div>("), "p_brand")).when(size == 1, F.concat(F.lit('<div id="'), "p_brand", F.lit('">(.*?)</div>'))).otherwise(F.concat(F.lit('<div class="'), "p_brand", F.lit(' content">(.*?)</div>')))
    candidates = table(spark, d, "part").select(F.col("p_type").alias("source"), F.col("p_partkey").alias("place"), made.alias("pattern"))
    new, wrong = patterns.learned(candidates)
    folder = f"{scratch(spark)}/config"
    patterns.put_patterns(spark, folder, 1, candidates.select("source", F.lit("old").alias("pattern")).distinct())
    patterns.put_patterns(spark, folder, 2, new)
    counts = wrong.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return stored.current(spark, folder, patterns.CONFIG).join(counts, "source", "left").select("source", "pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n_wrong"))


@query("""WITH {news} SELECT batch_id, CASE WHEN batch_id % 2 = 0 THEN 'second' ELSE 'first' END AS run, count(*) AS n, sum(score) AS score FROM news GROUP BY batch_id""")
def batches_written_again(spark: SparkSession, d: str) -> DataFrame:
    """A table of all batches, of which every second one is written again: it replaces itself and no other."""
    from .catalogue import news_rows

    rows, path = news_rows(spark, d).select("id", "score", "batch_id"), f"{scratch(spark)}/news"
    stored.put_batches(rows.withColumn("run", F.lit("first")), path)
    for _ in range(2):
        stored.put_batches(rows.filter("batch_id % 2 = 0").withColumn("run", F.lit("second")), path)
    return stored.batches(spark, path, "id long, score int, run string, batch_id long").groupBy("batch_id", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'read' WHEN c_custkey % 3 = 1 THEN 'scored' ELSE 'new' END AS status, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal ELSE 0 END AS score FROM customer")
def versions_by_key(spark: SparkSession, d: str) -> DataFrame:
    """News that are inserted, marked as scored and as read, each change a version of the table; the last one is run twice."""
    rows, path, schema = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("new").alias("status"), F.lit(0.0).alias("score"), "c_acctbal"), f"{scratch(spark)}/news", "id long, status string, score double"
    changes = {
        1: lambda old: old.unionByName(rows.select("id", "status", "score").join(old.select("id"), "id", "left_anti")),
        2: lambda old: news.upserted(old, rows.filter("id % 3 = 1").select("id", F.lit("scored").alias("status"), F.col("c_acctbal").alias("score")), "id"),
        3: lambda old: news.updated(old, rows.filter("id % 3 = 0").select("id", F.lit("read").alias("status")), "id", ["status"]),
    }
    for number in (1, 2, 3, 3):
        stored.put_version(spark, path, schema, number, changes[number])
    return stored.current(spark, path, schema)


@query("SELECT DISTINCT p_type AS name, p_type = 'ECONOMY' AS is_flash, 'http://x/' || p_type AS url, p_type <> 'SMALL' AS has_content, p_type LIKE 'S%' AS has_time FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT 'ANOTHER', TRUE, 'http://y', FALSE, FALSE")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    """A configuration written as JSON with a source for each part type, read again, with one added twice, one removed, and one that it has."""
    types = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    content = F.when(F.col("name") == "SMALL", "").otherwise("<div>(.*?)</div>")
    time = F.struct(F.when(F.col("name").startswith("S"), r"(\d{4}-\d\d-\d\d)").alias("pattern"))
    source = F.struct("name", (F.col("name") == "ECONOMY").alias("is_flash"), F.concat(F.lit("http://x/"), "name").alias("url"), content.alias("contentExtract"), time.alias("publishTimeExtract"))
    folder = f"{scratch(spark)}/sources"
    types.groupBy().agg(F.sort_array(F.collect_list(source)).alias("sources"), F.lit(30).alias("crawNumPerSource")).write.json(folder)
    config = tables.source_config(spark, folder)
    for _ in range(2):
        config = tables.with_source(config, "ANOTHER", "http://y", is_flash=True)
    return tables.listed_sources(tables.without_source(tables.with_source(config, "ECONOMY", "http://other"), "PROMO"))


@query("""SELECT l_orderkey AS id, l_linenumber AS nth, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN l_shipmode ELSE l_linestatus END ELSE 'body' END AS body FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'AIR' ELSE 'RAIL' END AS l_shipmode FROM lineitem) AS l""")
def flash_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Line items whose source is a flash one have their subtitle, else their title, as body."""
    nth = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), nth.alias("nth"), F.col("l_returnflag").alias("source_name"), F.col("l_linestatus").alias("title"), F.when(nth % 2 == 0, F.when(nth % 3 == 0, "AIR").otherwise("RAIL")).otherwise("").alias("subtitle"), F.lit("body").alias("body"))
    config = spark.createDataFrame([("A", True), ("N", False)], "name string, is_flash boolean")
    return tables.body_or_title(rows, config).select("id", "nth", "body")


@query("WITH {news} SELECT CAST(row_number() OVER (ORDER BY score DESC, publish_time DESC, id DESC) - 1 AS INTEGER) AS place, id, score, (SELECT publish_time FROM news ORDER BY score DESC, publish_time DESC, id DESC LIMIT 1) AS batch_time FROM news ORDER BY score DESC, publish_time DESC, id DESC LIMIT 50")
def feed_read_again(spark: SparkSession, d: str) -> DataFrame:
    """The history's feed of 50 as a snapshot's file, and its rows read from it."""
    from .catalogue import news_rows

    folder = f"{scratch(spark)}/feed"
    tables.write_feed(news.top(news_rows(spark, d), 50).select("id", "score", "publish_time"), folder, F.desc("score"), F.desc("publish_time"), F.desc("id"))
    return tables.read_feed(spark, folder, "id long, score int, publish_time string").select("place", "id", "score", "batch_time")


@query("SELECT 'report of ' || r_name AS first_line, len(n) AS n_lines FROM (SELECT r_name, list(n_name) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name) AS x")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """A report file for each region, read again as one text a file."""
    folder = scratch(spark)
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for name in sorted(r.r_name for r in table(spark, d, "region").select("r_name").collect()):  # five regions, a file each
        lines = joined.filter(F.col("r_name") == name).agg(F.concat(F.lit(f"report of {name}\n"), F.array_join(F.sort_array(F.collect_list("n_name")), "\n")).alias("text"))
        tables.write_text(lines, f"{folder}/{name.replace(' ', '_')}")
    return tables.reports(spark, f"{folder}/*/*.txt").select(F.substring_index("text", "\n", 1).alias("first_line"), (F.size(F.split(F.rtrim("text", F.lit("\n")), "\n")) - 1).cast("long").alias("n_lines"))


@query("SELECT o_orderkey AS id, round(((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)) / 9.0, 6) AS ratio FROM orders")
def sign_ratios(spark: SparkSession, d: str) -> DataFrame:
    """How many signs of a text that is no article each has; 版权所有 has 版权 in it."""
    id = F.col("o_orderkey")
    words = F.concat_ws(" ", F.lit("text"), F.when(id % 2 == 0, "投稿 to us"), F.when(id % 3 == 0, "版权所有"), F.when(id % 5 == 0, "at qq.com"))
    return table(spark, d, "orders").select(id.alias("id"), F.round(text.sign_ratio(words), 6).alias("ratio"))


@query("SELECT unnest(['crawl_absent', 'crawl_other']) AS missing")
def required_tables(spark: SparkSession, d: str) -> DataFrame:
    """Which of a job's tables the catalog lacks."""
    for name in ("part", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"crawl_{name}")
    missing = tables.missing_tables(spark, ["crawl_part", "crawl_absent", "crawl_orders", "crawl_other"])
    return table(spark, d, "region").limit(1).select(F.explode(F.array(*map(F.lit, missing))).alias("missing"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 08:30' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') END AS publish_time FROM orders""")
def own_time_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three sources: by their pattern's group, by its fallback without a group, and with neither."""
    kind, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    html = F.concat(F.lit("<div>1999-01-01</div><i id=t> "), F.date_format(day, "yyyy-MM-dd"), F.lit(" 08:30</i> released on "), F.date_format(day, "yyyy/MM/dd"), F.lit(" <b>2099-01-01</b>"))
    own = F.when(kind == 0, r"<i id=t>([^<]*)</i>").when(kind == 1, "<u>(.*?)</u>")
    spare = F.when(kind == 1, r"released on [\d/]+")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.by_pattern(html, own, spare).alias("publish_time"))


@query("SELECT p_partkey AS code, 'Big ' || p_name || ' of ' || p_brand || ' here !' AS line FROM part")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a list without their marks."""
    line = F.concat(F.lit("**Big** __"), "p_name", F.lit("__  `of`\t["), "p_brand", F.lit("](http://x/y) ~~here~~ ![](z.png) "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("code"), text.clean_markdown(line).alias("line"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    return spark.readStream.schema(rows.schema).parquet(f"{d}/events.parque[t]").withColumn("ts", at)  # a pattern stands for a file as well as for a folder


def streamed(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until there is no more of its input, written as a table."""
    stream.writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("SELECT CAST(1 AS BIGINT) AS batch_id, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) GROUP BY event_type")
def stream_of_today(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches with their number, of which only rows of the first day are taken."""
    folder = scratch(spark)
    day = table(spark, d, "events").agg(F.min(F.to_date("ts"))).first()[0]
    rows = ingest.not_late(event_stream(spark, d), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(day))
    ingest.in_batches(rows, lambda batch: stored.put_batches(batch.select("event_id", "event_type", "batch_id"), f"{folder}/rows"), f"{folder}/state").processAllAvailable()
    for q in spark.streams.active:
        if not q.status["isDataAvailable"]:
            q.stop()
    return stored.batches(spark, f"{folder}/rows", "event_id long, event_type string, batch_id long").groupBy("batch_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS url FROM events WHERE user_id % 2 = 1")
def stream_first_ever(spark: SparkSession, d: str) -> DataFrame:
    """Addresses (users' numbers) of all events once each, but of those that a table knows."""
    stateful.durable_state(spark)
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("url")).unionByName(table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"))).filter("cast(url as long) % 2 = 0")
    return streamed(stateful.first_ever(event_stream(spark, d).select(F.col("user_id").cast("string").alias("url")), known), scratch(spark))


@query(REFUSED_SQL)
def stream_refused(spark: SparkSession, d: str) -> DataFrame:
    """Sign-in attempts as a stream: the same as login_refused."""
    stateful.durable_state(spark)
    rows = event_stream(spark, d).select("event_id", "user_id", "ts", "event_type")
    return streamed(stateful.refused_stream(rows, "user_id", "ts", F.col("event_type") != "click", minutes=24 * 60).select("event_id", "refused"), scratch(spark))


@query("SELECT event_id, 1 AS failures, date_trunc('second', ts) + INTERVAL 60 SECOND AS due FROM events WHERE event_type = 'error' AND date_trunc('second', ts) + INTERVAL 60 SECOND <= (SELECT date_trunc('second', max(ts)) FROM events)")
def stream_retries(spark: SparkSession, d: str) -> DataFrame:
    """Events that failed come again a minute later, as far as time has gone on."""
    stateful.durable_state(spark)
    rows = event_stream(spark, d).select("event_id", F.date_trunc("second", "ts").alias("at"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return streamed(stateful.retry_queue(rows, "event_id", "at"), scratch(spark)).select("event_id", "failures", "due")


@query("WITH {news} SELECT CAST(row_number() OVER (ORDER BY score DESC, publish_time DESC, id DESC) - 1 AS INTEGER) AS place, id, score FROM news WHERE id % 7 <> 0 ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10")
def stream_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed kept up by batches: all news in four, then the deletion of every seventh, which empties no reserve."""
    from .catalogue import news_rows

    rows = news_rows(spark, d).select("id", "score", "publish_time", F.lit(False).alias("deleted"))
    folder = scratch(spark)
    feed = stateful.GrowingFeed(spark, f"{folder}/feed", "id long, score int, publish_time string", "id", {"score": True, "publish_time": True, "id": True}, size=10, reserve=100)
    stateful.feed_by_batches(feed, lambda n: rows.filter(F.col("id") % 4 == n - 1) if n < 5 else rows.filter("id % 7 = 0").withColumn("deleted", F.lit(True)), 5)
    tables.write_feed(feed.feed(5), f"{folder}/snapshot", F.desc("score"), F.desc("publish_time"), F.desc("id"))
    return tables.read_feed(spark, f"{folder}/snapshot", "id long, score int, publish_time string").select("place", "id", "score")


@query("""WITH {news}, n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) % 50 + 1 AS nth FROM news) SELECT id, CASE WHEN nth % 5 = 0 THEN 'failed' WHEN nth % 2 = 0 THEN 'useful' ELSE 'rejected' END AS state FROM n""")
def relevance_by_model(spark: SparkSession, d: str) -> DataFrame:
    """News in requests of 50, each with one reply that lists them by ordinal: those it leaves out have failed."""
    from .catalogue import news_rows

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        told = lambda n: ", ".join(f'{{"id": {i}, "will_flunctuate": {str(i % 2 == 0).lower()}}}' for i in range(1, n + 1) if i % 5)
        return pd.DataFrame({"chunk": frame.chunk, "reply": [f"Here it is:\n```json\n[{told(n)}]\n```" for n in frame.n]})

    rows = news.numbered(news_rows(spark, d).select("id"), [F.asc("id")], 50)
    requests = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    replies = tables.scored(requests, model, "chunk long, reply string", batch=1, in_flight=4).withColumn("told", values.recovered_batch(F.array("reply"), tables.RELEVANCE))
    replies = replies.select("chunk", F.inline("told")).select("chunk", F.col("id").cast("long").alias("nth"), F.col("will_flunctuate").alias("useful"))
    return news.judged(rows, replies).select("id", "state")


@query("""WITH {news} SELECT id, 'title ' || id AS title, 'http://x/' || id AS url, 'of ' || id AS summary, CASE WHEN id % 3 = 0 THEN 'coal|steel' ELSE 'banks' END AS related_sectors, score AS importance_score, CAST(id % 7 AS DOUBLE) / 2 AS intensity FROM news WHERE status = 'P' AND id % 4 <> 0 AND id % 9 <> 0""")
def scores_by_model(spark: SparkSession, d: str) -> DataFrame:
    """News scored one by one: a reply that says no, and one that can't be read, add nothing to the important ones."""
    from .catalogue import news_rows

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        def reply(id: int, score: int) -> str:
            if id % 9 == 0:
                return '{"will_flunctuate": true, "summary": "cut off'
            if id % 4 == 0:
                return "不会引起市场波动。"
            return f'```json\n{{"will_flunctuate": true, "summary": "of {id}", "related_sectors": "{"coal|steel" if id % 3 == 0 else "banks"}", "importance_score": {score}, "intensity": {id % 7 / 2}}}\n```'

        return frame.assign(reply=[reply(i, s) for i, s in zip(frame.id, frame.score, strict=True)])[["id", "title", "url", "reply"]]

    rows = news_rows(spark, d).filter("status = 'P'").select("id", "score", F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("url"))
    judged = tables.scored(rows, model, "id long, title string, url string, reply string", in_flight=4)
    found = judged.select("id", "title", "url", values.recovered_json(F.array("reply"), tables.SCORING).alias("reply"))
    return news.important(found).select("id", "title", "url", "summary", "related_sectors", "importance_score", "intensity")


@query("SELECT l_orderkey AS id, p_type AS sector FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND p_type LIKE '%O%'")
def sectors_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Sectors that a model names for each news: only known ones are kept, so what it makes up goes."""

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": frame.id, "reply": [f'I think: {{"sectors": ["{name}", "MADE UP"]}}' for name in frame.hint]})

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("sector"))
    rows = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("code")).join(parts, "code").select("id", F.col("sector").alias("hint"))
    found = tables.scored(rows, model, "id long, reply string", in_flight=4).select("id", F.explode(values.recovered_json(F.array("reply"), "sectors array<string>")["sectors"]).alias("sector"))
    return found.join(parts.select("sector").filter("sector like '%O%'").distinct(), "sector", "left_semi").select("id", "sector")


@query("""SELECT event_id AS news_id, CASE WHEN event_id % 4 <> 0 THEN '["by user ' || user_id || '"]' END AS valid_comments, CASE WHEN event_id % 4 <> 0 THEN '[]' END AS optimization_suggestions FROM events WHERE event_type = 'purchase'""")
def review_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Comments given to a model for a review; a reply that can't be read is kept as it came, with nothing read from it."""

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        told = [f'Well:\n```json\n{{"valid_comments": ["{c}"], "optimization_suggestions": []}}\n```' if i % 4 else "no answer" for i, c in zip(frame.news_id, frame.comment, strict=True)]
        return pd.DataFrame({"news_id": frame.news_id, "raw": told})

    rows = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("news_id"), F.concat(F.lit("by user "), F.col("user_id").cast("string")).alias("comment"))
    judged = tables.scored(rows, model, "news_id long, raw string", in_flight=4)
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("raw").alias("text")))
    reply = values.recovered_review(blocks, "valid_comments array<string>, optimization_suggestions array<string>")
    return social.review_rows(judged.withColumn("reply", reply)).drop("raw_llm_result")
