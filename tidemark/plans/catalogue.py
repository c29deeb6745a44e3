"""The named queries of the library over the driver's tables, each with the SQL that must give the same rows.

News are orders (batch: the year; score: by priority; raw time: the date as text), sectors the part types, stocks the
parts, quotes the mean prices of line items, users the customers, comments and crawled rows the events.
"""

from __future__ import annotations

from functools import reduce
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text, values
from ..operators import market, news, social
from ..sources import tables
from ..sources.tables import table
from .registry import QUERIES, REFUSED_SQL, SQL, Query, query

def news_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.year("o_orderdate").cast("long").alias("batch_id"), (2 * (6 - F.left("o_orderpriority", F.lit(1)).cast("int"))).alias("score"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("publish_time"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 3 - 1).cast("int").alias("is_useful"),
    )


def stock_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("sector"), F.col("p_partkey").alias("code"), F.col("p_brand").alias("tier"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


def news_sectors(spark: SparkSession, d: str, feed: DataFrame) -> DataFrame:
    """feed with its sectors: the types of an order's parts, in line order, each once."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_linenumber").join(F.broadcast(feed.select("id")), "id")
    typed = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    first = typed.groupBy("id", "p_type").agg(F.min("l_linenumber").alias("place"))
    listed = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "p_type"))), lambda x: x["p_type"]).alias("sectors"))
    return feed.join(listed, "id", "left")


@query("WITH {news} SELECT id, score, publish_time FROM news WHERE publish_time >= '1998-01-01 00:00:00' ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10")
def feed_top(spark: SparkSession, d: str) -> DataFrame:
    return news.top(news_rows(spark, d), 10, since="1998-01-01 00:00:00").select("id", "score", "publish_time")


@query("""WITH {news}, feed AS (SELECT id, score, publish_time FROM news ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10),
best AS (SELECT * FROM (SELECT p_type AS sector, p_partkey AS code, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS nth FROM part) AS x WHERE nth <= 10),
listed AS (SELECT f.id, p.p_type AS sector, min(l.l_linenumber) AS place FROM feed f JOIN lineitem l ON l.l_orderkey = f.id JOIN part p ON p.p_partkey = l.l_partkey GROUP BY f.id, p.p_type)
SELECT f.id, f.score, f.publish_time, coalesce(string_agg(CAST(b.code AS VARCHAR), '|' ORDER BY s.place, s.sector, b.nth), '') AS stocks
FROM feed f LEFT JOIN listed s ON s.id = f.id LEFT JOIN best b ON b.sector = s.sector GROUP BY f.id, f.score, f.publish_time""")
def feed_with_stocks(spark: SparkSession, d: str) -> DataFrame:
    feed = news_sectors(spark, d, news.top(news_rows(spark, d), 10).select("id", "score", "publish_time"))
    return market.with_stocks(feed, stock_rows(spark, d)).select("id", "score", "publish_time", F.array_join(F.col("codes").cast("array<string>"), "|").alias("stocks"))


@query("WITH {news} SELECT id, publish_time FROM news WHERE status = 'O' AND is_useful = 1 AND batch_id = (SELECT max(batch_id) FROM news) ORDER BY publish_time DESC, id DESC LIMIT 10")
def latest_batch_unread(spark: SparkSession, d: str) -> DataFrame:
    return news.queue(news_rows(spark, d), F.expr("status = 'O' and is_useful = 1"), 10).select("id", "publish_time")


@query("WITH {news} SELECT is_useful, status, count(*) AS n FROM news WHERE batch_id = (SELECT max(batch_id) FROM news) AND (is_useful IN (0, -1) OR (is_useful = 1 AND status = 'P')) GROUP BY is_useful, status")
def open_queues(spark: SparkSession, d: str) -> DataFrame:
    rows = news.queue(news_rows(spark, d), F.expr("is_useful in (0, -1) or (is_useful = 1 and status = 'P')"))
    return rows.groupBy("is_useful", "status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {news} SELECT coalesce(max(batch_id), 0) + 1 AS next_batch_id FROM news")
def next_batch_id(spark: SparkSession, d: str) -> DataFrame:
    return news.next_batch_id(news_rows(spark, d))


@query("WITH {news} SELECT id, score FROM news WHERE score >= 8 ORDER BY score DESC, publish_time DESC, id DESC LIMIT 20")
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    return news.top(news_rows(spark, d), 20, least=8).select("id", "score")


@query("WITH {news}, best AS (SELECT * FROM news WHERE batch_id = 1997 ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10) SELECT id, score, row_number() OVER (ORDER BY score DESC, publish_time DESC, id DESC) AS rank FROM best")
def top_by_batch(spark: SparkSession, d: str) -> DataFrame:
    best = news.top(news_rows(spark, d).filter("batch_id = 1997"), 10)
    return news.ranked(best, F.desc("score"), F.desc("publish_time"), F.desc("id")).select("id", "score", "rank")


@query("WITH {news} SELECT id FROM news LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) AS x ON l_orderkey = id WHERE score >= 8 AND (flag IS NULL OR flag = '')")
def null_or_blank_filter(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("flag"))
    return news_rows(spark, d).filter("score >= 8").join(flags, "id", "left").filter("flag is null or flag = ''").select("id")


@query("SELECT p_partkey AS code, p_brand AS tier FROM part WHERE p_type = 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2') AND p_size >= 10")
def dynamic_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = stock_rows(spark, d)
    for wanted in (F.col("sector") == "ECONOMY", F.col("tier").isin("Brand#1", "Brand#2"), F.col("size") >= 10):
        rows = rows.filter(wanted)
    return rows.select("code", "tier")


@query("SELECT p_type AS sector, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD') GROUP BY p_type")
def stocks_inner_join(spark: SparkSession, d: str) -> DataFrame:
    wanted = stock_rows(spark, d).filter(F.col("sector").isin("ECONOMY", "SMALL", "STANDARD")).select("sector", "code")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("code"), "l_quantity")
    return lines.join(wanted, "code").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT event_id AS id, CASE WHEN c_custkey IS NULL THEN NULL ELSE '游客' || right(c_name, 4) END AS author FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) AS c ON c_custkey = user_id ORDER BY ts DESC, event_id DESC LIMIT 50""")
def comments_left_join(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("nickname"), F.col("c_name").alias("phone"))
    comments = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"))
    return social.comments_with_users(comments, users).select("id", "author")


def _two(spark: SparkSession, d: str, as_joined: bool) -> DataFrame:
    parts = stock_rows(spark, d).select("code")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("code"), "l_quantity")
    return market.two_counts(parts, lines.filter("l_quantity > 40"), lines.filter("l_quantity < 10"), "code", as_joined)


@query("SELECT p_partkey AS code, count(a.l_partkey) AS n_one, count(b.l_partkey) AS n_two FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) a ON a.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10) b ON b.l_partkey = p_partkey GROUP BY p_partkey")
def two_left_join_count_raw(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d, as_joined=True)


@query("SELECT p_partkey AS code, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40) AS n_one, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 10) AS n_two FROM part")
def two_left_join_count_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d, as_joined=False)


@query("SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM pages k WHERE k.page_id % 3 = 0 AND k.url = pages.url)")
def url_anti_join(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return news.unknown_urls(pages, pages.filter("page_id % 3 = 0")).select("page_id")


@query("SELECT min(doc_id) AS doc_id, source AS url FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("url"))
    return news.insert_or_ignore(docs, docs.filter("url in ('src1', 'src2')"), "doc_id").select("doc_id", "url")


@query("SELECT p_partkey AS code FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 48)")
def semi_verify(spark: SparkSession, d: str) -> DataFrame:
    known = stock_rows(spark, d).filter("size > 48").select("sector").distinct()
    return stock_rows(spark, d).join(known, "sector", "left_semi").select("code")


@query("""WITH c AS (SELECT n_nationkey AS code, avg(c_acctbal) AS price FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 10 GROUP BY n_nationkey),
n AS (SELECT n_name AS name, CAST(max(s_acctbal) AS DOUBLE) AS price FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT n_nationkey AS code, n_name AS name, c.price IS NOT NULL AS by_code, n.price IS NOT NULL AS by_name, CASE WHEN c.price IS NULL THEN n.price END AS price FROM nation LEFT JOIN c ON c.code = n_nationkey LEFT JOIN n ON n.name = n_name""")
def two_key_fallback(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    by_code = table(spark, d, "customer").filter("c_nationkey < 10").groupBy(F.col("c_nationkey").alias("code")).agg(F.avg("c_acctbal").alias("price"))
    by_name = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.max("s_acctbal").alias("price")).join(nation, "code").select("name", "price")
    out = market.priced(nation, by_code, by_name).join(by_code.select("code", F.lit(True).alias("a")), "code", "left").join(by_name.select("name", F.lit(True).alias("b")), "name", "left")
    return out.select("code", "name", F.coalesce("a", F.lit(False)).alias("by_code"), F.coalesce("b", F.lit(False)).alias("by_name"), F.when(F.col("a").isNull(), F.col("price")).alias("price"))


@query("""WITH quotes AS (SELECT p_type AS qn, min(p_partkey) AS place, CAST(max(p_retailprice) AS DOUBLE) AS price FROM part GROUP BY p_type),
names AS (SELECT DISTINCT left(p_type, 4) AS name FROM part UNION SELECT DISTINCT p_type || ' X' FROM part UNION SELECT 'NONE')
SELECT name, quote_name, price FROM (SELECT name, qn AS quote_name, price, row_number() OVER (PARTITION BY name ORDER BY coalesce(name = qn, FALSE) DESC, place) AS nth FROM names LEFT JOIN quotes ON name = qn OR contains(qn, name) OR contains(name, qn)) AS x WHERE nth = 1""")
def substring_theta(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    quotes = part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("place"), F.max("p_retailprice").alias("price"))
    names = part.select(F.left("p_type", F.lit(4)).alias("name")).union(part.select(F.concat("p_type", F.lit(" X")))).union(spark.range(1).select(F.lit("NONE"))).distinct()
    return market.matched_names(names, quotes).select("name", "quote_name", "price")


_MOVES_SQL = """moves AS (SELECT l_orderkey AS id, p_type AS sector, CAST(min(l_quantity) AS DOUBLE) AS p, CAST(max(l_quantity) AS DOUBLE) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, p_type)"""


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """By news: the maps of its sectors' first and current values, each read from a delimited string."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(stock_rows(spark, d).select(F.col("code").alias("l_partkey"), "sector"), "l_partkey")
    by = lines.groupBy(F.col("l_orderkey").alias("id"), "sector").agg(F.min("l_quantity").alias("p"), F.max("l_quantity").alias("c"))
    pair = lambda c: F.array_sort(F.collect_list(F.struct(F.col("sector").alias("name"), F.col(c).alias("value"))))
    held = by.groupBy("id").agg(values.built_values(pair("p")).alias("published"), values.built_values(pair("c")).alias("current"))
    return held.withColumns({"p": values.parsed_values(F.col("published")), "c": values.parsed_values(F.col("current"))})


@query(f"WITH {_MOVES_SQL} SELECT id, sector, p AS published, c AS current FROM moves WHERE p > 0 AND c > p")
def map_explode_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _moves(spark, d).select("id", "c", F.explode("p").alias("sector", "published"))
    return rows.select("id", "sector", "published", F.element_at("c", F.col("sector")).alias("current")).filter("published > 0 and current > published")


@query(f"WITH {_MOVES_SQL} SELECT id, round(greatest(0.0, max((c - p) / p * 100)), 2) AS max_rise FROM moves GROUP BY id")
def max_rise(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d).select("id", values.max_rise(F.col("p"), F.col("c")).alias("max_rise"))


@query(f"WITH {_MOVES_SQL} SELECT id, sum(c - p) AS total_change FROM moves GROUP BY id")
def total_change(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d).select("id", F.aggregate(F.map_values(F.map_zip_with("p", "c", lambda k, p, c: c - p)), F.lit(0.0), lambda a, x: a + x).alias("total_change"))


@query("""WITH {news}, v AS (SELECT id, score, publish_time, CASE WHEN user_id % 4 <> 0 THEN 'A:1' ELSE '' END AS published, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'A:2' END AS current_value, CAST(user_id % 7 AS DOUBLE) AS rise, CAST(user_id % 6 AS DOUBLE) AS max_rise FROM news),
w AS (SELECT *, score >= 7 AND publish_time >= '1998-01-01' AS recent FROM v),
a AS (SELECT *, CASE WHEN current_value = '' THEN 'none' WHEN published = '' AND recent THEN 'both' WHEN published = '' THEN 'publish' WHEN recent THEN 'current' ELSE 'none' END AS action FROM w)
SELECT id, action, CASE WHEN action = 'none' THEN max_rise ELSE greatest(max_rise, CASE WHEN recent AND published <> '' THEN rise ELSE 0.0 END) END AS new_rise FROM a""")
def sync_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = news_rows(spark, d).withColumns({
        "published": F.when(F.col("user_id") % 4 != 0, "A:1").otherwise(""), "current_value": F.when(F.col("user_id") % 5 == 0, "").otherwise("A:2"),
        "rise": (F.col("user_id") % 7).cast("double"), "max_rise": (F.col("user_id") % 6).cast("double"),
    })
    return market.sync_decisions(rows, F.expr("score >= 7 and publish_time >= '1998-01-01'")).select("id", "action", "new_rise")


_PERIOD_SQL = "CASE WHEN hour(ts) < 9 OR (hour(ts) = 9 AND minute(ts) <= 30) THEN 'pre_market' ELSE 'regular' END"


@query(f"SELECT event_id, {_PERIOD_SQL} AS period, CASE WHEN {_PERIOD_SQL} = 'pre_market' THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS query_date FROM events")
def period_and_query_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.period(F.col("ts")).alias("period"), dates.query_date(F.col("ts")).alias("query_date"))


@query("""WITH q AS (SELECT event_type AS sector, date_trunc('day', ts) AS day, max(value) AS value FROM events WHERE user_id % 5 = 0 GROUP BY 1, 2),
n AS (SELECT event_id AS id, event_type AS sector, date_trunc('day', ts) AS day FROM events WHERE user_id % 5 <> 0)
SELECT id, (SELECT arg_max(q.value, q.day) FROM q WHERE q.sector = n.sector AND q.day <= n.day) AS value FROM n""")
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("sector"), F.to_date("ts").alias("query_date"))
    quotes = events.filter("user_id % 5 = 0").groupBy("sector", "query_date").agg(F.max("value").alias("value"))
    rows = events.filter("user_id % 5 <> 0").select(F.col("event_id").alias("id"), "sector", "query_date")
    return market.snapshot(rows, quotes).select("id", "value")


@query(f"SELECT {_PERIOD_SQL} AS period, CAST(ts AS DATE) AS day, count(*) AS n, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS sectors, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
def group_collect(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(dates.period(F.col("ts")).alias("period"), F.to_date("ts").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("sectors"), F.count_distinct("user_id").alias("n_users"))


@query("""SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 1 ELSE 0 END + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS high FROM events
WHERE CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 1 ELSE 0 END + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END >= 1""")
def high_dims_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "map<string,int>")["k"]
    dims = F.create_map(F.lit("a"), F.when(k >= 50, "高").otherwise("低"), F.lit("b"), F.when(F.col("event_type") == "click", "高").otherwise("中"))
    return table(spark, d, "events").select("event_id", values.high_dims(dims).alias("high")).filter("high >= 1")


@query("SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS n_useful, count(CASE WHEN value IS NULL THEN 1 END) AS n_error, count(CASE WHEN value IS NULL THEN 1 END) > count(*) // 2 AS retry FROM events GROUP BY event_type")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(value > 50).alias("n_useful"), F.count_if(value.isNull()).alias("n_error"))
    return rows.withColumn("retry", F.expr("n_error > n div 2"))


@query("SELECT source, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 0 ELSE 1 END) AS BIGINT) AS n_no_date FROM documents GROUP BY source")
def per_source_no_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("text").rlike("[0-9]{4}"), 0).otherwise(1)).alias("n_no_date"))


@query("SELECT l_suppkey AS sector, round(avg(l_quantity), 6) AS mean_change, count(*) > 0 AS known FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey")
def avg_change_label(spark: SparkSession, d: str) -> DataFrame:
    change = values.rate(F.concat(F.lit("+"), F.col("l_quantity").cast("string"), F.lit("%")))
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("sector")).agg(F.round(F.avg(change), 6).alias("mean_change"), (F.count(F.lit(1)) > 0).alias("known"))


@query("SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events) AS x WHERE nth <= 10")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    return news.first_of_each(rows, ["user_id"], [F.desc("value"), F.asc("event_id")], 10).select("user_id", "event_id", "nth")


@query("""WITH e AS (SELECT event_id, user_id, event_type <> 'error' AS dated, value > 20 AND event_type <> 'error' AS today, value <= 20 AND event_type <> 'error' AS old, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
i AS (SELECT *, sum(CAST(today AS INTEGER)) OVER (PARTITION BY user_id ORDER BY nth) AS island FROM e),
r AS (SELECT *, sum(CAST(old AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY nth) AS run FROM i),
s AS (SELECT *, min(CASE WHEN run >= 3 THEN nth END) OVER (PARTITION BY user_id) AS stop FROM r)
SELECT event_id FROM s WHERE nth <= 30 AND (stop IS NULL OR nth <= stop) AND NOT old""")
def admission_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    return news.admitted(rows, "user_id", "event_id", F.col("value") > 20, F.col("event_type") != "error", 30, 3).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) AS x WHERE before IS DISTINCT FROM event_type")
def adjacent_dedup(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", "event_type", before.alias("before")).filter("not (before <=> event_type)").select("event_id")


@query("SELECT event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_error FROM events")
def lookahead_frame(spark: SparkSession, d: str) -> DataFrame:
    ahead = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, 3)
    return table(spark, d, "events").select("event_id", F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(ahead).alias("next_error"))


@query("SELECT user_id AS phone, max(event_id) AS id FROM events WHERE event_type <> 'click' AND ts > TIMESTAMP '2024-01-05 00:00:00' GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("phone"), (F.col("event_type") == "click").cast("int").alias("used"), F.col("ts").alias("expire_at"))
    return social.newest_code(codes, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).select("phone", "id")


@query("""WITH {news} SELECT id, nth = 1 AND free AS locked FROM (SELECT id, c_mktsegment = 'MACHINERY' AS free, row_number() OVER (PARTITION BY user_id ORDER BY publish_time DESC, id DESC) AS nth FROM news JOIN customer ON c_custkey = user_id) AS x""")
def lock_first(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_mktsegment") == "MACHINERY").alias("free"))
    rows = news_rows(spark, d).select("id", "user_id", "publish_time").join(users, "user_id")
    return news.first_of_each(rows, ["user_id"], [F.desc("publish_time"), F.desc("id")], 2**31 - 1).select("id", ((F.col("nth") == 1) & F.col("free")).alias("locked"))


@query("SELECT n_nationkey AS id, CAST(floor((row_number() OVER (ORDER BY n_nationkey) - 1) / 4) AS BIGINT) AS chunk FROM nation")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return news.chunks(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), [F.asc("id")], 4)


@query("SELECT o_orderkey AS id, CAST(floor((row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) / 50) AS BIGINT) AS chunk FROM orders")
def batch_chunks_of_orders(spark: SparkSession, d: str) -> DataFrame:
    return news.chunks(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), [F.desc("o_orderdate"), F.asc("id")], 50).select("id", "chunk")


@query("SELECT p_type AS name, row_number() OVER (ORDER BY coalesce(rate, 0) DESC, p_type) AS place FROM (SELECT p_type, max(CASE WHEN p_size > 45 THEN p_retailprice END) AS rate FROM part GROUP BY p_type) AS x")
def quote_sort(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.max(F.when(F.col("p_size") > 45, F.col("p_retailprice"))).alias("rate")).withColumn("nth", F.col("name"))
    return market.sorted_quotes(quotes).select("name", "place")


@query("SELECT c_custkey AS id, 'idle' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'both' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    users, asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    idle = users.join(asked, "id", "left_anti").select("id", F.lit("idle").alias("kind"))
    return idle.unionByName(asked.join(users.filter("c_acctbal < 0"), "id", "left_semi").select("id", F.lit("both").alias("kind")))


#: The forms of a time in which orders are told, by id: SQL's format, Spark's format.
_TOLD = [
    ("%Y-%m-%d 08:05", "yyyy-MM-dd' 08:05'"), ("%Y/%m/%d", "yyyy/MM/dd"), ("%Y年%m月%d日 8:05", "yyyy年MM月dd日' 8:05'"), ("%Y-%m-%dT08:05:09", "yyyy-MM-dd'T08:05:09'"), ("%Y-%m-%d 08:05:09.25", "yyyy-MM-dd' 08:05:09.25'"),
    ("%b %d, %Y", "MMM dd, yyyy"), ("%m/%d/%Y", "MM/dd/yyyy"), ("%Y.%m.%d 08:05:09", "yyyy.MM.dd' 08:05:09'"), ("%Y-%m-%dT08:05", "yyyy-MM-dd'T08:05'"), ("at no time", "'at no time'"),
]
_TIMES_SQL = "|".join(dates.FORMS)
_NORMALISED_SQL = r"""CASE WHEN regexp_matches(raw, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') THEN raw WHEN regexp_matches(raw, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') THEN raw[1:10] || ' ' || raw[12:19]
  WHEN regexp_matches(raw, '^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}') THEN regexp_extract(raw, '^\d{4}') || '-' || lpad(regexp_extract(raw, '^\d{4}.(\d{1,2})', 1), 2, '0') || '-' || lpad(regexp_extract(raw, '^\d{4}.\d{1,2}.(\d{1,2})', 1), 2, '0') || ' ' ||
    CASE WHEN regexp_matches(raw, '^\d{4}.\d{1,2}.\d{1,2}日?\s*\d{1,2}:\d{2}') THEN lpad(regexp_extract(raw, '(\d{1,2}):\d{2}', 1), 2, '0') || ':' || regexp_extract(raw, ':(\d{2})', 1) || ':' || coalesce(nullif(regexp_extract(raw, ':\d{2}:(\d{2})', 1), ''), '00') ELSE '00:00:00' END END"""


@query(rf"""WITH x AS (SELECT o_orderkey AS id, o_orderdate, 'updated 1990/1/2, posted ' || CASE o_orderkey % 10 {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (f, _) in enumerate(_TOLD))} END || ' by x' AS told FROM orders),
f AS (SELECT id, unnest(found) AS raw, unnest(range(len(found))) AS place FROM (SELECT id, regexp_extract_all(told, '{_TIMES_SQL}') AS found FROM x) AS y),
n AS (SELECT *, {_NORMALISED_SQL} AS normalised FROM f), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(normalised, raw) DESC, place) AS nth FROM n)
SELECT x.id, raw, normalised, coalesce(normalised[1:10] = '1998-01-05', FALSE) AS today,
  CASE x.id % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS of_url FROM x JOIN best ON best.id = x.id AND nth = 1""")
def date_extract(spark: SparkSession, d: str) -> DataFrame:
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    form = F.coalesce(*(F.when(key % 10 == i, F.date_format(at, f)) for i, (_, f) in enumerate(_TOLD)))
    told = F.concat(F.lit("updated 1990/1/2, posted "), form, F.lit(" by x"))
    ends = [F.concat(F.lit("n1/2024/1399/"), F.date_format(at, "yyyy"), F.lit("/x")), F.concat(F.date_format(at, "yyyy/MMdd"), F.lit(".html")), F.lit("n1/2024/0041/x")]
    ends[0] = F.concat(F.date_format(at, "yyyy/MMdd"), F.lit("/n1/2024/1399/x"))
    url = F.concat(F.lit("http://example.com/"), F.coalesce(*(F.when(key % 3 == i, e) for i, e in enumerate(ends))))
    rows = table(spark, d, "orders").select(key.alias("id"), dates.latest_in(told).alias("raw"), dates.from_url(url).alias("of_url"))
    return rows.withColumns({"normalised": dates.normalised(F.col("raw")), "today": dates.is_day(F.col("raw"), F.lit("1998-01-05").cast("date"))})


_ENDS = ["/news/2024/01/02/a", "/article/1", "/Index/show/", "/news/a12.htm", "/newsroom/article/1", "/ARTICLE/1.GIF", "/CATEGORY/news/1", "/2024/a.htm", "/news/?s=1", "/a-12-b.html", "/page/show/", ""]


def _any_of(text_sql: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text_sql}, '{w}')" for w in words) + ")"


@query(rf"""WITH x AS (SELECT page_id, url || CASE page_id % 12 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS))} END AS u FROM pages)
SELECT page_id, NOT suffix(lower(u), '.gif') AND NOT {_any_of('u', text.LISTS)} AND NOT {_any_of('lower(u)', text.LISTS_ANY_CASE)}
  AND CASE WHEN regexp_matches(u, '/news(/|$|\?)') THEN regexp_matches(u, '/news/\d{{4}}/\d{{2}}/\d{{2}}/') ELSE {_any_of('lower(u)', text.ARTICLES)} END AS listed,
NOT suffix(lower(u), '.gif') AND NOT {_any_of('lower(u)', text.LEARNED_LISTS)} AND (((regexp_matches(u, '/\d+') OR regexp_matches(u, '[-.]\d+[-.]')) AND contains(u, '.htm')) OR {_any_of('lower(u)', text.LEARNED_ARTICLES)}) AS learned FROM x""")
def url_is_article(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat("url", F.coalesce(*(F.when(F.col("page_id") % 12 == i, e) for i, e in enumerate(_ENDS))))
    return table(spark, d, "pages").select("page_id", text.is_article_url(url).alias("listed"), text.is_article_url_learned(url).alias("learned"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS origin FROM pages")
def url_origin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", values.url_parameters(F.col("url"))["utm_source"].alias("origin"))


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, coalesce(contains(html, '<article>'), FALSE) AS has_article FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.title_of(F.col("html")).alias("title"), F.coalesce(F.col("html").contains("<article>"), F.lit(False)).alias("has_article"))


def _plain_sql(part: str, between: str = "") -> str:
    """SQL that takes tags out of a part of a page and reads the character references that the test pages have."""
    found = f"regexp_replace({part}, '<[^>]+>', '{between}', 'g')"
    return reduce(lambda c, kv: f"replace({c}, '{kv[0]}', '{kv[1]}')", (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")), found)


def _spaced_sql(part: str) -> str:
    return f"trim(regexp_replace({part}, '\\s+', ' ', 'g'))"


def _paragraphs_sql(part: str) -> str:
    kept = f"len(p) >= 15 AND NOT {_any_of('p', text.PARAGRAPH_NOISE)} AND NOT starts_with(p, 'http') AND NOT regexp_matches(p, '^\\[.+\\]\\(https?://') AND NOT (regexp_matches(p, '^\\d{{4}}[-/年]\\d{{1,2}}[-/月]\\d{{1,2}}[日]?\\s*\\d{{1,2}}:\\d{{2}}') AND len(p) < 30)"
    found = f"list_transform(regexp_extract_all({part}, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: regexp_replace({_plain_sql('p')}, '^\\s+|\\s+$', '', 'g'))"
    return f"nullif(array_to_string(list_filter({found}, lambda p: {kept}), ' '), '')".replace("{{", "{").replace("}}", "}")


@query(rf"""WITH x AS (SELECT page_id, html, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS area FROM pages),
b AS (SELECT page_id, html, area, {_spaced_sql(_plain_sql('area'))} AS body FROM x),
p AS (SELECT page_id, html, CASE WHEN length(body) >= 200 THEN body ELSE coalesce({_paragraphs_sql('area')}, {_paragraphs_sql('html')}, regexp_replace({_plain_sql('html', ' ')}, '\s{{3,}}', ' ', 'g')) END AS body FROM b)
SELECT page_id, {_spaced_sql("regexp_replace(body, '#{1,6}\\s+', '', 'g')")} AS body FROM p""")
def html_body(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.body_of(F.col("html"), F.col("url")).alias("body"))


#: Where a page's time may stand: what follows its own html, and what is found, by {i} (its day as 2024-01-31), {n} (the next day), {c} (2024年01月31日).
_PAGE_TIMES = [
    ("<span class='time'>{c} 23:22</span> 2099-01-01", "{c} 23:22"), ('<div class="news_info">{i}</div> 2099-01-01', "{i}"), ('<meta name="publishdate" content="{i}T08:00:00"> 2099-01-01', "{i}T08:00:00"), ("<meta name='og:published_time' content='{i}'> 2099-01-01", "{i}"),
    ("<time datetime='{i} 10:00'> 2099-01-01", "{i} 10:00"), ("<p>{i} and {n}</p>", "{n}"), ("<p>none</p>", "{i} 00:00:00"), ('<div class="news_bt1_left">来源 {i} 07:01</div> 2099-01-01', "{i} 07:01"), ('<b id="newstime">{i}</b> 2099-01-01', "{i}"),
    ('<p class="w-createtime"><i class="w-createtime-date">{i}</span> <i class="w-createtime-time">09:30:05</span> 2099-01-01', "{i} 09:30:05"), ('<div class="detail_left"><i>{i}</i> 11:12</div> 2099-01-01', "{i} 11:12"),
]
_DAYS_SQL = "x AS (SELECT page_id, strftime(DATE '2024-01-01' + CAST(page_id % 700 AS INTEGER), '%Y-%m-%d') AS i, strftime(DATE '2024-01-02' + CAST(page_id % 700 AS INTEGER), '%Y-%m-%d') AS n, strftime(DATE '2024-01-01' + CAST(page_id % 700 AS INTEGER), '%Y年%m月%d日') AS c FROM pages)"


@query(f"WITH {_DAYS_SQL} SELECT page_id, replace(replace(replace(CASE page_id % {len(_PAGE_TIMES)} {' '.join(f"WHEN {k} THEN '{t}'" for k, (_, t) in enumerate(_PAGE_TIMES))} END, '{{i}}', i), '{{n}}', n), '{{c}}', c) AS published FROM x")
def page_times(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a time of their own added in each of the places where one may stand."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 700).cast("int"))
    told = {"{i}": F.date_format(day, "yyyy-MM-dd"), "{n}": F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), "{c}": F.date_format(day, "yyyy年MM月dd日")}
    html = F.coalesce(*(F.when(F.col("page_id") % len(_PAGE_TIMES) == k, h) for k, (h, _) in enumerate(_PAGE_TIMES)))
    html = F.concat("html", reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), kv[1]), told.items(), html))
    return table(spark, d, "pages").select("page_id", dates.of_page(html, F.concat("url", F.lit("/"), F.date_format(day, "yyyy/MMdd"), F.lit("/"))).alias("published"))


_MARKS = ['<i class="article_content">', '<i id="news_detail">', "see news.smm.cn", '<i class="people_news_content">', '<b class="article" pubdate>', ""]


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'cnenergynews' WHEN 1 THEN 'mydrivers' WHEN 2 THEN 'smm' WHEN 3 THEN 'people' WHEN 4 THEN 'cnenergynews' ELSE CASE page_id % 4 WHEN 1 THEN 'moa' WHEN 3 THEN 'mydrivers' ELSE 'unknown' END END AS source FROM pages")
def page_sources(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("page_id")
    html = F.concat("html", F.coalesce(*(F.when(key % 6 == i, m) for i, m in enumerate(_MARKS))))
    url = F.concat("url", F.when(key % 4 == 1, "?www.moa.gov.cn").when(key % 4 == 3, "?news.mydrivers.com").otherwise(""))
    return table(spark, d, "pages").select("page_id", text.source_of(url, html).alias("source"))


@query(f"""WITH x AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) WHEN 1 THEN regexp_extract(html, '(?s)<nav>.*?</nav>') ELSE '' END AS part, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages)
SELECT page_id, {_spaced_sql(_plain_sql('part'))} AS found, CASE WHEN length({_spaced_sql(_plain_sql('h1'))}) >= 50 THEN {_spaced_sql(_plain_sql('h1'))} END AS heading FROM x""")
def source_patterns(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("page_id")
    pattern = F.when(key % 3 == 0, "<title[^>]*>([^<]*)</title>").when(key % 3 == 1, "<nav>.*?</nav>").otherwise("(not there)")
    tried = text.by_all_patterns(F.col("html"), {"h1": "<h1>(.*?)</h1>", "none": "(not there)"})
    return table(spark, d, "pages").select("page_id", text.by_source_pattern(F.col("html"), pattern).alias("found"), tried["h1"].alias("heading"))


@query(r"""WITH x AS (SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<&]*)', 1), '[*_~`]', '', 'g') AS title, strftime(DATE '2024-01-01' + CAST(page_id % 700 AS INTEGER), '%Y-%m-%d') AS i, regexp_replace(url, '[?#].*', '') AS u FROM pages)
SELECT page_id, 1 AS place, trim('About ' || title) AS title, u || '/article/1' AS url, '' AS subtitle, i AS list_date FROM x UNION ALL SELECT page_id, 3, trim('Also on ' || title), u || '/info/2', trim(left(trim('Of this: ' || title), 300)), CASE WHEN page_id % 2 = 0 THEN i END FROM x
UNION ALL SELECT page_id, 7, trim('Other than ' || title), u || '/news/' || replace(i, '-', '/') || '/3', '', i FROM x""")
def list_page_articles(spark: SparkSession, d: str) -> DataFrame:
    """List pages made of pages' titles, addresses and days: a dated title, a link that only navigates, a dated address."""
    title, url = F.regexp_replace(F.regexp_extract("html", "<title>([^<&]*)", 1), "[*_~`]", ""), F.regexp_replace("url", "[?#].*", "")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 700).cast("int")), "yyyy-MM-dd")
    lines = [
        F.lit("# List"), F.concat(F.lit("[About "), title, F.lit(" "), day, F.lit("]("), url, F.lit("/article/1)")), F.lit("[About these pages](http://x.example/about)"), F.concat(F.lit("[Read more]("), url, F.lit("/info/2)")),
        F.concat(F.lit("**[News] Also on "), title, F.lit("**")), F.when(F.col("page_id") % 2 == 0, day).otherwise("short"), F.concat(F.lit("*Of* this: "), title), F.concat(F.lit("[Other than "), title, F.lit("]("), url, F.lit("/news/"), F.translate(day, "-", "/"), F.lit("/3)")),
    ]
    return table(spark, d, "pages").select("page_id", F.inline(text.listed_articles(F.concat_ws("\n", *lines))))


_TITLE_SQL = "CASE doc_id % 5 WHEN 0 THEN '【图片】' || left(text, 20) WHEN 1 THEN '12345' WHEN 2 THEN left(text, 3) ELSE left(text, 30) END"


@query(rf"""WITH x AS (SELECT doc_id, length(coalesce(text, '')) AS n, coalesce({_TITLE_SQL}, '') AS title, CASE doc_id % 3 WHEN 0 THEN '2024-01-01 00:00:00' WHEN 1 THEN '2024-01-01' END AS t, length(regexp_replace(coalesce(text, ''), '[^<>{{]', '', 'g')) AS m FROM documents),
y AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(trim(title), '{p}') THEN 'noise_title:{p}'" for p in text.BAD_TITLES)} END AS noise FROM x)
SELECT doc_id, n AS n_chars, length(title) AS title_chars, t IS NOT NULL AS has_time, coalesce(t = '2024-01-01 00:00:00', FALSE) AS time_is_zero, n >= 200 AND length(title) >= 5 AND noise IS NULL AND NOT m > n * CAST(0.05 AS DOUBLE) AS passed,
  concat_ws(';', CASE WHEN n < 200 THEN 'content_too_short:' || n END, CASE WHEN length(title) < 5 THEN 'title_missing_or_too_short' END, CASE WHEN t = '2024-01-01 00:00:00' THEN 'time_may_be_missing' END, noise, CASE WHEN m > n * CAST(0.05 AS DOUBLE) THEN 'content_impure:label_chars=' || m END) AS issues FROM y""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    title = F.when(key % 5 == 0, F.concat(F.lit("【图片】"), F.left("text", F.lit(20)))).when(key % 5 == 1, "12345").when(key % 5 == 2, F.left("text", F.lit(3))).otherwise(F.left("text", F.lit(30)))
    at = F.when(key % 3 == 0, "2024-01-01 00:00:00").when(key % 3 == 1, "2024-01-01")
    rows = table(spark, d, "documents").select("doc_id", text.quality(title, F.col("text"), at).alias("r"))
    return rows.select("doc_id", "r.n_chars", "r.title_chars", "r.has_time", "r.time_is_zero", "r.passed", F.array_join("r.issues", ";").alias("issues"))


_LINES_SQL = rf"""l AS (SELECT doc_id, unnest(range(len(lines))) AS nth, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS x),
s AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS plain FROM l), m AS (SELECT *, length(plain) AS n FROM s),
o AS (SELECT *, CASE WHEN n = 0 THEN 0e0 WHEN n < 5 THEN 1e-1 ELSE greatest(0e0, least(1e0, CASE WHEN n < 15 THEN 2e-1 WHEN n < 30 THEN 5e-1 WHEN n < 200 THEN 8e-1 ELSE 6e-1 END * 2e-1
  + (1 - length(regexp_replace(array_to_string(regexp_extract_all(line, '\[[^\]]*\]\([^)]+\)|<a[^>]*>[^<]*</a>'), ''), '[\[\](){{}}<>`]', '', 'g')) / CAST(n AS DOUBLE)) * 2e-1 + (n - length(regexp_replace(plain, '[一-鿿]', '', 'g'))) / CAST(n AS DOUBLE) * 3e-1
  + (1 - (n - length(regexp_replace(plain, '[a-zA-Z0-9]', '', 'g'))) / CAST(n AS DOUBLE)) * 15e-2 - least(5e-1, ({' + '.join(f"CAST(contains(plain, '{w}') AS INTEGER)" for w in text.NOISE)}) * 15e-2) + CASE WHEN regexp_matches(plain, '[。！？.!?]$') THEN 1e-1 ELSE 0e0 END)) END AS score FROM m),
k AS (SELECT * FROM o WHERE n >= 3 AND NOT regexp_matches(plain, '^[|\-=•○●◆■□▪▫◦▪*]{{3,}}$') AND NOT (n < 10 AND regexp_matches(plain, '^[a-zA-Z0-9\s().,;:!?-]+$')) AND score >= 25e-2),
kept AS (SELECT * FROM (SELECT *, lag(plain) OVER (PARTITION BY doc_id ORDER BY nth) AS before FROM k) AS y WHERE before IS DISTINCT FROM plain)"""


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(nth AS INTEGER) AS nth, round(score, 6) AS score FROM kept")
def line_score_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines that score at least 0.25, without those equal to the line before. Each line is scored once."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(text.article_lines(F.col("text"))).alias("x"))
    return lines.select("doc_id", F.col("x.place").alias("nth"), F.round("x.score", 6).alias("score"))


@query(f"""WITH {_LINES_SQL}, t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY nth) AS text FROM kept GROUP BY doc_id),
c AS (SELECT doc_id, {reduce(lambda c, p: f"regexp_replace({c}, '{p}', '', 'g')", text.BOILERPLATE, 'text')} AS cleaned FROM t)
SELECT d.doc_id, coalesce(regexp_replace(regexp_replace(cleaned, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '') AS cleaned FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.text IS NOT NULL""".replace("{{3,}}", "{3,}"))
def boilerplate_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.without_boilerplate(F.col("text")).alias("cleaned"))


@query("""WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS x)
SELECT doc_id, line AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, place DESC) AS nth FROM l) AS y WHERE nth = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Of several texts for one article the longest, of equal ones the one of the best score."""
    told = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.length(x).alias("size"), i.alias("score"), x.alias("text")))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.array_max(told)["text"].alias("best"))


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY md5('7|' || CAST(page_id AS VARCHAR))) AS nth FROM pages) AS x WHERE nth <= 5")
def sampled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Five pages at random, the same ones for the same seed: this operator samples."""
    return table(spark, d, "pages").select("page_id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("page_id").cast("string")))).limit(5)


@query("SELECT p_partkey AS code, CASE WHEN p_size > 25 THEN '高' ELSE '低' END AS first, '' AS second, '中' AS third, '未知' AS fourth FROM part")
def four_dims_parse(spark: SparkSession, d: str) -> DataFrame:
    dims = values.four_dims(F.concat(F.when(F.col("size") > 25, "高").otherwise("低"), F.lit("//中")))
    names = dict(zip(("first", "second", "third", "fourth"), values.DIMENSIONS, strict=True))
    return stock_rows(spark, d).select("code", *(dims[v].alias(k) for k, v in names.items()))


def _report() -> Column:
    return F.concat("p_type", F.lit("/"), F.floor(F.col("p_partkey") / 100).cast("string")).alias("report_id")


def _by_key(line: Column) -> Column:
    """An aggregate: the lines of a report's parts, a hundred at most, in the order of their keys."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("at"), line.alias("line")))), lambda x: x["line"]), "\n")


@query("SELECT p_type || '/' || p_partkey // 100 AS report_id, p_brand AS tier, CASE WHEN p_size = 1 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS code, p_name AS name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def report_table_parse(spark: SparkSession, d: str) -> DataFrame:
    """Reports of a type and a range of a hundred keys, with their rows by key."""
    cell = F.concat(F.lit("| **"), F.col("p_brand"), F.lit("** | 1 | "), F.when(F.col("p_size") == 1, "-").otherwise(F.col("p_partkey").cast("string")), F.lit(" | "), F.col("p_name"), F.lit(" | link | 高/中/低/高 |"))
    reports = table(spark, d, "part").groupBy(_report()).agg(F.concat(F.lit("# Report\n|a|b|c|d|e|\n|---|---|---|---|---|\n"), _by_key(cell)).alias("text"))
    return market.report_rows(reports, ["Brand#1", "Brand#2"]).select("report_id", "tier", "code", "name")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """A report of each part type and range of keys, with both appendices: parts are what it rules out, their number what a link has."""
    cell = F.concat(F.lit("| **"), F.col("p_partkey").cast("string"), F.lit("** | "), F.col("p_name"), F.lit(" | of size "), F.col("p_size").cast("string"), F.lit(" | R"), (F.col("p_size") % 4).cast("string"), F.lit(" |"))
    by = table(spark, d, "part").groupBy(_report()).agg(_by_key(cell).alias("rows"), F.count(F.lit(1)).cast("string").alias("n"))
    parts = [F.lit("# Report\n| x | 1 | 2 | 3 |\n附录一 已剔除\n| 名称 | 代码 | 原因 | 规则 |\n|---|---|---|---|\n"), F.col("rows"), F.lit("\n附录二 覆盖\n上游资源: 已覆盖 "), F.col("n"), F.lit(" 家\n中游制造 √\n下游应用: 无此环节\n下游封测 ×\n其他\n附录三\n上游设备: √ 9")]
    return by.select("report_id", F.concat(*parts).alias("text"))


@query("SELECT p_type || '/' || p_partkey // 100 AS report_id, CAST(p_partkey AS VARCHAR) AS code, p_name AS name, 'of size ' || p_size AS reason, 'R' || (p_size % 4) AS rule_no FROM part")
def report_eliminated(spark: SparkSession, d: str) -> DataFrame:
    return market.eliminated_rows(_reports(spark, d)).select("report_id", "code", "name", "reason", "rule_no")


@query("""WITH n AS (SELECT p_type || '/' || p_partkey // 100 AS report_id, count(*) AS n FROM part GROUP BY 1)
SELECT report_id, '上游资源' AS link, '已覆盖' || n || '家' AS state FROM n UNION ALL SELECT report_id, '中游制造', '已覆盖1家' FROM n UNION ALL SELECT report_id, '下游应用', '无此环节' FROM n UNION ALL SELECT report_id, '下游封测', '未覆盖' FROM n""")
def report_coverage(spark: SparkSession, d: str) -> DataFrame:
    return market.chain_coverage(_reports(spark, d))


#: Sectors with initials and other names, and raw names that reach each step: initials, keywords that beat LIKE, LIKE, suffix, parts.
_SECTORS_SQL = "s AS (SELECT n_nationkey AS id, n_name AS name, 'p' || n_nationkey || 'q' AS initials, 'kw' || n_nationkey || ',' || left((SELECT m.n_name FROM nation m WHERE m.n_nationkey = (nation.n_nationkey + 3) % 25), 4) AS keywords FROM nation)"
_RAW_SQL = "k AS (SELECT DISTINCT p_name AS raw, '' AS pinyin FROM part UNION SELECT n_name, '' FROM nation UNION SELECT lower(n_name) || '板块', '' FROM nation UNION SELECT left(n_name, 4), '' FROM nation UNION SELECT 'zz' || n_nationkey, 'p' || n_nationkey || 'q' FROM nation UNION SELECT '#' || n_nationkey, left(n_name, 2) FROM nation UNION SELECT 'KW' || n_nationkey || '设备', '' FROM nation UNION SELECT 'xyzq' || right(n_name, 3), '' FROM nation)"
_STEPS_SQL = "SELECT raw, pinyin, {step} AS step, {key} AS key, {own} AS own, {least} AS from_tier, {most} AS to_tier, {any} AS any_place FROM k WHERE {where}"
_TRIES = [(0, "raw", "pinyin", 0, 0, "FALSE", "TRUE"), (1, "pinyin", "''", 0, 3, "FALSE", "length(pinyin) >= 2"), (2, "raw", "pinyin", 3, 3, "TRUE", "TRUE"), (3, "raw", "pinyin", 0, 3, "FALSE", "TRUE")]
_TRIES += [(4, "regexp_replace(raw, '(行业|板块|概念|设备|生产|制造|相关|主题)$', '')", "''", 0, 3, "FALSE", "regexp_matches(raw, '..(行业|板块|概念|设备|生产|制造|相关|主题)$')")]
_TRIES += [(3 + n, f"left(raw, {n})", "''", 0, 3, "FALSE", f"length(raw) > {n}") for n in (2, 3, 4)] + [(6 + n, f"right(raw, {n})", "''", 0, 2, "FALSE", f"length(raw) > {n}") for n in (2, 3, 4)]
_NORMALISE_SQL = f"""t AS ({' UNION ALL '.join(_STEPS_SQL.format(step=a, key=b, own=c, least=e, most=f, any=g, where=h) for a, b, c, e, f, g, h in _TRIES)}),
h AS (SELECT t.*, 0 AS tier, s.id, s.name FROM t JOIN s ON s.name = key UNION ALL SELECT t.*, 1, s.id, s.name FROM t JOIN s ON s.initials = own AND length(own) >= 2
  UNION ALL SELECT t.*, 2, s.id, s.name FROM t JOIN s ON s.name ILIKE '%' || key || '%' UNION ALL SELECT t.*, 3, s.id, s.name FROM t JOIN s ON s.keywords ILIKE '%' || key || '%'),
p AS (SELECT *, row_number() OVER (PARTITION BY raw, pinyin, step ORDER BY tier, id) AS nth, min(tier) OVER (PARTITION BY raw, pinyin, step) = 0 AS exact FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY raw, pinyin ORDER BY step, nth) AS choice FROM p WHERE (CASE WHEN exact THEN tier = 0 AND nth = 1 ELSE nth <= 5 END) AND tier BETWEEN from_tier AND to_tier AND (any_place OR nth = 1) AND (step < 9 OR tier IN (0, 2)))"""


def _sectors(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    other = nation.select(((F.col("n_nationkey") + 22) % 25).alias("n_nationkey"), F.left("n_name", F.lit(4)).alias("other"))
    key = F.col("n_nationkey").cast("string")
    return nation.join(other, "n_nationkey").select(
        F.col("n_nationkey").alias("id"), key.alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("kw"), key, F.lit(","), "other").alias("keywords"), F.concat(F.lit("p"), key, F.lit("q")).alias("pinyin_initial")
    )


def _raw_names(spark: SparkSession, d: str) -> DataFrame:
    nation, key, name, none = table(spark, d, "nation"), F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit("")
    told = [(name, none), (F.concat(F.lower(name), F.lit("板块")), none), (F.left(name, F.lit(4)), none), (F.concat(F.lit("zz"), key), F.concat(F.lit("p"), key, F.lit("q"))), (F.concat(F.lit("#"), key), F.left(name, F.lit(2))), (F.concat(F.lit("KW"), key, F.lit("设备")), none), (F.concat(F.lit("xyzq"), F.right(name, F.lit(3))), none)]
    pairs = nation.select(F.inline(F.array(*(F.struct(r.alias("raw"), p.alias("pinyin")) for r, p in told))))
    return table(spark, d, "part").select(F.col("p_name").alias("raw"), none.alias("pinyin")).unionByName(pairs).distinct()


@query(f"WITH {_SECTORS_SQL}, {_RAW_SQL}, {_NORMALISE_SQL} SELECT k.raw, k.pinyin, id, name, id IS NOT NULL AS normalized FROM k LEFT JOIN (SELECT * FROM f WHERE choice = 1) AS b ON b.raw = k.raw AND b.pinyin = k.pinyin")
def entity_normalise(spark: SparkSession, d: str) -> DataFrame:
    return market.normalised(_raw_names(spark, d), _sectors(spark, d)).select("raw", "pinyin", "id", "name", "normalized")


@query(f"""WITH {_SECTORS_SQL}, {_RAW_SQL}, {_NORMALISE_SQL}, q AS (SELECT n_name AS name, '+' || n_regionkey || '%' AS change_rate FROM nation WHERE n_nationkey < 15)
SELECT k.raw, k.pinyin, b.name AS sector, change_rate FROM k LEFT JOIN (SELECT * FROM f WHERE choice = 1) AS b ON b.raw = k.raw AND b.pinyin = k.pinyin LEFT JOIN q ON q.name = b.name""")
def sector_quote_lookup(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "nation").filter("n_nationkey < 15").select(F.col("n_name").alias("name"), F.concat(F.lit("+"), F.col("n_regionkey").cast("string"), F.lit("%")).alias("change_rate"))
    return market.sector_quotes(_raw_names(spark, d), _sectors(spark, d), quotes).select("raw", "pinyin", "sector", "change_rate")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 OR c_acctbal < 1000 THEN 'free' ELSE c_mktsegment END AS state FROM customer")
def subscription_state(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("level"), F.col("c_acctbal").alias("expires"))
    return social.states(users, F.lit(1000.0)).select("id", "state")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) >= 5 AS locked FROM events")
def login_lock(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return social.locked(rows, "user_id", "ts", F.col("event_type") == "error", minutes=1440).select("event_id", "failures", "locked")


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_id % 5 = 4 THEN FALSE END AS moves FROM events")
def llm_json_recover(spark: SparkSession, d: str) -> DataFrame:
    """Replies in blocks: the last one that holds JSON counts, in a list of one or not; one that only says no is no."""
    props, key = F.col("props"), F.col("event_id") % 5
    told = F.when(key == 0, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nDone."))).when(key == 1, F.concat(F.lit("["), props, F.lit("]"))).when(key < 4, props).otherwise("不会引起市场波动")
    blocks = F.when(key == 4, F.array(F.lit("thinking"), told)).otherwise(F.array(F.lit('draft {"k": -1}'), told, F.lit("that {is} all"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", values.recovered_json(blocks, "k int, will_flunctuate boolean").alias("r")).select("event_id", "r.k", F.col("r.will_flunctuate").alias("moves"))


@query("""WITH e AS (SELECT event_id, user_id % 2 = 0 AS even, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS moves FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN moves END AS first, CASE WHEN event_id % 2 = 1 THEN even END AS second, CASE WHEN event_id % 2 = 0 THEN moves END AS third FROM e""")
def llm_batch_recover(spark: SparkSession, d: str) -> DataFrame:
    """Replies on three news: a list whose last entry of an id counts, or loose objects whose first does, of which one is fifty deep."""
    moves = F.when(F.regexp_extract("props", r"(\d+)", 1).cast("int") % 2 == 0, "true").otherwise("false")
    even = F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")
    entry = lambda n, told, more="": F.concat(F.lit(f'{{"id": {n}, "will_flunctuate": '), told, F.lit(more + "}"))
    deep = ', "why": ' + '{"a": ' * 50 + "1" + "}" * 50
    listed = F.array(F.concat(F.lit("ok\n```json\n["), entry(3, F.lit("true")), F.lit(","), entry(7, F.lit("true")), F.lit(",")), F.concat(entry(3, moves), F.lit("]\n```")))
    loose = F.array(F.concat(F.lit("[1] { "), entry(2, even), F.lit(" {broken} "), entry(2, F.lit("null")), F.lit(" "), entry(1, moves, deep), F.lit(" ]")), F.lit('{"id": 3}'))
    found = values.aligned(values.recovered_batch(F.when(F.col("event_id") % 2 == 0, listed).otherwise(loose), "id int, will_flunctuate boolean"), F.lit(3))
    told = text.once(found, lambda x: F.struct(*(F.get(x, F.lit(i))["will_flunctuate"].alias(n) for i, n in enumerate(("first", "second", "third")))))
    return table(spark, d, "events").select("event_id", told.alias("r")).select("event_id", "r.*")


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def review_recover(spark: SparkSession, d: str) -> DataFrame:
    told = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("So: "), "props", F.lit("!"))).otherwise("no")
    blocks = F.array(F.struct(F.lit("text").alias("type"), told.alias("text")), F.struct(F.lit("thinking").alias("type"), F.lit('{"k": -1}').alias("text")))
    return table(spark, d, "events").select("event_id", values.recovered_review(blocks, "k int")["k"].alias("k"))


@query("""WITH {news}, n AS (SELECT id, user_id, row_number() OVER (ORDER BY publish_time DESC, id DESC) - 1 AS place FROM news WHERE batch_id = (SELECT max(batch_id) FROM news))
SELECT id, CAST(place // 50 AS BIGINT) AS chunk, CAST(place % 50 + 1 AS BIGINT) AS nth, CASE WHEN (place % 50 + 1) % 4 = 0 THEN 'failed' WHEN (place // 50 + place % 50 + 1) % 2 = 0 THEN 'useful' ELSE 'rejected' END AS state FROM n""")
def replies_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The newest batch in requests of 50, each news with the reply to its ordinal; every fourth has none."""
    rows = news.numbered(news.newest_batch(news_rows(spark, d)).select("id", "publish_time"), [F.desc("publish_time"), F.desc("id")], 50)
    replies = rows.filter("nth % 4 <> 0").select("chunk", "nth", ((F.col("chunk") + F.col("nth")) % 2 == 0).alias("useful"))
    return news.judged(rows, replies).select("id", "chunk", "nth", "state")


@query("WITH {news} SELECT id, CASE WHEN user_id % 10 = 0 THEN 'X' ELSE status END AS status FROM news")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = news_rows(spark, d)
    changes = rows.filter("user_id % 10 = 0").select("id", F.lit("X").alias("status"))
    return news.updated(rows, changes, "id", ["status"]).select("id", "status")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'NEW' ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'ADDED'")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    changes = rows.filter("id < 5").select("id", F.lit("NEW").alias("name")).unionByName(spark.range(1).select(F.lit(100).alias("id"), F.lit("ADDED").alias("name")))
    return news.upserted(rows, changes, "id")


@query("""WITH f AS (SELECT min(o_orderkey) AS id, o_custkey FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS id, count(event_id) AS n_comments, coalesce(string_agg(event_type, '|' ORDER BY ts, event_id), '') AS comments FROM orders LEFT JOIN f ON f.id = o_orderkey LEFT JOIN events ON user_id = f.o_custkey AND event_type <> 'view' GROUP BY o_orderkey""")
def comments_for_review(spark: SparkSession, d: str) -> DataFrame:
    """Every order with the comments on it: a customer's first order has all of their events but views."""
    orders = table(spark, d, "orders")
    first = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("news_id"))
    comments = table(spark, d, "events").filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("content")).join(first, "user_id")
    out = social.reviewed(orders.select(F.col("o_orderkey").alias("id")), comments)
    return out.select("id", F.size("comments").cast("long").alias("n_comments"), F.array_join("comments", "|").alias("comments"))


@query("SELECT o_orderkey AS id, count(event_id) AS n_comments, coalesce(string_agg(event_type, '|' ORDER BY ts, event_id), '') AS comments FROM orders LEFT JOIN events ON event_id - event_id % 3 = o_orderkey AND event_type <> 'view' GROUP BY o_orderkey")
def comments_for_every_review(spark: SparkSession, d: str) -> DataFrame:
    """Every order with its comments: three events in a row belong to one order, so lists don't grow with the table."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    comments = table(spark, d, "events").filter("event_type <> 'view'").select((F.col("event_id") - F.col("event_id") % 3).alias("news_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("content"))
    out = social.reviewed(rows, comments)
    return out.select("id", F.size("comments").cast("long").alias("n_comments"), F.array_join("comments", "|").alias("comments"))


@query("SELECT source, least(10, greatest(1, CAST(floor(3500 / (avg(length(coalesce(text, ''))) / 4 + 200)) AS BIGINT))) AS batch_size FROM documents GROUP BY source")
def model_batch_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(values.batch_size(F.avg(F.length(F.coalesce("text", F.lit(""))))).alias("batch_size"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS highest FROM events")
def running_max_rise(spark: SparkSession, d: str) -> DataFrame:
    return market.running_max(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "highest")


@query("""SELECT sector, string_agg(CAST(code AS VARCHAR), '|' ORDER BY nth) AS codes FROM (SELECT p_type AS sector, p_partkey AS code, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS nth FROM part) AS x WHERE nth <= 3 GROUP BY sector""")
def stock_previews(spark: SparkSession, d: str) -> DataFrame:
    return market.previews(stock_rows(spark, d)).select("sector", F.array_join(F.col("codes").cast("array<string>"), "|").alias("codes"))


@query("SELECT o_orderkey AS token, c_custkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (1, 2, 3, 5, 7, 32, 100) AND o_orderdate > DATE '1994-01-01'")
def signed_in_users(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expire_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return social.signed_in(tokens, users, [1, 2, 3, 5, 7, 32, 100], F.lit("1994-01-01").cast("timestamp_ntz")).select("token", "id", "name")


@query("""WITH k AS (SELECT DISTINCT p_type FROM part WHERE p_type LIKE '%O%')
SELECT l_orderkey AS id, string_agg(CASE WHEN p_type IN (SELECT p_type FROM k) THEN p_type END, '|' ORDER BY l_linenumber, l_partkey) AS sectors FROM lineitem JOIN part ON p_partkey = l_partkey
GROUP BY l_orderkey HAVING count(CASE WHEN p_type IN (SELECT p_type FROM k) THEN 1 END) > 0""")
def verified_sectors(spark: SparkSession, d: str) -> DataFrame:
    """By order its parts' types in line order, without those that aren't in the dimension of known ones."""
    part = stock_rows(spark, d).select("code", "sector")
    known = part.filter("sector like '%O%'").select("sector").distinct()
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("code"), "l_linenumber").join(part.join(known, "sector", "left_semi"), "code")
    return lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "code", "sector"))), lambda x: x["sector"]), "|").alias("sectors"))


@query("""WITH x AS (SELECT p_brand AS source, p_partkey AS place, CASE WHEN p_partkey % 97 = 0 AND p_brand < 'Brand#3' THEN 'div.Content-' ELSE 'div.' END || repeat('x', CAST(p_size % 9 AS INTEGER)) || CAST(p_partkey AS VARCHAR) AS pattern FROM part),
y AS (SELECT *, NOT contains(lower(pattern), 'content') AS plain FROM x)
SELECT source, pattern FROM (SELECT source, pattern, row_number() OVER (PARTITION BY source ORDER BY plain, CASE WHEN plain THEN length(pattern) ELSE 0 END, place) AS nth FROM y) AS z WHERE nth = 1""")
def best_patterns(spark: SparkSession, d: str) -> DataFrame:
    key, brand = F.col("p_partkey"), F.col("p_brand")
    pattern = F.concat(F.when((key % 97 == 0) & (brand < "Brand#3"), "div.Content-").otherwise("div."), F.repeat(F.lit("x"), (F.col("p_size") % 9).cast("int")), key.cast("string"))
    return table(spark, d, "part").select(brand.alias("source"), key.alias("place"), pattern.alias("pattern")).groupBy("source").agg(text.best_pattern(F.col("pattern"), F.col("place")).alias("pattern"))


@query("SELECT event_id AS id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 4 = 0)")
def own_comments_deleted(spark: SparkSession, d: str) -> DataFrame:
    comments = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    requests = comments.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    return social.without_own(comments, requests).select("id")


@query("""WITH s AS (SELECT c_custkey AS user_id, c_mktsegment AS level, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'expired' END AS status FROM customer)
SELECT user_id, level, CASE WHEN user_id % 3 = 0 AND status = 'active' THEN 'cancelled' ELSE status END AS status FROM s UNION ALL SELECT user_id, 'pro', 'active' FROM s WHERE user_id % 3 = 0""")
def subscribe(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("level"), F.when(F.col("c_acctbal") > 0, "active").otherwise("expired").alias("status"))
    return social.subscribed(held, held.filter("user_id % 3 = 0").select("user_id", F.lit("pro").alias("level")))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, CASE WHEN p_size = 1 THEN '' ELSE printf('%.2f%%', CAST(p_size - 25 AS DOUBLE)) END AS change_rate, CAST(p_partkey AS VARCHAR) AS price, CAST(p_size AS VARCHAR) AS dde_net_amount, CAST(p_partkey AS VARCHAR) AS dde_intensity, CAST(p_size AS BIGINT) AS advancers, CAST(0 AS BIGINT) AS decliners FROM part""")
def index_quotes(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    fields = [("指数代码", key), ("指数简称", F.col("p_name")), ("指数@涨跌幅:前复权排名[20240102]", F.lit("1")), ("指数@涨跌幅:前复权[20240102]", F.when(size != 1, (size - 25).cast("string"))), ("指数@最新价", key), ("指数@上涨家数[20240102]", size.cast("string")), ("指数@dde大单净额[20240102]", size.cast("string")), ("指数@dde大单净额{/}指数@流通市值{*}10000", key)]
    items = table(spark, d, "part").select(F.create_map(*(x for name, value in fields for x in (F.lit(name), value))).alias("item"))
    return market.index_quotes(items).select("code", "name", "change_rate", "price", "dde_net_amount", "dde_intensity", "advancers", "decliners")


@query("""WITH {news}, feed AS (SELECT id, score, publish_time FROM news ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10),
listed AS (SELECT DISTINCT f.id, p_type FROM feed f JOIN lineitem ON l_orderkey = f.id JOIN part ON p_partkey = l_partkey), quotes AS (SELECT p_type, CAST(max(p_size) AS DOUBLE) AS change FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type),
means AS (SELECT id, count(*) AS n, avg(change) AS mean FROM listed LEFT JOIN quotes ON quotes.p_type = listed.p_type GROUP BY id)
SELECT row_number() OVER (ORDER BY score DESC, publish_time DESC, f.id DESC) AS rank, f.id, score, coalesce(n, 0) AS n_sectors, CASE WHEN mean IS NULL THEN 'N/A' ELSE printf('%+.2f%%', mean) END AS mean_change FROM feed f LEFT JOIN means ON means.id = f.id""")
def sector_report(spark: SparkSession, d: str) -> DataFrame:
    feed = news_sectors(spark, d, news.top(news_rows(spark, d), 10).select("id", "score", "publish_time")).withColumn("sectors", F.array_join("sectors", "|"))
    types = stock_rows(spark, d).groupBy("sector").agg(F.min("code").alias("id"), F.max("size").alias("change"))
    sectors = types.select("id", F.col("id").cast("string").alias("code"), F.col("sector").alias("name"), F.lit("").alias("keywords"), F.lit("").alias("pinyin_initial"))
    quotes = types.filter("sector <> 'ECONOMY'").select(F.col("sector").alias("name"), F.format_string("+%s%%", F.col("change").cast("string")).alias("change_rate"))
    return market.report(feed, sectors, quotes)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, '' AS market_code, CAST(p_size AS VARCHAR) AS price, CASE WHEN p_size = 1 THEN '' WHEN p_size > 25 THEN printf('+%.2f%%', CAST(p_size - 25 AS DOUBLE)) ELSE printf('%.2f%%', CAST(p_size - 25 AS DOUBLE)) END AS change_rate, CAST(p_size AS VARCHAR) AS turnover_rate, p_type AS industrys FROM part""")
def stock_quotes(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    change = F.when(size != 1, (size - 25).cast("string"))
    fields = [("代码", key), ("股票简称", F.col("p_name")), ("最新价", size.cast("string")), ("最新涨跌幅[20240102]", F.when(size % 2 == 0, change)), ("涨跌幅:前复权[20240102]", F.when(size % 2 == 1, change)), ("换手率[20240102 09:30:00-20240102 15:00:00]", size.cast("string")), ("所属同花顺行业", F.col("p_type"))]
    items = table(spark, d, "part").select(F.create_map(*(x for name, value in fields for x in (F.lit(name), value))).alias("item"))
    return market.stock_quotes(items).select("code", "name", "market_code", "price", "change_rate", "turnover_rate", "industrys")


@query(f"WITH {_MOVES_SQL}, o AS (SELECT * FROM moves WHERE id % 4 <> 0) SELECT m.id, m.sector, m.p AS published, coalesce(CASE WHEN m.sector <> 'ECONOMY' THEN o.c END, m.p) AS current, coalesce(CASE WHEN m.sector <> 'ECONOMY' THEN o.c END, m.p) - m.p AS change FROM moves m LEFT JOIN o ON o.id = m.id AND o.sector = m.sector")
def client_changes(spark: SparkSession, d: str) -> DataFrame:
    """By news and sector what a client shows: no current values for some news, none of one sector for the others."""
    rows = _moves(spark, d).select("id", "published", F.when(F.col("id") % 4 != 0, F.array_join(F.filter(F.split("current", r"\|"), lambda x: ~x.startswith("ECONOMY:")), "|")).alias("current"))
    return rows.select("id", F.inline(values.client_changes(F.col("published"), F.col("current")))).withColumnRenamed("name", "sector")


@query("WITH {news} SELECT id, score FROM news WHERE publish_time = (SELECT max(publish_time) FROM news) ORDER BY score DESC, id DESC LIMIT 20")
def newest_created(spark: SparkSession, d: str) -> DataFrame:
    return news.newest_by_score(news_rows(spark, d), "publish_time").select("id", "score")


@query("WITH {news} SELECT id, publish_time FROM news ORDER BY publish_time DESC, id DESC LIMIT 20")
def recent_news(spark: SparkSession, d: str) -> DataFrame:
    return news.recent(news_rows(spark, d), "publish_time").select("id", "publish_time")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01 12:00:00' - INTERVAL 7 DAY")
def created_since(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return news.created_since(rows, "o_orderdate", F.lit("1998-07-01 12:00:00").cast("timestamp_ntz"), 7).select("id")


@query("""WITH {news}, best AS (SELECT * FROM (SELECT p_type AS sector, p_partkey AS code, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS nth FROM part) AS x WHERE nth <= 10),
listed AS (SELECT l_orderkey AS id, p_type AS sector, min(l_linenumber) AS place FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7 GROUP BY l_orderkey, p_type)
SELECT f.id, f.score, coalesce(string_agg(CAST(b.code AS VARCHAR), '|' ORDER BY s.place, s.sector, b.nth), '') AS stocks FROM news f LEFT JOIN listed s ON s.id = f.id LEFT JOIN best b ON b.sector = s.sector WHERE f.id = 7 GROUP BY f.id, f.score""")
def news_detail(spark: SparkSession, d: str) -> DataFrame:
    one = news_sectors(spark, d, news_rows(spark, d).filter("id = 7").select("id", "score"))
    return market.with_stocks(one, stock_rows(spark, d)).select("id", "score", F.array_join(F.col("codes").cast("array<string>"), "|").alias("stocks"))


@query("WITH {news} SELECT id FROM news WHERE user_id % 4 > 0 AND status = 'O'")
def sectors_to_sync(spark: SparkSession, d: str) -> DataFrame:
    rows = news_rows(spark, d).withColumn("sectors", F.when(F.col("user_id") % 4 > 0, F.col("status")).otherwise(""))
    return news.with_sectors(rows).filter("sectors = 'O'").select("id")


@query("SELECT DISTINCT p_type AS sector FROM part WHERE p_size > 10")
def sectors_with_stocks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names, sorted."""
    return market.sectors_with_stocks(stock_rows(spark, d).filter("size > 10")).orderBy("sector")


@query("SELECT p_name AS name, CAST(max(p_size) AS DOUBLE) AS value FROM part WHERE p_brand = 'Brand#3' AND p_type <> 'ECONOMY' GROUP BY p_name")
def values_of_day(spark: SparkSession, d: str) -> DataFrame:
    """The brand stands for a day."""
    quotes = table(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("day"), "p_type").agg(F.max("p_size").cast("double").alias("value"))
    names = quotes.filter("p_type <> 'ECONOMY'").select("name")
    of_day = market.values_of_day(quotes.filter("p_type <> 'ECONOMY'"), names, F.lit("Brand#3"))
    return of_day.groupBy("name").agg(F.max("value").alias("value"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS place, p_partkey AS code, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT p_partkey AS code, CAST(p_size AS DOUBLE) AS price FROM part WHERE p_size > 20), b AS (SELECT p_name AS name, CAST(max(p_size) AS DOUBLE) AS price FROM part WHERE p_size BETWEEN 5 AND 20 GROUP BY p_name),
v AS (SELECT id, place, l.code, l.name, coalesce(a.price, b.price) AS price FROM l LEFT JOIN a ON a.code = l.code LEFT JOIN b ON b.name = l.name)
SELECT id, coalesce(string_agg(name || ':' || printf('%.1f', price), '|' ORDER BY place, name, code) FILTER (WHERE price IS NOT NULL), '') AS value_string FROM v GROUP BY id""")
def value_strings(spark: SparkSession, d: str) -> DataFrame:
    """Each order's parts with their price by code, else by name, as one string in line order."""
    part = stock_rows(spark, d).select("code", "name", F.col("size").cast("double").alias("price"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("code"), "l_linenumber").join(part.select("code", "name"), "code")
    rows = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "code"))), lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"))).alias("sectors"))
    by_name = part.filter("price between 5 and 20").groupBy("name").agg(F.max("price").alias("price"))
    return market.value_strings(rows, part.filter("price > 20"), by_name).select("id", "value_string")


@query("""WITH {news}, f AS (SELECT * FROM news ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10)
SELECT string_agg(CAST(id AS VARCHAR), '|' ORDER BY score DESC, publish_time DESC, id DESC) AS ids, (SELECT publish_time FROM f ORDER BY score DESC, publish_time DESC, id DESC LIMIT 1) AS batch_time, count(*) AS count FROM f""")
def feed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    feed = news.top(news_rows(spark, d), 10)
    one = tables.feed_snapshot(feed.select("id", "score", "publish_time"), F.desc("score"), F.desc("publish_time"), F.desc("id"))
    return one.select(F.array_join(F.transform("data", lambda x: x["id"].cast("string")), "|").alias("ids"), "batch_time", "count")


@query("""WITH {news}, f AS (SELECT *, row_number() OVER (ORDER BY score DESC, publish_time DESC, id DESC) AS rank FROM news ORDER BY score DESC, publish_time DESC, id DESC LIMIT 10)
SELECT repeat('=', 70) || chr(10) || '新闻采集分析报告 - 2024-01-01 00:00:00' || chr(10) || repeat('=', 70) || chr(10) || string_agg(chr(10) || '【' || rank || '】' || left('Order ' || repeat(CAST(id AS VARCHAR), 20), 50) || chr(10) || '  来源: ' || status || ' | 时间: ' || publish_time || chr(10) || '  评分: ' || score || ' 分' || chr(10)
  || '  摘要: ' || CASE WHEN id % 2 = 0 THEN repeat('s', 80) || '...' ELSE 'N/A' END || chr(10) || '  关联板块: ' || CASE WHEN id % 3 = 0 THEN 'A, B' ELSE 'N/A' END || chr(10) || '  发布至今涨跌幅: N/A' || chr(10) || '  理由: ' || CASE WHEN id % 2 = 1 THEN 'because' ELSE 'N/A' END, chr(10) ORDER BY rank)
  || chr(10) || chr(10) || repeat('=', 70) || chr(10) || '共 10 条高评分新闻' AS text FROM f""")
def report_as_text(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("id")
    feed = news.ranked(news.top(news_rows(spark, d), 10), F.desc("score"), F.desc("publish_time"), F.desc("id"))
    rows = feed.select(
        "rank", F.concat(F.lit("Order "), F.repeat(key.cast("string"), F.lit(20))).alias("title"), F.col("status").alias("source"), "publish_time", "score", F.when(key % 2 == 0, F.repeat(F.lit("s"), F.lit(90))).alias("summary"),
        F.when(key % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("sectors"), F.lit("N/A").alias("mean_change"), F.when(key % 2 == 1, "because").otherwise("").alias("reason"),
    )
    return tables.report_text(rows, F.lit("2024-01-01 00:00:00"))


def _stub(frame: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: it fails on every seventh customer."""
    if (frame["id"].to_numpy() % 7 == 0).any():
        raise RuntimeError("no reply")
    return pd.DataFrame({"id": frame["id"].to_numpy(), "useful": frame["balance"].to_numpy() > 0})


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > 0 END AS useful, CASE WHEN c_custkey % 7 = 0 THEN 'no reply' END AS error FROM customer")
def model_judgements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return tables.scored(rows, _stub, "id long, useful boolean", batch=1, wait=0.0)


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_custkey % 7 = 0")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return tables.dead_letters(tables.scored(rows, _stub, "id long, useful boolean", batch=1, wait=0.0), rows, "id")


@query("WITH {news} SELECT id, 'Order ' || id AS title, CAST(score AS INTEGER) AS importance_score, 's' || id AS summary FROM news WHERE is_useful = 1")
def importance_rows(spark: SparkSession, d: str) -> DataFrame:
    reply = F.struct((F.col("is_useful") == 1).alias("will_flunctuate"), F.col("score").cast("int").alias("importance_score"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("summary"))
    rows = news_rows(spark, d).select("id", F.concat(F.lit("Order "), F.col("id").cast("string")).alias("title"), F.lit("").alias("url"), reply.alias("reply"))
    return news.important(rows).select("id", "title", "importance_score", "summary")


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS nth FROM orders)
SELECT day, string_agg(CASE WHEN nth <= 50 THEN CAST(o_orderkey AS VARCHAR) END, '|' ORDER BY o_orderkey) AS ids, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS sectors, count(*) AS n FROM o GROUP BY day""")
def news_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of each day the ids of its first 50 news, as a page shows them, all its distinct sectors and the number of all its news."""
    rows = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    first = news.first_of_each(rows.select("day", "o_orderkey"), ["day"], [F.asc("o_orderkey")], 50).groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), "|").alias("ids"))
    return rows.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("sectors"), F.count(F.lit(1)).alias("n")).join(first, "day")


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity >= 45 THEN 'high' WHEN l_quantity >= 35 THEN 'middle' ELSE 'low' END AS band, CASE WHEN l_quantity - 25 > 0 THEN 'up' WHEN l_quantity - 25 < 0 THEN 'down' ELSE 'flat' END AS sign,
round(CASE WHEN l_quantity > 10 THEN (l_quantity - 25) / (l_quantity - 10) * 100 ELSE 0 END, 6) AS percent, round(l_quantity * 7e-1 + 2 * 15e-2 + 15e-2, 6) AS composite FROM lineitem""")
def derived_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), values.score_band(n / 5).alias("band"), values.change_sign(n - 25).alias("sign"), F.round(values.percent(n - 25, n - 10), 6).alias("percent"), F.round(values.composite_score(n, F.lit(2.0), F.lit(1.0)), 6).alias("composite")
    )


@query("""WITH x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '2' ELSE '1' END || CAST(3 + c_custkey % 7 AS VARCHAR) || lpad(CAST(c_custkey AS VARCHAR), CAST(8 + CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS INTEGER), '0') AS phone FROM customer)
SELECT id, regexp_full_match(phone, '1[3-9]\\d{9}') AS valid_phone, id % 3 <> 0 AS valid_email, sha256(phone) AS hashed, '游客' || right(phone, 4) AS masked, CASE WHEN id % 4 = 0 THEN 'zhishu' ELSE 'stock' END AS intent FROM x""")
def user_checks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    phone = F.concat(F.when(key % 5 == 0, "2").otherwise("1"), (3 + key % 7).cast("string"), F.lpad(key.cast("string"), F.when(key % 11 == 0, 10).otherwise(9), F.lit("0")))
    email = F.when(key % 3 == 0, F.concat(F.lit("a@"), key.cast("string"))).otherwise(F.concat(F.lit("a.b@x"), key.cast("string"), F.lit(".org")))
    question = F.when(key % 4 == 0, "银行板块").otherwise("银行")
    return table(spark, d, "customer").select(key.alias("id"), values.valid_phone(phone).alias("valid_phone"), values.valid_email(email).alias("valid_email"), values.hashed(phone).alias("hashed"), values.masked_phone(phone).alias("masked"), values.intent(question).alias("intent"))


@query("SELECT doc_id, 'Of ' || coalesce(source, '') || ': ' || left(coalesce(text, ''), 3000) || '!' AS prompt FROM documents")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A template's fields are cut at 3,000 characters: that is its rule."""
    return table(spark, d, "documents").select("doc_id", values.filled("Of <<source>>: <<content>>!", {"source": F.col("source"), "content": F.col("text")}).alias("prompt"))


@query("SELECT event_id AS id, user_id, CASE WHEN event_id % 4 = 0 THEN 'edited ' || event_id ELSE event_type END AS content FROM events")
def own_comments_edited(spark: SparkSession, d: str) -> DataFrame:
    comments = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("content"))
    requests = comments.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), F.concat(F.lit("edited "), F.col("id").cast("string")).alias("content"))
    return social.edited(comments, requests).select("id", "user_id", "content")


@query("""WITH o AS (SELECT event_id AS id, user_id, event_type AS content, ts AS created_at FROM events WHERE event_type = 'view'), n AS (SELECT user_id, event_type AS content, ts AS created_at, event_id AS news_id FROM events WHERE event_type <> 'view')
SELECT id, news_id, user_id, content FROM (SELECT id, 0 AS news_id, user_id, content FROM o UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY created_at, user_id, news_id, content), news_id, user_id, content FROM n) AS x""")
def comments_added(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(0).cast("long").alias("news_id"), "user_id", F.col("event_type").alias("content"), F.col("ts").alias("created_at"))
    new = events.filter("content <> 'view'").select(F.col("id").alias("news_id"), "user_id", "content", "created_at")
    return social.added(events.filter("content = 'view'"), new).select("id", "news_id", "user_id", "content")


@query("""WITH s AS (SELECT c_custkey AS user_id, c_mktsegment AS level, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'expired' END AS status FROM customer) SELECT user_id, level, CASE WHEN user_id % 3 = 0 AND status = 'active' THEN 'cancelled' ELSE status END AS status FROM s""")
def subscriptions_cancelled(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("level"), F.when(F.col("c_acctbal") > 0, "active").otherwise("expired").alias("status"))
    return social.cancelled(held, held.filter("user_id % 3 = 0").select("user_id"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'free' WHEN c_custkey % 3 = 0 THEN 'pro' ELSE c_mktsegment END AS level, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '2025' ELSE '2024' END AS expires FROM customer")
def user_levels(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("level"), F.lit("2024").alias("expires"))
    orders = users.filter("id % 3 = 0").select(F.col("id").alias("user_id"), F.lit("pro").alias("level"), F.lit("2025").alias("expires"))
    return social.with_levels(users, orders, users.filter("id % 6 = 0").select(F.col("id").alias("user_id")))


@query("""WITH {news}, q AS (SELECT event_type AS sector, date_trunc('day', ts) AS day, max(value) AS value FROM events WHERE user_id % 5 = 0 GROUP BY 1, 2),
n AS (SELECT event_id AS id, date_trunc('day', ts) AS day, unnest([0, 1]) AS place FROM events WHERE user_id % 5 <> 0), s AS (SELECT id, day, place, CASE WHEN place = 0 THEN (CASE WHEN id % 2 = 0 THEN 'click' ELSE 'view' END) ELSE 'error' END AS sector FROM n)
SELECT id, place, sector, (SELECT arg_max(q.value, q.day) FROM q WHERE q.sector = s.sector AND q.day <= s.day) AS value FROM s""")
def sectors_at(spark: SparkSession, d: str) -> DataFrame:
    """The first two of each news' sectors as of its day."""
    events = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("sector"), F.to_date("ts").alias("query_date"))
    quotes = events.filter("user_id % 5 = 0").groupBy("sector", "query_date").agg(F.max("value").alias("value"))
    named = F.array(F.when(F.col("event_id") % 2 == 0, "click").otherwise("view"), F.lit("error"), F.lit("purchase"))
    return market.sectors_at(events.filter("user_id % 5 <> 0").select(F.col("event_id").alias("id"), "query_date", named.alias("sectors")), quotes, 2)


@query("""SELECT l_orderkey AS news_id, p_type AS sector, '+' || max(p_size) || '%' AS change_rate, '2024-01-02' AS query_time FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7 GROUP BY l_orderkey, p_type UNION ALL SELECT 7, 'OLD', '+0%', '2024-01-01'""")
def sector_indices(spark: SparkSession, d: str) -> DataFrame:
    """The indices that are kept of one news, after those of all orders have been added."""
    old = spark.range(1).select(F.lit(7).cast("long").alias("news_id"), F.lit("OLD").alias("sector"), F.lit("+0%").alias("change_rate"), F.lit("2024-01-01").alias("query_time"))
    part = stock_rows(spark, d).select("code", "sector", "size")
    sold = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("news_id"), F.col("l_partkey").alias("code")).join(part, "code").groupBy("news_id", "sector").agg(F.max("size").alias("size"))
    # each news has quotes of its own here: the sector's name goes with the news
    named = sold.select("news_id", F.concat_ws("|", "news_id", "sector").alias("sector"), "size")
    quotes = named.select(F.col("sector").alias("name"), F.concat(F.lit("+"), F.col("size").cast("string"), F.lit("%")).alias("change_rate"))
    held = market.indices_of(market.saved_indices(old, quotes, named.select("news_id", "sector"), F.lit("2024-01-02")), F.lit(7))
    return held.withColumn("sector", F.regexp_replace("sector", r"^\d+\|", ""))


@query("SELECT user_id, 'old' AS type, event_type AS content FROM events WHERE event_id % 3 = 0 UNION ALL SELECT CASE WHEN event_id % 3 = 1 THEN user_id END, 'new', event_type FROM events WHERE event_id % 3 <> 0 AND event_type <> 'view'")
def feedback_added(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "old").otherwise("new").alias("type"), F.col("event_type").alias("content"))
    new = events.filter("event_id % 3 <> 0").select(F.when(F.col("event_id") % 3 == 1, F.col("user_id")).alias("user_id"), "type", F.when(F.col("content") == "view", "  ").otherwise(F.col("content")).alias("content"))
    return social.feedback_added(events.filter("event_id % 3 = 0").select("user_id", "type", "content"), new)


@query("""SELECT event_id AS news_id, '["c' || event_id || '"]' AS valid_comments, CASE WHEN event_id % 2 = 0 THEN '[]' END AS optimization_suggestions, CASE WHEN event_id % 2 = 0 THEN '{"valid_comments": ["c' || event_id || '"], "optimization_suggestions": []}' ELSE '{"valid_comments": ["c' || event_id || '"]}' END AS raw_llm_result FROM events""")
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    raw = F.concat(F.lit('{"valid_comments": ["c'), key, F.when(F.col("event_id") % 2 == 0, '"], "optimization_suggestions": []}').otherwise('"]}'))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("raw").alias("text")))
    reply = values.recovered_review(blocks, "valid_comments array<string>, optimization_suggestions array<string>")
    return social.review_rows(table(spark, d, "events").select(F.col("event_id").alias("news_id"), raw.alias("raw")).withColumn("reply", reply))


@query(REFUSED_SQL)
def login_refused(spark: SparkSession, d: str) -> DataFrame:
    """Sign-in attempts and whether each is refused: each state depends on the one before."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return social.refused(rows, "user_id", "ts", F.col("event_type") != "click", minutes=24 * 60).select("event_id", "refused")


def queries() -> dict[str, Query]:
    for more in ("crawl", "jobs"):
        import_module(f"{__package__}.{more}")  # adds its own
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
