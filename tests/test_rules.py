"""Rules that the queries don't reach, by small cases and against plain restatements."""

import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import dates, values
from tidemark.operators import market, news, social
from tidemark.sources import tables
from tidemark.streaming import ingest


def one(spark, column, **row):
    return spark.createDataFrame(pd.DataFrame([row])).select(column.alias("x")).first()[0]


def test_values(spark):
    assert one(spark, values.parsed_values(F.col("t")), t="A:1|B:x|A:2|C:D:3|") == {"A": 2.0, "C:D": 3.0}
    assert one(spark, values.parsed_values(F.col("t")), t="") == {}
    assert one(spark, values.max_rise(values.parsed_values(F.col("p")), values.parsed_values(F.col("c"))), p="A:100|B:10|Z:0", c="A:90|B:12") == 20.0
    assert one(spark, values.max_rise(values.parsed_values(F.col("p")), values.parsed_values(F.col("c"))), p="A:100", c="A:90") == 0.0
    assert one(spark, values.rate(F.col("t")), t="+2.35%") == 2.35 and one(spark, values.rate(F.col("t")), t="--") is None
    assert one(spark, values.four_dims(F.col("t")), t="高/中")["客户"] == "未知"
    assert one(spark, values.field_like(F.create_map(F.lit("涨跌幅排名"), F.lit("1"), F.lit("涨跌幅[20260101]"), F.lit("2")), "涨跌幅"), t=1) == "2"
    assert one(spark, values.valid_phone(F.col("t")), t="13800000000") and not one(spark, values.valid_phone(F.col("t")), t="23800000000")
    assert one(spark, values.valid_email(F.col("t")), t="a.b@c.de") and not one(spark, values.valid_email(F.col("t")), t="a@b")
    assert one(spark, values.four_dims(F.col("t")), t="高//低")["盈利"] == ""
    assert one(spark, values.recovered_batch(F.array("t"), "id int, ok boolean", ("id",)), t='x [{"id":1,"ok":true}] y')[0].ok
    assert [one(spark, values.signed_rate(F.col("t")), t=t) for t in ("2.345", "-1", "0", "", "x")] == ["+2.35%", "-1.00%", "0.00%", "", ""]
    assert [one(spark, values.safe_round(F.col("t")), t=t) for t in ("2.344", "x")] == [2.34, None]
    assert one(spark, values.url_parameters(F.col("t")), t="http://x/?a=1&b=%E4%B8%AD&a=2&c=") == {"a": "1", "b": "中"} and one(spark, values.url_parameters(F.col("t")), t="http://x/") == {}
    assert one(spark, values.client_values(F.col("t")), t=" A :1:9|B:x|C|A:3") == {"B": 0.0, "A": 3.0}
    deep = '{"id": 2, "ok": true, "x": ' + '{"y": ' * 5 + "1" + "}" * 5 + "}"
    assert [r.id for r in one(spark, values.recovered_batch(F.array("t"), "id int, ok boolean", ("id", "ok")), t="{ [" + deep + ' {"id": 3}')] == [2]
    assert one(spark, values.filled("a <<t>>!", {"t": F.col("t")}, 3), t="12345") == "a 123!"
    assert one(spark, values.intent(F.col("t")), t="银行板块") == "zhishu"
    assert abs(one(spark, values.composite_score(F.lit(10.0), F.lit(0.0), F.lit(2.0)), t=1) - 7.3) < 1e-9


def test_fields_and_names(spark):
    item = F.create_map(F.lit("排名"), F.lit("0"), F.lit("市盈率(pe)[20240102]"), F.lit("1"), F.lit("换手率[20240102 09:30:00-20240102 15:00:00]"), F.lit("2"), F.lit("量比"), F.lit("3"))
    assert [one(spark, values.dynamic_field(item, n), t=1) for n in ("市盈率", "换手率", "量比", "量比lb", "价")] == ["1", "2", "3", "3", None]
    assert one(spark, values.members(F.split("t", ","), F.array(F.lit("a"), F.lit("b"))), t="b,x,a,b") == ["b", "a", "b"]
    assert one(spark, values.split_names(F.col("t")), t="a,b| c |") == ["a,b", "c"] and one(spark, values.split_names(F.col("t")), t="a, b,") == ["a", "b"]
    assert [one(spark, values.batch_size(F.lit(x)), t=1) for x in (0.0, 3500.0, 1e6)] == [10, 3, 1]


def plain_admission(rows, most, stop):
    out, run = [], 0
    for n, (i, today, dated) in enumerate(rows):
        if n >= most or run >= stop:
            break
        if not dated:
            out.append(i)
        elif today:
            run = 0
            out.append(i)
        else:
            run += 1
    return out


def test_admission_like_the_loop(spark):
    r = random.Random(5)
    rows = [(g, i, r.random() < 0.4, r.random() < 0.8) for g in range(60) for i in range(r.randint(0, 25))]
    df = spark.createDataFrame(rows, "g int, i int, today boolean, dated boolean")
    got = {(x.g, x.i) for x in news.admitted(df, "g", "i", F.col("today"), F.col("dated"), 15, 3).collect()}
    want = {(g, i) for g in range(60) for i in plain_admission([(i, t, d) for h, i, t, d in rows if h == g], 15, 3)}
    assert got == want


def test_snapshot_takes_the_latest_before(spark):
    n = spark.createDataFrame([(1, "a", 5), (2, "a", 2), (3, "b", 9)], "id int, sector string, query_date int")
    q = spark.createDataFrame([("a", 3, 1.0), ("a", 5, 2.0)], "sector string, query_date int, value double")
    assert {x.id: x.value for x in market.snapshot(n, q).collect()} == {1: 2.0, 2: None, 3: None}


def test_search_tiers(spark):
    s = spark.createDataFrame([(1, "c1", "白酒", "酿酒", "bj"), (2, "c2", "白酒概念", "", "bjgn"), (3, "c3", "AIDC", "数据中心", "aidc")], "id int, code string, name string, keywords string, pinyin_initial string")
    k = spark.createDataFrame([("白酒", ""), ("柏酒", "bj"), ("bj", ""), ("dc", ""), ("数据", ""), ("酒", "")], "key string, pinyin string")
    got = {}
    for x in market.searched(k, s).orderBy("key", "nth").collect():
        got.setdefault(x.key, []).append(x.id)
    assert got == {"白酒": [1], "柏酒": [1], "dc": [3], "数据": [3], "酒": [1, 2, 1]}
    raw = spark.createDataFrame([("白酒行业",), ("没有",), ("数据中心建设",)], "raw string")
    assert {x.raw: x.id for x in market.normalised(raw, s).collect()} == {"白酒行业": 1, "没有": None, "数据中心建设": 3}


def test_a_keyword_goes_before_a_part_of_a_name(spark):
    s = spark.createDataFrame([(1, "c1", "黄金概念", "", ""), (2, "c2", "贵金属", "黄金,白银", ""), (3, "c3", "煤炭", "xy", "mt")], "id int, code string, name string, keywords string, pinyin_initial string")
    raw = spark.createDataFrame([("黄金", ""), ("美坛", "mt"), ("zzxy", "")], "raw string, pinyin string")
    assert {x.raw: x.name for x in market.normalised(raw, s).collect()} == {"黄金": "贵金属", "美坛": "煤炭", "zzxy": None}


def test_sync_keeps_the_greater_rise(spark):
    rows = spark.createDataFrame([(1, "A:1", "A:2", 3.0, 9.0), (2, "", "A:2", 3.0, 1.0), (3, "A:1", "", 3.0, 1.0)], "id int, published string, current_value string, rise double, max_rise double")
    got = {x.id: (x.action, x.new_rise) for x in market.sync_decisions(rows, F.lit(True)).collect()}
    assert got == {1: ("current", 9.0), 2: ("both", 1.0), 3: ("none", 1.0)}
    assert {x.id: x.new_rise for x in market.sync_decisions(rows, F.lit(True), keep_greater=False).collect()}[1] == 3.0


def test_codes_and_locks(spark):
    codes = spark.createDataFrame([(1, "p", 0, 9), (2, "p", 1, 9), (3, "p", 0, 1)], "id int, phone string, used int, expire_at int")
    assert [x.id for x in social.newest_code(codes, F.lit(5)).collect()] == [1]


def plain_refusals(rows, most=5, seconds=300):
    """(user, at, failed) in order, by a loop over counts and locks."""
    count, until, out = {}, {}, []
    for user, at, failed in rows:
        if at < until.get(user, -1):
            out.append(True)
        elif count.get(user, 0) >= most:
            until[user], count[user] = at + seconds, 0
            out.append(True)
        else:
            count[user] = count.get(user, 0) + 1 if failed else 0
            out.append(False)
    return out


def test_refusals_like_the_loop(spark):
    r, rows, at = random.Random(3), [], 0
    for i in range(3000):
        at += r.randint(0, 40)
        rows.append((i, r.randint(0, 5), at, r.random() < 0.8))
    df = spark.createDataFrame(rows, "i int, user int, s long, bad boolean").withColumn("at", F.timestamp_seconds("s")).drop("s")
    got = {x.i: x.refused for x in social.refused(df.select("user", "at", "i", "bad"), "user", "at", F.col("bad")).collect()}
    want = plain_refusals([(u, s, b) for _, u, s, b in rows])
    assert [got[i] for i in range(len(rows))] == want and any(want)


def test_sources_and_models(spark):
    folder = tempfile.mkdtemp()
    text = '{"sources": [{"name": "a", "url": "http://a", "is_flash": true, "contentExtract": "<p>(.*)"}, {"name": "b", "url": "http://b", "publishTimeExtract": {"pattern": "x"}}], "crawNumPerSource": 30, "maxConsecutiveNonToday": 10}'
    with open(f"{folder}/sources.json", "w") as file:
        file.write(text)
    config = tables.source_config(spark, f"{folder}/sources.json")
    assert [(x.name, x.most, x.stop_after) for x in config.orderBy("name").collect()] == [("a", 30, 10), ("b", 30, 10)]
    more = tables.with_source(tables.with_source(config, "c", "http://c"), "a", "http://other")
    listed = {x.name: (x.is_flash, x.url, x.has_content, x.has_time) for x in tables.listed_sources(tables.without_source(more, "b")).collect()}
    assert listed == {"a": (True, "http://a", True, False), "c": (False, "http://c", False, False)}
    rows = spark.createDataFrame([("a", "t", "", "x"), ("b", "t", "s", "x")], "source_name string, title string, subtitle string, body string")
    assert {x.source_name: x.body for x in tables.body_or_title(rows, config).collect()} == {"a": "t", "b": "x"}
    feed = spark.createDataFrame([(1, 5, "2025"), (2, 9, "2026"), (3, 5, "2027")], "id int, score int, created_at string").repartition(3)
    tables.write_feed(feed, f"{folder}/feed", F.desc("score"), F.desc("created_at"))
    back = tables.read_feed(spark, f"{folder}/feed", "id int, score int, created_at string").orderBy("place").collect()
    assert [(x.id, x.batch_time) for x in back] == [(2, "2026"), (3, "2026"), (1, "2026")]
    told = tables.report_json(feed.withColumn("rank", F.col("id")), F.lit("now")).first().text
    assert told.startswith('{"status":"success","generated_at":"now","top_news":[{"id":1,')
    with open(f"{folder}/r.md", "w") as file:
        file.write("one\ntwo")
    assert tables.reports(spark, f"{folder}/r.md").first().text == "one\ntwo"
    rows.createOrReplaceTempView("here")
    assert tables.missing_tables(spark, ["here", "there"]) == ["there"]
    bodies = spark.createDataFrame([(1, " " * 30), (2, "long enough to be scored")], "id int, content string")
    assert [x.id for x in tables.to_score(bodies).collect()] == [2]


def test_models_that_fail(spark):
    rows = spark.range(20).withColumnRenamed("id", "n").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def model(frame):
        calls.add(1)
        if 7 in frame.n.tolist():
            raise ValueError("no reply")
        return frame.assign(good=True)

    got = tables.scored(rows, model, "n long, good boolean", batch=5, wait=0.0).collect()
    assert [x.n for x in got if x.error] == [5, 6, 7, 8, 9] and all(x.good for x in got if not x.error) and calls.value == 3 + 3
    left = tables.dead_letters(spark.createDataFrame([(x.n, x.error) for x in got], "n long, error string"), rows, "n")
    assert sorted(x.n for x in left.collect()) == [5, 6, 7, 8, 9]


def test_stream_keeps_each_url_once(spark):
    folder = tempfile.mkdtemp()
    spark.sql("select * from values ('u', timestamp'2026-01-01 00:00:00'), ('u', timestamp'2026-01-01 01:00:00'), ('v', timestamp'2026-01-01 00:00:00') t(url, at)").write.parquet(f"{folder}/in")
    stream = ingest.first_by_url(spark.readStream.schema("url string, at timestamp").parquet(f"{folder}/in"), "at")
    seen = []
    query = ingest.in_batches(stream, lambda rows: seen.extend((x.url, x.batch_id) for x in rows.collect()), f"{folder}/state")
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [("u", 1), ("v", 1)]


def test_stream_feeds_and_windows(spark):
    folder = tempfile.mkdtemp()
    spark.sql("select * from values (1, 5, '2025-03-09 10:00'), (2, 9, '2025-03-09'), (3, 9, 'Mar 9, 2025'), (4, 7, '2025-03-08') t(id, score, raw)").write.parquet(f"{folder}/in")
    stream = ingest.not_late(spark.readStream.schema("id int, score int, raw string").parquet(f"{folder}/in"), F.col("raw"), F.lit("2025-03-09").cast("date"))
    query = ingest.refreshing_feed(stream, f"{folder}/history", lambda rows: news.top(rows.withColumn("publish_time", F.col("raw")), 10).select("id", "score"), f"{folder}/feed", f"{folder}/state", F.desc("score"))
    query.processAllAvailable()
    query.stop()
    assert [x.id for x in tables.read_feed(spark, f"{folder}/feed", "id int, score int").orderBy("place").collect()] == [2, 1]
    events = spark.sql("select * from values ('a', timestamp'2026-01-01 00:01:00'), ('a', timestamp'2026-01-01 00:04:00'), ('b', timestamp'2026-01-01 00:06:00') t(k, at)")
    counted = ingest.counts_by_window(events, "at", "5 minutes", "k").collect()
    assert sorted((str(x.start)[11:16], x.k, x.n) for x in counted) == [("00:00", "a", 2), ("00:05", "b", 1)]
