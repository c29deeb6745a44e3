"""What only larger tables showed: rare pages and addresses, plans that change at run time, many calls."""

from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.functions.html_tree import Tree, dereferenced
from tidemark.operators import news, social
from tidemark.plans import catalogue
from tidemark.sources import tables
from tidemark.sources.paged import landed, paged_source

FOLDER = "/root/testdata/sf0.001"


def test_references_end_with_a_semicolon():
    told = {"a &amp; b&quot;": 'a & b"', "cut &amp": "cut &amp", "cut &amp</b>": "cut &amp</b>", "&&&amp": "&&&amp", "&copy;&middot;&#38;&#x4e2d;": "©·&中", "&#38": "&#38", "&unknown;": "&unknown;", "&ampx;": "&ampx;", "&amp;quot;": "&quot;"}
    assert {t: dereferenced(t) for t in told} == told
    tree = Tree('<a href="/?a=1&copy=2&amp;b">x &amp</a>')
    assert tree.attributes[1] == {"href": "/?a=1&copy=2&b"} and tree.pieces(0) == ["x &amp"]


def test_address_of_a_day_behind_other_numbers(spark):
    told = {"http://x/en/9823/2024/0129/": "2024-01-29 00:00:00", "http://x/1234/2024/0131.html": "2024-01-31 00:00:00", "http://x/n1/2024/1301/2024/0131?a": None, "http://x/2024/0132/": None, "http://x/2024/0010/": None}
    rows = spark.createDataFrame([(u,) for u in told], "u string")
    assert {r.u: r.day for r in rows.select("u", dates.from_url(F.col("u")).alias("day")).collect()} == told


def test_refused_where_a_join_would_turn_small_at_run_time(spark, tmp_path):
    spark.range(20_000).select((F.col("id") % 4).alias("user"), F.timestamp_seconds(F.col("id") * 7).alias("at"), F.col("id").alias("i"), (F.hash("id") % 3 != 0).alias("bad")).repartition(8).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    refused = lambda: {r.i for r in social.refused(rows, "user", "at", F.col("bad"), minutes=24 * 60).collect() if r.refused}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        got = refused()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want, state = set(), {}
    for r in sorted(rows.collect(), key=lambda r: (r.user, r.at, r.i)):
        count, until = state.get(r.user, (0, -1))
        when = int(r.at.timestamp())
        if when < until or count >= 5:
            want.add(r.i)
        if when >= until:
            count, until = (0, when + 86400) if count >= 5 else (count + 1 if r.bad else 0, until)
        state[r.user] = (count, until)
    assert got == want and want


def test_review_has_all_comments_of_a_customer(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(130).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 10 == 0, "view").otherwise(F.col("id").cast("string")).alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: (r.n_comments, r.comments) for r in catalogue.queries()["comments_for_review"](spark, str(tmp_path)).collect()}
    assert got == {1: (117, "|".join(str(i) for i in range(130) if i % 10)), 2: (0, ""), 3: (0, "")}


def test_calls_are_dealt_to_tasks_and_whole_numbers_stay(spark):
    def model(frame):
        if (frame.n % 7 == 0).any():
            raise ValueError("no reply")
        return frame.assign(twice=frame.n * 2)

    rows = spark.range(2**60, 2**60 + 3000, 1, 1).withColumnRenamed("id", "n")
    judged = tables.scored(rows, model, "n long, twice long", batch=1, tries=1, wait=0.0, in_flight=2)
    assert judged.rdd.getNumPartitions() > 8
    assert sorted((r.n, r.twice, r.error) for r in judged.collect()) == [(n, None, "no reply") if n % 7 == 0 else (n, 2 * n, None) for n in range(2**60, 2**60 + 3000)]


def test_fields_and_replies_are_read_once(spark):
    plan = lambda name: catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("stock_quotes").count("regexp_replace(") <= 6  # 85 before: each field read every key again
    assert plan("llm_batch_recover").count("regexp_replace(") <= 4 and plan("llm_batch_recover").count("from_json(") <= 2  # 10 and 4 before


def test_pages_are_shared_out_to_a_bounded_number_of_tasks(spark, tmp_path):
    source = paged_source("many_pages", "id int", lambda: 1995, lambda page, size: [{"id": page * 10 + i} for i in range(min(size, 1995 - 10 * (page - 1)))])
    got = landed(spark, source, f"{tmp_path}/landed", per_page=10, most_pages=1000)
    assert sorted((r.page, r.place, r.id) for r in got.collect()) == [(p, i, p * 10 + i) for p in range(1, 201) for i in range(10 if p < 200 else 5)]
    assert len(list((tmp_path / "landed").glob("*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism


def test_tags_that_repeat_are_read_once():
    tree = Tree("<ul>" + "<li class=row><b x='y'>t</b>" * 50 + "</ul>")
    assert tree.tags == ["", "ul", *["li", "b"] * 50] and len({id(a) for a in tree.attributes}) == 4  # 102 before
    assert tree.select("ul > li.row b[x=y]") == list(range(3, 102, 2)) and tree.select("ul > b") == []
    # the same letters up to the first > are another tag where a quote goes on behind it
    cut = Tree('<p a="x>one<p a="x>two">three<p a="x>four')
    assert cut.attributes == [{}, {"a": "x>one<p a=", "x": ""}, {"a": '"x'}] and cut.texts == ['two">three', "four"]


def test_plain_lines_pass_by_boilerplate_patterns(spark):
    told = {"The report of a customer and of others.": "The report of a customer and of others.", "The report of a customer.\n----\nIt says more than that.": "The report of a customer.\nIt says more than that.", "The report of a customer.\nend of a comment --> here it is": "The report of a customer.", "The report of a customer.\n责编：someone else who is here": "The report of a customer."}
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r.t: r.x for r in rows.select("t", text.without_boilerplate(F.col("t")).alias("x")).collect()} == told
    plan = rows.select(text.without_boilerplate(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and text.MARKED in plan


def test_requests_of_a_batch_are_dealt_to_tasks(spark):
    plan = catalogue.queries()["relevance_by_model"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan.split("MapInPandas")[1]  # requests lay in one task before


def test_told_ordinals_of_replies_are_not_broadcast(spark):
    rows = catalogue.queries()["relevance_by_model"](spark, FOLDER)
    assert len(rows.collect()) == 1500
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [chunk" in final and "BroadcastHashJoin [chunk" not in final  # at run time a broadcast of all of them before, 43,200,000 over 54,000,000 news


def test_ordinals_come_of_places(spark):
    rows = news.numbered(spark.range(0, 1000, 1, 5).select(((F.col("id") * 617) % 1000).alias("id")), [F.desc("id")], 30)
    assert sorted((r.id, r.chunk, r.nth) for r in rows.collect()) == [(i, (999 - i) // 30, (999 - i) % 30 + 1) for i in range(1000)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # 2 before: each batch was shuffled and ordered again
