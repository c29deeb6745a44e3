"""Jobs that were done in part once: every row comes back, whatever the size of the input."""

from pyspark.sql import functions as F

from tidemark.operators import market, news
from tidemark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_review_has_every_order_and_every_comment(spark):
    got = catalogue.queries()["comments_for_every_review"](spark, FOLDER).collect()
    assert sorted(r.id for r in got) == sorted(r.o_orderkey for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect())
    assert sum(r.n_comments for r in got) == spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type <> 'view'").count()
    assert max(r.n_comments for r in got) <= 3 and any(r.comments == "" for r in got)


def test_chunks_number_all_rows_in_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    got = news.chunks(rows, [F.desc("id")], 30)
    assert {r.id: r.chunk for r in got.collect()} == {i: (999 - i) // 30 for i in range(1000)}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert news.chunks(rows.filter("id < 0"), [F.desc("id")], 30).count() == 0


def test_snapshot_runs_over_days_not_news(spark):
    n = spark.createDataFrame([(i, "a" if i % 9 else None, i % 5) for i in range(2000)], "id int, sector string, query_date int")
    q = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("a", 4, 4.0), (None, 2, 7.0)], "sector string, query_date int, value double")
    got = market.snapshot(n, q)
    want = {"a": [None, 1.0, 1.0, 1.0, 4.0], None: [None, None, 7.0, 7.0, 7.0]}
    assert got.columns == ["id", "sector", "query_date", "value"]
    assert {r.id: r.value for r in got.collect()} == {i: want["a" if i % 9 else None][i % 5] for i in range(2000)}
    plan = got._jdf.queryExecution().optimizedPlan()
    below = plan.toString().split("Window [")[1]
    assert "Aggregate [_sector" in below
