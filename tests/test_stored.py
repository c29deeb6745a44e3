"""Sources by pages, tables that are written again, models with calls in flight."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import stored
from tidemark.sources.paged import RefusedError, landed, paged_source
from tidemark.sources.tables import scored


def pages_of(sizes, count=None):
    return paged_source("test_pages", "id int, name string", lambda: count, lambda page, size: [{"id": page * 1000 + i, "name": f"n{i}"} for i in range(sizes[page - 1] if page <= len(sizes) else 0)])


@pytest.mark.parametrize(("sizes", "count", "most", "want"), [([10, 10, 4], 24, 9, 24), ([10, 10, 4], 24, 2, 20), ([10, 10], None, 9, 20), ([10, 3, 10], 30, 9, 13), ([10, 0, 10], 30, 9, 10), ([], 0, 3, 0), ([10, 10, 10], 15, 9, 20)])
def test_pages_end_at_a_short_one(spark, tmp_path, sizes, count, most, want):
    got = landed(spark, pages_of(sizes, count), str(tmp_path / "pages"), per_page=10, most_pages=most)
    assert got.count() == want and got.columns == ["page", "place", "id", "name"]
    assert [r.place for r in got.orderBy("page", "place").collect()] == [i for n in sizes for i in range(n)][:want]


def test_pages_refresh_a_session_once(spark, tmp_path):
    def refusing(times):
        left = [times]

        def fetch(page, size):
            if left[0]:
                left[0] -= 1
                raise RefusedError("session")
            return [{"id": page}]

        return paged_source("refusing", "id int", lambda: 1, fetch, refresh=lambda: None)

    assert landed(spark, refusing(1), str(tmp_path / "a"), per_page=1).count() == 1
    with pytest.raises(Exception, match="RefusedError"):
        landed(spark, refusing(5), str(tmp_path / "b"), per_page=1)


def test_batches_replace_themselves(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string, batch_id int"
    assert stored.batches(spark, path, schema).count() == 0
    for batch, v in ((1, "a"), (2, "b"), (2, "c"), (2, "c")):
        stored.put_batches(spark.range(3).select("id", F.lit(v).alias("v"), F.lit(batch).alias("batch_id")), path)
    assert sorted(map(tuple, stored.batches(spark, path, schema).collect())) == [(i, v, b) for i in range(3) for b, v in ((1, "a"), (2, "c"))]


def test_versions_survive_failed_and_repeated_runs(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "id long, n long"
    add = lambda old: old.unionByName(spark.range(2).select("id", F.lit(1).cast("long").alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
    state = lambda: sorted(map(tuple, stored.current(spark, path, schema).collect()))
    assert state() == []
    stored.put_version(spark, path, schema, 1, add)
    stored.put_version(spark, path, schema, 2, add)
    stored.put_version(spark, path, schema, 2, add)
    assert state() == [(0, 2), (1, 2)]
    with pytest.raises(Exception, match="stop here"):
        stored.put_version(spark, path, schema, 3, lambda old: add(old).withColumn("n", F.when(F.col("id") == 1, F.raise_error(F.lit("stop here")).cast("long")).otherwise(F.col("n"))))
    assert state() == [(0, 2), (1, 2)] and stored.versions(spark, path) == [1, 2]
    stored.put_version(spark, path, schema, 3, add)
    assert state() == [(0, 3), (1, 3)] and stored.versions(spark, path) == [2, 3]


def test_calls_in_flight_keep_order_and_letters(spark):
    def model(frame):
        time.sleep(0.2)
        if (frame.id == 7).any():
            raise ValueError("no seven")
        return frame.assign(score=frame.id * 2)[["id", "score"]]

    rows, took = spark.range(24).coalesce(1), {}
    scored(rows.limit(1), model, "id long, score long").collect()  # a worker is there
    for n in (1, 8):
        began = time.time()
        got = scored(rows, model, "id long, score long", batch=1, tries=2, wait=0.1, in_flight=n).collect()
        took[n] = time.time() - began
        assert [r.id for r in got] == list(range(24)) and [r.id for r in got if r.error] == [7] and all(r.score == 2 * r.id for r in got if not r.error)
    assert took[8] < took[1] / 2
