"""Streams with state against loops, with restarts between their batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import social
from tidemark.streaming.stateful import GrowingFeed, durable_state, first_ever, refused_stream, retry_queue

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def states(spark):
    durable_state(spark)
    return spark


def run_in_parts(spark, tmp_path, schema, parts, make, restarts=True):
    """Each part as a micro-batch; the query starts anew for each, from its checkpoint."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        if restarts or i + 1 == len(parts):
            stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(out)


def test_addresses_are_never_forgotten(states, tmp_path):
    day = lambda n: START + datetime.timedelta(days=n)
    parts = [[(1, "a", day(0)), (2, "b", day(0)), (3, "", day(0)), (4, None, day(0))], [(5, "a", day(1)), (6, "known", day(1)), (7, "c", day(1)), (8, "c", day(1))], [(9, "b", day(40)), (10, "a", day(40)), (11, "d", day(40)), (12, "", day(40))]]
    known = states.createDataFrame([("known",), ("known",)], "url string")
    got = run_in_parts(states, tmp_path, "id int, url string, at timestamp", parts, lambda s: first_ever(s, known))
    rows = sorted((r.id, r.url) for r in got.collect())
    assert [i for i, _ in rows if i not in (7, 8)] == [1, 2, 3, 4, 11, 12] and [u for i, u in rows if i in (7, 8)] == ["c"]


def test_refused_attempts_as_in_batches(states, tmp_path):
    r = random.Random(2)
    rows = sorted(((i, r.choice("abc"), START + datetime.timedelta(seconds=r.randrange(4000)), r.random() < 0.8) for i in range(400)), key=lambda x: x[2])
    schema = "i int, user string, at timestamp, bad boolean"
    got = run_in_parts(states, tmp_path, schema, [rows[:120], rows[120:250], rows[250:]], lambda s: refused_stream(s, "user", "at", F.col("bad"), minutes=2, late="2 hours"))
    want = social.refused(states.createDataFrame(rows, schema), "user", "at", F.col("bad"), minutes=2)
    assert {x.i: x.refused for x in got.collect()} == {x.i: x.refused for x in want.collect()} and got.filter("refused").count() > 10 and got.count() == 400


def test_retries_come_when_due(states, tmp_path):
    at = lambda n: START + datetime.timedelta(seconds=n)
    parts = [[(1, at(0), "bad"), (2, at(0), "bad"), (3, at(0), None)], [(2, at(30), None), (9, at(61), None)], [(1, at(70), "worse"), (9, at(100), None)], [(9, at(300), None)], [(1, at(310), "worst"), (9, at(900), None)]]
    got = run_in_parts(states, tmp_path, "id int, at timestamp, error string", parts, lambda s: retry_queue(s, "id", "at", tries=3, wait=60.0))
    rows = sorted((r.id, r.failures, r.error, r.given_up, r.due) for r in got.collect())
    assert [x[:4] for x in rows] == [(1, 1, "bad", False), (1, 2, "worse", False), (1, 3, "worst", True)]
    assert [x[4] and x[4].replace(tzinfo=None) for x in rows] == [at(60), at(190), None]


def test_keys_share_states_of_retries(states, tmp_path):
    r, at, schema = random.Random(5), lambda n: START + datetime.timedelta(seconds=n), "id double, at timestamp, error string"
    source, out, nan = str(tmp_path / "in"), str(tmp_path / "out"), float("nan")
    want, state, n_states = [], {}, []
    for part in range(6):
        rows = [(r.choice([nan, None, *map(float, range(200))]), at(200 * part + i), r.choice([None, "bad", "worse"])) for i in range(200)]
        states.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = retry_queue(states.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "id", "at", tries=3, wait=100.0, groups=5)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
        n_states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        for i, when, error in rows:
            i = str(i)
            failures = state.pop(i, (0, None, None))[0] + (error is not None)
            if failures >= 3:
                want.append((i, 3, error, None))
            elif error is not None:
                state[i] = (failures, when + datetime.timedelta(seconds=100 * 2 ** (failures - 1)), error)
        for i, (failures, due, error) in state.items():
            if due and due <= at(200 * part + 199):
                want.append((i, failures, error, due))
                state[i] = (failures, None, error)
    got = [(str(x.id), x.failures, x.error, x.due and x.due.replace(tzinfo=None)) for x in states.read.parquet(out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100
    assert max(n_states) <= 4 * 5  # a state and a timer with its index for each group, not for each key


def test_feed_grows_without_its_history(states, tmp_path):
    r, feed = random.Random(3), GrowingFeed(states, str(tmp_path / "feed"), "id int, score int, note string", "id", {"score": True, "id": True}, size=5, reserve=6)
    rows = {}
    for epoch in range(1, 9):
        changes = {}
        for _ in range(12):
            i = r.randrange(60)
            changes[i] = (i, r.randrange(100), f"{epoch}", r.random() < 0.35)
        if epoch == 6:  # the best go
            changes = {i: (i, 0, "gone", True) for i in sorted(rows, key=lambda i: rows[i][1])[-9:]}
        for i, c in changes.items():
            rows.pop(i, None)
            if not c[3]:
                rows[i] = c[:3]
        batch = states.createDataFrame(list(changes.values()), "id int, score int, note string, deleted boolean")
        want = sorted(rows.values(), key=lambda x: (-x[1], -x[0]))[:5]
        for _ in range(2):  # a batch that is repeated
            assert [tuple(x) for x in feed.change(batch, epoch).collect()] == want, epoch
    assert 1 <= feed.refills <= 6


def test_feed_reads_no_history(states, tmp_path):
    feed = GrowingFeed(states, str(tmp_path / "feed"), "id int, score int", "id", {"score": True, "id": True}, size=3, reserve=4)
    for epoch in range(1, 4):
        out = feed.change(states.range(100 * epoch, 100 * epoch + 50).select(F.col("id").cast("int"), (F.col("id") % 41).cast("int").alias("score"), F.lit(False).alias("deleted")), epoch)
    assert feed.refills == 0 and [tuple(x) for x in out.collect()] == [(327, 40), (245, 40), (204, 40)][:3]
    assert "/history" not in out._jdf.queryExecution().toString()
