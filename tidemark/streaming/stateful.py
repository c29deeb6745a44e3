"""Streams with state that lasts: addresses of all time, locks and retries by key, a feed that grows without its history.

State lies in RocksDB on the executors' disks, dealt by key, and is recovered from the query's checkpoint; `durable_state`
sets that. So it may be larger than memory, and a batch costs what it has, not what came before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources import stored
from ..sources.tables import write_feed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def durable_state(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, and write what changes of it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def first_ever(stream: DataFrame, known: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Each address once in all time, however long ago it came; blank ones always. known: a table of addresses from before the stream.

    There is no watermark, so an address is never forgotten: the state is a row for each, in its key's task.
    """
    if known is not None:
        stream = stream.join(known.select(F.col(url).alias("_known")).distinct(), F.col(url) == F.col("_known"), "left_anti")
    blank = F.coalesce(F.col(url), F.lit("")) == ""
    # a blank address is told apart by its own row, so the rest of the row is its key
    rest = [c for c in stream.columns if c != url]
    key = F.when(blank, F.concat(F.lit(" "), F.to_json(F.struct(*rest)))).otherwise(F.col(url))
    return stream.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


class _Refusals(StatefulProcessor):
    """A user's failures in a row and the lock's end; the timer at its end forgets a user without failures."""

    def __init__(self, at: str, order: list[str], most: int, seconds: int) -> None:
        self.at, self.order, self.most, self.seconds = at, order, most, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        failures, until = self.state.get() if self.state.exists() else (0, -1)
        for row in sorted(rows, key=lambda r: (r["_at"], *(str(r[c]) for c in self.order))):
            refused = row["_at"] < until or failures >= self.most
            if row["_at"] >= until:
                if failures >= self.most:
                    failures, until = 0, row["_at"] + self.seconds
                    self.handle.registerTimer(until * 1000)
                else:
                    failures = failures + 1 if row["_failed"] else 0
            yield Row(**{c: row[c] for c in row.__fields__ if c not in ("_at", "_failed")}, refused=refused)
        self.state.update((failures, until))
        if not failures and until < 0:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists() and self.state.get()[0] == 0 and self.state.get()[1] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def refused_stream(attempts: DataFrame, user: str, at: str, failed: Column, most: int = 5, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """The stream's attempts with whether each is refused, by the rule of social.refused, where a user's batches come in order of time."""
    order = [c for c in attempts.columns if c not in (user, at)]
    rows = attempts.withColumns({"_failed": failed, "_at": F.col(at).cast("timestamp").cast("long"), at: F.col(at).cast("timestamp")}).withWatermark(at, late)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_at", "_failed"))
    return rows.groupBy(user).transformWithState(_Refusals(at, order, most, 60 * minutes), f"{kinds}, refused boolean", "append", "EventTime")


def _same(key):
    """What equal keys have in common, for a dict: floats as Spark groups them, and keys that have no hash."""
    return key if key is None or isinstance(key, (int, str)) else repr(key + 0.0 if isinstance(key, float) else key)


class _Retries(StatefulProcessor):
    """How often the keys of a group have failed; the timer at the earliest next try gives out those whose time has come.

    A group's state is read and written as one, so that a batch costs some calls for a group and none for a row.
    """

    def __init__(self, key: str, kind: str, tries: int, wait: float) -> None:
        self.key, self.kind, self.tries, self.wait = key, kind, tries, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"keys array<{self.kind}>, failures array<int>, due array<long>, errors array<string>, timer long")

    def _out(self, key, failures: int, due: int | None, error: str | None) -> Row:
        return Row(**{self.key: key, "failures": failures, "due": due and datetime.fromtimestamp(due / 1000, timezone.utc), "error": error, "given_up": due is None})

    def _held(self) -> tuple[dict, int]:
        """The group's keys that have failed (key, failures, due or 0, error), and when its timer is set, or 0."""
        state = self.state.get()
        if state is None:
            return {}, 0
        *columns, timer = state
        return {_same(row[0]): row for row in zip(*columns, strict=True)}, timer

    def _keep(self, held: dict, timer: int) -> None:
        first = min((due for _, _, due, _ in held.values() if due), default=0)
        if timer and timer != first:
            self.handle.deleteTimer(timer)
        if first and timer != first:
            self.handle.registerTimer(first)
        if held:
            self.state.update((*map(list, zip(*held.values(), strict=True)), first))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held, timer = self._held()
        changed = False
        for row in sorted(rows, key=lambda r: r["_at"]):
            name, error = _same(row[self.key]), row["error"]
            before = held.pop(name, None)
            changed = changed or before is not None or error is not None
            if error is None:
                continue
            failures = before[1] if before else 0
            if failures + 1 >= self.tries:
                yield self._out(row[self.key], failures + 1, None, error)
            else:
                held[name] = (row[self.key], failures + 1, int(row["_at"] + 1000 * self.wait * 2**failures), error)
        if changed:
            self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held, timer = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        for name, (one, failures, due, error) in held.items():
            if due and due <= now:
                held[name] = (one, failures, 0, error)
                yield self._out(one, failures, due, error)
        if held:
            self._keep(held, timer)

    def close(self) -> None:
        pass


def retry_queue(judged: DataFrame, key: str, at: str, tries: int = 3, wait: float = 60.0, late: str = "0 seconds", groups: int = 1 << 16) -> DataFrame:
    """From a stream of judgements (key, at, error or null) the rows to be judged again, when their time has come.

    After the first failure a row waits so many seconds, then twice as long each time; after the last try it comes out as
    given up, at once. A judgement without error forgets a row. Columns: key, failures, due, error, given_up.
    groups: keys share so many states and timers; each holds those of its keys that wait. A checkpoint keeps the number it began with.
    """
    rows = judged.select(key, F.col(at).cast("timestamp").alias(at), "error").withColumn("_at", F.unix_millis(at)).withWatermark(at, late)
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").transformWithState(_Retries(key, kind, tries, wait), f"`{key}` {kind}, failures int, due timestamp, error string, given_up boolean", "append", "EventTime")


class GrowingFeed:
    """A feed of the best `size` rows by `order`, kept up by batches of changes that never read what came before.

    Beside the feed a reserve is kept, as the best `size + reserve` rows with the order's key of the best row that was ever
    left out. Rows below that key may be worse than some that were left out, so they don't count. A batch may bring a key
    again (its last version counts) or delete it; both use the reserve up, and when it is used up, all rows are read once to fill it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: dict[str, bool], size: int, reserve: int = 200) -> None:
        """order: columns that rank the rows, with whether they descend; they end with the key, so no two rows are alike."""
        self.spark, self.path, self.schema, self.key, self.size, self.reserve = spark, path, schema, key, size, reserve
        self.order = [F.desc(c) if down else F.asc(c) for c, down in order.items()]
        self.columns = list(order)
        self.refills = 0

    def _better(self, rows: DataFrame, floor: Row | None) -> DataFrame:
        """The rows that rank before floor."""
        if floor is None:
            return rows
        before, same = F.lit(False), F.lit(True)
        for c, by in zip(self.columns, self.order, strict=True):
            value = F.lit(floor[c])
            down = "DESC" in str(by)
            before = before | (same & (F.col(c) > value if down else F.col(c) < value))
            same = same & F.col(c).eqNullSafe(value)
        return rows.filter(before)

    def _history(self, epoch: int) -> DataFrame:
        """All rows as they are after a batch: of each key the last change, if that is no deletion."""
        rows = self.spark.read.schema(f"{self.schema}, deleted boolean, batch int").parquet(f"{self.path}/history").filter(F.col("batch") <= epoch)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("row")).select("row.*")
        return newest.filter(~F.col("deleted")).drop("deleted", "batch")

    def _kept(self, rows: DataFrame, floor: Row | None) -> tuple[list[Row], Row | None]:
        """The best size + reserve of rows, and the floor below them. A feed is small: its limit is the list's."""
        most = self.size + self.reserve
        best = rows.orderBy(*self.order).limit(most + 1).collect()
        return (best[:most], best[most]) if len(best) > most else (best, floor)

    def change(self, rows: DataFrame, epoch: int) -> DataFrame:
        """The feed after a batch of rows (schema's columns and deleted). A batch that is repeated gives the same feed again."""
        stored.put_batches(rows.withColumn("batch", F.lit(epoch)), f"{self.path}/history", "batch")
        # what was written is read again, so that the state and the history see the same rows
        rows = self.spark.read.schema(f"{self.schema}, deleted boolean").parquet(f"{self.path}/history/batch={epoch}")
        names = rows.drop("deleted").columns
        old = stored.current(self.spark, f"{self.path}/state", f"{self.schema}, floor boolean", before=epoch)
        floors = old.filter("floor").drop("floor").collect()
        floor = floors[0] if floors else None
        kept = old.filter("not floor").drop("floor").join(rows.select(self.key), self.key, "left_anti").select(*names)
        best, floor = self._kept(self._better(kept.unionByName(rows.filter(~F.col("deleted")).drop("deleted")), floor), floor)
        if floor is not None and len(best) < self.size:
            self.refills += 1
            best, floor = self._kept(self._history(epoch), None)
        state = self.spark.createDataFrame([(*r, False) for r in best] + ([(*floor, True)] if floor else []), f"{self.schema}, floor boolean")
        stored.put_version(self.spark, f"{self.path}/state", self.schema, epoch, lambda _: state)
        return self.feed(epoch)

    def feed(self, epoch: int) -> DataFrame:
        """The feed as it was stored after a batch."""
        state = stored.current(self.spark, f"{self.path}/state", f"{self.schema}, floor boolean", before=epoch + 1)
        return state.filter("not floor").drop("floor").orderBy(*self.order).limit(self.size)

    def start(self, stream: DataFrame, feed_path: str, checkpoint: str):
        """Starts a query that takes each micro-batch as a change and writes the feed's snapshot."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, epoch: write_feed(self.change(rows, epoch + 1), feed_path, *self.order)).start()


def feed_by_batches(feed: GrowingFeed, batches: Callable[[int], DataFrame], count: int) -> DataFrame:
    """The feed after `count` batches, for tables whose batches are numbered."""
    for epoch in range(1, count + 1):
        out = feed.change(batches(epoch), epoch)
    return out
