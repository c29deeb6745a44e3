"""What the corpus operators share: reading a table, cutting lineage, batches of Arrow."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so it may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir. Only a local master (tests) gets one of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, in_each: int = 250_000) -> DataFrame:
    """df in as few partitions as rows need, so that a small table costs no shuffle files by the hundred."""
    return df.coalesce(max(1, -(-rows // in_each)))


def placed(rows: DataFrame, group: list[str], order: list[str], most_broadcast: int = 200_000) -> DataFrame:
    """rows with place (from 0 on in each group, by order, nulls first) and size (the group's rows). Columns of group have no nulls.

    Rows are dealt by ranges, so a group of any size is numbered by many tasks: each numbers its own range, and a running
    sum over the ranges (a row for each group and task that has it) gives where that begins. Equal rows are told apart by
    where they are stored, so they too are dealt to many tasks.
    """
    stored = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    keys = [*group, *order, "_row"]
    ranged = durable(stored.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_row"))
    ranged = ranged.withColumn("_task", F.shiftright("_at", 33))
    tasks = ranged.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = durable(tasks.select(*group, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("size")))
    if tasks.count() <= most_broadcast:
        tasks = F.broadcast(tasks)
    return ranged.join(tasks, [*group, "_task"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")


def running(rows: DataFrame, group: list[str], at: str, values: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]], step: int = 4096, most_broadcast: int = 200_000) -> DataFrame:
    """rows, which are stored, with each column of values replaced by its running value in the group, by at (from 0 on, no gaps).

    values: a column's aggregate, and how two of its results combine. Runs of step rows are windows of their own, and runs
    are combined after that, so a group of any size is spread over tasks.
    """
    block = F.floor(F.col(at) / step)
    within = Window.partitionBy(*group, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_block", block).withColumns({c: whole(F.col(c)).over(within) for c, (whole, _) in values.items()})
    long = rows.filter(F.col(at) >= step).select(*group).distinct()
    if not long.limit(1).count():
        return out.drop("_block")
    sums = rows.join(long, group, "left_semi").groupBy(*group, block.alias("_block")).agg(*(whole(F.col(c)).alias(f"_{c}") for c, (whole, _) in values.items()))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = durable(sums.select(*group, "_block", *(whole(F.col(f"_{c}")).over(before).alias(f"_{c}") for c, (whole, _) in values.items())).filter("_block > 0"))
    if sums.count() <= most_broadcast:
        sums = F.broadcast(sums)
    joined = out.join(sums, [*group, "_block"], "left")
    return joined.withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(both(F.col(c), F.col(f"_{c}"))) for c, (_, both) in values.items()}).drop("_block", *(f"_{c}" for c in values))


def forgetting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: Callable[[], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which empties the worker's cache at the end of each task: workers are kept for later stages, their words need not be."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            cache().clear()
            pa.default_memory_pool().release_unused()

    return whole


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose text column holds about most_bytes at most (one row at least)."""
    for batch in batches:
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def kept_rows(docs: DataFrame, decisions: DataFrame, flag: str, keys: dict[str, Column], first: Column, most_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that decisions keep.

    decisions: a row for each row of docs, with the columns keys and flag (kept or not). keys: how docs gives the same
    values; several rows may have them in common, and then as many of these stay as are kept, those with the least first.
    A row of docs goes through as one struct, so its columns may have any names. Keys of which nothing stays are broadcast
    up to most_broadcast of them; beyond, the join is a shuffle.
    """
    summed = durable(decisions.groupBy(*(F.col(k).alias(f"k_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("kept")))
    names = [f"k_{k}" for k in keys]
    marked = docs.select(F.struct("*").alias("row"), first.alias("first"), *(c.alias(n) for n, c in zip(names, keys.values(), strict=True)))
    same = lambda other: reduce(lambda a, b: a & b, (marked[k].eqNullSafe(other[k]) for k in names))
    n_gone, n_some = summed.agg(F.count_if(F.expr("kept = 0")), F.count_if(F.expr("kept between 1 and n - 1"))).first()
    gone = summed.filter("kept = 0").select(*names)
    if n_gone <= most_broadcast:
        gone = F.broadcast(gone)
    if not n_some:
        return marked.join(gone, same(gone), "left_anti").select("row.*")
    some = summed.filter("kept between 1 and n - 1").select(*names, "kept")
    whole = marked.join(gone, same(gone), "left_anti").join(some, same(some), "left_anti")
    nth = F.row_number().over(Window.partitionBy(*(marked[k] for k in names)).orderBy("first"))
    part = marked.join(some, same(some)).withColumn("nth", nth).filter("nth <= kept")
    return whole.select("row.*").unionByName(part.select("row.*"))
