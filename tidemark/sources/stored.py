"""Tables that are written more than once: batches that replace themselves, and versions of a table that is updated by key.

A run that fails, or that is repeated, leaves the table as it was, or as it would be after one run.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the session's shared folder (spark.checkpoint.dir; a local master may have one of its own)."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(shared)
    return rows.checkpoint(eager=True)


def put_batches(rows: DataFrame, path: str, *by: str) -> None:
    """Writes rows into the table's partitions by (batch_id), of which those that rows have are replaced as a whole."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or ("batch_id",))).parquet(path)


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All of a table of batches (schema: with the columns it is partitioned by); empty before the first."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    """The file system of a path, whichever Spark reads it by, and the path in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table, ascending. What a failed run has left is none."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest version of a table (before: of those below); empty before the first."""
    whole = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/version={whole[-1]}") if whole else spark.createDataFrame([], schema)


def put_version(spark: SparkSession, path: str, schema: str, number: int, change: Callable[[DataFrame], DataFrame], keep: int = 2) -> None:
    """Writes version `number` as change of the newest one below it; readers see it once it is whole.

    A number that is repeated gives the same version again. The newest `keep` whole versions stay.
    """
    change(current(spark, path, schema, before=number)).write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in versions(spark, path)[:-keep]:
        files, at = _files(spark, f"{path}/version={old}")
        files.delete(at, True)
