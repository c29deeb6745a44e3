"""A source that gives its rows by pages, as a data source of Spark: pages are planned from its count and read by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from math import ceil
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: What each row has besides its own columns: its page, and how many rows the page has (an empty page has one row, without values).
PAGE = "page int, on_page int, place int"


class RefusedError(Exception):
    """A source's answer that its session has ended."""


def _asked(ask: Callable[[], Any], refresh: Callable[[], None] | None) -> Any:
    """What ask gives; if it is refused, the session is refreshed once."""
    try:
        return ask()
    except RefusedError:
        if refresh is None:
            raise
        refresh()
        return ask()


def paged_source(name: str, schema: str, count: Callable[[], int | None], fetch: Callable[[int, int], list[Mapping[str, Any]]], refresh: Callable[[], None] | None = None) -> type[DataSource]:
    """A data source to register. count: the rows there are (0 or None: not known). fetch: the rows of a page (from 1 on) by its size.

    Options of a read: per_page, most_pages, first_page, tasks. As many pages are planned as the count needs, most_pages at most;
    with tasks, runs of pages are shared out to so many tasks, else each page is a task.
    """

    class Reader(DataSourceReader):
        def __init__(self, kinds: StructType, options: Mapping[str, str]) -> None:
            self.names = [f for f in kinds.names if f not in ("page", "on_page", "place")]
            self.per_page, self.most, self.first, self.tasks = (int(options.get(k, v)) for k, v in (("per_page", 100), ("most_pages", 5), ("first_page", 1), ("tasks", 0)))

        def partitions(self) -> list[InputPartition]:
            rows = _asked(count, refresh)
            pages = min(self.most, ceil(rows / self.per_page)) if rows else self.most
            run = max(1, ceil(pages / self.tasks)) if self.tasks else 1
            return [InputPartition((self.first + i, self.first + min(i + run, pages))) for i in range(0, pages, run)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for page in range(*partition.value):
                rows = _asked(lambda: fetch(page, self.per_page), refresh)  # noqa: B023 - asked at once
                for place, row in enumerate(rows):
                    yield (page, len(rows), place, *(row.get(n) for n in self.names))
                if not rows:
                    yield (page, 0, 0, *(None for _ in self.names))

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{PAGE}, {schema}"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema, self.options)

    return Paged


def landed(spark: SparkSession, source: type[DataSource], folder: str, per_page: int = 100, most_pages: int = 5, first_page: int = 1) -> DataFrame:
    """The rows of a paged source, which is read once, into folder: a later read or a lost task asks it no more.

    As if pages were asked for one after another: a page with fewer rows than per_page is the last one. Columns page and place stay.
    """
    spark.dataSource.register(source)
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.read.format(source.name()).options(per_page=per_page, most_pages=most_pages, first_page=first_page, tasks=tasks).load().write.mode("overwrite").parquet(folder)
    rows = spark.read.parquet(folder)
    last = rows.filter(F.col("on_page") < per_page).agg(F.coalesce(F.min("page"), F.lit(2**31 - 1)).alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col("page") <= F.col("last")).filter("on_page > 0").drop("last", "on_page")
