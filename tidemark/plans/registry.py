"""Where named queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NEWS_SQL = """news AS (SELECT o_orderkey AS id, o_custkey AS user_id, CAST(year(o_orderdate) AS BIGINT) AS batch_id, 2 * (6 - CAST(left(o_orderpriority, 1) AS INTEGER)) AS score,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS publish_time, o_orderstatus AS status, CAST(o_custkey % 3 - 1 AS INTEGER) AS is_useful FROM orders)"""

#: Sign-in attempts one after another, by recursion.
REFUSED_SQL = """WITH RECURSIVE a AS MATERIALIZED (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, event_type <> 'click' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id, event_type) AS n FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS fails, CAST(-1 AS BIGINT) AS until, FALSE AS refused FROM (SELECT DISTINCT user_id FROM a) AS u
 UNION ALL SELECT a.user_id, a.n, a.event_id, CASE WHEN a.at < s.until THEN s.fails WHEN s.fails >= 5 THEN 0 WHEN a.failed THEN s.fails + 1 ELSE 0 END, CASE WHEN a.at >= s.until AND s.fails >= 5 THEN a.at + 86400 ELSE s.until END, a.at < s.until OR s.fails >= 5 FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1)
SELECT event_id, refused FROM s WHERE n > 0"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{news}", NEWS_SQL)
        return f

    return add
