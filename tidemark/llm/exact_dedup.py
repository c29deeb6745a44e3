"""Exact deduplication in three combining stages, each of which compares whole texts.

1. Each task keeps one row per text it has read (Spark's map-side combine; the salt is the task's own number, so a
   task never splits one text).
2. The survivors of the tasks meet by digest and salt: a text that every task holds goes to `salts` tasks, not to one.
3. One row per text and salt is left; these meet by digest alone.

All stages group by digest *and* text, so two texts with one digest stay apart. The answer is then joined back to the
rows by digest; only where a digest turns out to stand for two texts does the join compare texts as well.

Defined results: a null text counts as empty, and all empty texts are one group. A null doc_id loses ties against any
other. Rows that repeat a doc_id and a text are copies of each other: exactly one is kept. An empty table gives an
empty result. Columns other than the two that are named are not read, so their names cannot clash.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
#: A row's rank among equal texts, as one number: code points first, then the smaller doc_id.
STEP, MIDDLE = Decimal(2**65), Decimal(2**63)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(n_points: Column, doc_id: Column) -> Column:
    behind = F.coalesce(F.lit(MIDDLE).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (n_points.cast("decimal(10,0)") * F.lit(STEP).cast("decimal(20,0)") + behind).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    behind = rank % F.lit(STEP).cast("decimal(20,0)")
    return F.when(behind > 0, (F.lit(MIDDLE).cast("decimal(20,0)") - behind).cast("long"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, hot_share: float = 1e-3, digest=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    digest: makes the key by which texts meet, SHA-256 by default; any deterministic function gives the same result.
    hot_share: a text with at least this share of all rows is joined back by broadcast; there are at most
    1 / hot_share such texts.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), text.alias("content")).select("doc_id", "points", "content", (digest or _sha256)(F.col("content")).alias("digest"), *([_sha256(F.col("content")).alias("sha256")] if digest else []))
    sha256 = "sha256" if digest else "digest"

    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("digest", "salt", "content").agg(F.max(_rank(F.col("points"), F.col("doc_id"))).alias("rank"), F.count(F.lit(1)).alias("size"))
    by_text = local.repartition("digest").groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("size").alias("size"))
    by_digest = durable(by_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("rank").alias("rank"), F.sum("size").alias("size")))

    shared = by_digest.filter("texts > 1").select("digest")
    total, clash = by_digest.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("texts"), F.lit(0))).first()
    winners = by_digest.filter("texts = 1").select("digest", "rank", "size")
    keys = ["digest"]
    slim = rows.select("doc_id", "points", "digest", F.lit(None).cast("string").alias("own"), F.col(sha256).alias("text_sha256"))
    if clash > 1:  # the texts themselves tell such rows apart
        winners = winners.withColumn("own", F.lit(None).cast("string")).unionByName(by_text.join(shared, "digest", "left_semi").select("digest", "rank", "size", F.col("content").alias("own")))
        slim = rows.join(shared.withColumn("clash", F.lit(True)), "digest", "left").select("doc_id", "points", "digest", F.when(F.col("clash"), F.col("content")).alias("own"), F.col(sha256).alias("text_sha256"))
        keys = ["digest", "own"]
    return _joined_back(slim, winners, keys, max(1000, int(total * hot_share)))


def _joined_back(slim: DataFrame, winners: DataFrame, keys: list[str], hot_at: int) -> DataFrame:
    hot = F.broadcast(winners.filter(F.col("size") >= hot_at).select(*(F.col(k).alias(f"h_{k}") for k in keys), F.col("rank").alias("h_rank"), F.col("size").alias("h_size")))
    on_hot = [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys]
    # a row of a hot text has its answer already; it gets a key of its own, so that the next join spreads such rows
    spread = F.when(F.col("h_rank").isNotNull(), F.concat(F.lit("hot "), F.xxhash64("doc_id").cast("string"))).otherwise(F.concat_ws("|", F.col("digest"), *(F.sha2(F.col(k), 256) for k in keys[1:])))
    left = slim.join(hot, on_hot, "left").withColumn("meet", spread)
    right = winners.filter(F.col("size") < hot_at).select(F.concat_ws("|", F.col("digest"), *(F.sha2(F.col(k), 256) for k in keys[1:])).alias("meet"), F.col("rank"), F.col("size"), *(F.col(k).alias(f"w_{k}") for k in keys[1:]))
    joined = left.join(right, [left["meet"] == right["meet"], *(F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys[1:])], "left").select(left["meet"], "doc_id", "points", "digest", "own", "text_sha256", F.coalesce("h_rank", "rank").alias("rank"), F.coalesce("h_size", "size").alias("size"))
    first = F.row_number().over(Window.partitionBy("meet", "doc_id", "digest", "own").orderBy(F.desc("points")))
    keep_id = _id_of(F.col("rank"))
    return joined.withColumn("nth", first).select(
        "doc_id", keep_id.alias("keep_id"), F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(keep_id) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )
