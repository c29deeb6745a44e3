"""Users, comments and sign-in records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import masked_phone, subscription
from .news import placed


def comments_with_users(comments: DataFrame, users: DataFrame, limit: int | None = 50) -> DataFrame:
    """Comments, newest first, with the nickname or the masked phone of their user; unknown users have none."""
    named = users.select(F.col("id").alias("user_id"), F.coalesce(F.nullif("nickname", F.lit("")), masked_phone(F.col("phone"))).alias("author"))
    rows = comments.join(named, "user_id", "left").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.limit(limit) if limit else rows


def newest_code(codes: DataFrame, now: Column) -> DataFrame:
    """Of each phone the newest code that is neither used nor expired."""
    good = codes.filter((F.col("used") == 0) & (F.col("expire_at") > now))
    return good.withColumn("nth", F.row_number().over(Window.partitionBy("phone").orderBy(F.desc("id")))).filter("nth = 1").drop("nth")


def locked(attempts: DataFrame, user: str, at: str, failed: Column, most: int = 5, minutes: int = 5) -> DataFrame:
    """Attempts with the number of failures in the last minutes, this one included, and whether that locks the user."""
    w = Window.partitionBy(user).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-60 * minutes, 0)
    return attempts.withColumn("failures", F.sum(failed.cast("long")).over(w)).withColumn("locked", F.col("failures") >= most)


def states(users: DataFrame, now: Column) -> DataFrame:
    return users.withColumn("state", subscription(F.col("level"), F.col("expires"), now))


def reviewed(news: DataFrame, comments: DataFrame) -> DataFrame:
    """News with its comments in order, for a review; news without comments has an empty list."""
    told = comments.groupBy("news_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("comments"))
    return news.join(told, news["id"] == told["news_id"], "left").drop("news_id").withColumn("comments", F.coalesce(F.transform("comments", lambda x: x["content"]), F.array().cast("array<string>")))


def feedback_added(feedback: DataFrame, requests: DataFrame) -> DataFrame:
    """feedback and new rows (user_id, type, content) with a content; a user may lack."""
    return feedback.unionByName(requests.filter(F.coalesce(F.btrim("content"), F.lit("")) != "").select(*feedback.columns))


def review_rows(reviews: DataFrame) -> DataFrame:
    """What is kept of reviews (news_id, reply: struct, raw): the reply's lists as JSON, and the reply as it came."""
    return reviews.select("news_id", *(F.to_json(F.col(f"reply.{c}")).alias(c) for c in ("valid_comments", "optimization_suggestions")), F.col("raw").alias("raw_llm_result"))


def signed_in(tokens: DataFrame, users: DataFrame, asked: list, now: Column) -> DataFrame:
    """The users of those tokens (token, user_id, expire_at) that are asked for and hold now."""
    held = tokens.filter(F.col("token").isin(asked) & (F.col("expire_at") > now)).select("token", F.col("user_id").alias("id"))
    return held.join(users, "id")


def without_own(comments: DataFrame, requests: DataFrame) -> DataFrame:
    """Comments without those whose own user asks for it (id, user_id); others' requests do nothing."""
    return comments.join(requests.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def subscribed(subscriptions: DataFrame, orders: DataFrame) -> DataFrame:
    """Subscriptions (user_id, level, status) after orders (user_id, level): those users' active ones end, new ones begin."""
    asking = orders.select("user_id").distinct().withColumn("_asks", F.lit(True))
    status = F.when(F.col("_asks") & (F.col("status") == "active"), "cancelled").otherwise(F.col("status"))
    old = subscriptions.join(asking, "user_id", "left").withColumn("status", status).select("user_id", "level", "status")
    return old.unionByName(orders.select("user_id", "level", F.lit("active").alias("status")))


def edited(comments: DataFrame, requests: DataFrame) -> DataFrame:
    """Comments with the content that their own user asks for (id, user_id, content); others' requests do nothing."""
    asked = requests.groupBy("id", "user_id").agg(F.max("content").alias("_content"))
    return comments.join(asked, ["id", "user_id"], "left").withColumn("content", F.coalesce("_content", "content")).drop("_content")


def added(comments: DataFrame, requests: DataFrame) -> DataFrame:
    """comments and new ones (news_id, user_id, content, created_at), numbered on from the greatest id by time."""
    last = comments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    order = [F.asc(c) for c in ("created_at", "user_id", "news_id", "content")]
    new = placed(requests, order).join(F.broadcast(last))
    return comments.unionByName(new.withColumn("id", F.col("_last") + F.col("place") + 1).select(*comments.columns))


def cancelled(subscriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """Subscriptions (user_id, level, status) without active ones of the users who cancel."""
    asking = requests.select("user_id").distinct().withColumn("_asks", F.lit(True))
    status = F.when(F.col("_asks") & (F.col("status") == "active"), "cancelled").otherwise(F.col("status"))
    return subscriptions.join(asking, "user_id", "left").withColumn("status", status).drop("_asks")


def with_levels(users: DataFrame, orders: DataFrame, cancels: DataFrame) -> DataFrame:
    """Users (id, level, expires) after orders (user_id, level, expires) and cancellations (user_id); who cancels is free."""
    new = orders.groupBy(F.col("user_id").alias("id")).agg(F.max(F.struct("expires", "level")).alias("_new"))
    gone = cancels.select(F.col("user_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    rows = users.join(new, "id", "left").join(gone, "id", "left")
    level = F.when(F.col("_gone"), "free").otherwise(F.coalesce("_new.level", "level"))
    expires = F.when(F.col("_gone").isNull(), F.coalesce("_new.expires", "expires"))
    return rows.withColumns({"level": level, "expires": expires}).drop("_new", "_gone")


def refused(attempts: DataFrame, user: str, at: str, failed: Column, most: int = 5, minutes: int = 5) -> DataFrame:
    """Attempts with whether each is refused, by counts that are kept for each user.

    Failures count up; a success that isn't refused sets the count to 0. At the first attempt with a count of `most` the
    user is locked for some minutes and the count is 0 again; that attempt and those until the lock ends are refused.
    The state after an attempt depends on the one before, so users with so many failures at all are read in order.
    """
    rows = attempts.withColumns({"_failed": failed, "_at": F.col(at).cast("timestamp").cast("long")})
    kinds = T.StructType([*rows.schema.fields, T.StructField("refused", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, until = None, 0, -1
        for frame in batches:
            out = []
            for who, when, bad in zip(frame[user], frame["_at"], frame["_failed"], strict=True):
                if who != now:
                    now, count, until = who, 0, -1
                if when < until:
                    out.append(True)
                elif count >= most:
                    count, until = 0, when + 60 * minutes
                    out.append(True)
                else:
                    count = count + 1 if bad else 0
                    out.append(False)
            yield frame.assign(refused=out)

    # a user's rows are together and in order in one partition, and pass through it in batches. The window needs them together
    # whatever is planned anew at run time; a join's side may be read where it lies once the other side turns out small
    order = ["_at", *(c for c in attempts.columns if c not in (user, at))]
    whole = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = rows.withColumn("_n", F.count_if("_failed").over(whole))
    risky = (F.col("_n") >= most) & F.col(user).isNotNull()
    ordered = counted.filter(risky).drop("_n").sortWithinPartitions(user, *order)
    calm = counted.filter(~risky).drop("_n").withColumn("refused", F.lit(False))
    return ordered.mapInPandas(run, kinds).unionByName(calm).drop("_failed", "_at")
