"""Mixing sources to target weights: temperature by bisection, then budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected on a grid: at 1 the
shares are as found, at 0 all sources weigh the same. It is the largest at which the weights' entropy reaches the target,
raised again where some source would be repeated more often than the limit allows. Each step is one aggregate over the
table of sources, which stays in Spark.

A source's budget is its weight of the whole budget. It is filled by passes over the source. In a pass its blocks are
permuted by a keyed hash, and so are the documents of a block. Full passes take all; the last takes a prefix of its
permutation, whose end is found by sums over hash prefixes, then over the blocks of one such prefix, then over the
documents of one block. Whether a document is drawn then depends on its source's row and its own hash alone.

Defined results: a null source is a source of its own. A null or empty text has no tokens and is drawn as often as the
passes reach it. A source without tokens has no weight and is not drawn. Rows that repeat a doc_id have one place in the
permutation and are drawn together; so are rows without doc_id in one source. An empty table gives an empty result.
Columns of docs may have any names: a row goes through as one struct. Where one is called as a column of the result that
this operator adds, the added one is returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WORD = r"[^\x20\x09-\x0D]+"


def bisected(sources: DataFrame, budget: float, *, entropy: float | None, most_repeats: float | None, steps: int) -> float:
    """The exponent, a multiple of 1 / steps, for a table with the column tokens (over 0)."""
    total, = sources.agg(F.sum("tokens")).first()
    if not total:
        return 1.0
    share = F.col("tokens") / F.lit(total)

    def at(k: int) -> tuple[float, float]:
        power = F.pow(share, F.lit(k / steps))
        norm, logs, most = sources.agg(F.sum(power), F.sum(power * F.ln(share)), F.max(power / share)).first()
        return math.log(norm) - (k / steps) * logs / norm, most / norm * budget / total

    def search(fine, low: int, high: int) -> int:
        """The smallest k from low to high that is fine; all above it are."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fine(middle) else (middle + 1, high)
        return low

    k = steps
    if entropy is not None:  # the entropy falls as k grows
        k = max(0, search(lambda k: at(k)[0] < entropy, 0, steps + 1) - 1)
    if most_repeats is not None and at(k)[1] > most_repeats:
        k = search(lambda k: k == steps or at(k)[1] <= most_repeats, k, steps)
    return k / steps


def _digits(tokens: Column, documents: Column, block_tokens: int, block_documents: int) -> Column:
    """So many hexadecimal digits of a document's hash name its block."""
    blocks = F.greatest(tokens / block_tokens, documents / block_documents, F.lit(1.0))
    return sum((F.when(blocks > 16**i, 1).otherwise(0) for i in range(8)), F.lit(0)).cast("int")


def _order(source_key: Column, seed: str, nth: Column, block: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), nth.cast("string"), source_key, block))


def _marked(docs: DataFrame, source: Column, tokens: Column, id_col: str, seed: str) -> DataFrame:
    key = F.concat_ws("", F.when(source.isNull(), "-").otherwise("+"), source.cast("string"))
    return docs.select(F.struct("*").alias("row"), key.alias("_source"), tokens.alias("_tokens"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_doc"))


def _cut(rows: DataFrame, keys: list[str], order: str, need: str) -> DataFrame:
    """By keys: the value of order at which the tokens so far first reach need, and what is needed within it."""
    summed = rows.groupBy(*keys, order).agg(F.sum("_tokens").alias("_tokens"), F.first(need).alias(need))
    until = F.coalesce(F.sum("_tokens").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = summed.withColumn("_until", until).filter(F.col("_until") < F.col(need))
    last = reached.groupBy(*keys).agg(F.max(F.struct(order, F.col("_until"), F.col(need))).alias("_last"))
    return last.select(*keys, F.col(f"_last.{order}").alias(order), (F.col(f"_last.{need}") - F.col("_last._until")).alias(need))


def plan(marked: DataFrame, *, budget: int | None, entropy_share: float | None, most_repeats: float | None, seed: str, steps: int, block_tokens: int, block_documents: int, most_broadcast: int) -> DataFrame:
    """One row per source: tokens, documents, budget, full passes, digits of a block, and where the last pass ends."""
    sources = durable(marked.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).filter("tokens > 0"))
    count, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    small = F.broadcast if count <= most_broadcast else lambda df: df  # a row per source
    whole = total if budget is None else budget
    target = None if entropy_share is None or count < 2 else entropy_share * math.log(count)
    exponent = bisected(sources, whole, entropy=target, most_repeats=most_repeats, steps=steps) if count else 1.0
    power = F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(exponent))
    norm = sources.agg(F.coalesce(F.sum(power), F.lit(1.0))).first()[0]
    sources = sources.withColumn("budget", F.round(F.lit(float(whole)) * power / F.lit(norm)).cast("long"))
    sources = sources.withColumn("passes", F.expr("budget div tokens")).withColumn("need", F.col("budget") - F.col("passes") * F.col("tokens"))
    sources = durable(sources.withColumn("digits", _digits(F.col("tokens"), F.col("documents"), block_tokens, block_documents)))

    # hashes of hashes are uniform: bounded sums by their first three digits, then by block, then by document
    blocks = marked.join(small(sources.filter("need > 0")), "_source").withColumn("_block", F.expr("substring(_doc, 1, digits)"))
    blocks = blocks.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_tokens"), F.first("need").alias("need"), F.first("passes").alias("passes"))
    blocks = durable(blocks.withColumn("_order", _order(F.col("_source"), seed, F.col("passes"), F.col("_block"))).withColumn("_front", F.substring("_order", 1, 3)))
    front = _cut(blocks, ["_source"], "_front", "need")
    within = blocks.drop("need").join(front, ["_source", "_front"])
    block = _cut(within.select("_source", "_order", "_tokens", "need"), ["_source"], "_order", "need")
    block = durable(block.join(blocks.select("_source", "_order", "_block"), ["_source", "_order"]).join(sources.select("_source", "digits"), "_source"))
    rows = marked.join(small(block), "_source").filter(F.expr("substring(_doc, 1, digits) = _block")).select("_source", "_doc", "_tokens", "need")
    last = _cut(rows, ["_source"], "_doc", "need").select("_source", F.col("_doc").alias("last_doc"))
    ends = block.select("_source", F.col("_order").alias("last_order")).join(last, "_source")
    return durable(sources.join(ends, "_source", "left").drop("need"))


def mix(
    docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", tokens: Column | None = None, budget: int | None = None, entropy_share: float | None = 0.98,
    most_repeats: float | None = 4.0, seed: str = "mix", steps: int = 1024, block_tokens: int = 1_000_000, block_documents: int = 10_000, most_broadcast: int = 100_000,
) -> DataFrame:
    """The rows of docs with all their columns, each as often as it is drawn, and the columns mix_tokens, mix_budget,
    mix_pass, mix_block and mix_order (a row's place in its source: compare by pass, then by order).

    tokens: the number of a row's tokens; its words by default. budget: tokens to draw; by default as many as there are.
    entropy_share: the target entropy as a share of the most that the sources allow.
    block_tokens, block_documents: a block has about so many at most. most_broadcast: up to so many sources, their rows
    are broadcast; more are joined by a shuffle.
    """
    counted = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long") if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    marked = _marked(docs, F.col(source_col), counted, id_col, seed)
    narrow = durable(marked.select("_source", "_tokens", "_doc"))
    sources = plan(narrow, budget=budget, entropy_share=entropy_share, most_repeats=most_repeats, seed=seed, steps=steps, block_tokens=block_tokens, block_documents=block_documents, most_broadcast=most_broadcast)
    named = sources.select("_source", *(F.col(c).alias(f"_{c}") for c in ("budget", "passes", "digits", "last_order", "last_doc")))
    if sources.count() <= most_broadcast:
        named = F.broadcast(named)
    drawn = marked.join(named, "_source").withColumn("_block", F.expr("substring(_doc, 1, _digits)"))
    drawn = drawn.withColumn("_last", _order(F.col("_source"), seed, F.col("_passes"), F.col("_block")))
    also = F.coalesce((F.col("_last") < F.col("_last_order")) | ((F.col("_last") == F.col("_last_order")) & (F.col("_doc") <= F.col("_last_doc"))), F.lit(False))
    times = F.col("_passes") + also.cast("long")
    drawn = drawn.filter(times > 0).withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    order = F.concat(_order(F.col("_source"), seed, F.col("_pass"), F.col("_block")), F.col("_doc"))
    added = {"mix_tokens": F.col("_tokens"), "mix_budget": F.col("_budget"), "mix_pass": F.col("_pass"), "mix_block": F.col("_block"), "mix_order": order}
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in added), *(v.alias(k) for k, v in added.items()))
