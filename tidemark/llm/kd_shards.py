"""Sharding by a k-d tree over the documents' metadata, with leaves of equal bytes.

A node that shall become k shards is split at the weighted quantile k // 2 / k of its bytes (the median, for an even k)
along the dimension in which its documents are spread widest. Dimensions are numbers of 24 bits: the place of the id
between the smallest and the largest, the logarithm of the size, hashes of source and language. Below each, 38 bits of a
hash of the id and the content break ties, so a hot source or language can be split anywhere, and the result does not
depend on how the rows lie in files. The quantile is exact: rounds of
histograms, one group per node and bin, narrow it to one value. Only those bounded histograms, and the tree with its
shards - 1 splits, are on the driver. A row finds its shard by comparing along the tree.

Slots number the rows of a shard from 0: rows are dealt into small cells of a shard by hash, cells get running sums.

Defined results: a null text has no bytes, a size of 16 and the CRC of no bytes. Null ids, sources and languages lie at
the low end. Rows that repeat may go to different shards: they are counted, and each has a number of its own. With fewer rows than
shards some shards are empty. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

BITS, TIES = 24, 38


@dataclass
class Node:
    """Shards from first on. Rows whose key of the dimension is up to last go into the first half of them."""

    first: int
    shards: int
    dimension: int = 0
    last: int = 0

    def halves(self) -> tuple[Node, Node]:
        half = self.shards // 2
        return Node(self.first, half), Node(self.first + half, self.shards - half)


def _hash_place(name: Column) -> Column:
    return F.when(name.isNull(), 0).otherwise(F.shiftrightunsigned(F.xxhash64(name), 64 - BITS))


def _keys(low: int, high: int) -> list[Column]:
    span = max(1, high - low)
    place = F.coalesce(F.floor((F.col("doc_id").cast("double") - low) / span * (2**BITS - 1)), F.lit(0))
    size = F.floor(F.log2(F.col("size").cast("double")) / 32 * (2**BITS - 1))
    dimensions = [place, size, F.col("source"), F.col("lang")]
    return [F.shiftleft(d.cast("long"), TIES) + F.col("tie") for d in dimensions]


def _small(spark: SparkSession, names: list[str], rows: list[tuple[int, ...]]) -> DataFrame:
    """A table of a few whole numbers, one row for a node at most."""
    structs = [F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))


def _quantiles(rows: DataFrame, nodes: list[Node], keys: list[str], bins: int) -> list[Node]:
    """Finds the dimension and the split of all nodes at once; returns the nodes that have rows.

    One job gives their widths and bytes. A few rounds of histograms then narrow each quantile to one key.
    """
    spark = rows.sparkSession
    ends = rows.groupBy("node").agg(F.sum("size").alias("size"), *(f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max)))).collect()
    found, todo = {x["node"]: x for x in ends}, {}
    for node in nodes:
        if (x := found.get(node.first)) is None:
            continue
        widths = [(x[f"high_{k}"] >> TIES) - (x[f"low_{k}"] >> TIES) for k in keys]
        node.dimension = widths.index(max(widths))
        k = keys[node.dimension]
        # the quantile's key lies in low..high; so many bytes are before it
        todo[node.first] = {"node": node, "low": x[f"low_{k}"], "high": x[f"high_{k}"], "before": 0, "want": x["size"] * (node.shards // 2) / node.shards}
    held = [x["node"] for x in todo.values()]
    while todo:
        near = rows.join(_small(spark, ["node", "dimension", "from", "upto", "width"], [(k, x["node"].dimension, x["low"], x["high"], (x["high"] - x["low"]) // bins + 1) for k, x in todo.items()]), "node")
        near = near.withColumn("key", F.element_at(F.array(*keys), (F.col("dimension") + 1).cast("int"))).filter("key between from and upto")
        table = near.groupBy("node", F.expr("(key - from) div width").alias("bin")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        parts: dict[int, list] = {}
        for row in sorted(table, key=lambda r: r["low"]):
            parts.setdefault(row["node"], []).append(row)
        for first, part in parts.items():
            x = todo[first]
            for row in part:
                if x["before"] + row["size"] >= x["want"]:
                    break
                x["before"] += row["size"]
            x["low"], x["high"] = row["low"], row["high"]
            if x["low"] == x["high"]:
                # its rows go where the left part comes nearer to what it shall have
                nearer = x["before"] + row["size"] - x["want"] <= x["want"] - x["before"]
                x["node"].last = x["low"] if nearer else x["low"] - 1
                del todo[first]
    return held


def kd_leaves(rows: DataFrame, keys: list[str], shards: int, bins: int = 512) -> DataFrame:
    """rows (size and the keys, long) with the column node: the leaf of each. Each level is kept, so that none is computed twice."""
    rows, level = durable(rows.withColumn("node", F.lit(0).cast("long"))), [Node(0, shards)] if shards > 1 else []
    while level:
        split = _quantiles(rows, level, keys, bins)
        if not split:
            break
        cuts = _small(rows.sparkSession, ["node", "dimension", "last", "right"], [(n.first, n.dimension, n.last, n.halves()[1].first) for n in split])
        key = F.element_at(F.array(*keys), (F.col("dimension") + 1).cast("int"))
        rows = durable(rows.join(cuts, "node", "left").withColumn("node", F.when(key > F.col("last"), F.col("right")).otherwise(F.col("node"))).drop("dimension", "last", "right"))
        level = [n for x in split for n in x.halves() if n.shards > 1]
    return rows


def _numbered(rows: DataFrame, most_at_once: int = 100_000) -> DataFrame:
    """rows with copy: equal rows are numbered from 0. They are counted, with sums before the shuffle, and told again."""
    counted = durable(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    span = F.lit(most_at_once)
    each = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {most_at_once}"))))
    if (counted.agg(F.max("copies")).first()[0] or 0) > most_at_once:
        each = each.repartition(*rows.columns, "part")  # a group of very many copies is told by many tasks
    last = F.least(F.col("copies"), (F.col("part") + 1) * span) - 1
    return each.withColumn("copy", F.explode(F.sequence(F.col("part") * span, last))).select(*rows.columns, "copy")


def kd_shards(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", cell_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    cell_rows: about so many rows get their slots in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        _hash_place(F.col(source_col)).alias("source"), _hash_place(F.col(lang_col)).alias("lang"), F.xxhash64(text).alias("content"),
    )
    rows = durable(_numbered(rows).withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "content", "copy"), 64 - TIES)).drop("content", "copy"))
    count, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    columns = _keys(low or 0, high or 0)
    names = [f"key{i}" for i in range(len(columns))]
    keyed = rows.select("doc_id", "size", "text_crc32", "tie", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
    cells = max(1, count // (shards * cell_rows))
    placed = kd_leaves(keyed, names, shards).select("doc_id", "size", "text_crc32", "tie", F.col("node").cast("int").alias("shard"), F.pmod(F.col("tie"), F.lit(cells)).cast("int").alias("cell"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows")
    starts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows")).select("shard", "cell", before.alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "tie")) - 1
    slots = placed.withColumn("nth", nth).join(starts, ["shard", "cell"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
