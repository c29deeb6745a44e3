"""A Merkle manifest of a table: a hash tree over the rows of each group, one over the groups, and a proof for each row.

1. A row's leaf is the SHA-256 of its named columns, each `-` if null, else its length in bytes, `:` and its value.
2. Bottom up: the nodes of a level are numbered within their group; every `arity` consecutive ones are a run, whose hash is
   a node of the next level, until one node is left, the group's subroot. Subroots are the leaves of a second tree, in the
   order of their groups. Each level is stored as its runs, with the digests of their nodes.
3. Top down: the root's proof is empty. Each level's runs join the nodes that they hash to; a node's proof is its siblings
   before that of its parent. Runs and nodes are one to one, so a group of any size is spread like any other.

A proof is a list of steps (what stands before a digest and after it); `folded` gives the root that follows from a leaf and
a proof.

Defined results: an empty table has no leaves and no proofs. Nulls may stand in any column; a null group comes first and is
a group like others, a null order comes first in its group. Rows of equal order stand in the order of their leaves, and rows
that repeat altogether next to each other, each with the proof of its own place. Texts of any length are hashed whole. Only
the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, placed


@dataclass
class Manifest:
    """levels: runs of each level of the groups' trees, then of the tree over groups (key, run, size, nodes), bottom up.

    proofs: a row for each row of the table: its order and group columns, leaf, subroot, root, proof, and what it carries.
    """

    levels: list[DataFrame]
    proofs: DataFrame


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values, of which none can run into the next."""
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return digest(F.concat(*fields))


def folded(of: Column, proof: Column) -> Column:
    """The root that a leaf leads to by its proof."""
    return F.aggregate(proof, of, lambda so_far, step: digest(F.concat(step["before"], so_far, step["after"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's level up, in one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def ascii_lower(text: Column) -> Column:
    """text with A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _of_run(nodes: Column) -> Column:
    return digest(F.array_join(F.transform(nodes, lambda x: x["node"]["digest"]), ""))


def _top(size: Column, nodes: Column) -> Column:
    """A lone node is its group's top itself."""
    return F.when(size == 1, nodes[0]["node"]["digest"]).otherwise(_of_run(nodes))


def _grown(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Levels of the trees of all keys, from nodes (key, place, size, node). A level has no runs of keys whose top was reached."""
    levels: list[DataFrame] = []
    nodes, most = leaves, leaves.agg(F.max("size")).first()[0] or 0
    while not levels or most > 1:
        runs = nodes.groupBy("key", F.floor(F.col("place") / arity).alias("run")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct(F.pmod("place", F.lit(arity)).alias("at"), "node"))).alias("nodes"))
        levels.append(durable(runs))
        nodes = levels[-1].filter(F.col("size") > arity).select("key", F.col("run").alias("place"), F.ceil(F.col("size") / arity).alias("size"), F.struct(_of_run(F.col("nodes")).alias("digest")).alias("node"))
        most = -(-most // arity)
    return levels


def _tops(levels: list[DataFrame], arity: int) -> DataFrame:
    """key, digest: of each key's last run."""
    last = [runs.filter(F.col("size") <= arity).select("key", _top(F.col("size"), F.col("nodes")).alias("digest")) for runs in levels]
    whole = last[0]
    for more in last[1:]:
        whole = whole.unionByName(more)
    return whole


def _pushed(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """key, node, proof, above: of each node of the lowest level. tops: key, proof and above, which its nodes inherit."""
    nodes = None
    for runs in reversed(levels):
        parents = runs.filter(F.col("size") <= arity).join(tops, "key")
        if nodes is not None:
            parents = parents.unionByName(runs.filter(F.col("size") > arity).join(nodes.select("key", F.col("place").alias("run"), "proof", "above"), ["key", "run"]))
        digests = F.transform("nodes", lambda x: x["node"]["digest"])
        opened = parents.withColumn("digests", digests).select("*", F.posexplode("nodes").alias("nth", "child"))
        step = F.struct(F.array_join(F.slice("digests", F.lit(1), F.col("nth")), "").alias("before"), F.array_join(F.slice("digests", F.col("nth") + 2, F.lit(arity)), "").alias("after"))
        proof = F.when(F.col("size") == 1, F.col("proof")).otherwise(F.concat(F.array(step), F.col("proof")))
        nodes = opened.select("key", (F.col("run") * arity + F.col("nth")).alias("place"), F.col("child.node").alias("node"), proof.alias("proof"), "above")
    return nodes


def merkle_manifest(docs: DataFrame, *, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", order_col: str = "doc_id", arity: int = 16, carry: dict[str, Column] | None = None) -> Manifest:
    """The levels and proofs of docs. carry: values of a row that its proof shall have beside it; order and group come by themselves.

    A group's key is a text in which null comes before all others.
    """
    key = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    read = docs.select(key.alias("key"), F.col(order_col).alias("by"), leaf([F.col(c) for c in columns]).alias("digest"), F.struct(F.col(group_col).alias("group"), *(c.alias(n) for n, c in (carry or {}).items()), F.lit(0).alias("end")).alias("own"))
    rows = placed(read, ["key"], ["by", "digest"]).select("key", "place", "size", F.struct("digest", "by", "own").alias("node"))
    levels = _grown(rows, arity)
    subroots = placed(_tops(levels, arity).withColumnRenamed("key", "name").withColumn("key", F.lit("")), ["key"], ["name"])
    upper = _grown(subroots.select("key", "place", "size", F.struct("digest", "name").alias("node")), arity)
    root = _tops(upper, arity).withColumnRenamed("digest", "above")
    empty_proof = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    groups = _pushed(upper, root.withColumn("proof", empty_proof), arity)
    groups = groups.select(F.col("node.name").alias("key"), "proof", F.struct(F.col("node.digest").alias("subroot"), F.col("above").alias("root")).alias("above"))
    found = _pushed(levels, groups, arity)
    proofs = found.select(F.col("node.by").alias(order_col), F.col("node.own.group").alias(group_col), F.col("node.digest").alias("leaf"), "above.subroot", "above.root", "proof", *(F.col(f"node.own.`{n}`").alias(n) for n in carry or {}))
    return Manifest([*levels, *upper], proofs)


def audited(docs: DataFrame, *, tampered_each: int = 5) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The audit lower-cases A-Z in the texts of documents whose number's CRC-32 is divisible by tampered_each, and folds each
    document's leaf with the proof made before. A document without doc_id or text is not changed by that.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % tampered_each == 0
    values = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = F.when(hit & F.col("text").isNotNull(), leaf(list((values | {"text": ascii_lower(F.col("text"))}).values())))
    found = merkle_manifest(docs, columns=list(values), carry={"changed": changed}).proofs
    out = found.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
