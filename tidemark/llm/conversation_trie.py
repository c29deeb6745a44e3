"""A prefix trie of conversations: which of them begin alike, how far, and what a store of shared prefixes would save.

1. Turns are numbered within their conversation by ranges; a conversation's prefix of d turns has as its digest the XOR of
   its turns' hashes, each of which holds the turn's place (two lanes of 64 bits, and d). XOR is a running value, so long
   conversations are spread over tasks.
2. The least conversation with a digest owns the prefix: it stands for the trie's node. Whoever owns a prefix owns all
   longer ones of its own, so each conversation's first owned depth is found by binary search: in each round all that are
   still open look up one depth, by two joins.
3. A conversation's owned depths are a chain, which hangs at the node before its first. Chains form a tree. Their sums go
   up by doubling: after round k a chain has what hangs up to 2 ** k below it, and knows its ancestor at that distance. So
   a chain of chains takes rounds by its logarithm, and sums reach hubs by partial sums.
4. Within a chain the sums run from its end, again in pieces.

Defined results: a null role or text is empty; turns are in order of their number, null first, and turns of equal number in
order of their SHA-256. Rows without a conversation's number belong to none and are left out. Rows that repeat are turns that
repeat. An empty table gives an empty trie. Texts are hashed whole. Other columns are not read, so they may have any names.
Two prefixes would be taken for one only if 128 bits of their hashes agreed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, placed, running

NODE = ["conv_id", "depth"]


def numbered(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0 on), size (the conversation's turns), said (a turn's digest) and points (code points of its text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(said).alias("said"), F.length(text).alias("points"))
    return placed(rows, ["conv_id"], ["turn", "said"]).select("conv_id", "place", "size", "said", "points")


def reopened(turns: DataFrame, given: Column, by: Column) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first turns replaced by as many of another's: its turns, and conversations with their lengths.

    given, by: for a conv_id, how many turns (a small number) and from which conversation; from one that has fewer all come, from
    one that doesn't exist none.
    """
    turns = durable(turns)
    own = durable(turns.filter("place = 0").select("conv_id", "size", given.alias("given"), by.alias("by")))
    sizes = own.select(F.col("conv_id").alias("by"), F.col("size").alias("there"))
    own = durable(own.join(sizes, "by", "left").select("conv_id", "by", "given", F.least("given", F.coalesce("there", F.lit(0))).alias("first"), "size"))
    most = own.agg(F.coalesce(F.max("first"), F.lit(0))).first()[0]
    openings = turns.filter(F.col("place") < most).select(F.col("conv_id").alias("by"), "place", "said", "points")
    openings = openings.join(own.select("conv_id", "by", "first"), "by").filter("place < first").select("conv_id", (F.col("place") + 1).alias("depth"), "said", "points")
    rest = turns.filter(F.col("place") >= given).join(own.select("conv_id", "given", "first"), "conv_id").select("conv_id", (F.col("place") - F.col("given") + F.col("first") + 1).alias("depth"), "said", "points")
    return openings.unionByName(rest), own.select("conv_id", (F.col("first") + F.greatest(F.col("size") - F.col("given"), F.lit(0))).alias("length"))


def _first_owned(lengths: DataFrame, prefixes: DataFrame, owners: DataFrame, root: int) -> DataFrame:
    """conv_id, length, first, up: the first depth that a conversation owns (one past its length, if none), and who owns the one before."""
    looked_up = lambda open_rows: open_rows.join(prefixes, NODE).join(owners.select("depth", "p1", "p2", "owner"), ["depth", "p1", "p2"])
    at_hand = durable(lengths.filter(F.col("conv_id") != root).select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high")))
    found = []
    while True:
        found.append(at_hand.filter("low = high").select("conv_id", "length", F.col("low").alias("first")))
        still = at_hand.filter("low < high")
        if not still.limit(1).count():
            break
        probed = looked_up(still.withColumn("depth", F.expr("(low + high) div 2")))
        owns = F.col("owner") == F.col("conv_id")
        at_hand = durable(probed.select("conv_id", "length", F.when(owns, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owns, F.col("depth")).otherwise(F.col("high")).alias("high")))
    firsts = found[0]
    for more in found[1:]:
        firsts = firsts.unionByName(more)
    ups = looked_up(firsts.filter("first > 1").withColumn("depth", F.col("first") - 1)).select("conv_id", "length", "first", F.col("owner").alias("up"))
    at_root = firsts.filter("first = 1").withColumn("up", F.lit(root))
    top = lengths.filter(F.col("conv_id") == root).select("conv_id", "length", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("up"))
    return durable(ups.unionByName(at_root).unionByName(top))


def _summed_up(chains: DataFrame, sums: list[str]) -> DataFrame:
    """chains (conv_id, up, sums) with all that hangs below added, by doubling."""
    state = durable(chains)
    while state.filter("up is not null").limit(1).count():
        below = state.filter("up is not null")
        added = below.groupBy("up").agg(*(F.sum(c).alias(f"_{c}") for c in sums)).withColumnRenamed("up", "conv_id")
        tops = F.col("next").isNotNull()
        further = below.select("conv_id", "up").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")).filter(tops), "up").select("conv_id", "next")
        joined = state.select("conv_id", *sums).join(added, "conv_id", "left").join(further, "conv_id", "left")
        state = durable(joined.select("conv_id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums)))
    return state


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's parts, which come one after another. A node's parts are never held together."""
    key, hasher, done = None, None, []

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": k[0], "depth": k[1], "ends_sha256": h} for k, h in done], schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if key == (conv, depth):
                hasher.update(b",")
            else:
                if key is not None:
                    done.append((key, hasher.hexdigest()))
                key, hasher = (conv, depth), hashlib.sha256()
            hasher.update(ids.encode())
        yield ended()
        done = []
    if key is not None:
        done.append((key, hasher.hexdigest()))
        yield ended()


def _ends(located: DataFrame, ids_in_part: int = 4096) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where conversations end: the hash of their numbers, ascending, with commas.

    Numbers are joined in parts by ranges of ids_in_part; one task hashes a node's parts one after another, in constant memory.
    """
    ends = located.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    parts = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / ids_in_part).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    parts = parts.select(F.col("owner").alias("conv_id"), "depth", "part", "ids").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return parts.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1 on), said, points. lengths: conv_id, length, also of conversations without turns.
    """
    lengths = durable(lengths)
    root, total = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    hashed = durable(turns.select("conv_id", "depth", (F.col("depth") - 1).alias("at"), F.xxhash64(F.lit(1), "depth", "said").alias("p1"), F.xxhash64(F.lit(2), "depth", "said").alias("p2"), F.col("points").cast("long").alias("points")))
    xor = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    prefixes = durable(running(hashed, ["conv_id"], "at", {"p1": xor, "p2": xor}).drop("at"))
    owners = durable(prefixes.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("points").alias("points")))
    located = _first_owned(lengths, prefixes.drop("points"), owners, -1 if root is None else root)

    top = lengths.filter(F.col("conv_id") == (root or 0)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("points"))
    nodes = owners.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "points").unionByName(top).withColumn("saved", (F.col("n_convs") - 1) * F.col("points"))
    chains = located.filter("first <= length")
    hung = chains.filter("up is not null").select(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("child"))
    at_end = hung.groupBy(*NODE).agg(F.count(F.lit(1)).alias("hanging")).withColumnRenamed("depth", "length")
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    below = _summed_up(chains.join(own, "conv_id").join(at_end, ["conv_id", "length"], "left").select("conv_id", "up", "saved", F.when(F.col("hanging").isNull(), 1).otherwise(0).cast("long").alias("leaves")), ["saved", "leaves"])

    hanging = hung.join(below.select(F.col("conv_id").alias("child"), "saved", "leaves"), "child").groupBy(*NODE).agg(F.count(F.lit(1)).alias("hanging"), F.sum("saved").alias("h_saved"), F.sum("leaves").alias("h_leaves"))
    nodes = nodes.join(chains, "conv_id").join(hanging, NODE, "left")
    n_hanging = F.coalesce("hanging", F.lit(0))
    last = F.col("depth") == F.col("length")
    nodes = nodes.select(
        *NODE, F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", (n_hanging + F.when(last, 0).otherwise(1)).alias("n_children"),
        (F.coalesce("h_leaves", F.lit(0)) + F.when(last & (n_hanging == 0), 1).otherwise(0)).alias("n_leaves"), (F.col("saved") + F.coalesce("h_saved", F.lit(0))).alias("saved_tokens"), (F.col("length") - F.col("depth")).alias("at"),
    )
    plus = (F.sum, lambda a, b: a + b)
    summed = running(durable(nodes), ["conv_id"], "at", {"n_leaves": plus, "saved_tokens": plus}).drop("at")
    return summed.join(_ends(located), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def shared_openings(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin with up to five turns of the first conversation of their hundred."""
    given, by = F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    return prefix_trie(*reopened(numbered(conversations), given, by))
