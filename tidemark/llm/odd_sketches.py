"""MinHash near-duplicates: bands of samples propose pairs, odd sketches of the same samples judge them, whole sets confirm.

1. Each text becomes its set of 64-bit shingle hashes; equal sets are one class.
2. Samples. A permutation cuts the hashes into buckets and takes each bucket's least, so one permutation of a large set
   gives all samples; small sets get fewer buckets and more permutations, so that a bucket has four hashes at least on average. How many
   depends on the power of two below the set's size. A set just below the next power is sampled in that way as well, so
   any two sets that may be similar have samples of one kind. P(samples agree) is the similarity, or more by buckets that both leave empty.
3. Bands of samples are hashed; classes with a band in common are a list.
4. Odd sketches. Each sample flips one bit of a bitmap. Where two bitmaps differ in k of n bits, some
   -n/4 ln(1 - 2k/n) of the samples differ. A pair that this puts `deviations` standard deviations below the threshold is
   dropped. So is one whose whole sets' parities differ in too many bits, which bounds how many hashes differ: small sets
   that lie just below the threshold end there. All others are compared by their whole sets.
5. In each list the one that has most lists in common with others is its head; each class is compared with the best head of its
   lists. In further rounds those that are not in a list's largest component of links are compared with another one of that; what
   is then in more than one component is compared across these, a pair once for all its lists. Components are exact, and no list of similar texts is expanded
   into its pairs.

With 288 samples in bands of 6, a pair at the threshold of 0.85 is in no list with a probability of 1e-10, and a pair above
it with less; an odd sketch drops it with less than that.

Defined results: a null or blank text has an empty set, is linked with nothing and is kept; its component_id is its own
doc_id. Repeated rows and equal texts link with each other. A null doc_id takes part in links, but is no component_id unless all
of the component are null; rows are kept by their number, so rows that repeat the least doc_id are all kept. An empty
table gives an empty result. Texts of any length are read whole. Other columns are not read, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forgetting, sized, slices
from .components import components
from .ngram_join import SKETCH, _cache, _verify_batches, parities, shingle_set

MIX = np.uint64(0xBF58476D1CE4E5B9)
EMPTY = np.uint64(2**64 - 1)
#: A bucket has so many hashes on average, at least.
FILL = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kinds(n: int, over: int, under: int) -> list[int]:
    """How a set of n hashes is sampled: by the power of two below n, and by the next one if a similar set may be so large."""
    own = n.bit_length() - 1
    return [own, own + 1] if n * under >= (over << (own + 1)) else [own]


def samples(tokens: np.ndarray, kind: int, count: int) -> np.ndarray:
    """The least hash of each bucket (EMPTY: none), count in all. Of the kind alone depends how many buckets there are."""
    buckets = max(1, min(count, (1 << kind) // FILL))
    passes = -(-count // buckets)
    seeds = _mixed(np.arange(1, passes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind))
    permuted = _mixed(tokens[None, :] ^ seeds[:, None])
    if buckets == 1:
        return permuted.min(axis=1)
    permuted.sort(axis=1)
    cells = ((permuted >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) + np.arange(passes)[:, None] * buckets
    flat, cells = permuted.ravel(), cells.ravel()
    wanted = np.arange(count)
    at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    return np.where(cells[at] == wanted, flat[at], EMPTY)


def odd_sketch(sampled: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits: whether an odd number of samples falls on each. A sample is its place and its value."""
    bits = _mixed(sampled ^ _mixed(np.arange(len(sampled), dtype=np.uint64))) >> np.uint64(32)
    odd = np.bincount((bits % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(sampled: np.ndarray, kind: int, rows: int) -> np.ndarray:
    grid = sampled.reshape(-1, rows)
    mixed = np.arange(len(grid), dtype=np.uint64) + np.uint64(kind << 32)
    for i in range(rows):
        mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
    return mixed.view(np.int64)


def most_bits(count: int, words: int, over: int, under: int, deviations: float) -> int:
    """In so many bits at most two sketches may differ that still can be similar.

    At the threshold the number of samples that differ is binomial; how many bits of so many flips stay odd varies besides.
    """
    t, n = over / under, 64 * words
    flips = 2 * count * (1 - t)
    middle = n / 2 * (1 - exp(-2 * flips / n))
    by_samples = 2 * exp(-2 * flips / n) * sqrt(count * t * (1 - t))
    by_flips = sqrt(n / 4 * (1 - exp(-4 * flips / n)))
    return ceil(middle + deviations * sqrt(by_samples**2 + by_flips**2))


def _described(width: int, count: int, rows: int, words: int, over: int, under: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            n, first, second, found, own, upper, full = [], [], [], [], [], [], []
            for x in batch.column("text"):
                tokens = shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", width)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                n.append(len(tokens))
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                taken = [(k, samples(tokens, k, count)) for k in kinds(len(tokens), over, under)] if len(tokens) else []
                found.append(np.concatenate([bands(s, k, rows) for k, s in taken]) if taken else None)
                own.append(odd_sketch(taken[0][1], words) if taken else None)
                upper.append(odd_sketch(taken[1][1], words) if len(taken) > 1 else None)
                full.append(parities(tokens) if taken else None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, own, upper, full)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), *lists], names=["doc_id", "text_hash", "n", "d1", "d2", "bands", "own", "upper", "full"])

    return run


def _tokens(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", width).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return run


def _may_link(x: str, y: str, words: int, most: int, over: int, under: int) -> Column:
    """Whether sizes and sketches of two rows (columns with these prefixes) allow a link."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    kind = lambda c: F.length(F.bin(c))  # noqa: E731  of two kinds the larger one judges
    left = F.when(kind(n) >= kind(m), F.col(f"{x}own")).otherwise(F.col(f"{x}upper"))
    right = F.when(kind(m) >= kind(n), F.col(f"{y}own")).otherwise(F.col(f"{y}upper"))
    differ = lambda a, b, count: sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(count)), F.lit(0))
    # two sets differ in as many hashes at least as bits of their own parities; for sets of up to some hundreds that is nearly all
    apart = differ(F.col(f"{x}full"), F.col(f"{y}full"), SKETCH) * (over + under) <= (n + m) * (under - over)
    return (n * under >= m * over) & (m * under >= n * over) & (differ(left, right, words) <= most) & apart


class _Confirmed:
    """Which pairs of classes are similar, by their whole sets. Sets are read from the texts once for each class that needs it."""

    def __init__(self, texts: DataFrame, keys: DataFrame, width: int, over: int, under: int, most_broadcast: int) -> None:
        self.texts, self.keys, self.width, self.over, self.under, self.most_broadcast = texts, keys, width, over, under, most_broadcast
        self.sets: DataFrame | None = None

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of pairs (a, b), which are stored."""
        size = pairs.count()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.sets is not None:
            ends = ends.join(self.sets.select("node"), "node", "left_anti")
        wanted = durable(sized(self.keys.join(ends, "node", "left_semi"), 2 * size))
        n = wanted.count()
        if n:
            chosen = F.broadcast(wanted) if n <= self.most_broadcast else wanted
            found = self.texts.join(chosen, (self.texts["text_hash"] == wanted["text_hash"]) & self.texts["doc_id"].eqNullSafe(wanted["own_id"])).select("node", "text")
            found = durable(found.mapInArrow(forgetting(_tokens(self.width), _cache), "node long, tokens binary").dropDuplicates(["node"]))  # a row that repeats is found again as often
            self.sets = found if self.sets is None else self.sets.unionByName(found)
        if self.sets is None:
            return pairs
        left, right = (self.sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in ("a", "b"))
        held = F.broadcast(pairs) if size <= self.most_broadcast else pairs
        return durable(held.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify_batches(self.over, self.under), "a long, b long"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links, which are followed between components only."""
    if labels is None:
        return durable(components(links))
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(between)
    fresh = moved.join(labels.select("node"), "node", "left_anti")
    further = labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
    return durable(further.select("node", F.coalesce("next", "component").alias("component")).unionByName(fresh))


def _split(lists: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """The rows of lists that are in more than one component, with their component and the list's main one, its largest."""
    named = sized(lists.join(labels, "node", "left"), size).select("sig", "node", "score", F.coalesce("component", "node").alias("component"))
    parts = sized(named.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("rows")), size)
    parts = sized(parts.groupBy("sig").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("rows", "component")).alias("main")), size)
    return durable(sized(named.join(parts.filter("parts > 1").drop("parts"), "sig"), size))


def _labels(lists: DataFrame, about: DataFrame, confirmed: Callable[[DataFrame], DataFrame], may_link: Callable[[str, str], Column], rounds: int, most_rest: int) -> DataFrame:
    """node, component of the classes in lists (sig, node) that are linked with another. about: node, n, sketches and bands."""
    sizes = lists.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    lists = durable(lists.join(sizes, "sig"))
    size = lists.count()
    # what has most in common with others is in the middle of them, so most of a group of copies is similar to it
    scores = sized(lists.groupBy("node").agg(F.sum("rows").alias("score")), size)
    lists = durable(sized(lists.drop("rows").join(scores, "node"), size))
    sides = lambda name: about.drop("bands").select(*(F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in about.columns if c != "bands"))
    best = F.struct("score", "node")
    at_hand = lists.join(sized(lists.groupBy("sig").agg(F.max_by("node", best).alias("main")), size), "sig").withColumn("component", F.col("node"))
    labels = tried = None
    for r in range(rounds):
        by = best if r == 0 else F.struct(F.xxhash64("node", "sig", F.lit(r)), F.col("node"))
        heads = sized(at_hand.filter("component = main").groupBy("sig").agg(F.max_by(F.struct("node", "score"), by).alias("head")), size)
        stars = sized(at_hand.filter("component <> main").join(heads, "sig"), size)
        # of the heads of its lists each is compared with one: the best, then any
        rank = F.struct("head.score", "head.node") if r == 0 else F.struct(F.xxhash64("node", "head.node", F.lit(r)), "head.node")
        stars = stars.groupBy("node").agg(F.max_by("head.node", rank).alias("head"))
        stars = sized(stars.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), size)
        stars = durable(stars if tried is None else sized(stars.join(tried, ["a", "b"], "left_anti"), size))
        near = durable(sized(stars.join(sides("a"), "a").join(sides("b"), "b").filter(may_link("a_", "b_")).select("a", "b"), size))
        tried = stars if tried is None else tried.unionByName(stars)
        labels = _merged(labels, confirmed(near))
        at_hand = _split(lists, labels, size)
        if not at_hand.limit(1).count():
            return labels
    # the main component of a list is compared with the rest of it, not with itself; a pair counts in the first list that both are in
    whole, rest = at_hand.drop("score").join(about, "node"), at_hand.filter("component <> main").drop("score").join(about, "node")
    x, y = (part.select(*(F.col(c).alias(f"{name}_{c}") for c in whole.columns)) for name, part in (("x", rest), ("y", whole)))
    if at_hand.filter("component <> main").count() <= most_rest:  # then rows of large lists stay where they are
        x = F.broadcast(x)
    apart = (F.col("x_sig") == F.col("y_sig")) & (F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("y_main")) | (F.col("x_node") < F.col("y_node")))
    first = F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("x_sig")
    across = x.join(y, apart & may_link("x_", "y_") & first).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    return _merged(labels, confirmed(durable(across.join(tried, ["a", "b"], "left_anti"))))


def minhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: tuple[int, int] = (85, 100), count: int = 288, rows: int = 6, words: int = 16, deviations: float = 7.0, rounds: int = 3, most_broadcast: int = 2_000_000, most_rest: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id is component_id).

    Two rows link when their common shingles are at least threshold of their united ones. count: samples of a set, a multiple
    of rows, which are a band's. words: of 64 bits in an odd sketch. deviations: how far below the threshold a sketch must
    put a pair to end it. rounds: in so many a list's members are compared with one of them each. most_broadcast: so many classes or pairs are found again by broadcast, more by a shuffle.
    most_rest: so many rows outside of their lists' largest components are compared across components by broadcast.
    """
    over, under = threshold
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    described = source.mapInArrow(forgetting(_described(width, count, rows, words, over, under), _cache), "doc_id long, text_hash long, n long, d1 long, d2 long, bands array<long>, own array<long>, upper array<long>, full array<long>")
    described = durable(described.withColumn("row", F.monotonically_increasing_id()))
    first = F.min_by(F.struct("doc_id", "text_hash", "n", "bands", "own", "upper", "full"), "row").alias("first")
    classes = durable(described.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), first))
    lists = classes.select("node", F.explode("first.bands").alias("sig"))
    about = classes.select("node", "first.n", "first.own", "first.upper", "first.full", "first.bands")
    keys = classes.select("node", "first.text_hash", F.col("first.doc_id").alias("own_id"))
    confirmed = _Confirmed(source, keys, width, over, under, most_broadcast)
    most = most_bits(count, words, over, under, deviations)
    labels = _labels(lists, about, confirmed, lambda x, y: _may_link(x, y, words, most, over, under), rounds, most_rest)

    named = classes.select("d1", "d2", "node", "least_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(ids, "component").select("d1", "d2", "component_id")
    out = described.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
