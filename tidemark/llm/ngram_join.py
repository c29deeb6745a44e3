"""Similarity self-join on word shingles, by prefixes of single tokens and of token combinations.

1. Each text becomes its set of 64-bit shingle hashes. Equal sets are one class, so exact copies cost nothing later.
2. Screen. Under one global order (the hash), a set that is similar to another one shares with it at least
   (q - 1/5) * 4/5 * n + 1 of the first q * n tokens. Tokens met in two classes are found by range of hash; a task sends
   each token once, whatever the number of its texts. Classes with too few shared tokens leave. The others are few.
3. Prefixes. Tokens are ordered rare first. Rare tokens are indexed alone, frequent ones in pairs and very frequent ones
   in triples within subclasses of the hash; the prefix is extended until no loss of the allowed number of tokens can
   remove every one of its combinations. So two similar sets share a combination, whatever the classes.
4. Verify. In each list of one combination all are compared with one member; after some rounds of this, lists in more
   than one component are compared across components, unless parity sketches prove two sets too different. Components
   are exact, though no list is expanded into all its pairs.

Defined results: a null or blank text has an empty set and is linked with nothing; its component_id is its own doc_id.
Repeated rows and equal texts link with each other. A null doc_id takes part in links, but never is a component_id
unless all of the component are null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forgetting, sized, slices
from .components import components

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F], dtype=np.uint64)
#: Classes of tokens: (least frequency as a multiple of `frequent`, tokens in a combination, tokens that a subclass shall have).
CLASSES = ((0, 1, 1), (1, 2, 4), (16, 3, 6))
SHORT = 8
#: Words of 64 bits in a set's parity sketch.
SKETCH = 16


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()


def _cache() -> dict:
    return _words


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of the whole sequence, if it has fewer words."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    mixed = hashes[: n - width + 1] * ODD[0]
    for k in range(1, width):
        mixed += hashes[k : n - width + 1 + k] * (ODD[k % 8] + np.uint64(2 * (k // 8)))
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def _sets(width: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            n, first, second, prefix = [], [], [], []
            for x in batch.column("text"):
                tokens = shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", width)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                n.append(len(tokens))
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                prefix.append(tokens[: min(len(tokens), ceil(share * len(tokens)) + 1)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _binaries(prefix)], names=["doc_id", "text_hash", "n", "d1", "d2", "prefix"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All the tokens of a binary column, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) if x.is_valid else np.empty(0, np.uint64) for x in column]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(x) for x in parts], dtype=np.int64)


def _ranges(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _groups(tokens: int) -> int:
    """So many ranges of hashes that one task's group holds about a million tokens, 64 at least."""
    return int(max(64, min(1 << 22, tokens // 1_000_000)))


def _screened(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each batch and range of tokens: each token once, with its class, or with class 0 if two classes here have it.

    The rows of ranges below 0 are classes, dealt by their hash to as many groups, and the number of their tokens that two
    classes of the batch have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = _flat(batch.column("prefix"))
            nodes = np.repeat(batch.column("d1").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            if not len(tokens):
                continue
            order = np.lexsort((nodes, tokens))
            tokens, nodes = tokens[order], nodes[order]
            fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
            tokens, nodes = tokens[fresh], nodes[fresh]
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            counts = np.diff(np.r_[starts, len(tokens)])
            here, times = np.unique(nodes[np.repeat(counts > 1, counts)], return_counts=True)
            out_range, out_tokens, out_nodes = [], [], []
            where = np.abs(here % ranges)
            by_range = np.argsort(where, kind="stable")
            for part in np.split(by_range, np.flatnonzero(np.diff(where[by_range])) + 1) if len(here) else []:
                out_range.append(-1 - int(where[part[0]]))
                out_tokens.append(times[part].astype(np.uint32).tobytes())
                out_nodes.append(here[part].tobytes())
            tokens, nodes = tokens[starts], np.where(counts > 1, 0, nodes[starts])
            cells = _ranges(tokens, ranges)
            full, begins = np.unique(cells, return_index=True)
            for r, a, b in zip(full.tolist(), begins.tolist(), [*begins[1:].tolist(), len(cells)], strict=True):
                # by class, so that a class's number compresses well beside its own neighbours
                by_node = np.argsort(nodes[a:b], kind="stable")
                out_range.append(r)
                out_tokens.append((tokens[a:b][by_node] >> np.uint64(8)).astype(np.uint32).tobytes())
                out_nodes.append(nodes[a:b][by_node].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_range, pa.int32()), _binaries(out_tokens), _binaries(out_nodes)], names=["range", "tokens", "nodes"])

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Classes of one range and how many of their tokens another class has as well."""
    if key[0].as_py() < 0:
        parts = [(np.frombuffer(n.as_buffer(), np.int64), np.frombuffer(t.as_buffer(), np.uint32)) for n, t in zip(table.column("nodes"), table.column("tokens"), strict=True)]
        classes, where = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        return pa.table({"d1": pa.array(classes), "shared": pa.array(np.bincount(where, weights=np.concatenate([x[1] for x in parts])).astype(np.int64))})
    tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("tokens")])
    nodes = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("nodes")])
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
    tokens, nodes = tokens[fresh], nodes[fresh]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    counts = np.diff(np.r_[starts, len(tokens)])
    flagged = np.bitwise_or.reduceat(nodes == 0, starts) | (counts > 1)
    classes, times = np.unique(nodes[np.repeat(flagged, counts) & (nodes != 0)], return_counts=True)
    return pa.table({"d1": pa.array(classes), "shared": pa.array(times.astype(np.int64))})


def parities(tokens: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits: whether a cell of the hash has an odd number of tokens. Two sets differ by at least as many tokens as bits."""
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketch_names() -> list[str]:
    return [f"k{i}" for i in range(SKETCH)]


def _token_arrays(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in batch.column("text")]
            words = np.array([parities(x) for x in sets], dtype=np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), _binaries([x.tobytes() for x in sets]), *(pa.array(words[:, i]) for i in range(SKETCH))], names=["node", "n", "tokens", *_sketch_names()])

    return run


def _counted(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokens' first 40 bits and counts, by batch and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, _ = _flat(batch.column("tokens"))
            if not len(tokens):
                continue
            tokens, counts = np.unique(tokens >> np.uint64(24), return_counts=True)
            full, begins = np.unique(_ranges(tokens << np.uint64(24), ranges), return_index=True)
            spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(tokens)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), _binaries([tokens[a:b].tobytes() for a, b in spans]), _binaries([counts[a:b].astype(np.uint32).tobytes() for a, b in spans])], names=["range", "tokens", "counts"])

    return run


def _frequent(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]).astype(np.int64)
        tokens, where = np.unique(tokens, return_inverse=True)
        counts = np.bincount(where, weights=counts).astype(np.int64)
        return pa.table({"token": pa.array(tokens[counts >= least].astype(np.int64)), "times": pa.array(counts[counts >= least])})

    return run


def signatures(tokens: np.ndarray, times: np.ndarray, frequent: int, threshold: tuple[int, int] = (4, 5)) -> set[int]:
    """The combinations by which a set is indexed. times: how often each token is known to occur (0: rarely)."""
    n, (over, under) = len(tokens), threshold
    errors = n - -(-n * over // under)
    kind = np.where(times >= 16 * frequent, 2, np.where(times >= frequent, 1, 0))
    order = np.lexsort((tokens, kind))
    ordered, kinds = tokens[order].tolist(), kind[order].tolist()
    found: set[int] = set()
    if n < SHORT:
        found.update(ordered)
    if n * over <= 3 * under:  # under four tokens must be shared: triples can't be asked for
        return found
    own = n.bit_length()  # a band holds sizes from 2 ** (own - 1) to below 2 ** own
    for band in {own, (n * under // over).bit_length()}:
        size = 0.3 * 2 ** (band - 1)
        parts = [max(1, int(size / wanted)) for _, _, wanted in CLASSES]
        held: dict[tuple[int, int], list[int]] = {}
        gained = 0
        for token, k in zip(ordered, kinds, strict=True):
            if k == 0:
                found.add(token)
                gained += 1
            else:
                group = held.setdefault((k, (token >> 8) % parts[k]), [])
                group.append(token)
                gained += len(group) >= CLASSES[k][1]
            if gained > errors:
                break
        for (k, _), group in held.items():
            for chosen in combinations(group, CLASSES[k][1]):
                found.add((sum(x * int(m) for x, m in zip(chosen, ODD.tolist(), strict=False)) + band) & (2**64 - 1))
    return found


def _postings(names: np.ndarray, times: np.ndarray, frequent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column("node").to_pylist(), batch.column("n").to_pylist()
            tokens, lengths = _flat(batch.column("tokens"))
            known = np.zeros(len(tokens), np.int64)
            if len(names):
                short = (tokens >> np.uint64(24)).astype(np.int64)
                at = np.minimum(np.searchsorted(names, short), len(names) - 1)
                known = np.where(names[at] == short, times[at], 0)
            ends = np.cumsum(lengths)
            for i, end in enumerate(ends):
                a = end - lengths[i]
                found = np.fromiter(signatures(tokens[a:end], known[a:end], frequent), dtype=np.uint64).view(np.int64)
                score = int(1000 * np.log2(1 + known[a:end]).mean()) if lengths[i] else 0
                columns = (nodes[i], sizes[i], score)
                yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.full(len(found), x)) for x in columns)], names=["sig", "node", "n", "score"])

    return run


def _merged(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same rows in larger batches."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wide


def _verify_batches(over: int, under: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
                keep.append(under * common >= over * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """The pairs (a, b) whose parity sketches don't prove them too different."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(k).alias(f"{k}_{name}") for k in _sketch_names()))
    differ = sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in _sketch_names()), F.lit(0))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(differ * (over + under) <= (F.col("n_a") + F.col("n_b")) * (under - over)).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, over: int, under: int, most_broadcast: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar. Inner joins of plain keys: Spark splits a key that many pairs have.

    Sketches come first, as they are small beside the tokens. Up to most_broadcast pairs are broadcast, so that only the
    tokens of sets that are left in a pair are shuffled, once.
    """
    pairs = durable(_near(pairs, sets, over, under))
    tokens = sets.select("node", "tokens")
    if pairs.count() <= most_broadcast:
        pairs = F.broadcast(pairs)
        tokens = tokens.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify_batches(over, under), "a long, b long")


def _verified(lists: DataFrame, sets: DataFrame, over: int, under: int, rounds: int, most_broadcast: int) -> DataFrame:
    """Links (a, b) that give the right components: in rounds each list's members are compared with one of them, the one
    whose tokens are the most frequent among those not yet taken, as the source of many copies is; what then is in more than
    one component is compared across components, where the sketches don't rule it out.
    """
    fits = lambda x, y: (x * under >= y * over) & (y * under >= x * over)
    many = lists.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("sig")
    lists = durable(lists.join(many, "sig"))
    size = lists.count()
    if not size:
        return lists.select(F.col("node").alias("a"), F.col("node").alias("b"))
    lists = sized(lists, size)
    at_hand = lists.withColumn("component", F.col("node"))
    last = None
    tried = links = None
    for _ in range(rounds):
        rank = F.struct("score", "node")
        if last is not None:
            at_hand = sized(at_hand.join(last, "sig", "left"), size)
        heads = at_hand.groupBy("sig").agg(F.max_by(F.struct("node", "n", "component", "score"), rank if last is None else F.when(F.col("last").isNull() | (rank < F.col("last")), rank)).alias("head"))
        heads = durable(sized(heads.filter("head is not null"), size))
        stars = sized(at_hand.join(heads, "sig"), size).filter(F.col("component") != F.col("head.component")).filter(fits(F.col("n"), F.col("head.n")))
        stars = stars.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        stars = durable(sized(stars, size) if tried is None else sized(sized(stars, size).join(tried, ["a", "b"], "left_anti"), size))
        new = durable(_linked(stars, sets, over, under, most_broadcast))
        tried = stars if tried is None else tried.unionByName(stars)
        links = sized(new if links is None else links.unionByName(new), size)
        last = heads.select("sig", F.struct(F.col("head.score").alias("score"), F.col("head.node").alias("node")).alias("last"))
        placed = sized(lists.join(components(links), "node", "left"), size).select("sig", "node", "n", "score", F.coalesce("component", "node").alias("component"))
        split = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("sig")
        at_hand = durable(sized(placed.join(sized(split, size), "sig"), size))
        if not at_hand.limit(1).count():  # no list is in more than one component
            return links
    # the largest component of a list is compared with the rest of it, not with itself
    main = sized(at_hand.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("sig").agg(F.max_by("component", F.struct("size", "component")).alias("main")), size)
    whole = sized(at_hand.drop("score").join(main, "sig"), size).join(sets.select("node", *_sketch_names()), "node")
    rest = whole.filter("component <> main")
    x, y = rest.select(*(F.col(c).alias(f"x_{c}") for c in rest.columns)), whole.select(*(F.col(c).alias(f"y_{c}") for c in whole.columns))
    differ = sum((F.bit_count(F.col(f"x_{k}").bitwiseXOR(F.col(f"y_{k}"))) for k in _sketch_names()), F.lit(0))
    near = (F.col("x_sig") == F.col("y_sig")) & (F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("y_main")) | (F.col("x_node") < F.col("y_node")))
    near &= fits(F.col("x_n"), F.col("y_n")) & (differ * (over + under) <= (F.col("x_n") + F.col("y_n")) * (under - over))
    across = x.join(y, near).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    across = durable(across.join(tried, ["a", "b"], "left_anti"))
    return links.unionByName(durable(_linked(across, sets, over, under, most_broadcast)))


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, screen: float = 0.3, frequent: int = 16, most_frequent: int = 400_000, most_broadcast: int = 2_000_000, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, first (one row of each component has it true), text_hash.

    Two rows link when 5 times their common shingles are at least 4 times their united ones.
    screen: the share of its tokens that a class is screened by. frequent: from this many classes on, a token is indexed
    in combinations; it is doubled until most_frequent tokens at most are so, which are then broadcast.
    most_broadcast: up to so many texts that pass the screen are found again by broadcast, and so many pairs of them join
    their tokens by broadcast; more by a shuffle.
    rounds: in so many rounds a list's members are compared with one of them each.
    """
    over, under = 4, 5
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = durable(
        source.mapInArrow(forgetting(_sets(width, screen), _cache), "doc_id long, text_hash long, n long, d1 long, d2 long, prefix binary").withColumn("row", F.monotonically_increasing_id())
    )
    total = rows.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 8
    ranges = _groups(total)

    shared = rows.select("d1", "prefix").mapInArrow(_screened(ranges), "range int, tokens binary, nodes binary")
    shared = shared.groupBy("range").applyInArrow(_shared, "d1 long, shared long").groupBy("d1").agg(F.sum("shared").alias("shared"))
    classes = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.min_by("text_hash", "row").alias("text_hash"), F.min_by("doc_id", "row").alias("doc_id"), F.first("n").alias("n"))
    needed = F.greatest(F.lit(1), F.floor((F.lit(screen) - 0.2) * 0.8 * F.col("n") + 1 - 1e-6))
    classes = durable(classes.join(shared, "d1", "left").withColumn("alive", F.coalesce(F.col("shared"), F.lit(0)) >= needed).select("d1", "d2", "node", "least_id", "text_hash", "doc_id", "n", "alive"))
    alive = classes.filter("alive").select("node", F.col("text_hash"), F.col("doc_id").alias("own_id"), "n")
    count, tokens = alive.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    chosen = F.broadcast(alive) if count <= most_broadcast else alive
    texts = source.join(chosen, (source["text_hash"] == alive["text_hash"]) & source["doc_id"].eqNullSafe(alive["own_id"])).select("node", "n", "text")
    sets = durable(texts.mapInArrow(forgetting(_token_arrays(width), _cache), f"node long, n long, tokens binary, {', '.join(f'{k} long' for k in _sketch_names())}"))
    if sets.groupBy("node").count().filter("count > 1").limit(1).count():  # a row that repeats is found again as often
        sets = durable(sets.dropDuplicates(["node"]))

    known = durable(sets.select("tokens").mapInArrow(_counted(_groups(tokens)), "range int, tokens binary, counts binary").groupBy("range").applyInArrow(_frequent(frequent), "token long, times long"))
    sizes = known.groupBy(F.floor(F.log2("times")).alias("power")).count().collect()
    while sum(x["count"] for x in sizes if 2 ** x["power"] >= frequent) > most_frequent:
        frequent *= 2
    chosen_tokens = known.filter(F.col("times") >= frequent).orderBy("token").toArrow()
    names, times = chosen_tokens.column("token").to_numpy(), chosen_tokens.column("times").to_numpy()

    lists = durable(sets.select("node", "n", "tokens").mapInArrow(_merged(_postings(names, times, frequent)), "sig long, node long, n long, score long"))
    links = _verified(lists, sets, over, under, rounds, most_broadcast)
    labels = components(links)

    named = classes.select("d1", "d2", "node", "least_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names_of = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("node").alias("first_node"), F.min(F.struct(F.col("least_id").isNull(), F.col("least_id"), F.col("node"))).alias("best"))
    named = durable(named.join(names_of, "component").select("d1", "d2", "component_id", F.col("best.node").alias("best")))
    joined = rows.select("row", "doc_id", "text_hash", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    chosen_row = joined.filter("best is not null").groupBy("best").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("least")).select(F.col("least.row").alias("row"), F.lit(True).alias("is_first"))
    out = joined.join(chosen_row, "row", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce(F.col("is_first"), F.col("n") == 0).alias("first"), "text_hash")
