"""Byte-level BPE encoding and decoding by ranks, with a hierarchical-bitmap rank queue.

The pre-tokens of a batch that are not known yet are encoded together. Their bytes are one linked list with a gap between
pre-tokens. A pair of neighbours whose union has a rank is put into the bucket of that rank, which holds list positions;
two levels of bitmaps say which buckets hold any, and find-first-set gives the lowest rank. Entries whose pair has changed
meanwhile are stale and skipped. A bucket is merged at once, by arrays where it holds many positions, else one after
another from the left. Where the merged token could join into a lower rank than its own, a pre-token gives only its
leftmost position, as its next rank may then be lower. Each merge costs a few operations, however long the pre-token.

What the last batch's pre-tokens became is remembered for the next one, and forgotten when a task ends. A text of over
LONG characters is split and encoded in parts of PART pre-tokens.

Defined results: a null text is empty; an empty text has no ids, and both hashes are those of no bytes. Rows that repeat
are encoded apart. A null doc_id is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgetting, slices

LONG, PART = 1 << 20, 100_000
#: From so many positions on, a bucket is merged by arrays.
MANY = 24


class ByteBpe:
    """ids of pre-tokens and texts. Made of a rank file's bytes: base64 of a token and its rank on each line."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.split = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.spelled = {str(rank): token for rank, token in self.bytes_of.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.size = max(self.bytes_of) + 1
        self.union: dict[int, int] = {}  # by left * size + right
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.union[a * self.size + b] = rank
        self.pairs = np.array(sorted(self.union), dtype=np.int64)
        self.joined = np.array([self.union[x] for x in self.pairs.tolist()], dtype=np.int32)
        self.single_pairs = self._looked_up(self.single.astype(np.int64).repeat(256) * self.size + np.tile(self.single, 256))
        # ranks whose token may join with a neighbour into a lower rank
        left, right = self.pairs // self.size, self.pairs % self.size
        self.sinking = {*np.maximum(left, right)[self.joined < np.maximum(left, right)].tolist()}
        self.shift = max(4, (self.size.bit_length() + 1) // 2)
        self.bit = [1 << i for i in range(max(1 << self.shift, (self.size >> self.shift) + 1))]
        self.kept: dict[str, str] = {}

    def _looked_up(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        if not len(self.pairs):
            return np.full(len(keys), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined[at], np.int32(-1))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the pieces (none empty), and where each piece's ids end."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n, ends = len(flat), np.cumsum([len(x) for x in pieces])
        held = [array("i", bytes(4 * n)) for _ in range(4)]  # lists for steps of one position, arrays for steps of many
        ids, after, before, wanted = held
        ids_, after_, before_, wanted_ = (np.frombuffer(x, dtype=np.int32) for x in held)
        ids_[:] = self.single[flat]
        after_[:] = np.arange(1, n + 1)
        before_[:] = np.arange(-1, n - 1)
        wanted_[:-1] = self.single_pairs[flat[:-1].astype(np.int32) << 8 | flat[1:]]
        after_[ends - 1] = wanted_[ends - 1] = -1
        before_[ends[:-1]] = -1
        owner = None

        # the rank queue: a bitmap of words, words of bits for ranks, and by rank the positions
        shift, bit, size, union = self.shift, self.bit, self.size, self.union.get
        mask, words, top = (1 << shift) - 1, [0] * ((size >> shift) + 1), 0
        found = np.flatnonzero(wanted_ >= 0)
        found = found[np.argsort(wanted_[found], kind="stable")]
        ranks, starts = np.unique(wanted_[found], return_index=True)
        first = dict(zip(ranks.tolist(), np.split(found, starts[1:]), strict=True)) if len(found) else {}
        grown: dict[int, list[int]] = {}
        heaps: dict[int, list[int]] = {}
        for rank in first:
            words[rank >> shift] |= bit[rank & mask]
            top |= bit[rank >> shift]

        fresh: list[tuple[int, int]] = []
        while True:
            for rank, i in fresh:
                heap = heaps.get(rank)
                if heap is not None:
                    heappush(heap, i)
                    continue
                bucket = grown.get(rank)
                if bucket is None:
                    grown[rank] = [i]
                    words[rank >> shift] |= bit[rank & mask]
                    top |= bit[rank >> shift]
                else:
                    bucket.append(i)
            fresh = []
            if not top:
                break
            word = (top & -top).bit_length() - 1
            lowest = words[word] & -words[word]
            rank = word << shift | lowest.bit_length() - 1
            heap = heaps.get(rank)
            if heap is not None:
                places = [heappop(heap)]
            else:
                places = grown.pop(rank, None)
                begun = first.pop(rank, None)
                if begun is not None:
                    places = begun.tolist() + (places or [])
                places = [i for i in {*places} if wanted[i] == rank]
                places.sort()
                if len(places) > 1 and rank in self.sinking:
                    if owner is None:
                        owner = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0))
                    if len(np.unique(owner[places])) < len(places):
                        heaps[rank] = heap = places
                        places = [heappop(heap)]
            if not heap:
                heaps.pop(rank, None)
                words[word] ^= lowest
                if not words[word]:
                    top ^= bit[word]
            if len(places) >= MANY:
                at = np.array(places, dtype=np.int32)
                gone = after_[at]
                if not (wanted_[gone] == rank).any():  # no two of them overlap
                    right = after_[gone]
                    ids_[at], after_[at], ids_[gone], wanted_[gone] = rank, right, -1, -1
                    ends_here = right < 0
                    before_[right[~ends_here]] = at[~ends_here]
                    new = self._looked_up(rank * size + ids_[right].astype(np.int64))
                    new[ends_here] = -1
                    wanted_[at] = new
                    left = before_[at]
                    left = left[left >= 0]
                    new_left = self._looked_up(ids_[left].astype(np.int64) * size + rank)
                    wanted_[left] = new_left
                    fresh = [*zip(new[new >= 0].tolist(), at[new >= 0].tolist(), strict=True), *zip(new_left[new_left >= 0].tolist(), left[new_left >= 0].tolist(), strict=True)]
                    continue
            for i in places:
                if wanted[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[i] = after[j]
                ids[i], ids[j], wanted[j] = rank, -1, -1
                new = -1
                if k >= 0:
                    before[k] = i
                    new = union(rank * size + ids[k], -1)
                    if new >= 0:
                        fresh.append((new, i))
                wanted[i] = new
                h = before[i]
                if h >= 0:
                    new = wanted[h] = union(ids[h] * size + rank, -1)
                    if new >= 0:
                        fresh.append((new, h))
        alive = ids_ >= 0
        return ids_[alive], np.cumsum(alive)[ends - 1]

    def learned(self, pieces: Iterable[str]) -> dict[str, str]:
        """The ids in decimal of each of the pieces; they are what is kept."""
        kept = {x: self.kept[x] for x in pieces if x in self.kept}
        rest = []
        for x in pieces:
            if x not in kept:
                as_bytes = x.encode("utf-8", "replace")
                whole = self.ranks.get(as_bytes)
                if whole is None:
                    rest.append((x, as_bytes))
                else:
                    kept[x] = str(whole)
        if rest:
            ids, ends = self.merged([x for _, x in rest])
            names, start = [*map(str, ids.tolist())], 0
            for (x, _), end in zip(rest, ends.tolist(), strict=True):
                kept[x] = " ".join(names[start:end])
                start = end
        self.kept = kept
        return kept

    def encode_all(self, texts: list[str]) -> Iterator[list[str]]:
        """Of each text its ids in decimal, joined by spaces; of a long one in several parts."""
        split = [self.split.findall(x) if len(x) <= LONG else None for x in texts]
        distinct: set[str] = set()
        for x in split:
            distinct.update(x or ())
        known = self.learned(distinct).__getitem__
        for text, pieces in zip(texts, split, strict=True):
            yield [" ".join(map(known, pieces))] if pieces is not None else self._in_parts(text)

    def _in_parts(self, text: str) -> Iterator[str]:
        matches = self.split.finditer(text)
        while pieces := [m.group() for m in islice(matches, PART)]:
            yield " ".join(map(self.learned({*pieces}).__getitem__, pieces))

    def encode(self, text: str) -> str:
        return " ".join(next(self.encode_all([text])))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.split()))


_made: dict[int, ByteBpe] = {}


class _Cache:
    """What a task forgets at its end."""

    @staticmethod
    def clear() -> None:
        for bpe in _made.values():
            bpe.kept = {}


def _bpe(rank_file: bytes, pattern: str) -> ByteBpe:
    key = hash((rank_file, pattern))
    if key not in _made:
        _made.clear()
        _made[key] = ByteBpe(rank_file, pattern)
    return _made[key]


def _run(docs: DataFrame, rank_path: str, pattern: str, columns: list[tuple[str, str, pa.DataType]], read: Callable[[ByteBpe, list[str]], Iterable[tuple]], id_col: str, text_col: str, batch_bytes: int = 2 << 20) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value, pattern)
        for batch in slices(batches, "text", batch_bytes):
            texts = [x.as_py() or "" for x in batch.column("text")]
            found = list(zip(*read(bpe, texts), strict=True)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), kind) for x, (_, _, kind) in zip(found, columns, strict=True))], names=["doc_id", *(c for c, _, _ in columns)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(forgetting(run, lambda: _Cache), ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *(f"{c} {kind}" for c, kind, _ in columns)]))


def encode(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row of docs."""

    def read(bpe: ByteBpe, texts: list[str]) -> Iterator[tuple]:
        for parts in bpe.encode_all(texts):
            yield (np.concatenate([np.array(x.split(), dtype=np.int32) for x in parts] or [np.empty(0, np.int32)]),)

    return _run(docs, rank_path, pattern, [("ids", "array<int>", pa.list_(pa.int32()))], read, id_col, text_col)


def decode(encoded: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (bytes) of each row of encoded, the form that encode() gives."""
    joined = encoded.select(F.col(id_col).alias("doc_id"), F.array_join(F.col(ids_col).cast("array<string>"), " ").alias("ids"))
    return _run(joined, rank_path, pattern, [("decoded", "binary", pa.binary())], lambda bpe, texts: [(bpe.decode(x),) for x in texts], "doc_id", "ids")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids in decimal and of what they decode to, in one pass over the texts.

    batch_bytes: about so much text is encoded at once; more takes less time (a pre-token is encoded once a batch) and more memory.
    """

    def read(bpe: ByteBpe, texts: list[str]) -> Iterator[tuple]:
        for parts in bpe.encode_all(texts):
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for ids in parts:
                of_ids.update((f" {ids}" if n else ids).encode())
                n += ids.count(" ") + 1 if ids else 0
                of_text.update(bpe.decode(ids))
            yield n, of_ids.hexdigest(), of_text.hexdigest()

    columns = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _run(docs, rank_path, pattern, columns, read, id_col, text_col, batch_bytes)
