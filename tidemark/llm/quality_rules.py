"""Quality rules: base counts, and lines labelled as content or boilerplate by a linear-chain conditional random field.

The field has two states, content and boilerplate, weights for what a line looks like and for each step from state to
state. It is fitted to documents whose quality is known. At most `most_labelled` of each kind, those with the least hash
of their id, give windows of WINDOW lines; at most `most_windows` of each kind, those with the least hash, are all that
reaches the driver. There lines of good documents count as content, of bad ones as boilerplate, and the windows are used
as they are and joined: runs of RUNS lines from a good one and a bad one take turns, so the steps between states are
learned as well. Viterbi decoding labels each document's lines together. A document stays if it passes the base rules and
at least `share` of its words lie in content lines.

Defined results: a null text has no words and fails. A text without a line that has a word has a content share of 0.
Without labels of both kinds no field can be fitted: all lines then count as content. Rows that repeat are judged apart.
A null doc_id is kept. Of repeated or null labels the worst counts, null ones none. Where an id repeats in docs, each of its
windows is taken once (the least). An empty table gives an empty result. Only the id and text columns are read, and
with keep_columns all columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, forgetting, slices

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS, ENDS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".?!:;\"')"
FEATURES, WINDOW = 11, 32
#: Lines of one kind in turn, where windows are joined to sequences that change state.
RUNS = (4, 1, 7, 2, 10, 3, 5)
BASE = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()


def _cache() -> dict:
    return _words


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    windows = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    often = times[where] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += not not line.strip(b" \t\n\r\x0b\x0c")
        else:
            seen.add(line)
    return len(words), len(joined.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeated_words(words)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line that has a word, and the number of its words."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        upper = size - len(line.translate(None, UPPER))
        lower = size - len(line.translate(None, LOWER))
        rows.append((
            1.0, min(n, 64) / 64, n < 4, (size - len(line.translate(None, SYMBOLS))) / n, upper / (upper + lower + 1), line.count(b"!") / n, line.count(b"|") / n,
            (size - len(line.translate(None, DIGITS))) / size, len(set(words)) / n, words[-1][-1:] in ENDS, line in seen,
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES), np.array(sizes, dtype=np.int64)


@dataclass
class Field:
    """emit: weights of the features for boilerplate against content; step[i, j]: from state i to state j (1: boilerplate)."""

    emit: np.ndarray
    step: np.ndarray

    def boilerplate(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: for each line whether the most probable sequence has it as boilerplate."""
        n = len(features)
        own = (features @ self.emit).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for i, x in enumerate(own):
            if i:
                from_a, from_b = b + s10 > a + s00, b + s11 > a + s01
                a, b = (b + s10 if from_a else a + s00), (b + s11 if from_b else a + s01)
                back.append((from_a, from_b))
            b += x
        state, states = b > a, [False] * n
        for i in range(n - 1, -1, -1):
            states[i] = state
            if i:
                state = back[i - 1][state]
        return np.array(states, dtype=bool)


def joined(good: np.ndarray, bad: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of two windows' lines, in runs that take turns, and each line's label."""
    rest, parts, labels, state = [good, bad], [], [], turn % 2
    while len(rest[0]) or len(rest[1]):
        size = RUNS[turn % len(RUNS)]
        parts.append(rest[state][:size])
        labels.append(np.full(len(parts[-1]), state))
        rest[state], state, turn = rest[state][size:], 1 - state, turn + 1
    return np.concatenate(parts), np.concatenate(labels)


def training_sequences(windows: list[tuple[np.ndarray, bool]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Windows (features, is_boilerplate) as they are and joined in pairs: features, labels of lines, kind of sequence."""
    good, bad = [x for x, b in windows if not b], [x for x, b in windows if b]
    plain = [(x, np.full(len(x), int(b)), int(b)) for x, b in windows]
    return plain + [(*joined(good[i % len(good)], bad[i % len(bad)], i), 2) for i in range(max(len(good), len(bad)))]


def fit_field(windows: list[tuple[np.ndarray, bool]], rounds: int = 120, weight_decay: float = 1e-3) -> Field | None:
    """The field of highest likelihood, by gradient steps over all sequences at once; good, bad and joined ones weigh the same."""
    if len({bad for _, bad in windows}) < 2:
        return None
    sequences = training_sequences(windows)
    lengths = np.array([len(x) for x, _, _ in sequences])
    kind = np.array([k for _, _, k in sequences])
    weight = (1 / np.bincount(kind, weights=lengths, minlength=3))[kind]
    x = np.zeros((len(sequences), int(lengths.max()), FEATURES))
    label = np.zeros(x.shape[:2], dtype=int)
    for i, (features, labels, _) in enumerate(sequences):
        x[i, : len(features)] = features
        label[i, : len(labels)] = labels
    real = np.arange(x.shape[1])[None, :] < lengths[:, None]
    emit, step = np.zeros(FEATURES), np.zeros((2, 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, step)]
    norm = (weight * lengths).sum()
    seen = np.array([[(weight[:, None] * (real[:, 1:] & (label[:, :-1] == i) & (label[:, 1:] == j))).sum() for j in range(2)] for i in range(2)])
    ahead_real = real.T[1:, :, None]
    for turn in range(1, rounds + 1):
        # forward and backward by line, each normalised: probabilities of the states given the lines before and after
        odds = np.clip(x @ emit, -30, 30).T
        own = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=-1)
        move = np.exp(step)
        forward, backward = np.empty_like(own), np.full_like(own, 0.5)
        forward[0] = own[0] / own[0].sum(axis=1, keepdims=True)
        for t in range(1, len(own)):
            now = (forward[t - 1] @ move) * own[t]
            forward[t] = np.where(ahead_real[t - 1], now / now.sum(axis=1, keepdims=True), forward[t - 1])
        for t in range(len(own) - 2, -1, -1):
            now = (own[t + 1] * backward[t + 1]) @ move.T
            backward[t] = np.where(ahead_real[t], now / now.sum(axis=1, keepdims=True), 0.5)
        both = forward * backward
        bad = np.where(real, (both[:, :, 1] / both.sum(axis=2)).T, 0)
        d_emit = np.einsum("w,wtf->f", weight, x * (label - bad)[:, :, None]) / norm - weight_decay * emit
        pair = forward[:-1, :, :, None] * move * (own * backward)[1:, :, None, :]
        pair *= (ahead_real[:, :, 0] * weight / pair.sum(axis=(2, 3)))[:, :, None, None]
        d_step = (seen - pair.sum(axis=(0, 1))) / norm - weight_decay * step
        for p, d, (m, v) in zip((emit, step), (d_emit, d_step), moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(emit, step)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_labelled: int, most_windows: int = 2000) -> list[tuple[np.ndarray, bool]]:
    """Windows of the lines of at most most_labelled good and as many bad documents.

    Only ids are sorted; these are then few. A text leaves its task as windows of bounded size. Of each label at most
    most_windows windows, those with the least hash, come to the driver to be fitted.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    parts = [known.filter(F.col("bad") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled) for bad in (False, True)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "doc_id").select("doc_id", "text", "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            for i, x in enumerate(batch.column("text")):
                found = line_features(x.as_buffer().to_pybytes())[0]
                cut = [found[k : k + WINDOW].tobytes() for k in range(0, len(found), WINDOW)]
                whose = pa.array(np.full(len(cut), i))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whose), batch.column("bad").take(whose), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["doc_id", "bad", "nth", "features"])

    kinds = [rows.schema["doc_id"], T.StructField("bad", T.BooleanType()), T.StructField("nth", T.IntegerType()), T.StructField("features", T.BinaryType())]
    windows = durable(rows.mapInArrow(run, T.StructType(kinds)).groupBy("doc_id", "bad", "nth").agg(F.min("features").alias("features")))
    parts = [windows.filter(F.col("bad") == bad).orderBy(F.xxhash64("doc_id", "nth"), "doc_id", "nth").limit(most_windows) for bad in (False, True)]
    got = parts[0].unionByName(parts[1]).select("bad", F.xxhash64("doc_id", "nth").alias("place"), "features").toArrow()
    taken = sorted(zip(got.column("bad").to_pylist(), got.column("place").to_pylist(), got.column("features").to_pylist(), strict=True))
    return [(np.frombuffer(f, dtype=np.float64).reshape(-1, FEATURES), b) for b, _, f in taken]


def judged(text: bytes, field: Field | None, share: float) -> tuple:
    counts = base_counts(text)
    n, repeats = counts[0], counts[4]
    failed = n < 50 or 100 * repeats > 50 * n
    features, sizes = line_features(text)
    bad = field.boilerplate(features) if field is not None and len(features) else np.zeros(len(features), dtype=bool)
    content = int(sizes[~bad].sum()) / n if n else 0.0
    return (*counts, content, failed, not failed and content >= share)


def _added() -> list[tuple[str, pa.DataType]]:
    return [*BASE, ("content_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, most_labelled: int = 2000, keep_columns: bool = False) -> DataFrame:
    """doc_id, the base counts, content_share, base_failed and kept for each row of docs.

    keep_columns: instead the rows of docs that are kept, with docs' own columns.
    """
    field = fit_field(labelled_sample(docs, labels, id_col, text_col, most_labelled))
    rows = docs if keep_columns else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    added = _added()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 16 << 20):
            found = [judged(x.as_buffer().to_pybytes() if x.is_valid else b"", field, share) for x in batch.column(text_col)]
            if keep_columns:
                yield batch.filter(pa.array([x[-1] for x in found], pa.bool_()))
            else:
                columns = zip(*found, strict=True) if found else [()] * len(added)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, added, strict=True))], names=["doc_id", *(n for n, _ in added)])

    if keep_columns:
        return rows.mapInArrow(forgetting(run, _cache), docs.schema)
    kinds = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("content_share", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    return rows.mapInArrow(forgetting(run, _cache), T.StructType([rows.schema["doc_id"], *(T.StructField(n, k) for n, k in kinds)]))
