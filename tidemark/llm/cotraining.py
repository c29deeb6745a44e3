"""Quality classifier by co-training of a text view and a metadata view.

The text view sees what a text is made of (kinds of characters, repeated words, line shapes, hashed words); the metadata
view sees source, language and the stated number of characters, and nothing of the text. Each view has a logistic regression. Both begin with the labelled documents of the
training fold. In each round each view scores a pool of unlabelled ones; what it is sure of becomes a pseudo-label for
the other view. In the end each view's scores are calibrated on the held-out fold (a logistic regression of one number),
and a document's log odds are the sum of both calibrated ones less the prior's, which counts the prior once.

Only the models are fitted on samples: at most `most_labelled` labelled and `most_pool` unlabelled documents, those with
the least hash of their id. Every document is scored, in one pass over the texts.

Defined results: a null or empty text has features of zero and is scored by them. Null source, language or number of characters is a
value of its own, as is a table without such a number. Of repeated labels of one id the lowest counts; null labels and ids count as unlabelled. Without labels of both
kinds nothing can be learned: every score is then the share of good labels, or 0.5 without any. Rows that repeat get the
same score. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forgetting, slices

WORDS, SOURCES, LANGS = 64, 32, 8
UPPER, LOWER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\r\x0b\x0c"
SYMBOLS, PUNCTUATION = b"#*$%&|<>", b".,;:"


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % WORDS
        return value


_buckets = _Buckets()


def _cache() -> dict:
    return _buckets


def text_view(text: bytes) -> list[float]:
    size, words = len(text), text.split()
    n = len(words)
    if not n:
        return [0.0] * (12 + WORDS)
    without = lambda chars: (size - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    shape = [
        without(UPPER), without(LOWER), without(DIGITS), without(SYMBOLS) * 4, without(PUNCTUATION) * 4, min(1.0, text.count(b"!") / n), min(1.0, text.count(b"|") / n),
        len(set(words)) / n, min(2.0, (size / n) / 10), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
    ]
    hashed = np.bincount(np.fromiter(map(_buckets.__getitem__, words), dtype=np.int64, count=n), minlength=WORDS) / n
    return [*shape, *np.sqrt(hashed).tolist()]


def meta_view(chars: int | None, source: str | None, lang: str | None) -> list[float]:
    place = lambda x, n: 0 if x is None else 1 + xxhash.xxh3_64_intdigest(x.encode()) % (n - 1)
    one = [0.0] * (SOURCES + LANGS + 3)
    one[place(source, SOURCES)] = 1.0
    one[SOURCES + place(lang, LANGS)] = 1.0
    known = max(chars or 0, 0)
    one[-3:] = [float(chars is None), float(np.log1p(known)) / 12, float(known < 300)]
    return one


@dataclass
class View:
    """A logistic regression and its calibration: log odds = scale * (weights . features + bias) + offset."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        return self.scale * (features @ self.weights + self.bias) + self.offset


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        odds = self.text.log_odds(text) + self.meta.log_odds(meta) - self.prior
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 16 << 20):
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text")]
        meta = [meta_view(*x) for x in zip(batch.column("chars").to_pylist(), batch.column("source").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("fold"), pa.array([text_view(t) for t in texts], kind), pa.array(meta, kind)], names=["doc_id", "quality", "fold", "text", "meta"])


def _fit(rows: DataFrame, view: str, regularisation: float = 1e-3) -> View:
    data = rows.select(array_to_vector(view).alias("features"), F.col("quality").cast("double").alias("label"))
    model = LogisticRegression(regParam=regularisation, maxIter=40, standardization=True).fit(data)
    return View(np.array(model.coefficients.toArray()), float(model.intercept))


def _odds(view: View, column: str):
    """The raw log odds as an expression."""
    weights = F.array(*(F.lit(float(w)) for w in view.weights))
    return F.aggregate(F.zip_with(F.col(column), weights, lambda x, w: x * w), F.lit(float(view.bias)), lambda total, x: total + x)


def _calibrated(view: View, held_out: DataFrame, column: str) -> View:
    data = held_out.select(F.array(_odds(view, column)).alias("odds"), "quality")
    fitted = _fit(data, "odds", 1e-2)
    return View(view.weights, view.bias, float(fitted.weights[0]), fitted.bias)


def _both(fit: Callable[[str], View]) -> dict[str, View]:
    """The two views, fitted at the same time: each is many small jobs."""
    with ThreadPoolExecutor(2) as pool:
        return dict(zip(("text", "meta"), pool.map(fit, ("text", "meta")), strict=True))


def _samples(docs: DataFrame, labels: DataFrame, most_labelled: int, most_pool: int) -> DataFrame:
    """doc_id, quality (null for the pool) and fold (0: held out) of the sampled ids, most_labelled + most_pool at most."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    labelled = known.orderBy(order, "doc_id").limit(most_labelled)
    pool = docs.filter("doc_id is not null").select("doc_id").join(known.select("doc_id"), "doc_id", "left_anti").orderBy(order, "doc_id").limit(most_pool).distinct().withColumn("quality", F.lit(None).cast("int"))
    return labelled.select("doc_id", F.col("quality").cast("int")).unionByName(pool).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)))


def cotrain(docs: DataFrame, labels: DataFrame, *, rounds: int = 3, sure: float = 0.95, most_labelled: int = 20_000, most_pool: int = 20_000, fit_tasks: int = 4) -> CoTrained | float:
    """The pair of calibrated views, or the share of good labels if they aren't of both kinds. docs: doc_id, text, source, lang, chars.

    fit_tasks: the models are fitted in so many tasks. Only the sampled rows' features are shuffled to them; the scan that
    finds these rows has as many tasks as docs has partitions.
    """
    chosen = F.broadcast(durable(_samples(docs, labels, most_labelled, most_pool)))
    rows = durable(docs.join(chosen, "doc_id").mapInArrow(forgetting(_features, _cache), "doc_id long, quality int, fold long, text array<double>, meta array<double>").repartition(fit_tasks))
    labelled, pool = rows.filter("quality is not null and fold <> 0"), rows.filter("quality is null")
    held_out = rows.filter("quality is not null and fold = 0")
    n, good, = labelled.agg(F.count(F.lit(1)), F.sum("quality")).first()
    tested, tested_good = held_out.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not n or good in (0, n):
        return good / n if n else 0.5
    calibrate = held_out if 0 < tested_good < tested else labelled
    taught = {"text": labelled, "meta": labelled}
    for _ in range(rounds):
        views = _both(lambda v: _fit(taught[v], v))
        limit = float(np.log(sure / (1 - sure)))
        for v, other in (("text", "meta"), ("meta", "text")):
            odds = _odds(views[v], v)
            told = pool.withColumn("quality", F.when(odds >= limit, 1).when(odds <= -limit, 0)).filter("quality is not null")
            taught[other] = labelled.unionByName(told)
    views = _both(lambda v: _calibrated(_fit(taught[v], v), calibrate, v))
    share = good / n
    return CoTrained(views["text"], views["meta"], float(np.log(share / (1 - share))))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", cut: float = 0.5, **training) -> DataFrame:
    """doc_id, text_odds, meta_odds (calibrated), score and kept (score >= cut) for each row of docs."""
    chars = F.col(chars_col) if chars_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), chars.cast("long").alias("chars"))
    model = cotrain(rows, labels, **training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _features(_with_nulls(batches)):
            size = batch.num_rows
            text = np.array(batch.column("text").flatten()).reshape(size, -1)
            meta = np.array(batch.column("meta").flatten()).reshape(size, -1)
            if isinstance(model, CoTrained):
                odds = [model.text.log_odds(text), model.meta.log_odds(meta)]
                score = model.score(text, meta)
            else:
                odds, score = [np.zeros(size), np.zeros(size)], np.full(size, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(odds[0]), pa.array(odds[1]), pa.array(score), pa.array(score >= cut)], names=["doc_id", "text_odds", "meta_odds", "score", "kept"])

    return rows.mapInArrow(forgetting(run, _cache), "doc_id long, text_odds double, meta_odds double, score double, kept boolean")


def _with_nulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [*batch.schema.names, "quality", "fold"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.int64())], names=names)

