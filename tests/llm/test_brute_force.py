"""Operators that SQL can't express against plain versions: the splits of shards, paths of the line field, fits of the quality views."""

import itertools
import random

import numpy as np

from tidemark.llm import cotraining
from tidemark.llm.cotraining import CoTrained, View, cotrain, meta_view, quality_scores, text_view
from tidemark.llm.kd_shards import TIES, kd_leaves
from tidemark.llm.quality_rules import FEATURES, Field


def plain_leaves(rows, first, shards, out):
    """rows: (id, size, keys). Splits by sorting."""
    if not rows:
        return
    if shards == 1:
        out.update((i, first) for i, *_ in rows)
        return
    half = shards // 2
    spread = [max(k[d] >> TIES for _, _, k in rows) - min(k[d] >> TIES for _, _, k in rows) for d in range(len(rows[0][2]))]
    d = spread.index(max(spread))
    want, before = sum(s for _, s, _ in rows) * half / shards, 0
    for key, group in itertools.groupby(sorted(rows, key=lambda r: r[2][d]), key=lambda r: r[2][d]):
        size = sum(s for _, s, _ in group)
        if before + size >= want:
            break
        before += size
    last = key if before + size - want <= want - before else key - 1
    plain_leaves([r for r in rows if r[2][d] <= last], first, half, out)
    plain_leaves([r for r in rows if r[2][d] > last], first + half, shards - half, out)


def test_splits_of_shards_like_sorting(spark):
    r = random.Random(8)
    for shards, spreads, ties in ((7, (1000, 50, 3), 2**30), (12, (5, 5, 5), 4), (5, (0, 1, 1), 1)):
        rows = [(i, r.choice([16, 20, 100, 5000]), tuple((r.randint(0, s) << TIES) + r.randrange(ties) for s in spreads)) for i in range(500)]
        df = spark.createDataFrame([(i, s, *k) for i, s, k in rows], "id long, size long, key0 long, key1 long, key2 long")
        got = {x.id: x.node for x in kd_leaves(df, ["key0", "key1", "key2"], shards, bins=9).collect()}
        want = {}
        plain_leaves(rows, 0, shards, want)
        assert got == want


def test_best_paths_like_all_paths():
    r = np.random.default_rng(4)
    for n in range(1, 11):
        for _ in range(20):
            field, features = Field(r.normal(size=FEATURES), r.normal(size=(2, 2)) * 2), r.normal(size=(n, FEATURES))
            own = features @ field.emit
            worth = lambda path: sum(x for x, s in zip(own, path, strict=True) if s) + sum(field.step[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
            assert field.boilerplate(features).tolist() == [bool(s) for s in max(itertools.product((0, 1), repeat=n), key=worth)]


def newton(x, y, penalty):
    """Logistic regression with a penalty on coefficients of scaled features, by Newton's steps."""
    scale = x.std(axis=0, ddof=1)
    z = np.c_[x / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + ridge, z.T @ (p - y) / len(x) + ridge @ w)
    return w[:-1] / scale, w[-1]


def test_views_are_fitted_like_newton(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4)) * [1, 5, 0.2, 1]
    y = (x @ [1, -0.2, 3, 0] + r.normal(size=300) > 0.3).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "v array<double>, quality int")
    view = cotraining._fit(df, "v", 0.01)
    weights, bias = newton(x, y, 0.01)
    assert np.allclose(view.weights, weights, atol=0.02) and abs(view.bias - bias) < 0.02


def test_scores_combine_the_views(spark):
    """Every document's score from its own two views, one by one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    own = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").alias("chars"))
    model = cotrain(own, labels)
    assert isinstance(model, CoTrained) and isinstance(model.text, View)
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    for d in docs.collect():
        odds = [v.scale * (np.array(f) @ v.weights + v.bias) + v.offset for v, f in ((model.text, text_view((d.text or "").encode())), (model.meta, meta_view(d.n_chars, d.source, d.lang)))]
        x = got[d.doc_id]
        assert np.allclose([x.text_odds, x.meta_odds], odds, atol=1e-3, rtol=1e-3) and abs(x.score - 1 / (1 + np.exp(-np.clip(sum(odds) - model.prior, -40, 40)))) < 1e-3 and x.kept == (x.score >= 0.5)
