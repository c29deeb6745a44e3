"""Near-duplicates by bands and odd sketches against a join of all shingles; the estimates they rest on."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.ngram_join import shingle_set
from tidemark.llm.odd_sketches import bands, kinds, minhash_dedup, most_bits, odd_sketch, samples

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, width=3):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def plain_join(rows):
    sets, parent, index = [plain_set(t) for _, t in rows], list(range(len(rows))), {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = {}
        for shingle in own:
            for j in index.setdefault(shingle, []):
                common[j] = common.get(j, 0) + 1
            index[shingle].append(i)
        for j, c in common.items():
            if 100 * c >= 85 * (len(own) + len(sets[j]) - c):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(own), least.get(top(i)) if own else d) for i, ((d, _), own) in enumerate(zip(rows, sets, strict=True))]


def edited(r):
    """Texts of all sizes in families whose members lie around the threshold."""
    rows = []
    for _ in range(45):
        n = r.choice([5, 7, 9, 12, 20, 40, 66, 70, 130, 140, 260, 300, 600, 1100, 2100])
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(8):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, n // 40), max(1, n // 30), max(1, n // 20)])):
                k = r.randrange(len(words))
                words[k : k + 1] = [f"x{r.randrange(10**6)}"] if r.random() < 0.5 or len(words) == 1 else []
            rows.append((len(rows), " ".join(words)))
    return rows


def test_near_duplicates_around_the_threshold(spark):
    rows = edited(random.Random(5))
    rows += [(5000 + i, t) for i, t in enumerate([None, "", " \n", "a", "A", "a b", "a  B", "é É", "É é", "x" * 150_000, "w " * 50_000])] + [(None, "a"), (None, "solo text here now"), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "n", "own", "sig", "component", "upper", "bands", "row", "d1", "a", "b")})
    for broadcast in (2_000_000, 0):
        got = minhash_dedup(docs, most_broadcast=broadcast, most_rest=broadcast).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(plain_join(rows), key=str)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash_dedup(docs.filter("false")).collect() == []


def apart(x, y):
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def test_sketches_estimate_and_bands_find():
    r = np.random.default_rng(3)
    limit = most_bits(288, 16, 85, 100, 7.0)
    for n in (7, 30, 64, 200, 900, 5000):
        gone, differences = 0, []
        for _ in range(60):
            common = r.integers(0, 2**63, n, dtype=np.uint64)
            rest = max(1, int(n * 0.15 / 0.85 / 2)) if n >= 13 else 1
            a = np.unique(np.r_[common, r.integers(0, 2**63, rest, dtype=np.uint64)])
            b = np.unique(common if n < 13 else np.r_[common, r.integers(0, 2**63, rest, dtype=np.uint64)])
            both = [k for k in kinds(len(a), 85, 100) if k in kinds(len(b), 85, 100)]
            x, y = samples(a, both[-1], 288), samples(b, both[-1], 288)
            gone += not (bands(x, 9, 6) == bands(y, 9, 6)).any()
            differences.append(apart(odd_sketch(x, 16), odd_sketch(y, 16)))
            share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(1 + 1024 / (4 * 288) * np.log(1 - 2 * differences[-1] / 1024) - share) < 0.12
        assert gone == 0 and max(differences) <= limit
    far = [shingle_set(" ".join(f"{i}{j}" for j in range(400)).encode(), 3) for i in "ab"]
    assert apart(*(odd_sketch(samples(x, 8, 288), 16) for x in far)) > limit


def test_sets_of_like_size_have_a_kind_in_common():
    for n in range(1, 3000):
        for m in range(n, n * 100 // 85 + 1):
            if 100 * n >= 85 * m:
                assert set(kinds(n, 85, 100)) & set(kinds(m, 85, 100)) and max(kinds(n, 85, 100)) >= m.bit_length() - 1
