"""The manifest and the prefix trie against plain versions on odd rows."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

import tidemark.llm.conversation_trie as conversation_trie
from tidemark.llm.common import placed, running
from tidemark.llm.conversation_trie import numbered, prefix_trie, shared_openings
from tidemark.llm.merkle import audited, folded, leaf, merkle_manifest

NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests, arity):
    proofs, below, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), arity):
            run = nodes[i : i + arity]
            for j, own in enumerate(below[i : i + arity]):
                for x in own:
                    proofs[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            held.append(sum(below[i : i + arity], []))
        nodes, below = up, held
    return nodes[0], proofs


def plain_audit(rows, arity=16):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own], arity)))
    root, upper = plain_tree([t[1] for t in trees], arity)
    out = []
    for (own, subroot, proofs), above in zip(trees, upper, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            first = x = plain_leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = plain_leaf((*r[:4], lower(r[4])))
            for before, after in proof + above:
                x = sha(before + x + after)
            out.append((r[0], first, subroot, root, sha("".join(a + b for a, b in proof + above)), x, x == root))
    return out


def odd_documents(n):
    r = random.Random(1)
    rows = [(r.choice([None, i, i, 7]), r.choice([None, "", "a", "é", "z", f"s{i % 40}"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "AbÉ", "x" * 5, "Y" * 150_000])) for i in range(n)]
    return rows + [(None, "hot", None, None, None)] * 40 + [(1000 + i, "hot", "en", 1, f"T{i}") for i in range(n)]


def test_manifest_of_odd_rows(spark):
    rows = odd_documents(300)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "place", "own", "digest", "size", "node", "leaf", "proof", "changed", "nodes", "run")})
    assert sorted(map(tuple, audited(docs).collect()), key=str) == sorted(plain_audit(rows), key=str)
    assert audited(docs.filter("false")).collect() == []
    (one,) = audited(docs.limit(1)).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_proofs_tell_changed_rows(spark):
    """By other arities and columns; a row that is changed, or given another's proof, doesn't lead to the root."""
    rows = [(i, f"g{i % 7}" if i % 7 else None, f"value {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "n long, g string, v string")
    for arity in (2, 3, 100):
        m = merkle_manifest(docs, columns=["n", "v"], group_col="g", order_col="n", arity=arity, carry={"v": F.col("v")})
        changed = F.when(F.col("n") % 3 == 0, F.lit("other")).otherwise(F.col("v"))
        got = m.proofs.select("n", (folded(leaf([F.col("n"), changed]), F.col("proof")) == F.col("root")).alias("ok")).collect()
        assert len(got) == 100 and all(r.ok == (r.n % 3 != 0) for r in got)
        assert sum(x.count() for x in m.levels) >= 7 and m.proofs.select("root").distinct().count() == 1


def test_places_and_running_values_in_pieces(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i * 7 % 500) for i in range(500)], "g string, x long")
    got = placed(rows.unionByName(rows), ["g"], ["x"])
    for broadcast in (0, 1000):
        found = {}
        for r in placed(rows.unionByName(rows), ["g"], ["x"], most_broadcast=broadcast).collect():
            found.setdefault(r.g, []).append((r.place, r.x, r["size"]))
        for g, own in found.items():
            xs = sorted(x for h, x in [("a" if i % 3 else "b", i * 7 % 500) for i in range(500)] * 2 if h == g)
            assert sorted(own) == [(i, x, len(xs)) for i, x in enumerate(xs)]
        sums = running(got.withColumn("v", F.col("x")), ["g"], "place", {"v": (F.sum, lambda a, b: a + b)}, step=64, most_broadcast=broadcast).collect()
        assert all(r.v == sum(x for p, x, _ in found[r.g] if p <= r.place) for r in sums) and len(sums) == 1000


def said(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_trie(conversations):
    members, children, sums = {}, {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        sums[p] = (sum(sums[x][0] for x in below) if below else 1, (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(sums[x][1] for x in below))
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *sums[p], ends(p, m)) for p, m in members.items())


def plain_openings(rows):
    turns = {}
    for c, n, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((n is not None, n or 0, said(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    given = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    first = lambda c: c - c % 100 if c >= 0 else c + -c % 100
    return plain_trie({c: turns.get(first(c), [])[: given[c]] + turns[c][given[c] :] for c in turns})


def rows_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=lambda r: r[:2])


def test_trie_of_odd_rows(spark):
    r = random.Random(1)
    rows = [(r.choice([None, -3, -100, 0, 100, 205, *range(100, 170)]), r.choice([None, 0, 1, 2, 3, 3]), r.choice([None, "", "u", "a"]), r.choice([None, "", "AbÉ😀", "x" * 5, "y", "z" * 150_000])) for _ in range(600)]
    rows += [(7000, i, "u", f"t{i % 3}") for i in range(40)] + [(8000 + i, j, "u", "s") for i in range(30) for j in range(i)] + [(9000 + i, 0, "u", "alike") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("depth", "place", "said", "owner", "size", "at", "up", "points", "first")})
    assert rows_of(shared_openings(df)) == plain_openings(rows)
    assert shared_openings(df.filter("false")).collect() == []
    assert [tuple(x)[:5] for x in shared_openings(df.filter("conv_id = 205").limit(1)).orderBy("depth").collect()][0] == (205, 0, None, 1, int(zlib.crc32(b"205") % 6 == 0))


def test_trie_of_long_chains(spark, monkeypatch):
    """Chains that hang on chains, and conversations longer than a piece."""
    talks = {1000 - k: [("u", f"t{j}") for j in range(k)] + [("a", f"own{k} {j}") for j in range(k % 3)] for k in range(1, 40)}
    turns = numbered(spark.createDataFrame([(c, i, role, text) for c, own in talks.items() for i, (role, text) in enumerate(own)], "conv_id long, turn long, role string, text string")).withColumn("depth", F.col("place") + 1)
    monkeypatch.setattr(conversation_trie, "running", lambda *a, **k: running(*a, **k, step=7))
    assert rows_of(prefix_trie(turns, turns.filter("place = 0").select("conv_id", F.col("size").alias("length")))) == plain_trie(talks)
