"""The corpus operators against SQL, the tokenizers' libraries, brute force and held-out labels; then odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.byte_bpe import ByteBpe, decode, encode, round_trip
from tidemark.llm.components import components
from tidemark.llm.cotraining import quality_scores
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.kd_shards import _numbered, kd_shards
from tidemark.llm.licenses import RULES, SENTENCES, license_scan, scanned
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_join, parities, shingle_set, signatures
from tidemark.llm.quality_rules import WINDOW, fit_field, line_features, quality_rules
from tidemark.llm.secrets import secret_scan
from tidemark.llm.token_counts import PieceCounter, token_counts

FOLDER = "/root/testdata/sf0.001"
VOCABULARY, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long one, repeated rows, columns whose names the operators use."""
    long = "one two three four five six " * 20_000
    rows = [(1, None, None, None), (None, "a b", "s", "en"), (2, "", "s", "en"), (3, " \n\t", "s", "en"), (4, long, "s", "en"), (5, "x" * 150_000, "s", None), (6, "same words in this text here", "s", "en"), (6, "same words in this text here", "s", "en"), (7, "Same  words in this text here", "t", "en"), (8, "é́ <|endoftext|> 😀", "t", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("node", "n", "row", "shard", "size", "key", "tokens", "_source", "digest", "kept", "quality", "fold", "component", "sig", "nth", "label", "n_tokens")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def test_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, FOLDER)
        found = duck.sql(sql)
        order = [found.columns.index(c) for c in got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall()), name


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * 10, "big" if i < 900 else f"s{i % 3}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, entropy_share=0.9, most_repeats=3.0, block_tokens=100).toPandas()
    by = got.groupby("source").agg(tokens=("mix_tokens", "sum"), budget=("mix_budget", "first"), passes=("mix_pass", "max"))
    assert ((by.tokens - by.budget).between(0, 10)).all()
    assert by.passes.max() <= 3 and by.budget["big"] < 9000 and by.budget["s1"] > 330
    assert not got.duplicated(["doc_id", "mix_pass"]).any()
    for _, part in got[got.mix_pass < got.groupby("source").mix_pass.transform("max")].groupby(["source", "mix_pass"]):
        assert len(part) == sum(s == part.source.iloc[0] for _, _, s in rows)


@pytest.mark.parametrize("shards", [7, 40])
def test_shards(docs, shards):
    got = kd_shards(docs, shards=shards, cell_rows=5).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {i: x for i, *x in zip(got.doc_id, got["size"], got.text_crc32, got.law, strict=True)} == {i: [len(t) + 16, zlib.crc32(t), "bytes"] for i, t in texts.items()} and got.grown_shard.isna().all()
    total = got.groupby("shard")["size"].sum()
    assert set(total.index) == set(range(shards)) and (total - total.mean()).abs().max() <= 2 * got["size"].max()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)


def test_shards_whatever_the_files(docs, odd):
    """The same rows in other partitions, and rows that repeat many times, lie in the same shards and slots."""
    for rows in (docs, odd.unionByName(odd), docs.unionByName(docs.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("copy"))):
        place = lambda d: sorted(map(str, kd_shards(d, shards=8, cell_rows=20).collect()))
        assert place(rows) == place(rows.repartition(7))
    copies = _numbered(odd.select("doc_id", "lang").unionByName(odd.select("doc_id", "lang")), most_at_once=3).groupBy("doc_id", "lang").agg(F.sort_array(F.collect_list("copy")).alias("n")).collect()
    assert sorted(len(r.n) for r in copies) == [2] * 8 + [4] and all(list(r.n) == list(range(len(r.n))) for r in copies)


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(VOCABULARY)
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    for chunk in (65_536, 37):  # also with chunks that cut words
        got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts(docs, VOCABULARY, chunk_chars=chunk).collect()}
        assert {k: v[0] for k, v in got.items()} == want
    assert all(got[r.doc_id][1:] == (len(r.text.encode()), want[r.doc_id] > 2048) for r in docs.collect())


def test_transducer_on_odd_texts():
    library, counter, r = Tokenizer.from_file(VOCABULARY), PieceCounter(open(VOCABULARY).read()), random.Random(2)
    alphabet = ["a", "b", "th", "é", "é", "İ", "Σ", "'s", "'ll", " ", "\n", " ", "\x1c", "1", "漢", "́", "<|endoftext|>", "<|", ">", "!", "😀", "aaaaaaaa", "HELLO", "_"]
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 25)))
        assert counter.text(t.encode()) == len(library.encode(t, add_special_tokens=False).ids), t


def test_byte_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    coded = encode(docs, RANKS, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert {r.doc_id: bytes(r.decoded).decode() for r in decode(coded, RANKS, P.PATTERN).collect()} == texts
    for r in round_trip(docs, RANKS, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    bpe, r = ByteBpe(open(RANKS, "rb").read(), P.PATTERN), random.Random(4)
    for t in ["ab" * 20_000, "the" * 9_000, *("".join(r.choice("aeth ing.\n\x1c é😀") for _ in range(200)) for _ in range(200))]:
        assert bpe.encode(t) == " ".join(map(str, library.encode_ordinary(t)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_rank_queue_on_many_pieces_at_once(name, monkeypatch):
    """Pieces that share a queue, repeat themselves, or hold ranks that sink; buckets merged by arrays and one by one."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    library, bpe, r = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ByteBpe(open(P.path(name), "rb").read(), P.PATTERN), random.Random(4)
    tokens = [x for x in ranks if len(x) > 1]
    sinking = [bpe.bytes_of[x] for x in sorted(bpe.sinking)]
    pieces = [bytes(r.choice(b"abcdeilnorstAB=-") for _ in range(r.randint(2, 200))) for _ in range(500)] + [b"ab" * 20_000, b"aba" * 10_000, b"=-" * 10_000, b"a" * 9_999]
    pieces += [b"".join(r.choice(tokens) for _ in range(r.randint(2, 9))) for _ in range(1500)] + [r.choice(sinking) * r.randint(2, 12) for _ in range(500)]
    for many in (2, 24, 10**9):
        monkeypatch.setattr("tidemark.llm.byte_bpe.MANY", many)
        (ids, ends), start = bpe.merged(pieces), 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            assert piece in ranks or ids[start:end].tolist() == library._core_bpe.encode_single_piece(piece), piece
            start = end
    text = "".join(r.choice(["the ", "café", " 12", "\n\n ", "zqx" * 50]) for _ in range(3000))
    monkeypatch.setattr("tidemark.llm.byte_bpe.LONG", 100)
    monkeypatch.setattr("tidemark.llm.byte_bpe.PART", 7)
    assert bpe.encode(text) == " ".join(map(str, library.encode_ordinary(text)))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())
    at, inverted = {i: i for i in sets}, {}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in inverted.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                at[b] = a
        for s in sets[i]:
            inverted.setdefault(s, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_like_brute_force(spark, docs):
    r, rows = random.Random(9), [(x.doc_id, x.text) for x in docs.collect()]
    base = [f"w{r.randint(0, 500)}" for _ in range(150)]
    short = [[f"v{r.randint(0, 9)}" for _ in range(r.randint(1, 9))] for _ in range(60)]
    for k in range(120):  # one large group around a base, with edits about the threshold
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000 + k, " ".join(w)) for k, w in enumerate(short)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for frequent in (16, 2):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join(df, frequent=frequent).collect()}
        assert got == want


def test_signatures_always_meet():
    """Two sets at the threshold share a combination, whatever tokens are frequent."""
    import numpy as np

    r = random.Random(6)
    for _ in range(400):
        n = r.randint(1, 150)
        x = [r.getrandbits(64) for _ in range(n)]
        frequency = {t: r.choice([0, 20, 400]) for t in x}
        y = list(x)
        while True:
            z = [r.getrandbits(64) if r.random() < 0.03 else t for t in y] + [r.getrandbits(64)] * (r.random() < 0.1)
            common = len({*x} & {*z})
            if 5 * common < 4 * (len({*x} | {*z})):
                break
            y = z
            if r.random() < 0.1:
                break
        a, b = np.unique(np.array(x, np.uint64)), np.unique(np.array(y, np.uint64))
        known = lambda s: np.array([frequency.get(t, 0) for t in s.tolist()])  # noqa: B023, E731
        assert signatures(a, known(a), 16) & signatures(b, known(b), 16)
        differ = len({*a.tolist()} ^ {*b.tolist()})
        assert sum(int(v).bit_count() for v in (parities(a) ^ parities(b)).view(np.uint64)) <= differ
    assert len(shingle_set(b"A b  c\td e f")) == 2 and len(shingle_set(b"a b")) == 1 and not len(shingle_set(b" "))


def test_components_of_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)], "a long, b long")
    got = {x.node: x.component for x in components(links).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 150, 200)} == {100}


def test_exact_dedup_with_clashing_digests(spark, odd):
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd).collect()}
    assert want == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd, digest=lambda t: F.left(t, F.lit(1))).collect()}
    kept = [r for r in exact_dedup(odd).collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept})


def test_quality_rules(spark, docs, labels):
    rows = quality_rules(docs, labels).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        t = texts[r.doc_id]
        words, lines = WORDS.findall(t), t.split("\n")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeats = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        duplicates = sum(bool(WORDS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), duplicates, len(repeats))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeats) > 50 * len(words)) and not (r.base_failed and r.kept)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    fair = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(k == bool(q) for k, q in fair) >= 0.95 * len(fair)


def test_quality_field_on_documents_of_both_kinds():
    """The field, fitted to other documents, tells the lines of good documents from those of bad ones between them."""
    import pyarrow.parquet as pq

    folder = FOLDER.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    kinds = {r["doc_id"]: not r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    lines_of = lambda i: [x for x in texts[i].split("\n") if x.split()]
    windows = [(x[k : k + WINDOW], bad) for i, bad in sorted(kinds.items()) if i % 3 for x in [line_features(texts[i].encode())[0]] for k in range(0, len(x), WINDOW)]
    field, r = fit_field(windows), random.Random(8)
    assert field.step[0, 0] > field.step[0, 1] and field.step[1, 1] > field.step[1, 0]
    good, bad = ([i for i, b in kinds.items() if b == kind and i % 3 == 0] for kind in (False, True))
    right = lines = between = 0
    for _ in range(200):
        rest, text, labels, state = [lines_of(r.choice(good)), lines_of(r.choice(bad))], [], [], r.random() < 0.5
        while rest[0] or rest[1]:
            n = r.randint(1, 7)
            text, labels, rest[state] = text + rest[state][:n], labels + [state] * len(rest[state][:n]), rest[state][n:]
            state = not state
        features, sizes = line_features("\n".join(text).encode())
        found = field.boilerplate(features)
        right, lines = right + int((found == labels).sum()), lines + len(labels)
        between += 0 < sizes[~found].sum() < sizes.sum()
    assert right >= 0.9 * lines and between >= 100


def test_cotraining_on_held_out_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scores = {r.doc_id: r.kept for r in quality_scores(docs, labels.filter("doc_id % 3 <> 0"), rounds=2).collect()}
    held = [(scores[r.doc_id], r.quality) for r in labels.filter("doc_id % 3 = 0").collect()]
    assert sum(k == bool(q) for k, q in held) >= 0.95 * len(held)


def test_views_teach_each_other(spark):
    """With few labels, rounds of exchange bring the score's accuracy above that of the labels alone."""
    r, rows = random.Random(12), []
    for i in range(900):
        good = i % 2 == 0
        own = "calm river stone garden letter".split() if good else "CLICK NOW WIN FREE CASH".split()
        words = [r.choice(own) if r.random() < 0.12 else r.choice("table window paper music winter summer market street".split()) for _ in range(60)]
        rows.append((i, " ".join(words), f"s{r.randint(0, 3) if (good ^ (r.random() < 0.1)) else r.randint(4, 7)}", "en", 400))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(24)], "doc_id long, quality int")
    right = lambda rounds: sum(x.kept == (x.doc_id % 2 == 0) for x in quality_scores(docs, labels, rounds=rounds, sure=0.8).filter("doc_id >= 24").collect())
    alone, taught = right(0), right(3)
    assert taught >= 0.95 * 876 and taught >= alone


def test_licenses(docs):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan(docs).collect():
        assert {*r.licenses} == {v for k, v in lines.items() if k in texts[r.doc_id].split("\n") or any(x.endswith(k) for x in texts[r.doc_id].split("\n"))}
    spdx = {
        "# SPDX-License-Identifier: GPL-2.0": (["GPL-2.0-only"], "copyleft"), "// SPDX-License-Identifier: MPL-2.0": (["MPL-2.0"], "copyleft"), "SPDX-License-Identifier: LicenseRef-Proprietary": (["LicenseRef-Proprietary"], "unknown"), "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */": (["MIT", "Apache-2.0"], "permissive"),
        "SPDX-License-Identifier: LGPL-2.1+ WITH Some-exception AND MIT": (["LGPL-2.1-or-later", "MIT"], "copyleft"), "SPDX-License-Identifier: Nothing-1.0 OR GPL-3.0-only": (["Nothing-1.0", "GPL-3.0-only"], "unknown"), "SPDX-License-Identifier: CC-BY-SA-4.0": (["CC-BY-SA-4.0"], "copyleft"),
    }
    assert {k: scanned(k)[:2] for k in spdx} == spdx
    wrapped = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions\n  and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    assert scanned(wrapped)[:2] == (["BSD-2-Clause"], "permissive")
    whole = "            GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    assert scanned(whole)[:2] == (["LGPL-2.1-only"], "copyleft")


def brute_recognised(names):
    """Ordered rules as patterns over the joined identifiers, each tried at every place."""
    left, found = [n.split(":")[0] for n in names], []
    for licence, rule, _ in RULES:
        pattern = re.compile("".join(f"(?:{re.escape(x.rstrip('?'))};){'?+' if x.endswith('?') else ''}" for x in rule))
        at = 0
        while at < len(left):
            m = pattern.match("".join(f"{x};" for x in left[at:]))
            size = m[0].count(";") if m else 0
            if size:
                found.append((at, licence))
                left[at : at + size] = ["-"] * size
            at += max(size, 1)
    return [x for _, x in sorted(found, key=lambda x: x[0])]


def test_licenses_like_brute_force():
    """Notices of random sentences, wrapped and commented at random among prose: identifiers and rules as they were put in."""
    r = random.Random(21)
    names = sorted(SENTENCES)
    for _ in range(400):
        lines, want = [], []
        mark = r.choice(["", "# ", " * ", "// "])
        rule = [x.rstrip("?") for x in r.choice(RULES)[1] if x.rstrip("?") in SENTENCES and (not x.endswith("?") or r.random() < 0.7)]
        for name in rule + [r.choice(names) for _ in range(r.randint(0, 4))]:
            words, width, line = r.choice(SENTENCES[name]).split(), r.randint(30, 90), ""
            for w in words:
                if len(line) + len(w) > width:
                    lines.append(mark + line.strip())
                    line = ""
                line += f" {w}"
            lines += [mark + line.strip(), mark if r.random() < 0.5 else "", *(["Some plain words of prose about rivers and stones"] if r.random() < 0.5 else [])]
            want.append(name)
        lines.append("A licence is told above.")  # so that the text speaks of one, whatever the sentences
        licences, verdict, told, _ = scanned("\n".join(lines))
        assert [x["sentence"] for x in told] == want
        assert licences == list(dict.fromkeys(brute_recognised(want)))


def test_odd_inputs(spark, odd, empty, labels):
    runs = {
        "mix": lambda d: mix(d), "shards": lambda d: kd_shards(d, shards=4), "secrets": lambda d: secret_scan(d), "tokens": lambda d: token_counts(d, VOCABULARY), "scores": lambda d: quality_scores(d, labels),
        "bpe": lambda d: round_trip(d, RANKS, P.PATTERN), "join": lambda d: ngram_join(d), "dedup": lambda d: exact_dedup(d), "rules": lambda d: quality_rules(d, labels.filter("false")), "licenses": lambda d: license_scan(d),
    }
    n = odd.count()
    for name, run in runs.items():
        assert run(empty).count() == 0, name
        got = run(odd).collect()
        if name not in ("mix", "secrets"):
            assert len(got) == n, name
    join = {r.doc_id: r.component_id for r in ngram_join(odd).collect()}
    assert join[6] == join[7] == 6 and join[2] == 2 and join[3] == 3 and join[1] == 1
    library = Tokenizer.from_file(VOCABULARY)
    counts = {r.doc_id: r.n_tokens for r in token_counts(odd, VOCABULARY, chunk_chars=1000).collect()}
    assert counts == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()}


def test_names_that_clash_come_through(spark, odd):
    """Extra columns, also ones called as working columns or results, keep their values."""
    extra = ("_source", "_block", "_budget", "_tokens", "_doc", "row", "first", "n", "kept", "k_doc_id", "_k_doc_id", "mix_pass", "mix_order", "doc", "features", "bad")
    held = odd.select("doc_id", "text", "source", "lang", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in extra))
    got = mix(held).collect()
    assert got and all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in got for c in extra if not c.startswith("mix_")) and all(r.mix_pass >= 0 for r in got)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, held, FOLDER)
        if name != "encoding":
            assert got.columns == held.columns
            assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in got.collect() for c in extra), name
        else:
            assert got.count() == held.count()
        assert stage(spark, held.filter("false"), FOLDER).count() == 0, name


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Nulls, empty and blank texts, repeated rows, ties: each stage's defined results."""
    stage = dict(corpus_pipeline.STAGES)
    rows = odd.select("doc_id", "text", "source", "lang", F.lit(1).cast("long").alias("n_chars"))
    words = lambda t: len(WORDS.findall(t or ""))
    good = stage["quality"](spark, rows, FOLDER).collect()
    assert all(words(r.text) >= 50 for r in good)
    once = stage["dedup"](spark, rows, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in once) == sorted(["3", "None", "4", "5", "6", "7", "8"])
    far = stage["near_dedup"](spark, rows, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in far) == sorted(["1", "None", "2", "3", "4", "5", "6", "8"])
    twice = stage["near_dedup"](spark, rows.unionByName(rows), FOLDER).collect()
    assert Counter(str(r.doc_id) for r in twice) == {"1": 2, "2": 2, "3": 2, "None": 1, "4": 1, "5": 1, "6": 1, "8": 1}
    mixed = stage["mixing"](spark, rows, FOLDER).collect()
    assert {r.doc_id for r in mixed if words(r.text)} <= {r.doc_id for r in rows.collect()} and all(r.source is not None for r in mixed) and Counter(r.doc_id for r in mixed)[6] % 2 == 0
    coded = stage["encoding"](spark, rows, FOLDER).collect()
    empty_hash = hashlib.sha256(b"").hexdigest()
    assert len(coded) == rows.count() and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded if r.doc_id in (1, 2)} == {(0, empty_hash, empty_hash)}
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows.collect()}


def test_pipeline(spark, odd, docs, labels):
    texts = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, FOLDER)
    kept = {r.doc_id for r in quality_rules(docs, labels).collect() if r.kept}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    once = stage["dedup"](spark, good, FOLDER)
    groups = {}
    for i in sorted(kept, key=lambda i: (-len(texts[i]), i)):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i]), i)
    assert {r.doc_id for r in once.collect()} == {*groups.values()}
    far = stage["near_dedup"](spark, once, FOLDER)
    assert {r.doc_id for r in far.collect()} == {c for _, c in brute_components([(i, texts[i]) for i in groups.values()]).values()}
    mixed = stage["mixing"](spark, far, FOLDER)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in far.collect()}
    assert corpus_pipeline.run(spark, FOLDER).count() == mixed.count()
