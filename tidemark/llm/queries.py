"""The queries of this subpackage, one for each operator, with its production parameters and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import round_trip
from .common import table
from .conversation_trie import shared_openings
from .cotraining import quality_scores
from .exact_dedup import exact_dedup
from .kd_shards import kd_shards
from .licenses import license_scan
from .merkle import audited
from .mixing import mix
from .ngram_join import ngram_join
from .odd_sketches import minhash_dedup
from .quality_rules import quality_rules
from .secrets import secret_scan
from .token_counts import token_counts


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a document: its pass over the source, its block, and its place in the pass."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=40)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its score. Labels are made from the corpus, as no table has any."""
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, batch_bytes=4 << 20)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_openings(table(spark, sf_dir, "conversations"))


#: The exponent is searched for over the whole grid, and a pass is one running sum over the permuted documents.
OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
src AS (SELECT s, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS docs FROM t GROUP BY s HAVING sum(n) > 0),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS c FROM src),
powers AS (SELECT k, s, tokens, docs, c, total, pow(tokens / total, k / 1024.0) AS p, tokens / total AS share FROM (SELECT unnest(range(0, 1025)) AS k) AS grid CROSS JOIN src CROSS JOIN total),
tried AS (SELECT k, max(c) AS c, ln(sum(p)) - (k / 1024.0) * sum(p * ln(share)) / sum(p) AS entropy, max(p / share) / sum(p) AS repeats FROM powers GROUP BY k),
flat AS (SELECT CASE WHEN max(c) < 2 THEN 1024 ELSE coalesce(max(CASE WHEN entropy >= 0.98 * ln(c) THEN k END), 0) END AS k FROM tried),
chosen AS (SELECT coalesce(min(CASE WHEN tried.k >= flat.k AND (repeats <= 4.0 OR tried.k = 1024) THEN tried.k END), 1024) AS k FROM tried, flat),
weighed AS (SELECT s, tokens, docs, CAST(round(total * p / sum(p) OVER ()) AS BIGINT) AS budget FROM powers WHERE k = (SELECT k FROM chosen)),
planned AS (
  SELECT s, budget, budget // tokens AS passes, budget % tokens AS need,
         (SELECT CAST(count(*) AS BIGINT) FROM (SELECT unnest(range(0, 8)) AS i) AS x WHERE greatest(tokens / 1000000, docs / 10000, 1.0) > pow(16, i)) AS digits FROM weighed),
placed AS (SELECT t.*, budget, passes, need, substr(d, 1, CAST(digits AS INTEGER)) AS block, md5('mix|' || CAST(passes AS VARCHAR) || '|' || t.s || '|' || substr(d, 1, CAST(digits AS INTEGER))) AS last FROM t JOIN planned ON t.s = planned.s),
summed AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY last, d RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(n) OVER (PARTITION BY s, last, d) AS before FROM placed),
drawn AS (SELECT *, unnest(range(0, passes + CASE WHEN before < need THEN 1 ELSE 0 END)) AS pass FROM summed)
SELECT doc_id, source, n AS mix_tokens, budget AS mix_budget, CAST(pass AS BIGINT) AS mix_pass, block AS mix_block, md5('mix|' || CAST(pass AS VARCHAR) || '|' || s || '|' || block) || d AS mix_order FROM drawn
"""

OP8_SQL = r"""
WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, row_number() OVER w AS nth FROM rows WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, sha256(content) AS text_sha256 FROM ranked
"""

#: Sets are joined by their shingles, links closed by recursion.
NEAR_SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {width} + 2), lambda i: array_to_string(words[i : i + {width} - 1], ' ')))) END AS shingles FROM worded),
keyed AS MATERIALIZED (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n, CASE WHEN len(shingles) > 0 THEN sha256(array_to_string(shingles, chr(10))) END AS k FROM sets),
classes AS MATERIALIZED (SELECT sha256(array_to_string(shingles, chr(10))) AS k, len(shingles) AS n, any_value(shingles) AS shingles FROM sets WHERE len(shingles) > 0 GROUP BY 1, 2),
single AS MATERIALIZED (SELECT k, n, unnest(shingles) AS shingle FROM classes),
links AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM single AS a JOIN single AS b ON a.shingle = b.shingle AND a.k <> b.k AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.k, b.k HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT k AS a, k AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT reach.a AS k, min(keyed.doc_id) AS component_id FROM reach JOIN keyed ON keyed.k = reach.b GROUP BY reach.a),
found AS (SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM keyed LEFT JOIN named ON keyed.k = named.k)
SELECT {columns} FROM found
"""
OP7_SQL = NEAR_SQL.format(width=5, percent=80, columns="doc_id, n_shingles, component_id")
OP12_SQL = NEAR_SQL.format(width=3, percent=85, columns="doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept")

#: CRC-32 of a number's decimal digits, by the table of 256 remainders that its polynomial gives.
CRC_TABLE_SQL = "crc AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(0, 8), lambda i: CAST(0 AS BIGINT))), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"
CRC_SQL = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda k: CAST(ascii(substr({0}, k, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


def _merkle_sql(levels: int = 7, upper: int = 5) -> str:
    """Levels are written out one by one: 16 ** levels rows of a source, 16 ** upper sources. A lone node passes through as it is."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE_SQL,
        f"read AS MATERIALIZED (SELECT *, {leaf('text')} AS leaf, CASE WHEN {CRC_SQL.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 AND text IS NOT NULL THEN {leaf(low)} END AS changed, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS k FROM documents, crc)",
        "l0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY k) AS size, leaf AS h, doc_id, changed FROM read)",
    ]

    def grown(letter: str, count: int) -> None:
        for i in range(count):
            parts.append(f"{letter}{i + 1} AS MATERIALIZED (SELECT k, place // 16 AS place, any_value((size + 15) // 16) AS size, CASE WHEN any_value(size) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h FROM {letter}{i} GROUP BY k, place // 16)")

    def stepped(letter: str, i: int) -> str:
        side = lambda sign: f"coalesce((SELECT string_agg(o.h, '' ORDER BY o.place) FROM {letter}{i} AS o WHERE o.k = n.k AND o.place // 16 = n.place // 16 AND o.place {sign} n.place), '')"
        return f"{letter}s{i} AS MATERIALIZED (SELECT k, place, size, {side('<')} AS before, {side('>')} AS after FROM {letter}{i} AS n)"

    grown("l", levels)
    parts.append(f"u0 AS MATERIALIZED (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS size, h, k AS name FROM l{levels})")
    grown("u", upper)
    parts += [stepped("l", i) for i in range(levels)] + [stepped("u", i) for i in range(upper)]
    joins = " ".join(f"JOIN ls{i} ON ls{i}.k = l0.k AND ls{i}.place = l0.place // {16**i}" for i in range(levels)) + " JOIN u0 ON u0.name = l0.k " + " ".join(f"JOIN us{i} ON us{i}.place = u0.place // {16**i}" for i in range(upper))
    steps = [f"{letter}s{i}" for letter, count in (("l", levels), ("u", upper)) for i in range(count)]
    parts.append(f"f0 AS (SELECT l0.doc_id, l0.h AS leaf, u0.h AS subroot, u{upper}.h AS root, coalesce(l0.changed, l0.h) AS folded, " + " || ".join(f"{s}.before || {s}.after" for s in steps) + " AS proof, " + ", ".join(f"{s}.before AS {s}_b, {s}.after AS {s}_a, {s}.size AS {s}_n" for s in steps) + f" FROM l0 {joins}, u{upper})")
    for i, s in enumerate(steps):
        parts.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {s}_n = 1 THEN folded ELSE sha256({s}_b || folded || {s}_a) END AS folded) FROM f{i})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{len(steps)}"


OP11_SQL = _merkle_sql()

OP13_SQL = f"""
WITH {CRC_TABLE_SQL},
t AS MATERIALIZED (SELECT conv_id AS c, role, text, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS place FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL) AS x),
convs AS MATERIALIZED (SELECT c, c - c % 100 AS base, {CRC_SQL.format('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM t) AS x, crc),
r AS (SELECT v.c, 0 AS part, t.place, t.said, t.text FROM convs AS v JOIN t ON t.c = v.base AND t.place < v.h UNION ALL SELECT v.c, 1, t.place, t.said, t.text FROM convs AS v JOIN t ON t.c = v.c AND t.place >= v.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, place) AS depth, said, text FROM r),
p AS MATERIALIZED (SELECT c, depth, length(text) AS points, sha256(string_agg(said, '') OVER (PARTITION BY c ORDER BY depth)) AS k FROM d UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS MATERIALIZED (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(points) AS saved FROM p GROUP BY depth, k),
edge AS MATERIALIZED (SELECT DISTINCT a.depth, a.k, b.k AS up FROM p AS a JOIN p AS b ON a.c = b.c AND b.depth = a.depth - 1),
kids AS MATERIALIZED (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM edge GROUP BY 1, 2),
sub AS (SELECT p.depth, p.k, sum(w.saved) AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves FROM node AS w JOIN p ON p.c = w.conv_id AND p.depth <= w.depth LEFT JOIN kids ON kids.depth = w.depth AND kids.k = w.k GROUP BY p.depth, p.k),
ends AS (SELECT p.depth, p.k, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM p JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY c) AS l ON l.c = p.c AND l.depth = p.depth GROUP BY p.depth, p.k)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node LEFT JOIN edge ON edge.depth = node.depth AND edge.k = node.k LEFT JOIN node AS parent ON parent.depth = edge.depth - 1 AND parent.k = edge.up LEFT JOIN kids ON kids.depth = node.depth AND kids.k = node.k
JOIN sub ON sub.depth = node.depth AND sub.k = node.k LEFT JOIN ends ON ends.depth = node.depth AND ends.k = node.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_kd_shards": op2_kd_shards,
        "op3_secrets": op3_secrets,
        "op4_token_counts": op4_token_counts,
        "op5_cotraining": op5_cotraining,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_ngram_join": op7_ngram_join,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_licenses": op10_licenses,
        "op11_merkle": op11_merkle,
        "op12_odd_sketches": op12_odd_sketches,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL,
        "op7_ngram_join": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_merkle": OP11_SQL,
        "op12_odd_sketches": OP12_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
