"""The corpus pipeline: documents that pass quality rules, once each, without near copies, mixed by source, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents; a document that is drawn more than once by the mixing is there as often.

Defined results of all stages: an empty table gives an empty one; nulls may stand in any column, and a row without doc_id
is a row like others; docs may have more columns, under any names, which pass through as they are (encoding has columns of
its own). Rows that repeat are as many rows. The stages say what they do with the rest.

SQL cannot express the quality rules (a fitted random field), so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import round_trip
from tidemark.llm.common import durable, kept_rows, table
from tidemark.llm.exact_dedup import exact_dedup, normalised
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_join
from tidemark.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: also those without text, with a null, empty or blank one. Of rows that repeat all go or stay."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), keep_columns=True)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one document stays, the longest, of these the one with the least id, none last.

    A null text equals an empty or blank one. Of rows that repeat one stays.
    """
    keys = {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(normalised(F.col("text")), 256)}
    return kept_rows(docs, exact_dedup(docs), "kept", keys, -F.length(F.coalesce("text", F.lit(""))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts one document stays, the one with the smallest id, none last. Null, empty and blank texts are linked with nothing.

    Of rows that repeat one stays, unless they have no words.
    """
    keys = {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    return kept_rows(docs, ngram_join(docs), "first", keys, F.lit(0))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are drawn: 98 % of the entropy that the sources allow, at most four repeats.

    A null source is a source of its own. Documents without words go where their source has none with words. Rows that
    repeat a doc_id are drawn together.
    """
    held = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    return mix(held).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, as a count and a hash, and what they decode to. A null text is empty; rows that repeat are encoded apart."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("dedup", dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
