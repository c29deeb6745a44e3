"""Patterns as data: checked before use, so that a wrong one loses its own rows only, and learned from candidates."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BODY_WORDS, without_tags
from . import stored


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern | str:
    """A pattern, or what is wrong with it."""
    try:
        return re.compile(pattern, re.S)
    except (re.error, OverflowError, RecursionError) as problem:
        return str(problem) or type(problem).__name__


def problem(pattern: Column) -> Column:
    """Why a pattern can't be used; null if it can, or if there is none."""

    def run(patterns: pa.Array) -> pa.Array:
        found = [p and compiled(p) for p in patterns.to_pylist()]
        return pa.array([p if isinstance(p, str) and p else None for p in found], pa.string())

    return F.arrow_udf(run, "string")(pattern)


def found_by(text: Column, pattern: Column) -> Column:
    """A pattern's first group that isn't empty, else all it finds. Empty without a find or a pattern, null for a wrong pattern."""

    def run(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts, patterns, strict=True):
            use = compiled(p.as_py()) if p.as_py() else ""
            hit = use.search(t.as_py()) if isinstance(use, re.Pattern) and t.is_valid else None
            out.append(None if isinstance(use, str) and use else next((g for g in hit.groups() if g), hit.group()) if hit else "")
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, pattern)


def body_by(html: Column, pattern: Column) -> Column:
    """What a source's own pattern finds in a page, as text without tags and styles; null for a wrong pattern."""
    return without_tags(F.regexp_replace(found_by(html, pattern), r"<style[^>]*>[\s\S]*?</style>", ""))


def split_by_check(rows: DataFrame, pattern_col: str = "pattern") -> tuple[DataFrame, DataFrame]:
    """rows with usable patterns (or none), and the others with the problem: a table to be mended."""
    checked = rows.withColumn("problem", problem(F.col(pattern_col)))
    return checked.filter("problem is null").drop("problem"), checked.filter("problem is not null")


def learned(candidates: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """From candidates (source, place, pattern) the pattern that each source shall have (source, pattern, of), and those that are wrong.

    Candidates come from pages of a source, of which the first `most` by place count. The first usable one that names a
    body is taken, else the shortest usable one. A source without any is not in the first table, so it keeps what it has.
    """
    sampled = candidates.filter(F.coalesce("pattern", F.lit("")) != "").withColumn("_nth", F.row_number().over(Window.partitionBy("source").orderBy("place", "pattern"))).filter(F.col("_nth") <= most).drop("_nth")
    usable, wrong = split_by_check(sampled)
    named = F.col("pattern").rlike("(?i)" + "|".join(BODY_WORDS))
    rank = F.struct(~named, F.when(named, 0).otherwise(F.length("pattern")), "place", "pattern")
    return usable.groupBy("source").agg(F.min_by("pattern", rank).alias("pattern"), F.count(F.lit(1)).alias("of")), wrong


CONFIG = "source string, pattern string"


def put_patterns(spark: SparkSession, path: str, number: int, new: DataFrame) -> None:
    """A new version of a configuration of patterns: new ones replace those of their sources, the rest stay."""
    fresh = new.select("source", "pattern")
    stored.put_version(spark, path, CONFIG, number, lambda old: old.join(fresh.select("source"), "source", "left_anti").unionByName(fresh))
