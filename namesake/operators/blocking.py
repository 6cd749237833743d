"""Signatures, block keys and candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phonetic import with_metaphone
from ..functions.text import parse_author

KEY_LENGTH = 8


def parsed_signatures(raw: DataFrame, key_length: int = KEY_LENGTH) -> DataFrame:
    """``id, d, author, last_name, fn_initial, mn_initial, focus_name`` from ``id, d, author``."""
    parts = raw.select("id", "d", "author", parse_author("author").alias("n")).select("id", "d", "author", "n.*")
    return with_block_key(parts, key_length)


def built_signatures(parts: DataFrame, key_length: int = KEY_LENGTH) -> DataFrame:
    """The same from ``id, d, last_name, fn_initial, mn_initial``; author is null where a part is."""
    author = F.concat(F.col("last_name"), F.lit(" "), F.col("fn_initial"), F.col("mn_initial"))
    return with_block_key(parts.select("id", "d", author.alias("author"), "last_name", "fn_initial", "mn_initial"), key_length)


def with_block_key(df: DataFrame, key_length: int = KEY_LENGTH) -> DataFrame:
    return with_metaphone(df, "last_name", "focus_name", key_length)


def candidate_pairs(batch: DataFrame, every: DataFrame) -> DataFrame:
    """``id1, d1, id2, d2, focus_name``: ordered pairs of a signature of ``batch`` and any other with its block key.

    An equi-join on the key, so a hot block is a skewed join that adaptive execution splits. Null keys never meet.
    """
    left = batch.select(F.col("id").alias("id1"), F.col("d").alias("d1"), "focus_name")
    right = every.select(F.col("id").alias("id2"), F.col("d").alias("d2"), "focus_name")
    return left.join(right, "focus_name").filter("id1 <> id2 or d1 <> d2").select("id1", "d1", "id2", "d2", "focus_name")


def article_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct unordered article pairs id1 < id2: the grain at which distances are computed."""
    return pairs.filter("id1 <> id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()


def rule_matches(signatures: DataFrame, subjects: DataFrame) -> DataFrame:
    """``id1, d1, id2, d2``: same key, different articles, a subject in common, and initials that do not contradict.

    An article's subjects travel as one array, so two articles with several subjects in common meet once.
    """
    of = subjects.groupBy("id").agg(F.collect_set("subject").alias("subjects"))
    s = signatures.select("id", "d", "focus_name", "fn_initial", "mn_initial").distinct().join(of, "id")
    a, b = s.alias("a"), s.alias("b")
    same = (F.col("a.focus_name") == F.col("b.focus_name")) & (F.col("a.id") != F.col("b.id")) & F.arrays_overlap("a.subjects", "b.subjects")
    agree = lambda c: (F.col(f"a.{c}") == F.col(f"b.{c}")) | F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull() | (F.col(f"a.{c}") == "") | (F.col(f"b.{c}") == "")
    found = a.join(b, same & agree("fn_initial") & agree("mn_initial"))
    return found.select(F.col("a.id").alias("id1"), F.col("a.d").alias("d1"), F.col("b.id").alias("id2"), F.col("b.d").alias("d2")).distinct()


def coauthors(signatures: DataFrame) -> DataFrame:
    """``id, focus_name, coauthor``: for each signature's key the keys of all signatures of its article, itself included."""
    a = signatures.select("id", "focus_name")
    return a.join(signatures.select("id", F.col("focus_name").alias("coauthor")), "id").distinct()


def top_blocks(signatures: DataFrame, n: int) -> DataFrame:
    """The ``n`` block keys with the most signatures, ties by key."""
    return signatures.filter("focus_name is not null").groupBy("focus_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "focus_name").limit(n)
