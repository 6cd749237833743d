"""Licence detection by ordered signature rules, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import CERTAINTY, Rule, rules

#: Phrases that are always reported, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PLACE = f"(?i)(?<!{_WORD})(?:" + "|".join(f"{_BREAK}+".join(p.split()) for p in BASE) + f")(?!{_WORD})"
_DETECTION = "array<struct<start:int,back:int,priority:int,rule:int,label:string>>"


def _sql(text: str) -> str:
    if "'" in text:
        raise ValueError("a quote in a rule")
    return f"r'{text}'"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+"))


def gate(found: list[Rule]) -> str:
    """One pattern that every text with a match of a rule or a base phrase matches; words are tried at their starts only."""
    starts = {r.opening for r in found} | {p.split()[0] for p in BASE}
    least = sorted(k for k in starts if not any(k != o and k.startswith(o) for o in starts))
    return "(?i)(?<![0-9a-z])(?:" + "|".join(least) + ")"


def _detections(found: list[Rule]) -> str:
    """Intervals of all rules whose keyword ``held`` has, over column ``low``, sorted by start, longest first."""
    table = ", ".join(f"named_struct('label', {_sql(r.label)}, 'priority', {r.priority}, 'keyword', {_sql(r.keyword)}, 'pattern', {_sql(r.pattern)}, 'rule', {i})" for i, r in enumerate(found))
    places = (
        "aggregate(zip_with(split(low, r.pattern, -1), regexp_extract_all(low, r.pattern, 0), (a, b) -> struct(char_length(a) as a, char_length(b) as b)), "
        f"struct(0 as at, cast(array() as {_DETECTION}) as found), "
        "(acc, x) -> if(x.b is null, acc, struct(acc.at + x.a + x.b as at, "
        "concat(acc.found, array(struct(acc.at + x.a as start, -(acc.at + x.a + x.b) as back, r.priority as priority, r.rule as rule, r.label as label))) as found)), "
        "acc -> acc.found)"
    )
    return f"array_sort(flatten(transform(filter(array({table}), r -> array_contains(held, r.keyword) and low rlike r.pattern), r -> {places})))"


#: Walks detections by start, longest first; ``reach[p]`` is how far those of priority p or stronger reach. One that ends within the
#: reach of its priority is contained in a detection as strong, and falls.
_RESOLVED = f"""
aggregate(detections, struct(array(0, 0, 0, 0, 0) as reach, cast(array() as {_DETECTION}) as kept),
  (acc, x) -> if(acc.reach[x.priority] >= -x.back, acc,
    struct(transform(acc.reach, (v, p) -> if(p >= x.priority, greatest(v, -x.back), v)) as reach, concat(acc.kept, array(x)) as kept)),
  acc -> acc.kept)"""


def scan(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections`` for every row of
    ``docs(doc_id, text)``.

    Words are runs of ASCII letters and digits and other non-ASCII characters, ASCII letters in lower case. n_base counts the
    places of the ``BASE`` phrases, first_word and last_word are the word numbers (from 0) of the first and last, null
    without any. detections holds what the rules found (start, back = -end, priority, rule, label, in code points of
    the text) after containment: a detection inside one of equal or stronger priority falls, equal intervals leave the
    strongest and earliest rule's. labels joins base labels and theirs; score is the certainty of the surest.

    A null or empty text has no words and no labels, the empty string, and score 0. Rows stand alone: repeated rows,
    null doc_ids and other columns change nothing. Texts without any keyword, most of them, run no rule.
    """
    found = rules() if found is None else found
    keywords = ", ".join(_sql(k) for k in sorted({r.keyword for r in found}))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("*", _words(F.col("text")).cast("long").alias("n_words"), F.col("text").rlike(gate(found)).alias("gated"))
    df = df.withColumn("low", F.when(F.col("gated"), F.translate("text", upper, upper.lower())))
    df = df.withColumn("held", F.expr(f"if(low is null, null, filter(array({keywords}), k -> contains(low, k)))"))
    df = df.withColumn("detections", F.expr(f"if(size(held) > 0, {_detections(found)}, null)"))
    df = df.withColumn("detections", F.expr(f"if(size(detections) > 0, {_RESOLVED}, cast(array() as {_DETECTION}))"))
    df = df.withColumn("places", F.when(F.col("gated"), F.expr(f"regexp_extract_all(low, {_sql(_PLACE)}, 0)")))
    some = F.size("places") > 0
    df = df.withColumn("between", F.when(some, F.split("low", _PLACE, -1)))
    start = F.create_map(*(F.lit(x) for p, label in BASE.items() for x in (p[0], label)))
    base = F.when(some, F.array_sort(F.array_distinct(F.transform("places", lambda m: F.element_at(start, F.substring(m, 1, 1)))))).otherwise(F.array().cast("array<string>"))
    certainty = F.create_map(*(F.lit(x) for p in CERTAINTY.items() for x in p))
    surest = F.array_max(F.concat(F.transform("detections", lambda d: F.element_at(certainty, d["priority"])), F.array(F.when(some, CERTAINTY[4]).otherwise(0.0))))
    return df.select(
        "doc_id",
        "n_words",
        F.when(some, F.size("places")).otherwise(0).cast("long").alias("n_base"),
        F.when(some, _words(F.element_at("between", 1))).cast("long").alias("first_word"),
        F.when(some, F.col("n_words") - _words(F.element_at("between", -1)) - _words(F.element_at("places", -1))).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        surest.alias("score"),
        "detections",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
