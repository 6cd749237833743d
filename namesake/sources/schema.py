"""Schemas of the relations, and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "articles": "processid int, id int, title string, journal string, type string, doi string, year int",
    "signatures": "id int, d int, first_name string, fn_initial string, mn_initial string, last_name string, middle_name string",
    "institutions": "id int, d int, institution string",
    "keywords": "id int, type_keyword string, keyword string",
    "references": "id int, first_author string, journal string, year int, title string",
    "subjects": "id int, subject string",
    "articles_authors": "id int, d int, author string, last_name string, fn_initial string, mn_initial string, focus_name string",
    "authors_disambiguated": "author_id long, id int, d int",
    "same_authors": "id1 int, d1 int, id2 int, d2 int, focus_name string, same boolean",
    "last_name_classes": "last_name string, aian int, api int, black int, hispanic int, tworace int, white int",
    "lda_topic": "id int, topic int",
}
KEYS = {
    "signatures": ("id", "d"), "articles_authors": ("id", "d"), "authors_disambiguated": ("id", "d"),
    "same_authors": ("id1", "d1", "id2", "d2", "focus_name"), "last_name_classes": ("last_name",), "lda_topic": ("id",),
}


def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that stand more than once, with their counts; null keys are not compared."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_key(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``df`` itself, or ValueError with one of the repeated keys."""
    found = duplicates(df, key).first()
    if found is not None:
        raise ValueError(f"key {key} repeats: {found.asDict()}")
    return df
