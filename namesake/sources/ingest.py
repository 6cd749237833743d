"""One submitted article to the five source tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .schema import SCHEMAS

#: What a submission must have, in the order in which it is missed.
REQUIRED = (("title", "Title"), ("authors", "Authors"), ("keywords", "Keywords"), ("subjects", "Subjects"), ("references", "References"))


def validate(article: dict[str, Any]) -> None:
    """ValueError with the first thing that is missing."""
    for key, name in REQUIRED:
        if not article.get(key):
            raise ValueError(f"{name} missing")


def catalogue_entry(entry: dict[str, Any]) -> dict[str, Any]:
    """A reference manager's document as a submission: given names split, source as journal, DOI out of the identifiers."""

    def author(a: dict[str, Any]) -> dict[str, str]:
        parts = (a.get("first_name") or "").split(" ")
        drop = lambda s: s[:-1] if s.endswith(".") else s
        return {"last_name": a.get("last_name") or "", "first_name": drop(parts[0]), "middle_name": drop(parts[1]) if len(parts) > 1 else ""}

    return {
        "title": entry.get("title"), "journal": entry.get("source"), "year": entry.get("year"), "doi": (entry.get("identifiers") or {}).get("doi"),
        "authors": [author(a) for a in entry.get("authors") or []], "keywords": entry.get("keywords") or [],
        "subjects": entry.get("subjects") or [], "references": entry.get("references") or [],
    }


def article_tables(spark: SparkSession, article: dict[str, Any], article_id: int, process_id: int) -> dict[str, DataFrame]:
    """Rows for articles, signatures, keywords, references and subjects; ids are the caller's."""
    validate(article)
    rows = {
        "articles": [(process_id, article_id, article["title"], article.get("journal") or "", None, article.get("doi") or "", article.get("year"))],
        "signatures": [
            (article_id, d, a.get("first_name") or "", (a.get("first_name") or "")[:1], (a.get("middle_name") or "")[:1], a.get("last_name"), a.get("middle_name") or "")
            for d, a in enumerate(article["authors"])
        ],
        "keywords": [(article_id, None, k) for k in article["keywords"]],
        "references": [(article_id, None, r.get("journal"), None, r.get("title")) for r in article["references"]],
        "subjects": [(article_id, s) for s in article["subjects"]],
    }
    return {name: spark.createDataFrame(data, SCHEMAS[name]) for name, data in rows.items()}
