"""The engine's relations as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phonetic import metaphone_duckdb
from ..functions.text import STOP_WORDS
from ..operators.blocking import parsed_signatures
from .workflow import Corpus


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("processid"), F.col("text").alias("title"), F.concat(F.lit("10."), "doc_id").alias("doi"), (1990 + F.col("n_chars") % 30).alias("year"))


def raw_signatures(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    return t.select(F.col("conv_id").alias("id"), F.col("turn").alias("d"), F.concat(word, F.lit(" "), F.upper(F.substring("role", 1, 2))).alias("author"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return parsed_signatures(raw_signatures(spark, d))


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("id"), "p_name", "p_type", "p_brand")


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return order_parts(spark, d).select("id", F.concat_ws(" ", "p_type", "p_brand").alias("keyword"))


def references(spark: SparkSession, d: str) -> DataFrame:
    return order_parts(spark, d).select("id", F.col("p_name").alias("journal"))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subject"))
    return a.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("subject"))).distinct()


def topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 10 + 1).alias("topic"))


def corpus(spark: SparkSession, d: str) -> Corpus:
    return Corpus(articles(spark, d), signatures(spark, d), keywords(spark, d), references(spark, d), subjects(spark, d), topics(spark, d))


# The same views in DuckDB's SQL.
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


def clean_duckdb(x: str) -> str:
    plain = rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[[:punct:]]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' $', '')"
    return f"CASE WHEN {plain} = '' THEN []::VARCHAR[] ELSE list_filter(string_split({plain}, ' '), lambda w: w NOT IN ({_STOP})) END"


VIEWS = {
    "articles": "SELECT doc_id AS id, doc_id % 50 AS processid, text AS title, '10.' || doc_id AS doi, 1990 + n_chars % 30 AS year FROM documents",
    "raw_signatures": "SELECT conv_id AS id, turn AS d, regexp_extract(text, '([A-Za-z]+)', 1) || ' ' || upper(substr(role, 1, 2)) AS author FROM conversations",
    "parts_": "SELECT id, d, author, nullif(regexp_extract(trim(author), '^(.*)[ \\t\\n\\x0B\\f\\r]+[\\pL\\pN_]+$', 1), '') AS l, nullif(regexp_extract(trim(author), '[ \\t\\n\\x0B\\f\\r]([\\pL\\pN_]+)$', 1), '') AS i FROM raw_signatures",
    "named": "SELECT id, d, author, CASE WHEN l IS NULL THEN trim(author) ELSE trim(l) END AS last_name, CASE WHEN l IS NOT NULL THEN substr(i, 1, 1) END AS fn_initial, CASE WHEN l IS NOT NULL THEN substr(i, 2, 1) END AS mn_initial FROM parts_",
    "signatures": f"SELECT *, {metaphone_duckdb('last_name')} AS focus_name FROM named",
    "order_parts": "SELECT l_orderkey AS id, p_name, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey",
    "keywords": "SELECT id, concat_ws(' ', p_type, p_brand) AS keyword FROM order_parts",
    "references_": "SELECT id, p_name AS journal FROM order_parts",
    "subjects": "SELECT doc_id AS id, source AS subject FROM documents UNION SELECT o_orderkey, o_orderpriority FROM orders",
    "topics": "SELECT doc_id AS id, n_chars % 10 + 1 AS topic FROM documents",
    "pairs": "SELECT a.id AS id1, a.d AS d1, b.id AS id2, b.d AS d2, a.focus_name FROM signatures a JOIN signatures b USING (focus_name) WHERE a.id <> b.id OR a.d <> b.d",
    "apairs": "SELECT DISTINCT id1, id2 FROM pairs WHERE id1 < id2",
    "tokens": " UNION ALL ".join((
        f"SELECT 'title' AS kind, id, unnest({clean_duckdb('title')}) AS token FROM articles WHERE title IS NOT NULL",
        f"SELECT 'keywords', id, unnest({clean_duckdb('keyword')}) FROM keywords WHERE keyword IS NOT NULL",
        f"SELECT 'refs', id, array_to_string({clean_duckdb('journal')}, ' ') FROM references_ WHERE journal IS NOT NULL",
        f"SELECT 'subject', id, unnest({clean_duckdb('subject')}) FROM subjects WHERE subject IS NOT NULL",
        "SELECT 'coauthor', id, focus_name FROM signatures WHERE focus_name IS NOT NULL",
    )),
    "counts": "SELECT kind, id, token, count(*) AS n FROM tokens GROUP BY ALL",
    "totals": "SELECT kind, id, sum(n) AS n FROM counts GROUP BY ALL",
    "common": "SELECT id1, id2, x.kind, sum(least(x.n, y.n)) AS c FROM apairs JOIN counts x ON x.id = id1 JOIN counts y ON y.id = id2 AND y.kind = x.kind AND y.token = x.token GROUP BY ALL",
    "distances": "SELECT p.id1, p.id2, a.kind, 1 - coalesce(c, 0)::DOUBLE / (a.n + b.n - coalesce(c, 0)) AS dist FROM apairs p JOIN totals a ON a.id = p.id1 JOIN totals b ON b.id = p.id2 AND b.kind = a.kind LEFT JOIN common k ON k.id1 = p.id1 AND k.id2 = p.id2 AND k.kind = a.kind",
    "wide": "SELECT id1, id2, " + ", ".join(f"max(dist) FILTER (kind = '{k}') AS dist_{k}" for k in ("title", "keywords", "refs", "subject", "coauthor")) + " FROM distances GROUP BY ALL",
    "sides": "SELECT s.*, year, topic FROM signatures s JOIN articles USING (id) JOIN topics USING (id)",
    "features": "SELECT p.*, CASE WHEN a.fn_initial = b.fn_initial THEN 1 ELSE 0 END AS eq_fn_initial, CASE WHEN a.mn_initial = b.mn_initial THEN 1 ELSE 0 END AS eq_mn_initial, CASE WHEN a.topic = b.topic THEN 1 ELSE 0 END AS eq_lda_topic, abs(a.year - b.year) AS diff_year, "
    + ", ".join(f"CASE WHEN p.id1 = p.id2 THEN 0 ELSE coalesce(dist_{k}, 1) END AS dist_{k}" for k in ("keywords", "refs", "subject", "title", "coauthor"))
    + ", 1.0::DOUBLE AS dist_ethnicity FROM pairs p JOIN sides a ON a.id = p.id1 AND a.d = p.d1 JOIN sides b ON b.id = p.id2 AND b.d = p.d2 LEFT JOIN wide w ON w.id1 = least(p.id1, p.id2) AND w.id2 = greatest(p.id1, p.id2)",
}


def with_views(query: str) -> str:
    """``query`` after the views that it names, directly or through others."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for v, body in VIEWS.items():
            if v not in need and re.search(rf"\b{v}\b", text):
                add(body)
                if v not in need:
                    need.append(v)

    add(query)
    if not need:
        return query
    inner = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in need)
    return f"WITH {inner}, {query[5:]}" if query.startswith("WITH ") else f"WITH {inner} {query}"
