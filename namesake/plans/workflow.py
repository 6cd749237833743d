"""The batch run over one process id, and training."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import distance as D
from ..operators.cluster import CUT
from ..operators.features import topic_corpus
from ..operators.scoring import THRESHOLD, decided, logistic
from ..operators.tiles import block_features, signature_tiles
from . import classify, topics

#: Coefficients of a plain pair score, for runs without a trained model.
PLAIN = {"eq_fn_initial": 1.5, "eq_mn_initial": 0.8, "eq_lda_topic": 0.5, "diff_year": -0.05, "dist_keywords": -1.0, "dist_refs": -1.5, "dist_subject": -1.0, "dist_title": -1.2, "dist_coauthor": -2.0, "dist_ethnicity": -0.5}
PLAIN_INTERCEPT = 4.5
#: Articles of a side of the tiles that boosting keeps on disk: an article is there once for each side of its block.
BOOSTED_SIDE = 1024


@dataclass
class Corpus:
    """The tables of a run. articles: processid, id, title, year; signatures: id, d, last_name, fn_initial, mn_initial, focus_name;
    keywords: id, keyword; references: id, journal; subjects: id, subject; topics: id, topic; classes: last_name_1, last_name_2, dist."""

    articles: DataFrame
    signatures: DataFrame
    keywords: DataFrame
    references: DataFrame
    subjects: DataFrame
    topics: DataFrame
    classes: DataFrame | None = None


def valid_process_id(process_id: int | str) -> int:
    """The id as a number; ValueError for anything that is not digits."""
    if not str(process_id).isdigit():
        raise ValueError(f"process id {process_id!r} is not a number")
    return int(process_id)


def all_tokens(c: Corpus, ids: DataFrame | None = None, *, distinct_items: bool = False) -> DataFrame:
    """Tokens of the five kinds, of the articles in ``ids(id)`` if given; ``distinct_items`` counts an item of a child table once for each article, as in training."""

    def once(df: DataFrame, column: str) -> DataFrame:
        chosen = df.select("id", column)
        chosen = chosen if ids is None else chosen.join(ids, "id", "left_semi")
        return chosen.distinct() if distinct_items else chosen

    kinds = [
        D.tokens_of("title", once(c.articles, "title"), "title"),
        D.tokens_of("keywords", once(c.keywords.withColumn("keyword", F.lower("keyword")), "keyword"), "keyword"),
        D.tokens_of("refs", once(c.references, "journal"), "journal", "whole"),
        D.tokens_of("subject", once(c.subjects, "subject"), "subject"),
        D.tokens_of("coauthor", once(c.signatures, "focus_name"), "focus_name", "as_is"),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def ids_of(signatures: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """``id``: the articles with a block key, of the blocks of ``batch(id)`` if given; no other article's text is cut into tokens."""
    keyed = signatures.filter("focus_name is not null")
    if batch is not None:
        keyed = keyed.join(keyed.join(batch, "id", "left_semi").select("focus_name").distinct(), "focus_name", "left_semi")
    return keyed.select("id").distinct()


def batch_features(c: Corpus, process_id: int | str | None = None) -> DataFrame:
    """Features of all candidate pairs of a process's signatures, or of all signatures; one lazy plan."""
    batch = None if process_id is None else c.articles.filter(F.col("processid") == valid_process_id(process_id)).select("id")
    counts = D.token_counts(all_tokens(c, ids_of(c.signatures, batch)))
    return block_features(batch, c.signatures, c.articles, c.topics, counts, c.classes)


def run_batch(c: Corpus, process_id: int | str | None = None, score: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``id1, d1, id2, d2, focus_name, p, same``: decisions for a process's pairs, with a fixed score unless one is given."""
    p = logistic(PLAIN, PLAIN_INTERCEPT) if score is None else score
    scored = batch_features(c, process_id).withColumn("p", p)
    return decided(scored, "p", threshold).select("id1", "d1", "id2", "d2", "focus_name", "p", "same")


def batch_boosted(c: Corpus, label: Callable[[dict], Any], rounds: int = classify.ROUNDS) -> DataFrame:
    """``classify.predict`` of boosting that is fitted to all pairs, ``label`` telling the same author; without a table of pairs."""
    counts = D.token_counts(all_tokens(c, F.broadcast(ids_of(c.signatures))))
    made = classify.boosted_blocks(signature_tiles(None, c.signatures, c.articles, c.topics, counts, c.classes, BOOSTED_SIDE), label, rounds)
    id_type = c.signatures.schema["id"].dataType.simpleString()
    return made.withColumns({i: F.col(i).cast(id_type) for i in ("id1", "id2")})


def _matrices(c: Corpus, limit: float) -> DataFrame:
    counts = D.token_counts(all_tokens(c, F.broadcast(ids_of(c.signatures))))  # the ids alone, so no text is shuffled
    return blocks.matrices(c.signatures, c.articles, c.topics, counts, PLAIN, PLAIN_INTERCEPT, limit, c.classes)


def batch_clusters(c: Corpus, cut: float = CUT) -> DataFrame:
    """``cluster.clusters(run_batch(c), cut)`` of all processes without a table of pairs."""
    return blocks.clusters(_matrices(c, blocks.limit_of(cut)), cut)


def batch_cut_sweep(c: Corpus, step: float = 0.05) -> DataFrame:
    """``cluster.cut_sweep(run_batch(c), step)`` of all processes without a table of pairs."""
    return blocks.cut_sweep(_matrices(c, blocks.limit_of()), step)


def run_trained(c: Corpus, model: PipelineModel, process_id: int | str | None = None, topic_model: tuple | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``run_batch`` with a trained pair model, after topics are inferred for articles that have none (if a topic model is given)."""
    if topic_model is not None:
        c = replace(c, topics=c.topics.select("id", "topic").unionByName(topics.infer(topic_corpus(c.articles, c.keywords), topic_model, known=c.topics)))
    scored = classify.score(model, batch_features(c, process_id))
    return decided(scored, "p", threshold).select("id1", "d1", "id2", "d2", "focus_name", "p", "same")


def results(same: DataFrame, signatures: DataFrame, articles: DataFrame, process_id: int | None, limit: int | None = 500) -> DataFrame:
    """``d1, title, doi, author``: for each author of a process's article the articles found to be theirs; of all processes with ``processid`` before, without a process id."""
    mine = articles.select(F.col("id").alias("id1"), "processid")
    keys = ["processid", "d1"] if process_id is None else ["d1"]
    found = same.filter("same").select("id1", "d1", "id2", "d2").join(mine if process_id is None else mine.filter(F.col("processid") == process_id), "id1")
    # Both left joins are one, on the article: its signatures and its own rows travel as lists, so pairs are shuffled by it once.
    authors = signatures.filter("id is not null").groupBy("id").agg(F.collect_list(F.struct("d", "author")).alias("authors"))
    own = articles.filter("id is not null").groupBy("id").agg(F.collect_list(F.struct("title", "doi")).alias("own"))
    other = authors.join(own, "id", "full").withColumnRenamed("id", "id2")
    author = F.explode_outer(F.filter("authors", lambda s: s["d"] == F.col("d2"))).alias("s")
    named = found.select(*keys, "id2", "d2").join(other, "id2", "left").select(*keys, "own", author).select(*keys, F.explode_outer("own").alias("o"), "s.author")
    out = named.select(*keys, "o.title", "o.doi", "author")
    return out if limit is None else out.orderBy(*keys, "title", "doi", "author").limit(limit)


def grouped_results(rows: DataFrame) -> DataFrame:
    """``d1, related`` (after ``processid``, if ``rows`` has it): one row for each place from 0 to the process's largest, with an empty list where nothing was found."""
    keys = [k for k in ("processid",) if k in rows.columns]
    top = rows.groupBy(*keys).agg(F.max("d1").alias("top")).select(*keys, F.explode(F.sequence(F.lit(0), "top")).alias("d1"))
    lists = rows.groupBy(*keys, "d1").agg(F.array_sort(F.collect_list(F.struct("title", "doi", "author"))).alias("related"))
    return top.join(lists, [*keys, "d1"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<struct<title:string,doi:string,author:string>>")))


def result_counts(rows: DataFrame) -> DataFrame:
    """``d1, n_related`` (after ``processid``, if ``rows`` has it): the lengths of the lists of ``grouped_results``, without gathering them."""
    keys = [k for k in ("processid",) if k in rows.columns]
    counted = rows.groupBy(*keys, "d1").agg(F.count("*").alias("n_related"))
    top = counted.groupBy(*keys).agg(F.max("d1").alias("top")).select(*keys, F.explode(F.sequence(F.lit(0), "top")).alias("d1"))
    return top.join(counted, [*keys, "d1"], "left").withColumn("n_related", F.coalesce("n_related", F.lit(0).cast("long")))
