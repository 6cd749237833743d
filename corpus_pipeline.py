"""The corpus pipeline: stages that each call an operator of namesake.llm on what the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.llm import bpe, language_id, mixing, near_dedup, suffix_dedup
from namesake.llm._store import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their lang; what is undetermined goes, and what shares no n-gram with a learned language beyond chance.

    Null, empty and letterless texts are undetermined and go. Long texts are read whole; repeated rows and rows without doc_id are judged
    like others; an empty table, or one without labels, gives an empty result. Other columns are not passed on.
    """
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.learn(docs), carry=COLUMNS)
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") > 0)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least doc_id (null comes last), then of the text with the least hash, and of
    repeated rows one. Rows without a word belong to no group and stay."""
    docs = docs.select(*COLUMNS)
    found = near_dedup.near_duplicates(docs, with_hash=True).withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()})
    names = found.filter("n_shingles > 0").groupBy("id", "none", "text_hash").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    marked = written(names.filter("not first or n > 1"), "marked")
    same = (F.coalesce(docs.doc_id, F.lit(0)) == marked.id) & (docs.doc_id.isNull() == marked.none) & (F.xxhash64(docs.text) == marked.text_hash)
    once = docs.join(marked, same, "left_anti")
    repeated = marked.filter("first")
    if repeated.isEmpty():
        return once
    again = docs.join(repeated, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("other"))
    return once.unionByName(again.select("doc_id", "text", "other.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that also stand elsewhere.

    A null text comes back empty, a text that is all repeats too; a row that is there twice loses what both hold. Rows without
    doc_id are cut like others, long texts whole; an empty table gives an empty result. Other columns are not passed on.
    """
    cut = suffix_dedup.cut_repeats(docs.select(*COLUMNS), with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens are mixed to the target weights.

    Null sources and languages are groups like others; texts without tokens stay. Repeated rows stay or go together, rows without doc_id by
    their texts. Long texts count whole; an empty table gives an empty result. Other columns are not passed on.
    """
    return mixing.mixed(docs.select(*COLUMNS), with_text=True).filter("sampled").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document; none for a null or empty text.

    Rows stand alone, repeated or without doc_id; long texts are encoded whole; an empty table gives an empty result.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has no byte n-gram filters, MinHash components or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
