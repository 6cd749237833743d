"""Topic model of articles."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..functions.text import clean_field
from ..operators.scoring import argmax_first

TOPICS = 10


def terms(corpus: DataFrame) -> DataFrame:
    """``id, terms``: stemmed words of each text, numbers and stop words left out."""
    words = corpus.select("id", F.explode(clean_field(F.regexp_replace("text", "[0-9]+", ""))).alias("word")).filter("word <> ''")
    counted = words.groupBy("id", "word").agg(F.count("*").cast("int").alias("n"))
    return stemmed(counted).groupBy("id").agg(F.flatten(F.collect_list(F.expr("array_repeat(stem, n)"))).alias("terms"))


def fit(corpus: DataFrame, k: int = TOPICS, seed: int = 123, iterations: int = 20) -> tuple[CountVectorizerModel, LDAModel]:
    counted = terms(corpus)
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", vocabSize=1 << 16).fit(counted)
    return vocabulary, LDA(k=k, seed=seed, maxIter=iterations, optimizer="online").fit(vocabulary.transform(counted))


def infer(corpus: DataFrame, model: tuple[CountVectorizerModel, LDAModel], known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``id, topic`` (from 1) of the texts without a topic in ``known``, at most ``limit`` of them in order of id."""
    waiting = corpus if known is None else corpus.join(known.select("id"), "id", "left_anti")
    if limit is not None:
        waiting = waiting.orderBy("id").limit(limit)
    vocabulary, lda = model
    posterior = vector_to_array(F.col("topicDistribution"))
    return lda.transform(vocabulary.transform(terms(waiting))).select("id", argmax_first(posterior).cast("int").alias("topic"))
