"""Class vectors of last names from a supplied table of labels.

The classes are whatever the label table says; the reference workflow's are census groups. Inferring such groups for people
is sensitive, so this is optional: a pair without class vectors is at distance 1.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import character_bigrams, clean_last_name, soundex_number

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PER_CLASS, TRAIN_SHARE, SEED = 1000, 0.75, 123
#: Per cent of bearers above which a name belongs to a class.
MAJORITY, LARGE = 60.0, 30.0


def labels_from_shares(shares: DataFrame, columns: dict[str, float]) -> DataFrame:
    """``name`` and a 0/1 column for each of ``columns``, 1 where the share is above its limit; "(S)" and null are 0."""
    number = lambda c: F.coalesce(F.expr(f"try_cast(nullif(cast(`{c}` as string), '(S)') as double)"), F.lit(0.0))
    return shares.select("name", *((number(c) > limit).cast("int").alias(c) for c, limit in columns.items()))


def name_features(names: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with ``clean``, its distinct ``bigrams`` and ``soundex_num``; a single letter is doubled."""
    return names.withColumn("clean", clean_last_name(column)).withColumns({"bigrams": character_bigrams("clean"), "soundex_num": F.coalesce(soundex_number("clean"), F.lit(0.0))})


def balanced(labelled: DataFrame, label: str, per_class: int = PER_CLASS, seed: int = SEED) -> DataFrame:
    """About ``per_class`` distinct names of each class, by a seeded order."""
    pick = F.row_number().over(Window.partitionBy(label).orderBy(F.rand(seed)))
    return labelled.dropDuplicates(["name"]).withColumn("_n", pick).filter(F.col("_n") <= per_class).drop("_n")


def fit(spark: SparkSession, labelled: DataFrame, label: str, kind: str = "svm", seed: int = SEED) -> tuple[PipelineModel, DataFrame]:
    """A classifier of names for column ``label``, and its scored held-out quarter."""
    rows = name_features(balanced(labelled.select("name", F.col(label).cast("double").alias("label")), "label", seed=seed))
    train, test = rows.randomSplit([TRAIN_SHARE, 1 - TRAIN_SHARE], seed)
    vocabulary = CountVectorizerModel.from_vocabulary([a + b for a in LETTERS for b in LETTERS], "bigrams", "vector", 1.0)
    vocabulary.setBinary(True)
    model = LinearSVC(maxIter=50) if kind == "svm" else LogisticRegression(maxIter=50)
    fitted = Pipeline(stages=[vocabulary, VectorAssembler(inputCols=["vector", "soundex_num"], outputCol="features"), model]).fit(train)
    return fitted, fitted.transform(test)


def infer(names: DataFrame, models: dict[str, PipelineModel], known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``last_name`` and a 0/1 column for each model, for distinct names that ``known`` lacks, in order of name up to ``limit``."""
    waiting = names.select("last_name").filter("last_name is not null").distinct()
    if known is not None:
        waiting = waiting.join(known.select("last_name"), "last_name", "left_anti")
    if limit is not None:
        waiting = waiting.orderBy("last_name").limit(limit)
    rows = name_features(waiting, "last_name")
    for label, model in models.items():
        rows = model.transform(rows).withColumn(f"_{label}", F.col("prediction").cast("int"))
        rows = rows.drop("vector", "features", "rawPrediction", "probability", "prediction")
    return rows.select("last_name", *(F.col(f"_{label}").alias(label) for label in models))
