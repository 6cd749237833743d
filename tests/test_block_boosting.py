"""Boosting over the distinct binned rows of tiles against Spark's boosting over a table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesake.operators import boosting
from namesake.operators.features import FEATURES
from namesake.plans import classify, queries, testdata, workflow

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(4000).withColumn("same_author", (F.rand(1) < 0.4).cast("int"))
    noisy = lambda i: F.round((1 - F.col("same_author")) * 0.3 + F.rand(i) * 0.7, 3)
    few = lambda i: F.floor(F.rand(i) * 3) * 0.5
    return made.select("id", "same_author", *((noisy(i) if f in ("dist_title", "dist_refs") else few(i)).alias(f) for i, f in enumerate(FEATURES))).persist()


def keyed(spark, rows):
    cuts = classify.thresholds(rows, FEATURES)
    frame = rows.orderBy("id").toPandas()
    bins = [np.searchsorted(c, frame[f].to_numpy(float), side="right").astype(np.uint8) for f, c in zip(FEATURES, cuts, strict=True)]
    key, weight = np.unique(boosting.packed(frame.same_author.to_numpy(), bins), return_counts=True)
    return spark.createDataFrame(list(zip(key.tolist(), weight.tolist(), strict=True)), "key long, weight long").persist(), [len(c) + 1 for c in cuts], bins


@pytest.mark.parametrize("task_rows", [250_000, 900])
def test_the_trees_are_those_of_spark(spark, rows, monkeypatch, task_rows):
    """In one task, and in several that add up their sums."""
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    want = {r.id: r.p for r in classify.score(classify.fit(rows, "boosting", rounds=20), rows).collect()}
    keys, sizes, bins = keyed(spark, rows)
    trees = boosting.grow(keys, sizes, 20, classify.STEP)
    p = 1 / (1 + np.exp(-2 * boosting.margin_of(boosting.margins(trees, sizes, classify.STEP), bins)))
    assert len(trees) == 20 and np.abs(p - [want[i] for i in range(4000)]).max() < 1e-9


def test_one_label_or_no_row_makes_no_split(spark):
    one = spark.createDataFrame([(1, 3), (1 | 1 << 1, 2)], "key long, weight long")
    assert boosting.grow(one, [2], 2, 0.05)[0] == 1.0
    assert boosting.grow(one.filter("key = 0"), [2], 2, 0.05) == []


def test_classified_blocks_are_classified_pairs(spark, monkeypatch):
    """Also with many keys sent on before a task ends; an article without a year has no decision."""
    monkeypatch.setattr(classify, "HELD_KEYS", 100)
    c = testdata.corpus(spark, TINY)
    c.articles = c.articles.withColumn("year", F.when(F.col("id") % 7 != 0, F.col("year")))
    made = workflow.batch_features(c).persist()
    made = made.withColumn("same_author", queries._same_author({f: F.col(f) for f in FEATURES}).cast("int"))
    want = classify.predict(classify.fit(made, "boosting", rounds=8), made)
    found = workflow.batch_boosted(c, queries._same_author, rounds=8)
    assert found.dtypes == want.dtypes
    want, found = (sorted(map(str, x.collect())) for x in (want, found))
    assert found == want and {x.rsplit("=", 1)[1] for x in found} >= {"None)", "True)", "False)"}


def test_tiles_are_made_once(spark):
    found = queries.QUERIES["classified_pairs"](spark, TINY)
    assert "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == workflow.batch_features(testdata.corpus(spark, TINY)).count()
