"""Evaluation of pair decisions and clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEP = tuple(round(0.05 + 0.005 * k, 3) for k in range(190))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion(rows: DataFrame, predicted: str, actual: str, by: tuple[str, ...] = (), positive: int = 1) -> DataFrame:
    """Counts and accuracy, precision, recall, F1 of 0/1 columns; ``positive`` says which value is the class looked for."""
    p, a = F.col(predicted) == positive, F.col(actual) == positive
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counted = rows.filter(p.isNotNull() & a.isNotNull()).groupBy(*by).agg(count(p & a).alias("tp"), count(p & ~a).alias("fp"), count(~p & a).alias("fn"), count(~p & ~a).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counted.select(*by, "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), *_prf(tp, fp, fn))


def macro_mean(metrics: DataFrame, by: str) -> DataFrame:
    """Mean of block metrics for each method; blocks of one row are left out."""
    kept = metrics.filter("tp + fp + fn + tn > 1")
    return kept.groupBy(by).agg(*(F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "precision", "recall", "f1")))


def threshold_sweep(scores: DataFrame, probability: str, actual: str, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """``threshold, precision, recall, f1`` for score > threshold, for each of ``thresholds``.

    Scores are first counted by the number of thresholds they exceed (a binary search in an array, no join), so what is
    summed up is one row for each threshold.
    """
    table = F.array(*map(F.lit, thresholds))
    above = F.size(F.filter(table, lambda t: F.col(probability) > t))
    counted = scores.filter(F.col(probability).isNotNull()).groupBy(above.alias("k")).agg(F.sum(F.when(F.col(actual) == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    steps = scores.sparkSession.range(len(thresholds) + 1).select(F.col("id").cast("int").alias("k"))
    full = steps.join(counted, "k", "left").fillna(0)
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    sums = full.select("k", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("claimed"), F.sum("pos").over(Window.partitionBy(F.lit(0))).alias("all"))
    tp, claimed, every = F.col("tp"), F.col("claimed"), F.col("all")
    return sums.filter("k > 0").select(table[F.col("k") - 1].alias("threshold"), *_prf(tp, claimed - tp, every - tp))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of highest F1, the lowest threshold of equals."""
    return sweep.orderBy(F.desc_nulls_last("f1"), "threshold").limit(1)


def pairwise(clusters: DataFrame, found: str = "found", truth: str = "truth", by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 over pairs in one cluster, for each ``by``, from group sizes: no pair is formed. Null without any pair."""
    n = F.col("n")
    both = clusters.groupBy(*by, found, truth).agg(F.count("*").alias("n"))
    pairs = lambda k, *cols: both.groupBy(*by, *cols).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(n * (n - 1) / 2).alias("pairs")).select(F.lit(k).alias("k"), *by, "pairs")
    tagged = pairs("tp", found, truth).unionByName(pairs("found", found)).unionByName(pairs("truth", truth))
    one = tagged.groupBy(*by).agg(*(F.max(F.when(F.col("k") == k, F.col("pairs"))).alias(k) for k in ("tp", "found", "truth")))
    tp = F.col("tp")
    return one.select(*by, *_prf(tp, F.col("found") - tp, F.col("truth") - tp))


def bcubed(clusters: DataFrame, found: str = "found", truth: str = "truth") -> DataFrame:
    """B-cubed precision, recall and F1: means over items of the overlap's share of its clusters, from group sizes."""
    both = clusters.groupBy(found, truth).agg(F.count("*").alias("n"))
    r = clusters.groupBy(found).agg(F.count("*").alias("r"))
    s = clusters.groupBy(truth).agg(F.count("*").alias("s"))
    joined = both.join(r, found).join(s, truth)
    n = F.col("n")
    means = joined.agg((F.sum(n * n / F.col("r")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("s")) / F.sum(n)).alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return means.select("precision", "recall", _ratio(2 * p * q, p + q).alias("f1"))
