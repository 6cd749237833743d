"""Scores of pairs with given coefficients, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.340


def logistic(coefficients: dict[str, float], intercept: float) -> Column:
    """Probability from columns and coefficients; null if a column is."""
    z = F.lit(float(intercept))
    for name, weight in coefficients.items():
        z = z + F.col(name) * float(weight)
    return 1 / (1 + F.exp(-z))


def decided(scored: DataFrame, probability: str = "p", threshold: float = THRESHOLD) -> DataFrame:
    """``scored`` with ``same``: probability at or above the threshold, null for null."""
    return scored.withColumn("same", F.col(probability) >= threshold)


def argmax_first(values: Column) -> Column:
    """Place (from 1) of the largest element, the first of equals."""
    return F.array_position(values, F.array_max(values))
