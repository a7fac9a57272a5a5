"""Score a table with a single perceptron: ``y = activation(w . x + b)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions.activations import activate
from utterscope.functions.vectors import dot


def linear(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    """``w . x + b`` over named numeric columns."""
    terms = [F.lit(float(w)) * F.col(name) for name, w in weights.items()]
    return reduce(lambda total, term: total + term, terms) + F.lit(float(bias))


def linear_vector(vec: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """``w . x + b`` over an array column."""
    return dot(vec, F.lit([float(w) for w in weights])) + F.lit(float(bias))


def perceptron(frame: DataFrame, z: Column, activation: str, **parameters: float) -> DataFrame:
    """Add the pre-activation ``z`` and the output ``y``."""
    return frame.withColumn("z", z).withColumn("y", activate(activation, F.col("z"), **parameters))


def activation_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, n, mean, min, max, positive_share`` of the outputs of a scored table."""
    return scored.groupBy(*by).agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.avg((F.col("y") > 0).cast("double")).alias("positive_share"),
    )
