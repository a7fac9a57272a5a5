"""Activation functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default slopes and scales.
LEAKY_SLOPE = 0.1
LEAKY_MAX_SLOPE = 0.01
ELU_ALPHA = 1.0
SWISH_BETA = 1.0


def step(z: Column) -> Column:
    return F.when(z >= 0, 1.0).otherwise(0.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def tanh(z: Column) -> Column:
    return F.tanh(z)


def relu(z: Column) -> Column:
    return F.greatest(F.lit(0.0), z)


def leaky_relu(z: Column, alpha: float = LEAKY_SLOPE) -> Column:
    return F.when(z > 0, z).otherwise(alpha * z)


def leaky_relu_max(z: Column, alpha: float = LEAKY_MAX_SLOPE) -> Column:
    """The greater of ``z`` and ``alpha * z``; equals :func:`leaky_relu` for ``alpha <= 1``."""
    return F.greatest(alpha * z, z)


def elu(z: Column, alpha: float = ELU_ALPHA) -> Column:
    return F.when(z > 0, z).otherwise(alpha * F.expm1(z))


def swish(z: Column, beta: float = SWISH_BETA) -> Column:
    return z * sigmoid(beta * z)


ACTIVATIONS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (step, sigmoid, tanh, relu, leaky_relu, leaky_relu_max, elu, swish)
}


def activate(name: str, z: Column, **parameters: float) -> Column:
    """Apply the activation called ``name``; an unknown name is an error."""
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}, expected one of {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name](z, **parameters)
