"""Activation functions and sums of exponentials as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softmax(values) -> Column:
    """Shares of the exponentials of an array, shifted by its maximum; null for null, empty for empty."""

    def shares(shifted: Column) -> Column:
        return let(_sum(shifted), lambda total: F.transform(shifted, lambda x: x / total))

    return let(_shifted(values), shares)


def log_sum_exp(values) -> Column:
    """Logarithm of the summed exponentials of an array."""
    return F.array_max(values) + F.log(_sum(_shifted(values)))


def _shifted(values) -> Column:
    return let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


#: Derivatives by the value of the function itself.
DERIVATIVES = {"sigmoid": lambda a: a * (1 - a), "tanh": lambda a: 1 - a * a, "relu": lambda a: (a > 0).cast("double")}
