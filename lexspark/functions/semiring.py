"""Semiring arithmetic as Column expressions.

Probabilities stay doubles in the real domain in all tables; negative logarithms are made
at the edges only (files and reports).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of a normalised state, of equal floats, and the cost of a backoff that must not be taken.
NORM_EPS = 0.001
FLOAT_EPS = 1e-6
INF_BACKOFF = 99.0
INFINITY = float("inf")


def neg_log(p: Column) -> Column:
    """-ln p; infinity for 0."""
    return F.when(p > 0, -F.log(p)).otherwise(F.lit(INFINITY))


def prob(cost: Column) -> Column:
    return F.exp(-cost)


def neg_log_sum(a: Column, b: Column) -> Column:
    """-ln(e^-a + e^-b)."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == INFINITY, low).otherwise(low - F.log1p(F.exp(low - high)))


def neg_log_diff(a: Column, b: Column) -> Column:
    """-ln(e^-a - e^-b); null if b is the larger mass."""
    return F.when(b == INFINITY, a).when(a == b, F.lit(INFINITY)).when(a < b, a - F.log1p(-F.exp(a - b)))


def log_sum_exp(cost: Column) -> Column:
    """Aggregate: the cost of all rows together, in the real domain."""
    total = F.sum(F.exp(-cost))
    return F.when(total > 0, -F.log(total)).otherwise(F.lit(INFINITY))


def signed(x: Column) -> Column:
    """(sign, -ln|x|): the signed-log form of a real number."""
    return F.struct(F.signum(x).cast("int").alias("sign"), neg_log(F.abs(x)).alias("mag"))


def unsigned(s: Column) -> Column:
    return s["sign"] * F.exp(-s["mag"])


def lexicographic(first: Column, second: Column) -> Column:
    """A pair whose least value is the semiring sum: structs order by their fields in turn."""
    return F.struct(first.alias("first"), second.alias("second"))
