"""Vector columns (ARRAY<FLOAT or DOUBLE>); all sums run in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > TINY, dot(a, b) / size).otherwise(0.0)


def unit(a: Column | str) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > TINY, x / n).otherwise(0.0))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def mean_abs_diff(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    d = minus(a, b)
    return dot(d, d)


def residual_cosine(qv: Column, qp: Column, pv: Column) -> Column:
    """From the cosines query-node, query-parent and parent-node of unit vectors."""
    return (qv - qp * pv) / F.sqrt(F.greatest(1 - qp * qp, F.lit(TINY)))


def discounted_gain(k: Column) -> Column:
    """Sum of 1 / log2(i + 1) for i from 1 to k (0 for k < 1)."""
    return F.when(k >= 1, F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))).otherwise(0.0)
