"""Vector arithmetic on array columns, in double precision and without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(x: Column, nan: float, plus: float, minus: float) -> Column:
    """Replaces NaN and the infinities."""
    return F.when(F.isnan(x), nan).when(x == float("inf"), plus).when(x == float("-inf"), minus).otherwise(x)


def steady(v: Column) -> Column:
    """In doubles, NaN replaced by 0 and the infinities by 1 and -1."""
    return F.transform(v, lambda x: finite(x.cast("double"), 0.0, 1.0, -1.0))


def unit(v: Column) -> Column:
    """Steady and of length 1; a zero vector stays as it is."""
    whole = F.transform(F.array(steady(v)), lambda s: F.struct(s.alias("s"), norm(s).alias("n")))
    return F.get(F.transform(whole, lambda w: F.transform(w["s"], lambda x: x / F.when(w["n"] == 0, 1.0).otherwise(w["n"]))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1] of steady vectors; a zero vector has norm 1 here, so its similarity is 0."""
    return unit_cosine(unit(a), unit(b))


def unit_cosine(a: Column, b: Column) -> Column:
    """The same of vectors that `unit` made."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays, steady ones; 1 where either has no variance."""
    a, b = steady(a), steady(b)
    n = F.size(a)
    x, y = total(doubles(a)) / n, total(doubles(b)) / n
    cov, va, vb = dot(a, b) - n * x * y, dot(a, a) - n * x * x, dot(b, b) - n * y * y
    return F.when((va <= 1e-12) | (vb <= 1e-12), 1.0).otherwise(cov / F.sqrt(va * vb))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
