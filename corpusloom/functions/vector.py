"""Functions of vectors held as arrays. Single-precision values are widened before any arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def entropy(p: Column) -> Column:
    """Of shares, in natural units."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The squared distance, in natural units."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl(p, m) + kl(q, m)) / 2


def centroid(df, vector: str, *by: str):
    """By group: n and the mean vector, by place; partial sums travel, vectors don't."""
    each = df.select(*by, F.posexplode(wide(F.col(vector))).alias("place", "x")).groupBy(*by, "place").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    if not by:
        return each.agg(F.max("n").alias("n"), _ordered())
    return each.groupBy(*by).agg(F.max("n").alias("n"), _ordered())


def _ordered() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias("centroid")


Metric = Callable[[Column, Column], Column]
