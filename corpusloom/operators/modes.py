"""Hartigan's dip of groups of any size, with its null distribution.

The dip is the least over modes m of the greater of two errors: that of the best convex function up to m, half the greatest distance
between the distribution and the convex minorant of its left limits before m, and that of the best concave one from m on. The first grows with m and
the second falls, so the mode is found by halving, each step linear in the values. A mode may have a mass of its own; the least dip of n values is 1 / (2 n).

A group is told by PARTS of equal numbers of rows at most: each value's place is counted over ranges of the whole order, and a part by its greatest value and its
number. So a group of up to PARTS rows is exact, and of a larger one the dip is off by less than the share of a part; `error` says by how much at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import graph, windows

#: Parts of a group, and the greatest size that null samples are drawn in; above it, the dip times the root of the size stands for all.
PARTS, NULL_SIZE = 1 << 16, 1024


def _minorant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The greatest convex function below the points, at each x (increasing)."""
    xs, ys = x.tolist(), y.tolist()
    px, py = [], []
    for a, b in zip(xs, ys, strict=True):
        while len(px) > 1 and (py[-1] - py[-2]) * (a - px[-2]) >= (b - py[-2]) * (px[-1] - px[-2]):
            px.pop()
            py.pop()
        px.append(a)
        py.append(b)
    return np.interp(x, px, py)


def dip(values: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The dip of values that stand so many times each (once, if not said)."""
    if not len(values):
        return float("nan")
    x, at = np.unique(np.asarray(values, float), return_inverse=True)
    n = np.bincount(at, weights=None if counts is None else np.asarray(counts, float))
    upto = np.cumsum(n) / n.sum()
    below = np.append(0.0, upto[:-1])

    def left(m: int) -> float:
        return float((upto[:m] - _minorant(x[: m + 1], below[: m + 1])[:m]).max(initial=0.0) / 2)

    def right(m: int) -> float:
        return float((-_minorant(-x[m:][::-1], -upto[m:][::-1])[::-1] - below[m:])[1:].max(initial=0.0) / 2)

    lo, hi = 0, len(x) - 1  # the first mode whose left error isn't below its right one
    while lo < hi:
        m = (lo + hi) // 2
        lo, hi = (lo, m) if left(m) >= right(m) else (m + 1, hi)
    return max(0.5 / n.sum(), min(max(left(m), right(m)) for m in (max(0, lo - 1), lo)))


def null_dips(sizes: DataFrame, replicates: int, seed: int = 42, chunk: int = 25) -> DataFrame:
    """size and dip of so many samples of the uniform distribution of each distinct size (size); tasks hold a few samples each, with random streams of their own."""
    parts = sizes.select(F.col("size").cast("long").alias("size")).distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // chunk) - 1))))

    def sample(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
        n = min(chunk, replicates - chunk * int(key[1]))
        return pd.DataFrame({"size": key[0], "dip": [dip(rng.random(int(key[0]))) for _ in range(n)]})

    return graph.spread(parts, "size", "chunk").groupBy("size", "chunk").applyInPandas(sample, "size long, dip double")


def told(rows: DataFrame, value: str, by: Sequence[str], parts: int = PARTS) -> DataFrame:
    """by, n and the parts of each group's values: part, x (its greatest value) and c (its rows). Null values are left out."""
    by = list(by)
    x = F.col(value).cast("double")
    placed = windows.ranked(rows.where(~F.isnan(x)).select(*by, x.alias("x")), "x", *by)
    part = F.when(F.col("n") <= parts, F.col("place") - 1).otherwise(F.floor((F.col("place") - 1) / F.col("n") * parts)).cast("long")
    return placed.groupBy(*by, "n", part.alias("part")).agg(F.max("x").alias("x"), F.count("*").alias("c"))


def dips(rows: DataFrame, value: str, by: Sequence[str], replicates: int = 400, least: int = 20, seed: int = 42, parts: int = PARTS) -> DataFrame:
    """by, n, dip, error and p of each group of rows: the share of uniform samples whose dip is as great; p is null below least rows.

    Samples have the group's size, or NULL_SIZE where it is larger: both dips are then multiplied by the roots of their sizes.
    """
    by = list(by)

    def one(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("part")
        n = int(r["c"].sum())
        error = 0.0 if n <= parts else -(-n // parts) / n
        return pd.DataFrame([(*key[: len(by)], n, dip(r["x"].to_numpy(), r["c"].to_numpy()), error)], columns=[*by, "n", "dip", "error"])

    kinds = dict(rows.dtypes)
    held = told(rows, value, by, parts)
    each = graph.settle(held.groupBy(*by).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long", "dip double", "error double"])))
    size = F.least("n", F.lit(NULL_SIZE)).cast("long")
    null = null_dips(each.where(F.col("n") >= least).select(size.alias("size")), replicates, seed)
    null = null.groupBy("size").agg(F.collect_list("dip").alias("null"))  # replicates a size
    out = each.withColumn("size", size).join(null, "size", "left")
    scaled = F.col("dip") * F.sqrt(F.col("n") / F.col("size"))
    p = F.size(F.filter("null", lambda d: d >= scaled)) / F.size("null")
    return out.select(*by, "n", "dip", "error", F.when(F.col("null").isNotNull(), p).alias("p"))
