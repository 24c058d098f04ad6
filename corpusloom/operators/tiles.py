"""Sums over all pairs of vectors, taken tile by tile: blocks of rows meet in tasks that return sums or counts, and no pair leaves its task."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import graph

#: Rows of a block, on average, at least; blocks of a table while they have no more than so many bytes each; and distances taken at a time.
ROWS, BLOCKS, BYTES, CELLS = 512, 48, 1 << 23, 1 << 20


def block_rows(rows: DataFrame, most: int | None = None) -> int:
    """Rows of a block of rows (v), most at most. Each block goes to as many tasks as there are blocks, so their number stays the same while a block's vectors have no more than BYTES: what is
    moved then grows with the rows alone."""
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    held = max(ROWS, BYTES // (8 * max(1, width or 1)))
    return min(max(ROWS, -(-n // BLOCKS)), held if most is None else min(held, most))


def _pairs_of_blocks(rows: DataFrame, group: str, n_rows: int) -> tuple[DataFrame, list[str]]:
    """rows (id, group, ...) dealt so that every two blocks of all groups meet once: keys ga, ba, gb, bb, and first, whether a row is of the block (ga, ba).

    A group's number of blocks follows its count. The blocks are few rows: they are joined, not the rows.
    """
    sizes = graph.settle(rows.groupBy(group).agg(F.ceil(F.count("*") / n_rows).cast("int").alias("blocks")))
    blocks = sizes.select(F.col(group).alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    a, b = blocks.toDF("ga", "ba"), blocks.toDF("gb", "bb")
    met = a.join(b, (F.col("ga") < F.col("gb")) | ((F.col("ga") == F.col("gb")) & (F.col("ba") <= F.col("bb"))))
    keys = ["ga", "ba", "gb", "bb"]
    first = met.select(*keys, F.col("ga").alias(group), F.col("ba").alias("block"), F.lit(True).alias("first"))
    second = met.where("ga <> gb OR ba <> bb").select(*keys, F.col("gb").alias(group), F.col("bb").alias("block"), F.lit(False).alias("first"))
    own = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return own.join(first.unionByName(second), [group, "block"]), keys


def per_tile(rows: DataFrame, group: str, f: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame], schema: str, n_rows: int = ROWS) -> DataFrame:
    """ga, gb and what f returns for every two blocks of rows (id, group, ...), once; f gets one block alone for the pairs within it."""

    def run(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        a, b = both[both["first"]], both[~both["first"]]
        out = f(a, None if (key[0], key[1]) == (key[2], key[3]) else b)
        out.insert(0, "gb", key[2])
        out.insert(0, "ga", key[0])
        return out

    dealt, keys = _pairs_of_blocks(rows, group, n_rows)
    kind = dict(rows.dtypes)[group]
    return graph.spread(dealt, *keys).groupBy(*keys).applyInPandas(run, f"ga {kind}, gb {kind}, {schema}")


def drawn(rows: DataFrame, group: str, replicates: int, most: int | None, seed: int = 42) -> DataFrame:
    """rows (id, group, ...) once for each replicate (replicate): of each group those of smallest hash of seed, replicate and id, so many at most; all, where most is None."""
    each = rows.withColumn("replicate", F.explode(F.array(*map(F.lit, range(replicates)))))
    if most is None:
        return each
    order = Window.partitionBy(group, "replicate").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "replicate", F.col("id"))), "id")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def distance_cube(rows: DataFrame, year: str, dims: Sequence[int]) -> DataFrame:
    """ya <= yb, replicate, dim, pairs and total: the Euclidean distances of all ordered pairs of rows (id, year, replicate, v), by their years.

    Distances in the leading dim coordinates, for every dim in one pass. A pair within a year counts twice, a row with itself once, at 0.
    """

    def tile(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        out = []
        for r in sorted(set(a["replicate"])):
            x = np.array(a.loc[a["replicate"] == r, "v"].tolist(), float)
            y = x if b is None else np.array(b.loc[b["replicate"] == r, "v"].tolist(), float)
            if not len(x) or not len(y):
                continue
            same = b is not None and a["_year"].iloc[0] == b["_year"].iloc[0]
            total, step = dict.fromkeys(sorted(dims), 0.0), max(1, CELLS // len(y))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                square, done = np.zeros((len(part), len(y))), 0
                for d in total:
                    p, q = part[:, done:d], y[:, done:d]
                    square += (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * p @ q.T
                    done = d
                    if b is None:
                        square[np.arange(len(part)), np.arange(at, at + len(part))] = 0
                    total[d] += float(np.sqrt(np.maximum(square, 0)).sum())
            out.extend((int(r), int(d), int(len(x) * len(y) * (1 + same)), s * (1 + same)) for d, s in total.items())
        return pd.DataFrame(out, columns=["replicate", "dim", "pairs", "total"])

    each = rows.select("id", F.col(year).cast("long").alias("_year"), "replicate", "v")
    sums = per_tile(each, "_year", tile, "replicate int, dim int, pairs long, total double", block_rows(each))
    return sums.groupBy(F.col("ga").alias("ya"), F.col("gb").alias("yb"), "replicate", "dim").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def energy_grid(rows: DataFrame, year: str, windows: Sequence[int], gaps: Sequence[int], dims: Sequence[int], replicates: int, most: int | None, least: int = 1) -> DataFrame:
    """dim, window, gap, anchor, value, z_score, n_before and n_after: the energy distance between the years [anchor - window, anchor - gap] and
    [anchor + gap, anchor + window], the median of the replicates, and its z over a cell's anchors.

    rows: id, year and v. All cells come from one cube of sums by two years. A gap of 0 counts as 1, as the anchor's own year is on neither side; anchors with fewer than
    least rows on a side, and gaps beyond the window, give none. z is null where the values don't vary.
    """
    rows = rows.select("id", F.col(year).cast("long").alias(year), "v").where(F.col(year).isNotNull() & F.col("v").isNotNull())
    cube = graph.settle(distance_cube(drawn(rows, year, replicates, most), year, dims))
    years = graph.settle(rows.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n")))  # a row a year
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    cells = [(w, g) for w, g in itertools.product(windows, gaps) if max(g, 1) <= w]
    grid = rows.sparkSession.createDataFrame(cells, "window int, gap int").withColumn("near", F.greatest("gap", F.lit(1)))
    anchors = grid.join(span).select("window", "gap", "near", F.explode(F.sequence("lo", "hi")).alias("anchor"))

    def side(y: Column) -> Column:
        off = F.abs(y - F.col("anchor"))
        return F.when((off >= F.col("near")) & (off <= F.col("window")), F.when(y < F.col("anchor"), "before").otherwise("after"))

    of = ["window", "gap", "anchor"]
    counted = anchors.join(years, F.col("year").between(F.col("anchor") - F.col("window"), F.col("anchor") + F.col("window"))).withColumn("side", side(F.col("year")))
    sizes = counted.groupBy(*of).agg(*(F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in ("before", "after")))
    sizes = sizes.where((F.col("n_before") >= least) & (F.col("n_after") >= least))
    both = cube.withColumn("twice", F.when(F.col("ya") == F.col("yb"), 1).otherwise(2))
    met = anchors.join(both, F.col("ya").between(F.col("anchor") - F.col("window"), F.col("anchor") + F.col("window")) & F.col("yb").between(F.col("anchor") - F.col("window"), F.col("anchor") + F.col("window")))
    met = met.withColumns({"sa": side(F.col("ya")), "sb": side(F.col("yb"))}).where("sa IS NOT NULL AND sb IS NOT NULL")

    def mean(a: str, b: str) -> Column:
        of_ = (F.col("sa") == a) & (F.col("sb") == b)
        times = F.lit(1) if a != b else F.col("twice")
        return F.sum(F.when(of_, F.col("total") * times)) / F.sum(F.when(of_, F.col("pairs") * times))

    value = (2 * mean("before", "after") - mean("before", "before") - mean("after", "after")).alias("value")
    each = met.groupBy("dim", *of, "replicate").agg(value).where("value IS NOT NULL")
    medians = each.groupBy("dim", *of).agg(F.percentile("value", F.lit(0.5)).alias("value")).join(sizes, of)
    cell = Window.partitionBy("dim", "window", "gap")  # a row an anchor
    z = (F.col("value") - F.avg("value").over(cell)) / F.nullif(F.stddev_samp("value").over(cell), F.lit(0.0))
    return medians.select("dim", *of, "value", z.alias("z_score"), "n_before", "n_after")


#: Values of one chunk of a histogram.
CHUNK = 4096


def cosine_histogram(rows: DataFrame, label: str, decimals: int = 5, n_rows: int = 4 * ROWS) -> DataFrame:
    """chunk, within and between: how many pairs of rows (id, label, v) have each cosine, rounded, by whether their labels are the same; CHUNK values a row.

    The histogram has 2 * 10^decimals + 1 values at every size of the table; a tile returns the chunks that it has pairs in.
    """
    scale = 10**decimals
    width = -(-(2 * scale + 1) // CHUNK) * CHUNK

    def tile(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        x = np.array(a["v"].tolist(), float)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        y = x if b is None else np.array(b["v"].tolist(), float)
        y = y if b is None else y / np.sqrt((y * y).sum(axis=1, keepdims=True))
        other = a if b is None else b
        counts = np.zeros((2, width), np.int64)
        for at in range(0, len(x), 256):
            place = np.rint(np.clip(x[at : at + 256] @ y.T, -1, 1) * scale).astype(np.int64) + scale
            same = a["_label"].to_numpy()[at : at + 256, None] == other["_label"].to_numpy()[None, :]
            real = np.ones_like(same) if b is not None else np.arange(at, at + len(place))[:, None] < np.arange(len(y))[None, :]
            for k in (0, 1):
                counts[k] += np.bincount(place[real & (same == (k == 0))], minlength=width)
        chunks = counts.reshape(2, -1, CHUNK)
        held = np.flatnonzero(chunks.any(axis=(0, 2)))
        return pd.DataFrame({"chunk": held.astype(np.int32), "within": [c.astype(float) for c in chunks[0, held]], "between": [c.astype(float) for c in chunks[1, held]]})

    every = rows.select("id", F.col(label).alias("_label"), "v", F.lit(0).alias("_all")).where("_label IS NOT NULL AND v IS NOT NULL")
    every = every.where(F.exists("v", lambda c: c != 0))
    found = per_tile(every, "_all", tile, "chunk int, within array<double>, between array<double>", n_rows)
    total = lambda c: F.transform(vector_to_array(Summarizer.sum(array_to_vector(c))), lambda x: F.round(x)).alias(c)
    return found.groupBy("chunk").agg(total("within"), total("between"))


def rank_statistic(histogram: DataFrame) -> DataFrame:
    """One row: n_within, n_between, u (pairs of a within and a between in which the within is greater, a tie counting half), auc, and z with the variance of ties taken off."""
    h = graph.settle(histogram)
    total = F.struct(*(F.aggregate(c, F.lit(0.0), lambda t, x: t + x).alias(c) for c in ("within", "between")))
    sums = h.select("chunk", total.alias("s")).select("chunk", "s.within", "s.between")
    before = sums.alias("x").join(sums.alias("y"), F.col("y.chunk") < F.col("x.chunk"), "left").groupBy(F.col("x.chunk").alias("chunk")).agg(F.coalesce(F.sum("y.between"), F.lit(0.0)).alias("below"))  # a row a chunk

    def walked(t: Column, z: Column) -> Column:
        w, b = z["within"], z["between"]
        n = w + b
        return F.struct((t["below"] + b).alias("below"), (t["u"] + w * (t["below"] + b / 2)).alias("u"), (t["ties"] + n * n * n - n).alias("ties"))

    start = F.struct(F.col("below").alias("below"), F.lit(0.0).alias("u"), F.lit(0.0).alias("ties"))
    each = h.join(before, "chunk").select(F.aggregate(F.arrays_zip("within", "between"), start, walked).alias("t"))
    one = each.agg(F.sum("t.u").alias("u"), F.sum("t.ties").alias("ties")).crossJoin(sums.agg(F.sum("within").alias("w"), F.sum("between").alias("b")))  # a row each
    n = F.col("w") + F.col("b")
    spread = F.sqrt(F.col("w") * F.col("b") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return one.select(F.col("w").cast("long").alias("n_within"), F.col("b").cast("long").alias("n_between"), "u", (F.col("u") / (F.col("w") * F.col("b"))).alias("auc"), ((F.col("u") - F.col("w") * F.col("b") / 2) / spread).alias("z"))
