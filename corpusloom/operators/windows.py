"""Frames over years: sliding pairs of windows, scores across years, peaks, gaps and trims.

Ranges of years are exploded into equi-joins; windows run over tables of one row a year and series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import settle


def anchors(works: DataFrame, year: str, windows: Sequence[int]) -> DataFrame:
    """anchor and window: years from first + w up to but not including last - w."""
    ends = works.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    each = ends.select("lo", "hi", F.explode(F.array(*map(F.lit, windows))).alias("window"))
    return each.where("lo + window <= hi - window - 1").select("window", F.explode(F.expr("sequence(lo + window, hi - window - 1)")).alias("anchor"))


def sliding_pairs(works: DataFrame, year: str, windows: Sequence[int], gap: int = 1, least: int = 1) -> DataFrame:
    """works by anchor, window and side: before is [anchor - window, anchor - gap], after [anchor + gap, anchor + window].

    Pairs with fewer than least works on a side go. Each anchor is exploded to the years that it covers, and the join is on the year.
    """
    a = anchors(works, year, windows)
    cover = a.select("anchor", "window", F.explode(F.expr(f"sequence({gap}, window)")).alias("d")).select("anchor", "window", F.explode(F.array(-F.col("d"), F.col("d"))).alias("d"))
    cover = cover.select("anchor", "window", (F.col("anchor") + F.col("d")).alias(year), F.when(F.col("d") < 0, "before").otherwise("after").alias("side"))
    pairs = works.join(F.broadcast(cover), year)  # years by windows: a few hundred rows
    enough = pairs.groupBy("anchor", "window").agg(F.count_if(F.col("side") == "before").alias("b"), F.count_if(F.col("side") == "after").alias("a")).where(F.least("a", "b") >= least)
    return pairs.join(F.broadcast(enough.select("anchor", "window")), ["anchor", "window"])


def uneven_pairs(works: DataFrame, year: str, windows: Sequence[int], cut: int) -> DataFrame:
    """As sliding_pairs with before [anchor - window - cut, anchor - cut] and after [anchor + 1, anchor + 1 + window]."""
    a = anchors(works, year, windows)
    before = a.select("anchor", "window", F.expr(f"explode(sequence(anchor - window - {cut}, anchor - {cut}))").alias(year), F.lit("before").alias("side"))
    after = a.select("anchor", "window", F.expr("explode(sequence(anchor + 1, anchor + 1 + window))").alias(year), F.lit("after").alias("side"))
    return works.join(F.broadcast(before.union(after)), year)


#: Parts that a group is cut into before its least rows are sought, so that no task sorts a whole group.
PARTS = 256


def equal_n(pairs: DataFrame, key: str, seed: int, most: int, replicates: int | None = None) -> DataFrame:
    """The same number of works on both sides, at most `most`, chosen by a hash of seed, anchor, window and key: a sample that any engine can draw.

    Each part of a side keeps its own `most` first, and only those are ranked together. replicates: so many samples, by replicate, of seeds one after the other."""
    of = ["anchor", "window"] if replicates is None else ["anchor", "window", "replicate"]
    n = pairs.groupBy("anchor", "window").agg(F.least(F.count_if(F.col("side") == "before"), F.count_if(F.col("side") == "after"), F.lit(most)).alias("m"))
    own = F.lit(seed)
    if replicates is not None:
        pairs, own = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), F.lit(seed) + F.col("replicate")
    drawn = F.md5(F.concat_ws("|", own.cast("string"), "anchor", "window", F.col(key).cast("string")))
    part = pairs.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    part = top_per_group(part, most, [drawn, F.col(key)], *of, "side", "part").drop("place", "part")
    return top_per_group(part, most, [drawn, F.col(key)], *of, "side").join(F.broadcast(n), ["anchor", "window"]).where("place <= m").drop("place", "m")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with name: each row's place from 1 in the whole order, which must be total. Ranges of the order are ranked apart and begin after
    what comes before them, so no task sees all rows."""
    part = settle(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    n = part.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = n.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return part.join(F.broadcast(before), "part").withColumn(name, F.col("before") + place).drop("part", "before")


def z_scores(series: DataFrame, value: str, *by: str) -> DataFrame:
    """series with z against the mean and sample deviation of its group; null where that is 0 or unknown. Moments are joined back, so no group is sorted."""
    m = series.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return series.join(m, list(by)).withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def peaks(series: DataFrame, year: str, z: str, above: float, *by: str) -> DataFrame:
    """Rows that stand above both neighbours and above a limit."""
    w = Window.partitionBy(*by).orderBy(year)
    known = series.where(F.col(z).isNotNull())
    return known.withColumns({"p": F.lag(z).over(w), "n": F.lead(z).over(w)}).where((F.col(z) > above) & (F.col("p") < F.col(z)) & (F.col("n") < F.col(z))).drop("p", "n")


def supported(found: DataFrame, year: str, kind: str, within: int, least: int) -> DataFrame:
    """year and n: peaks that at least so many kinds show within some years, and that aren't within them of an earlier such year kept."""
    near = found.select(F.explode(F.expr(f"sequence({year} - {within}, {year} + {within})")).alias("at"), kind)
    years = near.join(found.select(F.col(year).alias("at")).distinct(), "at").groupBy("at").agg(F.count_distinct(kind).alias("n")).where(F.col("n") >= least)
    listed = years.agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("l"))  # a row a year
    kept = f"aggregate(l, CAST(array() AS array<struct<at: bigint, n: bigint>>), (a, x) -> IF(size(a) = 0 OR x.at - element_at(a, -1).at > {within}, concat(a, array(struct(CAST(x.at AS bigint) AS at, x.n AS n))), a))"
    return listed.select(F.explode(F.expr(kept)).alias("x")).select(F.col("x.at").alias(year), "x.n")


def interpolate(series: DataFrame, year: str, value: str, *by: str) -> DataFrame:
    """series whose gaps lie on a line between the known neighbours; at the ends, the nearest known."""
    back = Window.partitionBy(*by).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(year).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(year).alias("t"), F.col(value).alias("v")))
    out = series.withColumns({"p": F.last(point, ignorenulls=True).over(back), "q": F.first(point, ignorenulls=True).over(ahead)})
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col(year) - F.col("p.t")) / F.nullif(F.col("q.t") - F.col("p.t"), F.lit(0))
    return out.withColumn(value, F.coalesce(F.col(value), line, F.col("p.v"), F.col("q.v"))).drop("p", "q")


def ranked(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, the value, place (from 1 within the group, ties in any order) and n (the group's rows) of every row whose value is known. Places are told by ranges of the whole
    order, so no task sorts a whole group."""
    r = df.where(F.col(value).isNotNull()).select(*by, value, F.monotonically_increasing_id().alias("tie"))
    placed = settle(numbered(settle(r), [*(F.col(c) for c in by), F.col(value), F.col("tie")], "place"))
    ends = placed.groupBy(*by).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}"))
    met = placed.alias("p").join(ends.alias("e"), same)
    return met.select(*(F.col(f"p.{c}") for c in by), F.col(f"p.{value}"), (F.col("p.place") - F.col("e.first") + 1).alias("place"), "e.n")


def trimmed(df: DataFrame, value: str, trim: int, *by: str) -> DataFrame:
    """lo, hi and median of each group's values without so many at either end; of groups of no more than twice that, of all."""
    cut = F.when(F.col("n") > 2 * trim, trim).otherwise(0)
    m = F.col("n") - 2 * cut
    at = lambda place: F.max(F.when(F.col("place") == cut + place, F.col(value)))
    middle = (at(F.floor((m + 1) / 2)) + at(F.floor(m / 2) + 1)) / 2
    return ranked(df, value, *by).groupBy(*by).agg(at(F.lit(1)).alias("lo"), at(m).alias("hi"), middle.alias("median"))


def islands(df: DataFrame, year: str) -> DataFrame:
    """first, last and n of runs of consecutive years."""
    r = df.select(year).distinct().withColumn("k", F.col(year) - F.row_number().over(Window.orderBy(year)))
    return r.groupBy("k").agg(F.min(year).alias("first"), F.max(year).alias("last"), F.count("*").alias("n")).drop("k")


def top_per_group(df: DataFrame, k: int, order: Sequence[Column], *by: str) -> DataFrame:
    """The first k rows of each group; Spark keeps k a task and group before it shuffles."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def robust_minmax(df: DataFrame, value: str) -> DataFrame:
    """df with scaled: the value between its 1st and 99th percentile, as a share of that range."""
    ends = df.agg(F.percentile(value, F.lit(0.01)).alias("lo"), F.percentile(value, F.lit(0.99)).alias("hi"))
    x = (F.least(F.greatest(F.col(value), F.col("lo")), F.col("hi")) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", x).drop("lo", "hi")
