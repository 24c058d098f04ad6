"""Descriptive tables: concentration, counts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concentration(df: DataFrame, year: str, venue: str) -> DataFrame:
    """Per year: Herfindahl index, Shannon entropy (natural log), number of venues and of papers.

    Rows whose year or venue is missing or blank are left out. Two hash aggregations, both combined
    before their shuffle: a hot year or venue costs one row a task.
    """
    n = (
        df.where(F.col(year).isNotNull() & F.col(venue).isNotNull() & (F.trim(venue) != ""))
        .groupBy(F.col(year).alias("year"), F.col(venue).alias("venue"))
        .agg(F.count("*").alias("n"))
    )
    # sum p^2 = sum n^2 / N^2 and -sum p ln p = ln N - sum n ln n / N: no window over the year is needed
    return (
        n.groupBy("year")
        .agg(
            F.sum("n").alias("n_papers"),
            F.count("*").alias("n_venues"),
            F.sum((F.col("n") * F.col("n")).cast("double")).alias("sq"),
            F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nln"),
        )
        .select(
            "year",
            F.round(F.col("sq") / (F.col("n_papers") * F.col("n_papers")), 6).alias("hhi"),
            F.round(F.log(F.col("n_papers").cast("double")) - F.col("nln") / F.col("n_papers"), 6).alias("shannon_entropy"),
            "n_venues",
            "n_papers",
        )
    )


def buckets(counts: DataFrame, n: str) -> DataFrame:
    """Distribution of a count column: rows by bucket, mean, median, tails and maximum, as metric and value."""
    c = F.col(n)
    edges = [("0", c == 0), ("1-5", c.between(1, 5)), ("6-20", c.between(6, 20)), ("21-50", c.between(21, 50)), ("51-100", c.between(51, 100)), ("100+", c > 100)]
    aggs = [F.count_if(x).cast("double").alias(k) for k, x in edges]
    aggs += [F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.05)).alias("p5"), F.percentile(c, F.lit(0.95)).alias("p95"), F.max(c).cast("double").alias("max")]
    return metrics(counts.agg(*aggs))


def metrics(row: DataFrame) -> DataFrame:
    """A one-row table of numbers as rows of metric and value (rounded to six places)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(f"`{c}`").cast("double"), 6).alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("x")).select("x.metric", "x.value")


def strata(df: DataFrame, axes: dict[str, Column], removed: Column) -> DataFrame:
    """Rows and removed rows of overlapping strata: each row counts once on every axis, in one aggregation."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("stratum")) for a, c in axes.items()))).alias("s")
    g = df.select(each, removed.alias("gone")).groupBy("s.axis", "s.stratum").agg(F.count("*").alias("n"), F.count_if("gone").alias("removed"))
    return g.select("axis", "stratum", "n", "removed", F.round(F.col("removed") / F.col("n"), 6).alias("share"))


def top_or_other(df: DataFrame, by: Column, least: int) -> DataFrame:
    """Counts by value; values of fewer than least rows together as Other, missing ones as unknown."""
    n = df.groupBy(F.coalesce(by, F.lit("unknown")).alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(F.when((F.col("n") >= least) | (F.col("v") == "unknown"), F.col("v")).otherwise("Other").alias("value")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def ledger(stages: DataFrame, order: str, name: str, n: str) -> DataFrame:
    """Stages with rows removed as In, Removed, Out with running balance. stages: one row each, the first holds the start (negative)."""
    from pyspark.sql import Window

    w = Window.orderBy(order)  # a handful of stages
    out = -F.sum(n).over(w)
    return stages.select(F.col(name).alias("Stage"), (out + F.when(F.col(n) > 0, F.col(n)).otherwise(0)).alias("In"), F.greatest(F.col(n), F.lit(0)).alias("Removed"), out.alias("Out"))


def chi_squared(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cells of a contingency table that has them: observed, expected, standardised residual."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    r, c = n.groupBy(row).agg(F.sum("n").alias("r")), n.groupBy(column).agg(F.sum("n").alias("c"))
    t = n.agg(F.sum("n").alias("t"))
    cells = r.crossJoin(c).crossJoin(F.broadcast(t)).join(n, [row, column], "left")  # distinct values by distinct values
    e = F.col("r") * F.col("c") / F.col("t")
    o = F.coalesce("n", F.lit(0))
    residual = (o - e) / F.sqrt(e * (1 - F.col("r") / F.col("t")) * (1 - F.col("c") / F.col("t")))
    return cells.select(row, column, o.alias("observed"), e.alias("expected"), residual.alias("residual"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that are null or blank, by column, in one pass."""
    return metrics(df.agg(*(F.avg(F.expr(f"CASE WHEN `{c}` IS NULL OR trim(CAST(`{c}` AS string)) = '' THEN 1.0D ELSE 0.0D END")).alias(c) for c in columns)))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """low and high of the interval of a share k / n."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties a half.

    Rows are counted by score first, so ties are one row and the running count is over distinct scores.
    """
    from pyspark.sql import Window

    by = df.groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = by.withColumn("below", F.sum("q").over(w) - F.col("q"))
    return each.agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def thresholds(df: DataFrame, score: str, positive: str, cuts: list[float]) -> DataFrame:
    """Precision, recall, F1 and Youden's J at each of a list of cuts, in one pass."""
    c = F.col(positive)
    aggs = [x for i, t in enumerate(cuts) for x in (F.count_if(c & (F.col(score) >= t)).alias(f"tp{i}"), F.count_if(~c & (F.col(score) >= t)).alias(f"fp{i}"))]
    row = df.agg(*aggs, F.count_if(c).alias("p"), F.count_if(~c).alias("q"))
    each = row.select("p", "q", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("cut"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(cuts)))).alias("x")).select("p", "q", "x.*")
    pr, re = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.col("p")
    return each.select("cut", F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(2 * pr * re / F.nullif(pr + re, F.lit(0.0)), 6).alias("f1"), F.round(re - F.col("fp") / F.col("q"), 6).alias("j"))


def average_rank(c: str, *by: str) -> Column:
    """The mean of the places that equal values would take."""
    from pyspark.sql import Window

    return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
