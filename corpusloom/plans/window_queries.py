"""Queries over windows, rankings and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import windows as W
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import EDGES, VECTORS, edges, vectors

C = F.col

#: dated: orders with year. series: by year and status the mean price, some missing.
DATED = "dated AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, o_totalprice AS price FROM orders)"
SERIES = f"{DATED}, series AS (SELECT status, year, CASE WHEN (year + ascii(status)) % 4 <> 0 THEN avg(price) END AS value FROM dated GROUP BY status, year)"
#: pairs: vectors by anchor, window and side.
PAIRS = f"""{VECTORS}, e AS (SELECT min(year) AS lo, max(year) AS hi FROM vectors), a AS (SELECT w AS "window", unnest(range(lo + w, hi - w)) AS anchor FROM e, (VALUES (1), (2)) t(w)),
  pairs AS (SELECT anchor, "window", vec_id, v, label, year, CASE WHEN year < anchor THEN 'before' ELSE 'after' END AS side FROM a JOIN vectors ON year BETWEEN anchor - "window" AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + "window")"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(year(o_orderdate) AS bigint) AS year", "o_orderstatus AS status", "o_totalprice AS price")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dated(spark, sf_dir).groupBy("status", "year").agg(F.avg("price").alias("value"))
    return s.withColumn("value", F.when((C("year") + F.ascii("status")) % 4 != 0, C("value")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding_pairs(vectors(spark, sf_dir), "year", (1, 2))


@query("win_sliding_pair", f'WITH {PAIRS} SELECT anchor, "window", side, count(*) AS n FROM pairs GROUP BY ALL')
def win_sliding_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("anchor", C("window").cast("int").alias("window"), "side").agg(F.count("*").alias("n"))


@query("win_asym_pair", f"""WITH {VECTORS}, e AS (SELECT min(year) AS lo, max(year) AS hi FROM vectors), a AS (SELECT w AS "window", unnest(range(lo + w, hi - w)) AS anchor FROM e, (VALUES (1), (2)) t(w)) SELECT anchor, "window", CASE WHEN year < anchor THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM a JOIN vectors ON year BETWEEN anchor - "window" - 1 AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + 1 + "window" GROUP BY ALL""")
def win_asym_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.uneven_pairs(vectors(spark, sf_dir), "year", (1, 2), 1).groupBy("anchor", "window", "side").agg(F.count("*").alias("n"))


@query("win_lex_break", "SELECT CASE WHEN doc_id % 10 < 4 THEN 'before' ELSE 'after' END AS side, count(*) AS n FROM documents WHERE doc_id % 10 < 4 OR doc_id % 10 BETWEEN 5 AND 7 GROUP BY 1")
def win_lex_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before a break, and the three years after the next."""
    y = table(spark, sf_dir, "documents").select((C("doc_id") % 10).alias("y"))
    return y.where("y < 4 OR y BETWEEN 5 AND 7").groupBy(F.when(C("y") < 4, "before").otherwise("after").alias("side")).agg(F.count("*").alias("n"))


_Z = "z AS (SELECT status, year, value, CASE WHEN stddev_samp(value) OVER (PARTITION BY status) > 0 THEN (value - avg(value) OVER (PARTITION BY status)) / stddev_samp(value) OVER (PARTITION BY status) END AS z FROM series)"


@query("win_zscore", f"WITH {SERIES}, {_Z} SELECT status, year, round(z, 6) AS z FROM z")
def win_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.z_scores(series(spark, sf_dir), "value", "status").select("status", "year", F.round("z", 6).alias("z"))


@query("win_zseries", f"WITH {SERIES}, {_Z} SELECT year, round(avg(z), 6) AS z, count(z) AS n FROM z GROUP BY year")
def win_zseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.z_scores(series(spark, sf_dir), "value", "status").groupBy("year").agg(F.round(F.avg("z"), 6).alias("z"), F.count("z").alias("n"))


@query("win_null_band", f"WITH {SERIES}, m AS (SELECT status, avg(value) AS mu, stddev_samp(value) AS sd FROM series GROUP BY status), n AS (SELECT status, year, avg(price) AS nm, stddev_pop(price) / sqrt(count(*)) AS ns FROM dated GROUP BY 1, 2) SELECT status, year, round((nm - 1.96 * ns - mu) / sd, 5) AS low, round((nm + 1.96 * ns - mu) / sd, 5) AS high FROM n JOIN m USING (status)")
def win_null_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = series(spark, sf_dir).groupBy("status").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    n = dated(spark, sf_dir).groupBy("status", "year").agg(F.avg("price").alias("nm"), (F.stddev_pop("price") / F.sqrt(F.count("*"))).alias("ns")).join(m, "status")
    band = lambda s: F.round((C("nm") + s * 1.96 * C("ns") - C("mu")) / C("sd"), 5)
    return n.select("status", "year", band(-1).alias("low"), band(1).alias("high"))


_PEAK = "p AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS n FROM z WHERE z IS NOT NULL WINDOW w AS (PARTITION BY status ORDER BY year))"


@query("win_local_max", f"WITH {SERIES}, {_Z}, {_PEAK} SELECT status, year FROM p WHERE z > 0.2 AND p < z AND n < z")
def win_local_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.peaks(W.z_scores(series(spark, sf_dir), "value", "status"), "year", "z", 0.2, "status").select("status", "year")


@query("win_robust", f"WITH {DATED}, f AS (SELECT DISTINCT year, status FROM dated WHERE (year + ascii(status)) % 3 = 0), n AS (SELECT a.year, count(DISTINCT b.status) AS n FROM f a JOIN f b ON abs(a.year - b.year) <= 1 GROUP BY 1 HAVING count(DISTINCT b.status) >= 2) SELECT year, n FROM (SELECT *, row_number() OVER (ORDER BY year) AS r FROM n) WHERE r % 2 = 1")
def win_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years here follow one another without gaps, so greedy suppression within one year keeps every second one."""
    f = dated(spark, sf_dir).where((C("year") + F.ascii("status")) % 3 == 0).select("year", "status").distinct()
    return W.supported(f, "year", "status", 1, 2)


@query("win_interp", f"""WITH {SERIES}, k AS (SELECT status, year, value, max(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY status ORDER BY year) AS py, min(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY status ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qy FROM series)
  SELECT k.status, k.year, round(coalesce(k.value, p.value + (q.value - p.value) * (k.year - py) / nullif(qy - py, 0), p.value, q.value), 4) AS value FROM k LEFT JOIN series p ON p.status = k.status AND p.year = py LEFT JOIN series q ON q.status = k.status AND q.year = qy""")
def win_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.interpolate(series(spark, sf_dir), "year", "value", "status").select("status", "year", F.round("value", 4).alias("value"))


@query("win_trim", "WITH r AS (SELECT l_returnflag AS f, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT f, min(q) AS lo, max(q) AS hi, median(q) AS median FROM r WHERE r > 5 AND r <= n - 5 GROUP BY f")
def win_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trimmed(table(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("f"), C("l_quantity").alias("q")), "q", 5, "f")


@query("win_topk", f"WITH {EDGES} SELECT ref, count(*) AS n FROM edges GROUP BY ref ORDER BY n DESC, ref LIMIT 200")
def win_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ref").limit(200)


@query("win_topk_group", f"WITH {EDGES}, n AS (SELECT year, ref, count(*) AS n FROM edges GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, ref) AS place FROM n) SELECT year, ref, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def win_topk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = edges(spark, sf_dir).groupBy("year", "ref").agg(F.count("*").alias("n"))
    return W.top_per_group(n, 10, [F.desc("n"), C("ref")], "year")


@query("win_minmax", "WITH e AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer) SELECT c_custkey, round((least(greatest(c_acctbal, lo), hi) - lo) / (hi - lo), 6) AS scaled FROM customer, e")
def win_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.robust_minmax(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("win_score", "WITH s AS (SELECT s_suppkey, s_acctbal / 10000 AS a, s_nationkey % 9 / 4 AS b, s_suppkey % 2 AS t FROM supplier) SELECT s_suppkey, round(0.4 * a + 0.6 * b + 0.1 * t, 6) AS score FROM s")
def win_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(0.4 * C("s_acctbal") / 10000 + 0.6 * (C("s_nationkey") % 9) / 4 + 0.1 * (C("s_suppkey") % 2), 6).alias("score"))


@query("win_priority", "SELECT doc_id, round(doc_id % 90 + 10 * (1 + doc_id % 3) + 0.01 * (doc_id % 30) + CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) / 16777216 / 1000, 6) AS priority FROM documents")
def win_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, sources and age, with a hash to break ties."""
    tie = F.conv(F.substring(F.md5(C("doc_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216 / 1000
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C("doc_id") % 90 + 10 * (1 + C("doc_id") % 3) + 0.01 * (C("doc_id") % 30) + tie, 6).alias("priority"))


@query("win_sort", f"WITH {DATED} SELECT id, year, CAST(row_number() OVER (ORDER BY year DESC, price DESC, id) AS INTEGER) AS place FROM dated")
def win_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a report, told by place."""
    return W.numbered(dated(spark, sf_dir).select("id", "year", "price"), [F.desc("year"), F.desc("price"), C("id")], "place").select("id", "year", C("place").cast("int").alias("place"))


@query("win_zone", f"WITH {SERIES}, {_Z}, y AS (SELECT year FROM z WHERE z > 0 GROUP BY year HAVING count(*) >= 2), r AS (SELECT year, year - row_number() OVER (ORDER BY year) AS k FROM y) SELECT min(year) AS first, max(year) AS last, count(*) AS n FROM r GROUP BY k")
def win_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = W.z_scores(series(spark, sf_dir), "value", "status").where("z > 0").groupBy("year").agg(F.count("*").alias("n")).where("n >= 2")
    return W.islands(z, "year")


@query("win_layout", f"WITH {DATED} SELECT id, CAST(row_number() OVER (PARTITION BY year, status ORDER BY price DESC, id) AS INTEGER) AS slot, count(*) OVER (PARTITION BY year, status) AS n FROM dated")
def win_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("year", "status")
    return dated(spark, sf_dir).select("id", F.row_number().over(w.orderBy(F.desc("price"), "id")).alias("slot"), F.count("*").over(w).alias("n"))


@query("win_peak", f"WITH {SERIES} SELECT status, arg_max(year, value) AS peak, round(max(value) - min(value), 4) AS spread FROM series GROUP BY status")
def win_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("status").agg(F.max_by("year", "value").alias("peak"), F.round(F.max("value") - F.min("value"), 4).alias("spread"))


@query(
    "rs_sub",
    f"""WITH {PAIRS}, n AS (SELECT anchor, "window", least(count(*) FILTER (WHERE side = 'before'), count(*) FILTER (WHERE side = 'after'), 2000) AS m FROM pairs GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY replicate, anchor, "window", side ORDER BY md5(concat(42 + replicate, '|', anchor, '|', "window", '|', vec_id)), vec_id) AS r FROM pairs, (SELECT CAST(unnest(range(20)) AS INTEGER) AS replicate))
  SELECT replicate, anchor, "window", side, vec_id FROM r JOIN n USING (anchor, "window") WHERE r <= m""",
)
def rs_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty samples of equal number on both sides of each pair."""
    return W.equal_n(pairs(spark, sf_dir), "vec_id", 42, 2000, 20).select("replicate", "anchor", "window", "side", "vec_id")
