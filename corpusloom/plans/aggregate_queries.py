"""Queries over descriptive tables and tests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import special
from corpusloom.operators import describe as D
from corpusloom.operators import quality_flags as Q
from corpusloom.plans.flag_queries import JUDGED, judged
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import EDGES, RECORDS, WORKS, edges, records, works

C = F.col


def _year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long"))


@query("agg_yearly", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 400000) AS large FROM orders GROUP BY 1")
def agg_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _year(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.count_if(C("o_totalprice") > 400000).alias("large"))


@query("agg_growth", "WITH n AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n, round(n / lag(n) OVER (ORDER BY year) - 1, 6) AS growth FROM n")
def agg_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = _year(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"))
    return n.withColumn("growth", F.round(C("n") / F.lag("n").over(Window.orderBy("year")) - 1, 6))


_REFS = "n AS (SELECT o_orderkey, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


@query("agg_refcount", f"WITH {_REFS}, m AS (SELECT CAST(count(*) FILTER (WHERE n = 0) AS DOUBLE) AS \"0\", CAST(count(*) FILTER (WHERE n BETWEEN 1 AND 5) AS DOUBLE) AS \"1-5\", CAST(count(*) FILTER (WHERE n BETWEEN 6 AND 20) AS DOUBLE) AS \"6-20\", CAST(count(*) FILTER (WHERE n BETWEEN 21 AND 50) AS DOUBLE) AS \"21-50\", CAST(count(*) FILTER (WHERE n BETWEEN 51 AND 100) AS DOUBLE) AS \"51-100\", CAST(count(*) FILTER (WHERE n > 100) AS DOUBLE) AS \"100+\", avg(n) AS mean, median(n) AS median, quantile_cont(n, 0.05) AS p5, quantile_cont(n, 0.95) AS p95, CAST(max(n) AS DOUBLE) AS max FROM n) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return D.buckets(n, "n")


@query("agg_coverage", f"WITH {WORKS}, m AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(CASE WHEN doi IS NOT NULL THEN 1.0 ELSE 0 END) AS with_doi, avg(CASE WHEN doi IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (WHERE cited >= 50) AS core_with_doi, avg(CASE WHEN doi IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (WHERE year BETWEEN 1995 AND 1999) AS early, avg(CASE WHEN doi IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (WHERE year >= 2000) AS late FROM works) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.when(C("doi").isNotNull(), 1.0).otherwise(0.0)
    share = lambda c, name: F.avg(F.when(c, has)).alias(name)
    return D.metrics(works(spark, sf_dir).agg(F.count("*").cast("double").alias("total"), F.avg(has).alias("with_doi"), share(C("cited") >= 50, "core_with_doi"), share(C("year").between(1995, 1999), "early"), share(C("year") >= 2000, "late")))


@query("agg_pre2007", f"WITH {EDGES}, o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey IN (SELECT src FROM edges) AS cites FROM orders), m AS (SELECT CAST(count(*) AS DOUBLE) AS works, CAST(count(*) FILTER (WHERE cites) AS DOUBLE) AS with_refs, count(*) FILTER (WHERE cites) / count(*) AS coverage FROM o WHERE y < 1998) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_pre2007(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage before a cut."""
    cites = edges(spark, sf_dir).select(C("src").alias("o_orderkey")).distinct().withColumn("cites", F.lit(True))
    o = _year(spark, sf_dir).where("year < 1998").select("o_orderkey").join(cites, "o_orderkey", "left")
    return D.metrics(o.agg(F.count("*").cast("double").alias("works"), F.count("cites").cast("double").alias("with_refs"), (F.count("cites") / F.count("*")).alias("coverage")))


@query("agg_strata", f"WITH {JUDGED}, s AS (SELECT unnest([{{'axis': 'source', 's': source}}, {{'axis': 'lang', 's': lang}}, {{'axis': 'doi', 's': CASE WHEN doi IS NULL THEN 'no' ELSE 'yes' END}}, {{'axis': 'decile', 's': CAST(cited // 9 AS VARCHAR)}}]) AS x, action = 'remove' AS gone FROM judged) SELECT x.axis AS axis, x.s AS stratum, count(*) AS n, count(*) FILTER (WHERE gone) AS removed, round(count(*) FILTER (WHERE gone) / count(*), 6) AS share FROM s GROUP BY 1, 2")
def agg_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"source": C("source"), "lang": C("lang"), "doi": F.when(C("doi").isNull(), "no").otherwise("yes"), "decile": F.floor(C("cited") / 9)}
    return D.strata(judged(spark, sf_dir), axes, C("action") == "remove")


@query("agg_source_table", "WITH s AS (SELECT source, count(*) AS raw, count(*) FILTER (WHERE n_chars > 500) AS refined FROM documents GROUP BY source) SELECT source, raw, refined, round(100.0 * refined / raw, 4) AS pct FROM s UNION ALL SELECT 'TOTAL', CAST(sum(raw) AS BIGINT), CAST(sum(refined) AS BIGINT), round(100.0 * sum(refined) / sum(raw), 4) FROM s")
def agg_source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("raw"), F.count_if(C("n_chars") > 500).alias("refined"), F.grouping("source").alias("all"))
    return n.select(F.when(C("all") == 1, "TOTAL").otherwise(C("source")).alias("source"), "raw", "refined", F.round(100 * C("refined") / C("raw"), 4).alias("pct"))


@query("agg_langtable", "WITH n AS (SELECT lang AS v, count(*) AS n FROM documents GROUP BY 1) SELECT CASE WHEN n >= 130 THEN v ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds FROM n GROUP BY 1")
def agg_langtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_or_other(table(spark, sf_dir, "documents"), C("lang"), 130)


@query("agg_flow", f"WITH {JUDGED}, s AS (SELECT 0 AS o, 'records' AS Stage, -count(*) AS n FROM judged UNION ALL SELECT 1, 'flag 1', count(*) FILTER (WHERE action = 'remove' AND f1) FROM judged UNION ALL SELECT 2, 'flag 2', count(*) FILTER (WHERE action = 'remove' AND NOT f1 AND f2) FROM judged UNION ALL SELECT 3, 'other', count(*) FILTER (WHERE action = 'remove' AND NOT f1 AND NOT f2) FROM judged), r AS (SELECT *, -sum(n) OVER (ORDER BY o) AS out FROM s) SELECT Stage, CAST(out + greatest(n, 0) AS BIGINT) AS \"In\", greatest(n, 0) AS Removed, CAST(out AS BIGINT) AS Out FROM r")
def agg_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone, j = C("action") == "remove", judged(spark, sf_dir)
    row = j.agg((-F.count("*")).alias("records"), F.count_if(gone & C("f1")).alias("flag 1"), F.count_if(gone & ~C("f1") & C("f2")).alias("flag 2"), F.count_if(gone & ~C("f1") & ~C("f2")).alias("other"))
    stages = row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(c).alias("s"), C(f"`{c}`").alias("n")) for i, c in enumerate(row.columns)))).alias("x")).select("x.*")
    return D.ledger(stages, "o", "s", "n")


@query("agg_xtab", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) FILTER (WHERE o_orderstatus = 'X') AS X FROM orders GROUP BY 1")
def agg_xtab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _year(spark, sf_dir).groupBy("year").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().fillna(0)


_CELLS = "n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT lang, sum(n) AS r FROM n GROUP BY 1), c AS (SELECT source, sum(n) AS c FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n), x AS (SELECT lang, source, coalesce(n, 0) AS o, r * c / t AS e, r, c, t FROM r, c, t LEFT JOIN n USING (lang, source))"
_CELLS = _CELLS.replace("FROM r, c, t LEFT JOIN n USING (lang, source)", "FROM (SELECT * FROM r, c, t) LEFT JOIN n USING (lang, source)")


@query("agg_chi2", f"WITH {_CELLS} SELECT lang, source, o AS observed, round(e, 6) AS expected, round((o - e) / sqrt(e * (1 - r / t) * (1 - c / t)), 5) AS residual FROM x")
def agg_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chi_squared(table(spark, sf_dir, "documents"), "lang", "source").withColumns({"expected": F.round("expected", 6), "residual": F.round("residual", 5)})


@query("st_cramers_v", f"WITH {_CELLS} SELECT round(sqrt(sum((o - e) * (o - e) / e) / (max(t) * (least(count(DISTINCT lang), count(DISTINCT source)) - 1))), 6) AS v FROM x")
def st_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.chi_squared(table(spark, sf_dir, "documents"), "lang", "source")
    chi = F.sum(F.pow(C("observed") - C("expected"), 2) / C("expected"))
    return x.agg(F.round(F.sqrt(chi / (F.sum("observed") * (F.least(F.count_distinct("lang"), F.count_distinct("source")) - 1))), 6).alias("v"))


@query("agg_langstats", "SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4) AS pct, round(avg(n_chars), 4) AS mean, median(n_chars) AS median FROM documents GROUP BY lang")
def agg_langstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    n = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.percentile("n_chars", F.lit(0.5)).alias("median"))
    return n.crossJoin(F.broadcast(d.agg(F.count("*").alias("t")))).select("lang", "n", F.round(100 * C("n") / C("t"), 4).alias("pct"), "mean", "median")


_SIDE = "side AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'S' ELSE 'N' END AS side FROM part)"


@query("agg_flows", f"WITH {EDGES}, {_SIDE} SELECT concat(a.side, '->', b.side) AS flow, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM edges JOIN side a ON src = a.id JOIN side b ON ref = b.id GROUP BY 1")
def agg_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "part").select(C("p_partkey").alias("id"), F.when(C("p_size") % 3 == 0, "S").otherwise("N").alias("side"))
    n = edges(spark, sf_dir).join(side.toDF("src", "a"), "src").join(side.toDF("ref", "b"), "ref").groupBy(F.concat("a", F.lit("->"), "b").alias("flow")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("flow", "n", F.round(100 * C("n") / C("t"), 4).alias("pct"))


@query("agg_core_comp", f"WITH {WORKS} SELECT lang, count(*) FILTER (WHERE cited >= 80) AS core, count(*) AS n, round(count(*) FILTER (WHERE cited >= 80) / count(*), 6) AS share FROM works GROUP BY lang")
def agg_core_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).groupBy("lang").agg(F.count_if(C("cited") >= 80).alias("core"), F.count("*").alias("n")).withColumn("share", F.round(C("core") / C("n"), 6))


@query("agg_venue_top", "SELECT p_brand AS venue, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS cited FROM part GROUP BY 1 ORDER BY n DESC, cited DESC, venue LIMIT 10")
def agg_venue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(C("p_brand").alias("venue")).agg(F.count("*").alias("n"), F.sum("p_size").alias("cited")).orderBy(F.desc("n"), F.desc("cited"), "venue").limit(10)


@query("agg_venue_logodds", "WITH n AS (SELECT p_brand AS venue, count(*) FILTER (WHERE p_size > 25) AS a, count(*) FILTER (WHERE p_size <= 25) AS b FROM part GROUP BY 1) SELECT venue, round(log2((a + 0.5) / (b + 0.5)), 6) AS lean, CASE WHEN log2((a + 0.5) / (b + 0.5)) > 0.1 THEN 'a' WHEN log2((a + 0.5) / (b + 0.5)) < -0.1 THEN 'b' ELSE 'even' END AS side FROM n")
def agg_venue_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy(C("p_brand").alias("venue")).agg(F.count_if(C("p_size") > 25).alias("a"), F.count_if(C("p_size") <= 25).alias("b"))
    lean = F.log2((C("a") + 0.5) / (C("b") + 0.5))
    return n.select("venue", F.round(lean, 6).alias("lean"), Q.cascade([(lean > 0.1, "a"), (lean < -0.1, "b")], "even").alias("side"))


@query("agg_syllabi", f"WITH {WORKS}, t AS (SELECT source, doi IS NOT NULL AS has_doi, source_count FROM works) SELECT coalesce(source, 'TOTAL') AS source, has_doi, count(*) AS n, count(*) FILTER (WHERE source_count >= 2) AS at_least_2 FROM t GROUP BY GROUPING SETS ((source, has_doi), (has_doi))")
def agg_syllabi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = works(spark, sf_dir).select("source", C("doi").isNotNull().alias("has_doi"), "source_count")
    g = t.groupingSets([["source", "has_doi"], ["has_doi"]], "source", "has_doi").agg(F.count("*").alias("n"), F.count_if(C("source_count") >= 2).alias("at_least_2"))
    return g.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "has_doi", "n", "at_least_2")


@query("agg_courses", f"WITH {RECORDS} SELECT doi, count(*) AS n, string_agg(DISTINCT author, ' ; ' ORDER BY author) AS authors FROM records WHERE doi IS NOT NULL GROUP BY doi")
def agg_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where("doi IS NOT NULL")
    return r.groupBy("doi").agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set("author")), " ; "), F.lit("")).alias("authors"))


@query("agg_teaching_inst", "SELECT l_partkey AS work, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 25")
def agg_teaching_inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("work")).agg(F.count_distinct("l_suppkey").alias("n")).where("n >= 25")


@query("agg_missingness", f"WITH {RECORDS}, m AS (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1.0 ELSE 0 END) AS {c}" for c in ("doi", "title", "year", "author")) + " FROM records) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.missingness(records(spark, sf_dir), ["doi", "title", "year", "author"])


@query("agg_distinctive", f"WITH {EDGES}, a AS (SELECT ref, count(*) AS n FROM edges WHERE src % 2 = 0 GROUP BY 1), b AS (SELECT ref, count(*) AS m FROM edges WHERE src % 2 = 1 GROUP BY 1) SELECT coalesce(a.ref, b.ref) AS ref, coalesce(n, 0) AS n, coalesce(m, 0) AS m, round((coalesce(n, 0) + 1) / (coalesce(m, 0) + 1), 6) AS ratio FROM a FULL JOIN b ON a.ref = b.ref WHERE coalesce(n, 0) >= 3 ORDER BY ratio DESC, ref LIMIT 10")
def agg_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = edges(spark, sf_dir).groupBy("ref").agg(F.count_if(C("src") % 2 == 0).alias("n"), F.count_if(C("src") % 2 == 1).alias("m")).where("n >= 3")
    return n.withColumn("ratio", F.round((C("n") + 1) / (C("m") + 1), 6)).orderBy(F.desc("ratio"), "ref").limit(10)


@query("agg_share_break", "WITH p AS (SELECT year(o_orderdate) < 1998 AS early, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS k FROM orders GROUP BY 1) SELECT round(a.k / a.n, 6) AS before, round(b.k / b.n, 6) AS after, round(pow(a.k / a.n - b.k / b.n, 2) / (((a.k + b.k) / (a.n + b.n)) * (1 - (a.k + b.k) / (a.n + b.n)) * (1 / a.n + 1 / b.n)), 5) AS chi2 FROM p a, p b WHERE a.early AND NOT b.early")
def agg_share_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, hit = C("year") < 1998, C("o_orderpriority") == "1-URGENT"
    r = _year(spark, sf_dir).agg(F.count_if(early).alias("n"), F.count_if(~early).alias("m"), F.count_if(early & hit).alias("k"), F.count_if(~early & hit).alias("l"))
    a, b, p = C("k") / C("n"), C("l") / C("m"), (C("k") + C("l")) / (C("n") + C("m"))
    return r.select(F.round(a, 6).alias("before"), F.round(b, 6).alias("after"), F.round(F.pow(a - b, F.lit(2)) / (p * (1 - p) * (1 / C("n") + 1 / C("m"))), 5).alias("chi2"))


_RSS = "(regr_syy(y, x) - CASE WHEN regr_sxx(y, x) > 0 THEN pow(regr_sxy(y, x), 2) / regr_sxx(y, x) ELSE 0 END)"


@query("agg_chow", f"WITH n AS (SELECT CAST(year(o_orderdate) AS DOUBLE) AS x, ln(count(*)) AS y FROM orders GROUP BY year(o_orderdate)), r AS (SELECT {_RSS} AS r FROM n), a AS (SELECT {_RSS} AS r FROM n WHERE x < 1998), b AS (SELECT {_RSS} AS r FROM n WHERE x >= 1998), k AS (SELECT count(*) AS n FROM n) SELECT round(((r.r - a.r - b.r) / 2) / ((a.r + b.r) / (k.n - 4)), 4) AS f FROM r, a, b, k")
def agg_chow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The F statistic of a break in the line through the logarithms of yearly counts."""
    n = _year(spark, sf_dir).groupBy("year").agg(F.ln(F.count("*")).alias("y")).select(C("year").cast("double").alias("x"), "y")
    parts = [F.lit(True), C("x") < 1998, C("x") >= 1998]
    rss = [F.regr_syy(F.when(c, C("y")), C("x")) - F.pow(F.regr_sxy(F.when(c, C("y")), C("x")), F.lit(2)) / F.regr_sxx(F.when(c, C("y")), C("x")) for c in parts]
    r = n.agg(*(e.alias(k) for k, e in zip("rab", rss, strict=True)), F.count("*").alias("n"))
    return r.select(F.round(((C("r") - C("a") - C("b")) / 2) / ((C("a") + C("b")) / (C("n") - 4)), 4).alias("f"))


@query("agg_p_values")
def agg_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test, statistic and p of agg_chi2 (of the whole table), agg_share_break and agg_chow. Each is one row, whose tail a function of that row gives."""
    x = D.chi_squared(table(spark, sf_dir, "documents"), "lang", "source")
    free = (F.count_distinct("lang") - 1) * (F.count_distinct("source") - 1)
    chi = x.agg(F.lit("chi2").alias("test"), F.sum(F.pow(C("observed") - C("expected"), 2) / C("expected")).alias("statistic"), free.cast("double").alias("df1"), F.lit(None).cast("double").alias("df2"))
    share = agg_share_break(spark, sf_dir).selectExpr("'share_break' AS test", "chi2 AS statistic", "1D AS df1", "CAST(null AS double) AS df2")
    years = _year(spark, sf_dir).agg((F.count_distinct("year") - 4).cast("double").alias("df2"))
    chow = agg_chow(spark, sf_dir).crossJoin(years).selectExpr("'chow' AS test", "f AS statistic", "2D AS df1", "df2")  # one row each

    def tails(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            p = [special.chi2_sf(s, a) if pd.isna(b) else special.f_sf(s, a, b) for s, a, b in zip(rows["statistic"], rows["df1"], rows["df2"], strict=True)]
            yield rows[["test", "statistic"]].assign(p=p)

    return chi.unionByName(share).unionByName(chow).where("statistic IS NOT NULL AND df1 > 0").mapInPandas(tails, "test string, statistic double, p double")


@query("agg_adapt", "WITH t AS (SELECT contains(lower(text), 'hand') AS a, contains(lower(text), 'thing') AS b FROM documents) SELECT count(*) FILTER (WHERE a AND NOT b) AS first_only, count(*) FILTER (WHERE b AND NOT a) AS second_only FROM t")
def agg_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.contains(F.lower("text"), F.lit(t)) for t in ("hand", "thing"))
    return table(spark, sf_dir, "documents").agg(F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"))


@query("agg_wilson", "WITH n AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 1500) AS k FROM documents GROUP BY 1), p AS (SELECT source, n, k / n AS p, 1 + 3.8416 / n AS d FROM n) SELECT source, round((p + 3.8416 / (2 * n)) / d - 1.96 / d * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)), 6) AS low, round((p + 3.8416 / (2 * n)) / d + 1.96 / d * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)), 6) AS high FROM p")
def agg_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(C("n_chars") > 1500).alias("k"))
    return n.select("source", D.wilson(C("k"), C("n")).alias("w")).select("source", "w.low", "w.high")


_SCORED = "s AS (SELECT quality = 1 AS pos, least(n_chars, 4000) // 100 AS score FROM documents JOIN labels USING (doc_id))"


@query("agg_auc", f"WITH {_SCORED}, r AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r")
def agg_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.auc(_scored(spark, sf_dir), "score", "pos").select(F.round("auc", 6).alias("auc"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.least("n_chars", F.lit(4000)) / 100).alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", (C("quality") == 1).alias("pos")), "doc_id")


@query("agg_thresholds", f"WITH {_SCORED}, t AS (SELECT unnest([5.0, 10.0, 20.0]) AS cut), c AS (SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (WHERE pos AND score >= cut) AS tp, count(*) FILTER (WHERE NOT pos AND score >= cut) AS fp, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM s, t GROUP BY cut) SELECT cut, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p), 6) AS f1, round(tp / p - fp / q, 6) AS j FROM c")
def agg_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.thresholds(_scored(spark, sf_dir), "score", "pos", [5.0, 10.0, 20.0])


@query("agg_nunique", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def agg_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("agg_cube", "SELECT p_brand AS brand, p_type AS type, count(*) AS n, CAST(grouping(p_brand) * 2 + grouping(p_type) AS BIGINT) AS level FROM part GROUP BY CUBE (p_brand, p_type)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(C("p_brand").alias("brand"), C("p_type").alias("type")).cube("brand", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("agg_rowpct", "WITH n AS (SELECT p_brand AS community, p_type AS cluster, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY community) AS t, row_number() OVER (PARTITION BY community ORDER BY n DESC, cluster) AS place FROM n) SELECT community, cluster, round(n / t, 6) AS share, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2")
def agg_rowpct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, sf_dir, "part").groupBy(C("p_brand").alias("community"), C("p_type").alias("cluster")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("community")
    r = n.select("community", "cluster", F.round(C("n") / F.sum("n").over(w), 6).alias("share"), F.row_number().over(w.orderBy(F.desc("n"), "cluster")).alias("place"))
    return r.where("place <= 2")


@query("agg_keyword_freq", r"WITH k AS (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS keyword FROM part) SELECT keyword, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 4) AS pct FROM k GROUP BY 1")
def agg_keyword_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = p.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(p.agg(F.count("*").alias("t")))).select("keyword", "n", F.round(100 * C("n") / C("t"), 4).alias("pct"))


@query("agg_verify", "WITH m AS (SELECT CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n, avg(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS mean FROM events) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in JSON as metric and value."""
    k = F.from_json("props", "k bigint")["k"]
    return D.metrics(table(spark, sf_dir, "events").agg(F.sum(k).cast("double").alias("total"), F.count("*").cast("double").alias("n"), F.avg(k).alias("mean")))


@query("agg_vars", f"WITH {JUDGED}, m AS (SELECT CAST((SELECT count(*) FROM judged) AS DOUBLE) AS unified, CAST((SELECT count(*) FROM judged WHERE action = 'keep') AS DOUBLE) AS refined, CAST((SELECT count(*) FROM edges) AS DOUBLE) AS edges, CAST((SELECT count(*) FROM judged WHERE cited >= 50) AS DOUBLE) AS core) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named numbers from several tables: rows of one-row tables."""
    j = judged(spark, sf_dir).agg(F.count("*").alias("unified"), F.count_if(C("action") == "keep").alias("refined"), F.count_if(C("cited") >= 50).alias("core"))
    return D.metrics(j).unionByName(D.metrics(edges(spark, sf_dir).agg(F.count("*").alias("edges"))))


@query("agg_lit", "WITH m AS (SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) < 1998) / count(*) FILTER (WHERE year(o_orderdate) < 1998) AS share_before, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) >= 1998) / count(*) FILTER (WHERE year(o_orderdate) >= 1998) AS share_after FROM orders) SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)")
def agg_lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, hit = C("year") < 1998, C("o_orderpriority") == "1-URGENT"
    return D.metrics(_year(spark, sf_dir).agg((F.count_if(early & hit) / F.count_if(early)).alias("share_before"), (F.count_if(~early & hit) / F.count_if(~early)).alias("share_after")))


@query("st_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS x, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS y FROM customer) SELECT round(corr(x, y), 6) AS rho FROM r")
def st_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").select(D.average_rank("c_acctbal").alias("x"), D.average_rank("c_nationkey").alias("y"))
    return r.agg(F.round(F.corr("x", "y"), 6).alias("rho"))


_PART = "n AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS r FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS c FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)"


@query("ml_ari", f"WITH {_PART}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(r * (r - 1) / 2) FROM ra) AS x, (SELECT sum(c * (c - 1) / 2) FROM rb) AS y, (SELECT t * (t - 1) / 2 FROM t) AS m) SELECT round((i - x * y / m) / ((x + y) / 2 - x * y / m), 6) AS ari FROM s")
def ml_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import clusters

    return clusters.adjusted_rand(table(spark, sf_dir, "part"), "p_brand", "p_type").select(F.round("ari", 6).alias("ari"))


@query("st_nmi", f"WITH {_PART}, i AS (SELECT sum(n / t * ln(n * t / (r * c))) AS i FROM n JOIN ra USING (a) JOIN rb USING (b), t), ha AS (SELECT -sum(r / t * ln(r / t)) AS h FROM ra, t), hb AS (SELECT -sum(c / t * ln(c / t)) AS h FROM rb, t) SELECT round(i / ((ha.h + hb.h) / 2), 6) AS nmi FROM i, ha, hb")
def st_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import clusters

    return clusters.mutual_information(table(spark, sf_dir, "part"), "p_brand", "p_type").select(F.round("nmi", 6).alias("nmi"))


@query("st_pearson", "WITH n AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, avg(o_totalprice) AS p FROM orders GROUP BY 1), g AS (SELECT p, n / lag(n) OVER (ORDER BY year) - 1 AS g FROM n) SELECT round(corr(p, g), 5) AS r FROM g")
def st_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = _year(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("p"))
    return n.withColumn("g", C("n") / F.lag("n").over(Window.orderBy("year")) - 1).agg(F.round(F.corr("p", "g"), 5).alias("r"))


@query("st_analytic_null", "WITH n AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1) SELECT year, CAST(0.5 AS DOUBLE) AS null_mean, round(sqrt((a + b + 1) / (12.0 * a * b)), 6) AS null_std FROM n")
def st_analytic_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of an area under the curve without any difference."""
    n = _year(spark, sf_dir).groupBy("year").agg(F.count_if(C("o_orderstatus") == "F").alias("a"), F.count_if(C("o_orderstatus") == "O").alias("b"))
    return n.select("year", F.lit(0.5).alias("null_mean"), F.round(F.sqrt((C("a") + C("b") + 1) / (12.0 * C("a") * C("b"))), 6).alias("null_std"))
