"""Queries over resampling, kernels, clustering, and summaries of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import clusters, graph, kernels, modes, tiles
from corpusloom.operators import divergence as D
from corpusloom.operators import windows as W
from corpusloom.plans.divergence_queries import MOST_TERMS, WHOLE, brands, drawn, lexical_sample, whole
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import VECTORS, edges, vectors
from corpusloom.plans.window_queries import DATED, dated, series

C = F.col


def edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges by window and side."""
    e = edges(spark, sf_dir).where("src <> ref")
    return W.sliding_pairs(e, "year", (1, 2)).select("anchor", C("window").cast("int").alias("window"), "side", "src", "ref").distinct()


@query("div_s4")
def div_s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.by_pair(drawn(spark, sf_dir), "v", kernels.frechet)


@query("div_c2st_emb")
def div_c2st_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.two_sample(drawn(spark, sf_dir), "v")


@query("div_c2st_lex")
def div_c2st_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As div_c2st_emb on the weights of the whole vocabulary."""
    return kernels.sparse_two_sample(lexical_sample(spark, sf_dir), "doc_id", MOST_TERMS)


@query("div_g1")
def div_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.rank_shift(edge_pairs(spark, sf_dir))


@query("div_g2")
def div_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.graph_shift(edges(spark, sf_dir), (1, 2), kernels.spectral_gap)


@query("div_g5")
def div_g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of the exponent of in-degrees, from counts of degrees alone."""
    return D.exponent_shift(edge_pairs(spark, sf_dir), "ref")


@query("div_g8")
def div_g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.graph_shift(edges(spark, sf_dir), (1, 2), kernels.betweenness)


@query("rs_perm")
def rs_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.permutation_energy(drawn(spark, sf_dir), "v")


@query("rs_boot")
def rs_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.bootstrap(drawn(spark, sf_dir), "v", kernels.energy)


@query("rs_summary")
def rs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the bootstrap's median and quantiles and the permutation's z and p."""
    boot = kernels.bootstrap(drawn(spark, sf_dir), "v", kernels.energy).groupBy("anchor", "window").agg(*(F.percentile("value", F.lit(q)).alias(n) for n, q in (("boot_median", 0.5), ("boot_q025", 0.025), ("boot_q975", 0.975))))
    null = kernels.permutation_energy(drawn(spark, sf_dir), "v")
    return null.join(boot, ["anchor", "window"], "left").select("anchor", "window", C("observed").alias("point_estimate"), "boot_median", "boot_q025", "boot_q975", "z_score", "p_value", (C("p_value") < 0.05).alias("significant"))


@query("rs_cp")
def rs_cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.change_points(series(spark, sf_dir), "year", "value", ["status"])


_BREAKS = f"{DATED}, b AS (SELECT DISTINCT status, year FROM dated WHERE (year * 3 + ascii(status)) % 4 = 0)"


@query("rs_conv", f"WITH {_BREAKS}, y AS (SELECT unnest(range(1995, 2002)) AS year) SELECT y.year, count(*) AS n_total, round(100.0 * count(*) / (SELECT count(*) FROM b), 4) AS pct_total, string_agg(DISTINCT status, ';' ORDER BY status) AS methods FROM y JOIN b ON b.year BETWEEN y.year - 1 AND y.year + 1 GROUP BY 1")
def rs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each year the breaks that any series has within one year."""
    b = dated(spark, sf_dir).where((C("year") * 3 + F.ascii("status")) % 4 == 0).select("status", "year").distinct()
    near_ = b.select("status", F.explode(F.sequence(C("year") - 1, C("year") + 1)).alias("year")).where("year BETWEEN 1995 AND 2001")
    n = near_.groupBy("year").agg(F.count("*").alias("n_total"), F.array_join(F.array_sort(F.collect_set("status")), ";").alias("methods"))
    return n.crossJoin(F.broadcast(b.agg(F.count("*").alias("t")))).select("year", "n_total", F.round(100 * C("n_total") / C("t"), 4).alias("pct_total"), "methods")


@query("rs_sample", f"WITH {DATED}, n AS (SELECT status, greatest(1, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM dated)) AS BIGINT)) AS k FROM dated GROUP BY 1), r AS (SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY md5(concat('7|', id)), id) AS r FROM dated) SELECT id, status FROM r JOIN n USING (status) WHERE r <= k")
def rs_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 100 rows, by share of status and at least one of each, drawn by a hash."""
    d = dated(spark, sf_dir)
    n = d.groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("t"))))
    k = n.select("status", F.greatest(F.lit(1), F.floor(100 * C("n") / C("t"))).alias("k"))
    ranked = W.top_per_group(d, 100, [F.md5(F.concat(F.lit("7|"), C("id").cast("string"))), C("id")], "status")
    return ranked.join(F.broadcast(k), "status").where("place <= k").select("id", "status")


@query("rs_null_sep")
def rs_null_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.rewiring_null(whole(spark, sf_dir), brands(spark, sf_dir), 1000)


@query("gr_louvain")
def gr_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole graph at several resolutions; one task holds it."""
    e = whole(spark, sf_dir).select(F.lit("all").alias("graph"), "a", "b", F.lit(1).alias("n"))
    return kernels.communities(e, ["graph"], (0.5, 1.0, 1.5, 2.0))


_ROUND = "v{0} AS (SELECT node, label FROM l{1} UNION ALL SELECT s.a, label FROM s JOIN l{1} ON s.b = node), c{0} AS (SELECT node, label, count(*) AS n FROM v{0} GROUP BY 1, 2), l{0} AS MATERIALIZED (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, label) AS r FROM c{0}) WHERE r = 1)"


@query("gr_label_propagation", f"WITH {WHOLE}, s AS (SELECT a, b FROM whole UNION SELECT b, a FROM whole), l0 AS (SELECT DISTINCT a AS node, a AS label FROM s), {_ROUND.format(1, 0)}, {_ROUND.format(2, 1)}, {_ROUND.format(3, 2)} SELECT node, label FROM l3")
def gr_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of graphs that no single task can hold."""
    return graph.label_propagation(whole(spark, sf_dir), 3)


@query("gr_rewire")
def gr_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, rewired."""
    return kernels.rewired(whole(spark, sf_dir))


@query("win_quota")
def win_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best orders with quotas. Of each kind the 100 best are enough: no choice of 100 takes a worse one."""
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_totalprice").alias("score"), (C("o_orderstatus") == "P").alias("p"), (C("o_orderpriority") == "5-LOW").alias("low"))
    best = W.top_per_group(o, 100, [F.desc("score"), C("id")], "p", "low").drop("place").withColumn("g", F.lit(0))
    return best.groupBy("g").applyInPandas(lambda r: kernels.quota_selection(r.reset_index(drop=True), 100, {"p": 40, "low": 30}, "score", "id")[["id", "score", "p", "low"]], "id long, score double, p boolean, low boolean")


@query("ml_kmeans")
def ml_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.kmeans(vectors(spark, sf_dir).select("vec_id", "v"), "v", 6).select("vec_id", C("cluster").cast("long").alias("cluster"))


@query("ml_silhouette")
def ml_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(clusters.silhouette(vectors(spark, sf_dir), "v", [3, 6]), "k long, silhouette double")


@query("ml_cluster_compare")
def ml_cluster_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two clusterings of the same rows."""
    v = clusters.kmeans(vectors(spark, sf_dir).select("vec_id", "label", "v"), "v", 6)
    return clusters.adjusted_rand(v, "label", "cluster")


@query("ml_umap")
def ml_umap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components: a stand-in for a neighbour embedding, which this environment lacks."""
    return clusters.project(vectors(spark, sf_dir).select("vec_id", "v"), "v", 2).select("vec_id", C("projected")[0].alias("x"), C("projected")[1].alias("y"))


@query("ml_gmm")
def ml_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(C("v")[0].alias("x"))
    return spark.createDataFrame([("delta_bic", clusters.delta_bic(v, "x"))], "metric string, value double")


@query("ml_dip")
def ml_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hartigan's dip of a coordinate of every vector and its p, by label, over all years and by period."""
    v = vectors(spark, sf_dir).select("label", C("v")[0].alias("x"), F.explode(F.array(F.lit("all"), F.when(C("year") <= 1997, "to 1997").otherwise("from 1998"))).alias("period"))
    return modes.dips(v, "x", ["label", "period"])


@query("ml_grid", f"WITH {VECTORS}, g AS (SELECT w, k FROM (VALUES (1), (2)) t(w), (VALUES (1), (2)) s(k) WHERE k <= w), e AS (SELECT min(year) AS lo, max(year) AS hi FROM vectors), a AS (SELECT w, k, unnest(range(lo + w, hi - w)) AS anchor FROM e, g) SELECT CAST(w AS INTEGER) AS \"window\", CAST(k AS INTEGER) AS gap, anchor, count(*) FILTER (WHERE year < anchor) AS n_before, count(*) FILTER (WHERE year > anchor) AS n_after FROM a JOIN vectors ON year BETWEEN anchor - w AND anchor - k OR year BETWEEN anchor + k AND anchor + w GROUP BY ALL")
def ml_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a grid of windows and gaps."""
    cells = [W.sliding_pairs(vectors(spark, sf_dir).select("vec_id", "year"), "year", [w for w in (1, 2) if w >= g], g).withColumn("gap", F.lit(g)) for g in (1, 2)]
    n = cells[0].unionByName(cells[1]).groupBy(C("window").cast("int").alias("window"), "gap", "anchor")
    return n.agg(F.count_if(C("side") == "before").alias("n_before"), F.count_if(C("side") == "after").alias("n_after"))


@query("ml_pca_sweep")
def ml_pca_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy distance after projections on fewer principal components."""
    v = vectors(spark, sf_dir).select(C("vec_id").alias("id"), "year", "v")
    p = clusters.project(v, "v", 32).select("id", "year", C("projected").alias("v"))
    cells = tiles.energy_grid(p, "year", (2,), (1,), (8, 32), 1, None).join(F.broadcast(W.anchors(v, "year", (2,))), ["anchor", "window"])  # a row an anchor
    return cells.select("anchor", C("window").cast("int").alias("window"), F.when(F.least("n_before", "n_after") > 1, C("value")).alias("value"), C("dim").cast("int").alias("dims"))


@query("ml_embed_text", "SELECT p_partkey, concat_ws('. ', nullif(p_name, ''), CASE WHEN p_size > 10 THEN p_type END, p_brand) AS text FROM part")
def ml_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(". ", F.nullif("p_name", F.lit("")), F.when(C("p_size") > 10, C("p_type")), "p_brand").alias("text"))


@query("ml_embed_cache", "WITH t AS (SELECT doc_id, substr(md5(text), 1, 8) AS h FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE h END AS h FROM t WHERE doc_id % 3 <> 0) SELECT CASE WHEN c.h IS NULL THEN 'new' WHEN c.h = t.h THEN 'hit' ELSE 'stale' END AS state, count(*) AS n FROM t LEFT JOIN c USING (doc_id) GROUP BY 1")
def ml_embed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("h"))
    cache = t.where("doc_id % 3 <> 0").select("doc_id", F.when(C("doc_id") % 4 == 0, "old").otherwise(C("h")).alias("c"))
    state = F.when(C("c").isNull(), "new").when(C("c") == C("h"), "hit").otherwise("stale")
    return t.join(cache, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
