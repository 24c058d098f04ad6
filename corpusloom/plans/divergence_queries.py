"""Queries over graphs and divergence."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.functions.vocabulary import STOPS
from corpusloom.operators import divergence as D
from corpusloom.operators import clusters, counting, kernels
from corpusloom.operators import graph as G
from corpusloom.operators import windows as W
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import EDGES, VECTORS, edges, vectors
from corpusloom.plans.window_queries import PAIRS, pairs

C = F.col
#: whole: the undirected graph of all edges; labels: brands of those nodes that are parts.
WHOLE = f"{EDGES}, whole AS (SELECT DISTINCT least(src, ref) AS a, greatest(src, ref) AS b FROM edges WHERE src <> ref), labels AS (SELECT p_partkey AS node, p_brand AS label FROM part)"


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The undirected graph of all edges."""
    return G.undirected(edges(spark, sf_dir), "src", "ref")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(C("p_partkey").alias("node"), C("p_brand").alias("label"))


@query("gr_cocite", "WITH e AS (SELECT l_orderkey AS src, l_partkey AS ref FROM lineitem) SELECT x.ref AS a, y.ref AS b, count(*) AS n FROM e x JOIN e y ON x.src = y.src AND x.ref < y.ref GROUP BY 1, 2 HAVING count(*) >= 2")
def gr_cocite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated edges count each time."""
    return G.cocitation(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS src", "l_partkey AS ref"), 2, multiple=True)


@query("gr_cocite_bin", f"WITH {EDGES} SELECT x.ref AS a, y.ref AS b, count(*) AS n FROM edges x JOIN edges y ON x.src = y.src AND x.ref < y.ref GROUP BY 1, 2 HAVING count(*) >= 2")
def gr_cocite_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cocitation(edges(spark, sf_dir), 2)


@query("gr_coupling", f"WITH {EDGES} SELECT x.src AS a, y.src AS b, count(*) AS n FROM edges x JOIN edges y ON x.ref = y.ref AND x.src < y.src GROUP BY 1, 2 HAVING count(*) >= 3")
def gr_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.coupling(edges(spark, sf_dir), 3)


@query("gr_coupling_jacc", f"WITH {EDGES}, d AS (SELECT src, count(*) AS d FROM edges GROUP BY 1), c AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM edges x JOIN edges y ON x.ref = y.ref AND x.src < y.src GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, b, n, round(1 - n / (p.d + q.d - n), 6) AS distance FROM c JOIN d p ON p.src = a JOIN d q ON q.src = b")
def gr_coupling_jacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.coupling_jaccard(edges(spark, sf_dir), 3).withColumn("distance", F.round("distance", 6))


@query("gr_direct", f"WITH {WHOLE} SELECT a, b FROM whole")
def gr_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir)


@query("gr_degree", f"WITH {EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT ref, 0, 1 FROM edges) GROUP BY node")
def gr_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir))


@query("gr_components")
def gr_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a recursive statement lists all pairs within reach."""
    return G.components(whole(spark, sf_dir))


#: Steps of PageRank at most: on the test tables all ranks rest after 80.
STEPS = 100
_PR = "".join(
    f", r{i + 1} AS MATERIALIZED (SELECT v.node, v.leaf, 0.15 / (SELECT count(*) FROM v) + 0.85 * (coalesce(g.g, 0) + (SELECT sum(rank) FROM r{i} WHERE leaf) / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN (SELECT e.ref AS node, sum(rank / d) AS g FROM e JOIN r{i} ON src = node JOIN d USING (src) GROUP BY 1) g USING (node))"
    for i in range(STEPS)
)


@query("gr_pagerank", f"WITH {EDGES}, e AS (SELECT DISTINCT src, ref FROM edges WHERE src <> ref), d AS (SELECT src, count(*) AS d FROM e GROUP BY 1), v AS (SELECT node, node NOT IN (SELECT src FROM e) AS leaf FROM (SELECT src AS node FROM e UNION SELECT ref FROM e)), r0 AS (SELECT node, leaf, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v){_PR} SELECT node, round(rank * 1000, 7) AS rank FROM r{STEPS}")
def gr_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that have come to rest, far below the places that are given."""
    return G.pagerank(edges(spark, sf_dir), STEPS, tolerance=1e-17).select("node", F.round(C("rank") * 1000, 7).alias("rank"))


@query("gr_pagerank_full")
def gr_pagerank_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that have come to rest."""
    return G.pagerank(edges(spark, sf_dir), 100, tolerance=1e-9)


_LABELLED = f"{WHOLE}, l AS (SELECT a, b, x.label AS la, y.label AS lb FROM whole JOIN labels x ON a = x.node JOIN labels y ON b = y.node)"


@query("gr_modularity", f"WITH {_LABELLED}, d AS (SELECT label, count(*) AS d FROM (SELECT la AS label FROM l UNION ALL SELECT lb FROM l) GROUP BY 1), i AS (SELECT la AS label, count(*) AS n FROM l WHERE la = lb GROUP BY 1), m AS (SELECT count(*) AS m FROM l) SELECT round(sum(coalesce(n, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (label), m")
def gr_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.modularity(whole(spark, sf_dir), brands(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


@query("gr_within_share", f"WITH {_LABELLED} SELECT count(*) AS n, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0 END), 6) AS share FROM l")
def gr_within_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within_share(whole(spark, sf_dir), brands(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("gr_assort", f"WITH {_LABELLED}, b AS (SELECT la, lb FROM l UNION ALL SELECT lb, la FROM l), t AS (SELECT count(*) AS t, count(*) FILTER (WHERE la = lb) AS s FROM b), q AS (SELECT sum(n * n) AS q FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY la)) SELECT round((s / t - q / (t * t)) / (1 - q / (t * t)), 6) AS assortativity FROM t, q")
def gr_assort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assortativity(whole(spark, sf_dir), brands(spark, sf_dir)).select(F.round("assortativity", 6).alias("assortativity"))


@query("gr_edge_metric", f"WITH {WHOLE}, {VECTORS} SELECT CAST(a % 5 AS BIGINT) AS year, count(*) AS n, round(avg(list_cosine_similarity(x.v, y.v)), 6) AS mean FROM whole JOIN vectors x ON a = x.vec_id JOIN vectors y ON b = y.vec_id GROUP BY 1")
def gr_edge_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", "v")
    return G.edge_metric(whole(spark, sf_dir).withColumn("year", C("a") % 5), v, V.cosine, "year").withColumn("mean", F.round("mean", 6))


@query("gr_meta", f"WITH {_LABELLED} SELECT least(la, lb) AS la, greatest(la, lb) AS lb, count(*) AS n FROM l GROUP BY 1, 2")
def gr_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.meta_graph(whole(spark, sf_dir), brands(spark, sf_dir))


@query(
    "gr_meta_members",
    f"""WITH {WHOLE}, d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM whole UNION ALL SELECT b FROM whole) GROUP BY 1), l AS (SELECT node, label, d FROM d JOIN labels USING (node)), s AS (SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM l) AS share FROM l GROUP BY 1),
    k AS (SELECT * FROM s WHERE share >= 0.04), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, node) AS r FROM l), m AS (SELECT label, string_agg(CAST(node AS VARCHAR), ';' ORDER BY r) AS members FROM r WHERE r <= 8 GROUP BY 1)
    SELECT label AS community, n, round(share, 6) AS share, round((SELECT sum(n) FROM k) / (SELECT count(*) FROM l), 6) AS coverage, members FROM k JOIN m USING (label)""",
)
def gr_meta_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of some size: their share, how much they cover together, and their members of most edges."""
    return G.meta_members(whole(spark, sf_dir), brands(spark, sf_dir), 0.04).withColumns({c: F.round(c, 6) for c in ("share", "coverage")})


@query("gr_align", "WITH x AS (SELECT p_partkey AS node, p_brand AS a, p_type AS b FROM part), s AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), p AS (SELECT a, count(*) AS p FROM x GROUP BY 1), q AS (SELECT b, count(*) AS q FROM x GROUP BY 1) SELECT a, b, round(n / (p + q - n), 6) AS jaccard FROM s JOIN p USING (a) JOIN q USING (b)")
def gr_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return G.align(p.select("p_partkey", "p_brand"), p.select("p_partkey", "p_type")).withColumn("jaccard", F.round("jaccard", 6))


@query("gr_temporal", f"WITH {EDGES}, n AS (SELECT cut, ref, count(*) AS n FROM edges, (VALUES (1996), (1998), (2000)) t(cut) WHERE year <= cut GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY n DESC, ref) AS r FROM n) SELECT CAST(cut AS BIGINT) AS cut, ref, n FROM r WHERE r <= 50")
def gr_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cited by several cuts, all in one pass over the edges."""
    cuts = F.explode(F.filter(F.array(*(F.lit(c).cast("long") for c in (1996, 1998, 2000))), lambda c: C("year") <= c)).alias("cut")
    n = edges(spark, sf_dir).select("ref", cuts).groupBy("cut", "ref").agg(F.count("*").alias("n"))
    return W.top_per_group(n, 50, [F.desc("n"), C("ref")], "cut").drop("place")


@query("gr_dag", f"WITH {EDGES}, t AS (SELECT ref FROM edges GROUP BY ref ORDER BY count(*) DESC, ref LIMIT 300) SELECT DISTINCT ref AS cited, src AS citing FROM edges WHERE ref IN (SELECT ref FROM t) AND src IN (SELECT ref FROM t) AND src > ref")
def gr_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from cited to citing among a backbone; they rise, so there is no cycle."""
    e = edges(spark, sf_dir).select("src", "ref")
    top = e.groupBy("ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ref").limit(300).select("ref")
    e = e.join(F.broadcast(top), "ref", "left_semi").join(F.broadcast(top.toDF("src")), "src", "left_semi")
    return e.where("src > ref").select(C("ref").alias("cited"), C("src").alias("citing")).distinct()


@query("gr_anchor", "WITH h AS (SELECT p_partkey AS node, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'bolt') THEN 'bolt' END AS l, CAST(contains(p_name, 'red') AS INT) + CAST(contains(p_name, 'bolt') AS INT) AS n FROM part) SELECT node, l AS label FROM h WHERE n = 1")
def gr_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that exactly one anchor names."""
    terms = ("red", "bolt")
    hit = F.array_compact(F.array(*(F.when(F.contains("p_name", F.lit(t)), F.lit(t)) for t in terms)))
    return table(spark, sf_dir, "part").select(C("p_partkey").alias("node"), hit.alias("h")).where("size(h) = 1").select("node", C("h")[0].alias("label"))


@query("gr_sem6", "WITH n AS (SELECT p_type AS t, count(*) AS n FROM part GROUP BY 1), b AS (SELECT t FROM n WHERE n >= 0.02 * (SELECT sum(n) FROM n)) SELECT p_type AS cluster, p_brand AS community, count(*) AS n FROM part WHERE p_type IN (SELECT t FROM b) GROUP BY 1, 2")
def gr_sem6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.community_share(table(spark, sf_dir, "part"), "p_type", 0.02).groupBy(C("p_type").alias("cluster"), C("p_brand").alias("community")).agg(F.count("*").alias("n"))


#: The most vectors a side of a window pair, as the operator's own limit; both sides are drawn to equal size by a hash.
MOST = 2000
_EQUAL = f"""{PAIRS}, n AS (SELECT anchor, "window", least(count(*) FILTER (WHERE side = 'before'), count(*) FILTER (WHERE side = 'after'), {MOST}) AS m FROM pairs GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY anchor, "window", side ORDER BY md5(concat('42|', anchor, '|', "window", '|', vec_id)), vec_id) AS r FROM pairs), eq AS (SELECT r.* FROM r JOIN n USING (anchor, "window") WHERE r <= m)"""
_DIST = "x.v AS x, y.v AS y, x.side AS s, y.side AS t, x.vec_id AS i, y.vec_id AS j, x.anchor AS anchor, x.\"window\" AS \"window\" FROM eq x JOIN eq y ON x.anchor = y.anchor AND x.\"window\" = y.\"window\""


def drawn(spark: SparkSession, sf_dir: str, most: int = MOST) -> DataFrame:
    return W.equal_n(pairs(spark, sf_dir), "vec_id", 42, most).select("anchor", C("window").cast("int").alias("window"), "side", "vec_id", "v")


@query("div_s2", f'WITH {_EQUAL}, d AS (SELECT list_distance(x, y) AS d, * FROM (SELECT {_DIST})) SELECT anchor, "window", round(2 * avg(d) FILTER (WHERE s = \'before\' AND t = \'after\') - avg(d) FILTER (WHERE s = \'before\' AND t = \'before\') - avg(d) FILTER (WHERE s = \'after\' AND t = \'after\'), 6) AS value FROM d GROUP BY 1, 2')
def div_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.by_pair(drawn(spark, sf_dir), "v", kernels.energy).withColumn("value", F.round("value", 6))


@query("div_s1", f"""WITH {_EQUAL}, d AS (SELECT pow(list_distance(x, y), 2) AS d2, * FROM (SELECT {_DIST}) WHERE i <> j), b AS (SELECT anchor, "window", f, f * median(d2) AS b FROM (SELECT * FROM d WHERE s = 'before' AND t = 'before' AND i < j OR s = 'after' AND t = 'after' AND i < j OR s = 'before' AND t = 'after'), (VALUES (0.5), (1.0), (2.0)) q(f) GROUP BY anchor, "window", f),
  k AS (SELECT anchor, "window", f, s, t, exp(-d2 / (2 * b)) AS k FROM d JOIN b USING (anchor, "window")) SELECT anchor, "window", concat('bw=', f, 'x_median') AS hyperparams, round(greatest(0, avg(k) FILTER (WHERE s = 'before' AND t = 'before') + avg(k) FILTER (WHERE s = 'after' AND t = 'after') - 2 * avg(k) FILTER (WHERE s = 'before' AND t = 'after')), 6) AS value FROM k GROUP BY anchor, "window", f""")
def div_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At half, once and twice the median squared distance."""
    return kernels.mmd_by_pair(drawn(spark, sf_dir), "v", (0.5, 1.0, 2.0)).withColumn("value", F.round("value", 6))


@query("div_s3")
def div_s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 100 random directions."""
    return kernels.by_pair(drawn(spark, sf_dir), "v", kernels.sliced_wasserstein)


@query("ml_series", f"""WITH {PAIRS}, n AS (SELECT anchor, "window", label, count(*) FILTER (WHERE side = 'before') AS b, count(*) FILTER (WHERE side = 'after') AS a FROM pairs GROUP BY ALL), p AS (SELECT anchor, "window", b / sum(b) OVER w AS p, a / sum(a) OVER w AS q FROM n WINDOW w AS (PARTITION BY anchor, "window"))
  SELECT anchor, "window", round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 6) AS value FROM p GROUP BY 1, 2""")
def ml_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.share_divergence(pairs(spark, sf_dir), "label").withColumn("value", F.round("value", 6))


@query("ml_centroid", f"""WITH {PAIRS}, u AS (SELECT unnest(range(1, 65)) AS i), m AS (SELECT anchor, "window", side, i, avg(v[i]) AS m FROM pairs, u GROUP BY ALL), c AS (SELECT anchor, "window", side, list(m ORDER BY i) AS c FROM m GROUP BY ALL)
  SELECT anchor, "window", round(1 - list_cosine_similarity(x.c, y.c), 6) AS value FROM c x JOIN c y USING (anchor, "window") WHERE x.side = 'before' AND y.side = 'after'""")
def ml_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.centroid_shift(pairs(spark, sf_dir), "v").withColumn("value", F.round("value", 6))


@query("ml_axis", f"""WITH {VECTORS}, u AS (SELECT unnest(range(1, 65)) AS i), m AS (SELECT i, avg(v[i]) FILTER (WHERE label = 0) - avg(v[i]) FILTER (WHERE label = 1) AS d FROM vectors, u GROUP BY i), a AS (SELECT list(d ORDER BY i) AS a FROM m), p AS (SELECT vec_id, list_dot_product(v, a) / sqrt(list_dot_product(a, a)) AS p FROM vectors, a) SELECT vec_id, round(p - (SELECT median(p) FROM p), 6) AS projection FROM p""")
def ml_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection on the axis between two groups' means, centred on the median."""
    v = vectors(spark, sf_dir)
    c = V.centroid(v.where("label < 2"), "v", "label")
    axis = c.groupBy().agg(F.max(F.when(C("label") == 0, C("centroid"))).alias("x"), F.max(F.when(C("label") == 1, C("centroid"))).alias("y")).select(V.unit(F.zip_with("x", "y", lambda x, y: x - y)).alias("axis"))
    p = v.crossJoin(F.broadcast(axis)).select("vec_id", V.dot(C("v"), C("axis")).alias("p"))
    return p.crossJoin(F.broadcast(p.agg(F.percentile("p", F.lit(0.5)).alias("m")))).select("vec_id", F.round(C("p") - C("m"), 6).alias("projection"))


@query("ml_embed_qa", f"WITH {VECTORS}, d AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS c FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id) SELECT same, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS sd FROM d GROUP BY same")
def ml_embed_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of all pairs within and between labels, from the moments of each label's unit vectors: no pair is formed."""
    return D.cosine_moments(vectors(spark, sf_dir), "label", "v").select("same", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


#: Terms of the vocabulary, documents that hold each at least, and works that a side has at least: 5 in a corpus of fewer than 200.
MOST_TERMS, LEAST_DOCS, LEAST_WORKS, FEW = 5000, 3, 30, 5
_WORD = r"[\p{L}\p{N}_]{2,}"
_words = functools.partial(counting.words, r"\w{2,}")  # the same words
#: every: the words of every document with its year; terms: those of the vocabulary; weights: their weights in each document.
TERMS = rf"""docs AS (SELECT doc_id, 1995 + doc_id % 10 AS year, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text IS NOT NULL), every AS (SELECT doc_id, year, unnest(w) AS term FROM docs),
  vocab AS (SELECT term FROM every WHERE term NOT IN ({', '.join(f"'{w}'" for w in STOPS)}) GROUP BY term HAVING count(DISTINCT doc_id) >= {LEAST_DOCS} ORDER BY count(*) DESC, term LIMIT {MOST_TERMS}), terms AS (SELECT * FROM every WHERE term IN (SELECT term FROM vocab)),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
  weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""
LEX = f"""{TERMS}, a AS (SELECT w AS "window", unnest(range(1995 + w, 2004 - w)) AS anchor FROM (VALUES (2), (3), (4)) t(w)), d AS (SELECT doc_id, year FROM docs),
  every_pair AS (SELECT anchor, "window", doc_id, CASE WHEN year < anchor THEN 'before' ELSE 'after' END AS side FROM a JOIN d ON year BETWEEN anchor - "window" AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + "window"),
  enough AS (SELECT anchor, "window" FROM every_pair GROUP BY ALL HAVING least(count(*) FILTER (WHERE side = 'before'), count(*) FILTER (WHERE side = 'after')) >= (SELECT CASE WHEN count(*) < 200 THEN {FEW} ELSE {LEAST_WORKS} END FROM docs)),
  pairs AS (SELECT p.* FROM every_pair p JOIN enough USING (anchor, "window"))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a text, and its year."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", (1995 + C("doc_id") % 10).alias("year"))


def every_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document's whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (1995 + C("doc_id") % 10).alias("year"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("term"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that documents are weighed by, of bounded number, their places and how many documents hold each."""
    d = table(spark, sf_dir, "documents")
    n = counting.totals(d, "doc_id", C("text"), _words, counting.once(d.where("text IS NOT NULL"), "doc_id"))
    return G.settle(D.commonest(n, "term", STOPS, LEAST_DOCS, MOST_TERMS))


def terms(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """The terms of the vocabulary in every document's whole text."""
    names = vocabulary(spark, sf_dir) if names is None else names
    return every_term(spark, sf_dir).join(F.broadcast(names.select("term")), "term", "left_semi").select("doc_id", "year", "term")


def weights(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """doc_id, term and w. Where each document is one row, its weights are told where it is read and only they are moved."""
    names = vocabulary(spark, sf_dir) if names is None else names
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    if not counting.once(d, "doc_id"):
        tf = counting.counts(d, "doc_id", C("text"), _words, False).join(F.broadcast(names.select("term")), "term", "left_semi")
        return D.tfidf_of_counts(tf.withColumnRenamed("n", "tf"), "doc_id", "term", d)
    n = d.count()
    inverse = names.select("term", (F.ln((1 + F.lit(n)) / (1 + C("docs"))) + 1).alias("idf"))
    return counting.weighed(d, "doc_id", C("text"), _words, {r["term"]: r["idf"] for r in inverse.collect()})  # MOST_TERMS rows at most


def least_works(d: DataFrame) -> int:
    """How many works a side must have, by the size of the corpus."""
    return FEW if d.count() < 200 else LEAST_WORKS


def lexical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return W.sliding_pairs(d, "year", (2, 3, 4), least=least_works(d))


def lexical_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number of works on both sides, 2,000 at most, with their weights by place in the vocabulary."""
    names = vocabulary(spark, sf_dir)
    v = D.sparse_vectors(docs(spark, sf_dir), weights(spark, sf_dir, names), names, "doc_id")
    p = W.equal_n(lexical_pairs(spark, sf_dir), "doc_id", 42, 2000)
    return p.select("anchor", C("window").cast("int").alias("window"), "side", "doc_id").join(v.select("doc_id", "ix", "w"), "doc_id")


@query("fn_tfidf", f"WITH {TERMS} SELECT doc_id, term, round(w, 6) AS w FROM weights")
def fn_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(
    "div_l1",
    f"""WITH {LEX}, n AS (SELECT anchor, "window", count(*) FILTER (WHERE side = 'before') AS nb, count(*) FILTER (WHERE side = 'after') AS na FROM pairs GROUP BY ALL),
    m AS (SELECT anchor, "window", term, coalesce(sum(w) FILTER (WHERE side = 'before'), 0) / max(nb) AS b, coalesce(sum(w) FILTER (WHERE side = 'after'), 0) / max(na) AS a FROM pairs JOIN weights USING (doc_id) JOIN n USING (anchor, "window") GROUP BY ALL),
    s AS (SELECT anchor, "window", (b + 1e-10) / (sum(b) OVER w + 1e-10 * (SELECT count(*) FROM vocab)) AS p, (a + 1e-10) / (sum(a) OVER w + 1e-10 * (SELECT count(*) FROM vocab)) AS q FROM m WINDOW w AS (PARTITION BY anchor, "window"))
    SELECT anchor, "window", round(sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)), 6) AS value FROM s GROUP BY 1, 2""",
)
def div_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = vocabulary(spark, sf_dir)
    yearly = docs(spark, sf_dir).join(weights(spark, sf_dir, names), "doc_id").groupBy("year", "term").agg(F.sum("w").alias("w"))
    return D.lexical_js(lexical_pairs(spark, sf_dir), yearly, "doc_id", "term", names.count(), by="year").withColumn("value", F.round("value", 6))


_PAST = (3, 5)


@query(
    "div_l2",
    f"""WITH {TERMS}, y AS (SELECT doc_id, year AS y FROM docs), v AS (SELECT w AS "window", k FROM (VALUES {', '.join(f'({w})' for w in _PAST)}) t(w), (SELECT unnest(range(-5, 6)) AS k) WHERE k <> 0 AND abs(k) <= w),
    ab AS (SELECT doc_id, "window", y - k AS anchor, CASE WHEN k < 0 THEN 'past' ELSE 'future' END AS side FROM y, v), g AS (SELECT "window", anchor, side, term, sum(w) AS g FROM ab JOIN weights USING (doc_id) GROUP BY ALL), t AS (SELECT "window", anchor, side, sum(g) AS t FROM g GROUP BY ALL),
    d AS (SELECT doc_id, y AS anchor, term, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM y JOIN weights USING (doc_id)), e AS (SELECT min(y) AS lo, max(y) AS hi FROM y),
    k AS (SELECT t."window", anchor, t.side, doc_id, least(50, sum(p * ln(p / (coalesce(g, 0) / t + 1e-10)))) AS kl FROM d JOIN t USING (anchor) JOIN e ON anchor BETWEEN lo + t."window" AND hi - t."window" LEFT JOIN g ON g."window" = t."window" AND g.anchor = d.anchor AND g.side = t.side AND g.term = d.term GROUP BY ALL)
    SELECT CAST("window" AS INTEGER) AS "window", anchor, round(avg(kl) FILTER (WHERE side = 'past'), 5) AS novelty, round(avg(kl) FILTER (WHERE side = 'future'), 5) AS transience, round(avg(kl) FILTER (WHERE side = 'past') - avg(kl) FILTER (WHERE side = 'future'), 5) AS resonance FROM k GROUP BY 1, 2""",
)
def div_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By window, for the years that have whole windows on both sides."""
    w, d = G.settle(weights(spark, sf_dir)), docs(spark, sf_dir)
    each = [D.novelty(d, w, "doc_id", "year", n).withColumn("window", F.lit(n)) for n in _PAST]
    out = each[0].unionByName(each[1])
    return out.select("window", "anchor", *(F.round(c, 5).alias(c) for c in ("novelty", "transience", "resonance")))


@query(
    "div_l3",
    f"""WITH {TERMS}, best AS (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 100), docs_ AS (SELECT year, count(DISTINCT doc_id) AS docs FROM terms GROUP BY 1), n AS (SELECT term, year, count(*) AS n FROM terms GROUP BY 1, 2),
    g AS (SELECT term, year, coalesce(n, 0) / docs AS m FROM (SELECT * FROM best, docs_) LEFT JOIN n USING (term, year)), z AS (SELECT year, (m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0) AS z FROM g WINDOW w AS (PARTITION BY term))
    SELECT year, count(*) FILTER (WHERE z > 2) AS value FROM z GROUP BY year""",
)
def div_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bursts(terms(spark, sf_dir), "doc_id", "term", "year", 100, 2.0)


@query("st_logodds", f"WITH {TERMS}, n AS (SELECT term, count(*) FILTER (WHERE year < 2000) AS b, count(*) FILTER (WHERE year >= 2000) AS a FROM every GROUP BY 1), t AS (SELECT sum(b) AS tb, sum(a) AS ta, count(*) AS v FROM n), p AS (SELECT *, v * (a + b) / (ta + tb) AS prior FROM n, t) SELECT term, round(ln((a + prior) / (ta + v - a - prior)) - ln((b + prior) / (tb + v - b - prior)), 6) AS log_odds, b AS before, a AS after FROM p WHERE a + b >= 5")
def st_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.log_odds(every_term(spark, sf_dir), "term", C("year") < 2000).where("before + after >= 5").withColumn("log_odds", F.round("log_odds", 6))


@query(
    "st_tfidf_shift",
    f"""WITH {TERMS}, s AS (SELECT doc_id, year < 2000 AS early FROM docs), n AS (SELECT early, count(*) AS n FROM s GROUP BY 1), m AS (SELECT term, early, count(*) AS docs, sum(w) / max(n) AS m FROM s JOIN weights USING (doc_id) JOIN n USING (early) GROUP BY 1, 2)
    SELECT term, round(sum(CASE WHEN early THEN -m ELSE m END), 6) + 0.0 AS diff, coalesce(CAST(sum(docs) FILTER (WHERE early) AS BIGINT), 0) AS docs_before, coalesce(CAST(sum(docs) FILTER (WHERE NOT early) AS BIGINT), 0) AS docs_after
    FROM m WHERE length(term) >= 3 AND NOT regexp_matches(term, '[0-9]') GROUP BY term""",
)
def st_tfidf_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each clean term's mean weight moves, and how many documents have it."""
    w = docs(spark, sf_dir).select("doc_id", F.when(C("year") < 2000, "before").otherwise("after").alias("side"))
    out = D.mean_shift(w, weights(spark, sf_dir), "doc_id", "term", "side").where(T.clean_term(C("term"), STOPS))
    return out.withColumn("diff", F.round("diff", 6) + 0.0)



@query("div_g3", f"WITH {EDGES} SELECT year, CASE WHEN count(*) >= 3 THEN median(1990 + ref % 12) END AS value FROM edges GROUP BY year")
def div_g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.age_shift(edges(spark, sf_dir).select("year", (1990 + C("ref") % 12).alias("ref_year")), 3)


_GPAIRS = f"""{EDGES}, a AS (SELECT w AS "window", unnest(range(1995 + w, 2001 - w)) AS anchor FROM (VALUES (1), (2)) t(w)), pairs AS (SELECT anchor, "window", CASE WHEN year < anchor THEN 'before' ELSE 'after' END AS side, src, ref FROM a JOIN edges ON year BETWEEN anchor - "window" AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + "window")"""


def _edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding_pairs(edges(spark, sf_dir), "year", (1, 2))


@query("div_g6", f"""WITH {_GPAIRS}, d AS (SELECT anchor, "window", side, ref, count(*) AS d FROM pairs GROUP BY ALL), n AS (SELECT anchor, "window", side, d, count(*) AS n FROM d GROUP BY ALL), h AS (SELECT anchor, "window", side, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM n GROUP BY ALL) SELECT anchor, "window", round(abs(sum(CASE WHEN side = 'after' THEN h ELSE -h END)), 6) AS value FROM h GROUP BY 1, 2""")
def div_g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.degree_entropy_shift(_edge_pairs(spark, sf_dir), "ref").withColumn("value", F.round("value", 6))


@query("div_g7", f"WITH {EDGES}, e AS (SELECT DISTINCT src, ref FROM edges WHERE src > ref), x AS (SELECT DISTINCT a.src AS node, b.src AS citer FROM e a JOIN e b ON a.ref = b.ref AND b.src <> a.src), y AS (SELECT ref AS node, src AS citer FROM e WHERE ref IN (SELECT src FROM e)), j AS (SELECT coalesce(x.node, y.node) AS node, x.node IS NOT NULL AS r, y.node IS NOT NULL AS d FROM x FULL JOIN y ON x.node = y.node AND x.citer = y.citer), n AS (SELECT node, count(*) FILTER (WHERE d AND NOT r) AS i, count(*) FILTER (WHERE d AND r) AS j, count(*) FILTER (WHERE NOT d) AS k FROM j GROUP BY node) SELECT node, round((i - j) / (i + j + k), 6) AS cd FROM n WHERE i + j > 0")
def div_g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.disruption(edges(spark, sf_dir).where("src > ref")).withColumn("cd", F.round("cd", 6))


@query("div_g7_year", f"""WITH {EDGES}, e AS (SELECT DISTINCT src, ref FROM edges WHERE src > ref), x AS (SELECT DISTINCT a.src AS node, b.src AS citer FROM e a JOIN e b ON a.ref = b.ref AND b.src <> a.src),
    j AS (SELECT coalesce(x.node, y.ref) AS node, x.node IS NOT NULL AS r, y.ref IS NOT NULL AS d FROM x FULL JOIN e y ON x.node = y.ref AND x.citer = y.src), n AS (SELECT node, count(*) FILTER (WHERE d AND NOT r) AS i, count(*) FILTER (WHERE d AND r) AS j, count(*) FILTER (WHERE NOT d) AS k FROM j GROUP BY node),
    o AS (SELECT DISTINCT src AS node, year FROM edges) SELECT year, round(avg((i - j) / (i + j + k)), 6) AS value FROM o LEFT JOIN n USING (node) GROUP BY year""")
def div_g7_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean disruption of each year's works."""
    e = edges(spark, sf_dir)
    return D.yearly_disruption(e.where("src > ref"), e.select(C("src").alias("node"), "year")).withColumn("value", F.round("value", 6))


@query("div_g4")
def div_g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year, the share of edges between the two communities of the whole graph."""
    e = edges(spark, sf_dir).where("src <> ref")
    return D.crossing_share(e.select(C("src").alias("a"), C("ref").alias("b"), "year"), clusters.spectral(whole(spark, sf_dir).withColumn("n", F.lit(1.0)), 2).toDF("node", "label"), "year")


@query("div_g9")
def div_g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the shares of the communities found in each window pair's united graph."""
    p = _edge_pairs(spark, sf_dir).where("src <> ref").select("anchor", C("window").cast("int").alias("window"), "side", "src", "ref").distinct()
    return kernels.community_divergence(p, edges(spark, sf_dir).where("src <> ref"))
