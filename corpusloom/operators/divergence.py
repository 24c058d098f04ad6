"""Divergence between the sides of a window pair: semantic, lexical and citation measures.

A pair is (anchor, window); sides are before and after. Measures of pairs of vectors compare the two sides of one pair, drawn to
bounded equal samples beforehand where the sides are large (windows.equal_n); terms and degrees are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vector as V
from corpusloom.operators import graph

PAIR = ["anchor", "window"]
EPSILON = 1e-10


def cosine_moments(df: DataFrame, label: str, vector: str) -> DataFrame:
    """same (whether labels agree), n, mean and sd of the cosines of all pairs of rows, without forming one.

    Of unit vectors u the pairs' cosines sum to (|sum u|^2 - n) / 2 and their squares to (|sum u u'|^2 - n) / 2, so each task sends one sum of
    vectors and one of products a label. Rows without label, vector or length are left out.
    """

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for rows in it:
            for key, v in rows.groupby("label")["v"]:
                u = np.array(v.tolist(), float)
                length = np.sqrt((u * u).sum(axis=1, keepdims=True))
                u = (u / np.where(length > 0, length, 1))[length[:, 0] > 0]
                mine = np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u).ravel()])
                sums[key] = sums[key] + mine if key in sums else mine
        for key, x in sums.items():
            yield pd.DataFrame({"label": key, "i": np.arange(len(x)), "dims": int(round(len(x) ** 0.5 - 0.5)), "x": x})

    kind = dict(df.dtypes)[label]
    each = df.select(F.col(label).alias("label"), F.col(vector).alias("v")).where("label IS NOT NULL AND v IS NOT NULL").mapInPandas(part, f"label {kind}, i long, dims long, x double")
    by_label = each.groupBy("label", "i", "dims").agg(F.sum("x").alias("x"))

    def pairs(sums: DataFrame, *by: str) -> DataFrame:
        where = lambda c: F.sum(F.when(c, F.col("x") * F.col("x")).otherwise(0.0))
        n, first = F.sum(F.when(F.col("i") == 0, F.col("x"))), F.col("i").between(1, F.col("dims"))
        m = sums.groupBy(*by).agg(n.alias("k"), where(first).alias("s"), where(F.col("i") > F.col("dims")).alias("q"))
        return m.agg(F.sum(F.expr("k * (k - 1) / 2")).alias("n"), F.sum(F.expr("(s - k) / 2")).alias("s"), F.sum(F.expr("(q - k) / 2")).alias("q"))

    same = pairs(by_label, "label")
    whole = pairs(by_label.groupBy("i", "dims").agg(F.sum("x").alias("x")))
    apart = whole.crossJoin(same.toDF("n2", "s2", "q2")).selectExpr("false AS same", "n - n2 AS n", "s - s2 AS s", "q - q2 AS q")  # one row each
    both = same.selectExpr("true AS same", "n", "s", "q").unionByName(apart).where("n > 0.5")
    return both.selectExpr("same", "CAST(round(n) AS bigint) AS n", "s / n AS mean", "CASE WHEN n > 1.5 THEN sqrt(greatest(0D, (q - s * s / n) / (n - 1))) END AS sd")


def centroid_shift(pairs: DataFrame, vector: str) -> DataFrame:
    """Cosine distance of the sides' mean vectors."""
    c = V.centroid(pairs, vector, *PAIR, "side")
    side = lambda s, n: c.where(F.col("side") == s).select(*PAIR, F.col("centroid").alias(n))
    return side("before", "x").join(side("after", "y"), PAIR).select(*PAIR, (1 - V.cosine(F.col("x"), F.col("y"))).alias("value"))


def share_divergence(pairs: DataFrame, label: str, log: Callable = F.log2) -> DataFrame:
    """Jensen-Shannon divergence, in bits or by another logarithm, of the sides' shares of labels."""
    n = pairs.groupBy(*PAIR, label).agg(F.count_if(F.col("side") == "before").alias("b"), F.count_if(F.col("side") == "after").alias("a"))
    return _js(n, "b", "a", 0.0, log)


def _js(n: DataFrame, b: str, a: str, epsilon: float, log, size: int | None = None) -> DataFrame:
    t = n.groupBy(*PAIR).agg(F.sum(b).alias("tb"), F.sum(a).alias("ta"), (F.count("*") if size is None else F.lit(size)).alias("k"))
    j = n.join(F.broadcast(t), PAIR)  # one row a pair
    p, q = (F.col(b) + epsilon) / (F.col("tb") + epsilon * F.col("k")), (F.col(a) + epsilon) / (F.col("ta") + epsilon * F.col("k"))
    part = lambda x: F.when(x > 0, x * log(x / ((p + q) / 2))).otherwise(0.0)
    return j.groupBy(*PAIR).agg((F.sum(part(p) + part(q)) / 2).alias("value"))


def vocabulary(terms: DataFrame, doc: str, term: str, stops: Sequence[str], least: int = 3, most: int = 5000) -> DataFrame:
    """term and i, its place from 0: the terms of most occurrences, so many at most, that stand in least documents or more and aren't stop words; ties go to the smaller term."""
    n = terms.where(~F.col(term).isin(*stops)).groupBy(doc, term).agg(F.count("*").alias("n")).groupBy(term).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return commonest(n, term, stops, least, most).select(term, "i")


def commonest(totals: DataFrame, term: str, stops: Sequence[str], least: int = 3, most: int = 5000) -> DataFrame:
    """The vocabulary, with docs, of terms whose totals are known: term, n and docs."""
    best = totals.where((F.col("docs") >= least) & ~F.col(term).isin(*stops)).orderBy(F.desc("n"), term).limit(most)
    return best.select(term, "docs", (F.row_number().over(Window.orderBy(F.desc("n"), term)) - 1).alias("i"))  # no more rows than `most`


def tfidf(terms: DataFrame, doc: str, term: str, docs: DataFrame | None = None) -> DataFrame:
    """doc, term, w: sublinear counts by smooth inverse document frequency, each document of length one. terms: a row each time a term occurs.

    docs: all documents, those without any of the terms included; where it isn't given, those of terms.
    """
    return tfidf_of_counts(terms.groupBy(doc, term).agg(F.count("*").alias("tf")), doc, term, docs)


def tfidf_of_counts(tf: DataFrame, doc: str, term: str, docs: DataFrame | None = None) -> DataFrame:
    """tfidf of terms counted already: doc, term and tf."""
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = (tf.select(doc).distinct() if docs is None else docs).agg(F.count("*").alias("n"))
    raw = tf.join(df, term).crossJoin(F.broadcast(n)).select(doc, term, ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, doc).select(doc, term, (F.col("w") / F.col("length")).alias("w"))


def unit_weights(raw: DataFrame, doc: str, term: str) -> DataFrame:
    """doc, term and w of raw weights, each document of length one; raw is computed once."""
    return raw.select(doc, term, (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).alias("w"))


def sparse_vectors(works: DataFrame, weights: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """works with ix and w: the places of a work's terms in a vocabulary (term, i; of bounded size) and their weights, in order; empty for a work without any."""
    each = weights.join(F.broadcast(names), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x"))
    out = works.join(each, key, "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return out.withColumns({"ix": empty("x.i", "array<int>"), "w": empty("x.w", "array<double>")}).drop("x")


def lexical_js(pairs: DataFrame, weights: DataFrame, key: str, term: str, size: int | None = None, by: str | None = None) -> DataFrame:
    """Jensen-Shannon distance (the root, in natural units) of the sides' mean weights, smoothed by EPSILON over a vocabulary of so many terms, or over the pair's own.

    by: a column of pairs that alone tells a work's pairs and sides (its year), and of which weights are sums already, in place of a work's own: then weights has by, term and w."""
    n = pairs.groupBy(*PAIR).agg(F.count_if(F.col("side") == "before").alias("nb"), F.count_if(F.col("side") == "after").alias("na"))
    met = pairs.join(weights, key) if by is None else weights.join(F.broadcast(pairs.select(*PAIR, "side", by).distinct()), by)
    w = met.groupBy(*PAIR, term).agg(F.sum(F.when(F.col("side") == "before", F.col("w")).otherwise(0.0)).alias("sb"), F.sum(F.when(F.col("side") == "after", F.col("w")).otherwise(0.0)).alias("sa"))
    m = w.join(F.broadcast(n), PAIR).withColumns({"b": F.col("sb") / F.col("nb"), "a": F.col("sa") / F.col("na")})
    return _js(m.select(*PAIR, term, "b", "a"), "b", "a", EPSILON, F.ln, size).withColumn("value", F.sqrt(F.greatest(F.lit(0.0), F.col("value"))))


def novelty(works: DataFrame, weights: DataFrame, key: str, year: str, window: int, clip: float = 50.0) -> DataFrame:
    """Per year: mean divergence of its documents from the window before (novelty) and after (transience), and their difference (resonance).

    A document's terms are few, so only they are summed; a term that the window lacks has EPSILON.
    """
    y = works.select(F.col(key), F.col(year).alias("y"))
    yearly = y.join(weights, key).groupBy("y", "term").agg(F.sum("w").alias("w"))  # a year's terms move, not each document's
    shift = F.explode(F.expr(f"array_except(sequence(-{window}, {window}), array(0))")).alias("d")
    about = yearly.select("y", "term", "w", shift).select((F.col("y") - F.col("d")).alias("anchor"), F.when(F.col("d") < 0, "past").otherwise("future").alias("side"), "term", "w")
    group = about.groupBy("anchor", "side", "term").agg(F.sum("w").alias("g"))
    total = group.groupBy("anchor", "side").agg(F.sum("g").alias("t"))
    ends = y.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    doc = y.crossJoin(F.broadcast(ends)).where(f"y >= lo + {window} AND y <= hi - {window}").join(weights, key)
    size = weights.groupBy(key).agg(F.sum("w").alias("s"))
    doc = doc.join(size, key).select(key, F.col("y").alias("anchor"), "term", (F.col("w") / F.col("s")).alias("p"), F.explode(F.array(F.lit("past"), F.lit("future"))).alias("side"))
    each = doc.join(F.broadcast(total), ["anchor", "side"]).join(group, ["anchor", "side", "term"], "left")
    kl = F.sum(F.col("p") * F.ln(F.col("p") / (F.coalesce("g", F.lit(0.0)) / F.col("t") + EPSILON)))
    d = each.groupBy("anchor", "side", key).agg(F.least(kl, F.lit(clip)).alias("kl")).groupBy("anchor").agg(F.avg(F.when(F.col("side") == "past", F.col("kl"))).alias("novelty"), F.avg(F.when(F.col("side") == "future", F.col("kl"))).alias("transience"))
    return d.withColumn("resonance", F.col("novelty") - F.col("transience"))


def bursts(terms: DataFrame, doc: str, term: str, year: str, top: int, above: float) -> DataFrame:
    """Per year: how many of the top terms stand above their own mean over all years by so many population deviations."""
    best = terms.groupBy(term).agg(F.count("*").alias("n")).orderBy(F.desc("n"), term).limit(top).select(term)
    docs = terms.groupBy(year).agg(F.count_distinct(doc).alias("docs"))
    n = terms.join(F.broadcast(best), term).groupBy(term, year).agg(F.count("*").alias("n"))
    grid = best.crossJoin(docs).join(n, [term, year], "left").withColumn("m", F.coalesce("n", F.lit(0)) / F.col("docs"))  # top terms by years
    s = grid.groupBy(term).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    z = grid.join(s, term).withColumn("z", F.when(F.col("sd") > 0, (F.col("m") - F.col("mean")) / F.col("sd")))
    return z.groupBy(year).agg(F.count_if(F.col("z") > above).alias("value"))


def log_odds(terms: DataFrame, term: str, before: Column) -> DataFrame:
    """term, log_odds, before and after: the log odds of two sides with a prior in proportion to all counts, of total size the vocabulary."""
    n = terms.groupBy(term).agg(F.count_if(before).alias("b"), F.count_if(~before).alias("a"))
    t = n.agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"), F.count("*").alias("v"))
    j = n.crossJoin(F.broadcast(t))
    prior = F.col("v") * (F.col("a") + F.col("b")) / (F.col("ta") + F.col("tb"))
    odds = lambda c, total: F.ln((F.col(c) + prior) / (F.col(total) + F.col("v") - F.col(c) - prior))
    return j.select(term, (odds("a", "ta") - odds("b", "tb")).alias("log_odds"), F.col("b").alias("before"), F.col("a").alias("after"))


def mean_shift(works: DataFrame, weights: DataFrame, key: str, term: str, side: str) -> DataFrame:
    """term, diff (mean weight after less mean weight before), and docs_before and docs_after, the works that have the term."""
    n = works.groupBy(side).agg(F.count("*").alias("n"))
    w = works.join(weights, key).groupBy(side, term).agg(F.sum("w").alias("s"), F.count("*").alias("docs")).join(F.broadcast(n), side).withColumn("m", F.col("s") / F.col("n"))
    sign = F.when(F.col(side) == "after", F.col("m")).otherwise(-F.col("m"))
    docs = [F.coalesce(F.sum(F.when(F.col(side) == k, F.col("docs"))), F.lit(0)).alias(f"docs_{k}") for k in ("before", "after")]
    return w.groupBy(term).agg(F.sum(sign).alias("diff"), *docs)


def age_shift(edges: DataFrame, least: int) -> DataFrame:
    """year and value: the median year of what a year's works cite; null with fewer than least. edges: year, ref_year."""
    return edges.groupBy("year").agg(F.when(F.count("ref_year") >= least, F.percentile("ref_year", F.lit(0.5))).alias("value"))


def degree_entropy_shift(pairs: DataFrame, ref: str) -> DataFrame:
    """The change of the entropy of in-degrees' distribution. pairs: anchor, window, side, ref for each edge."""
    d = pairs.groupBy(*PAIR, "side", ref).agg(F.count("*").alias("d")).groupBy(*PAIR, "side", "d").agg(F.count("*").alias("n"))
    h = d.groupBy(*PAIR, "side").agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("h"))
    return h.groupBy(*PAIR).agg(F.abs(F.sum(F.when(F.col("side") == "after", F.col("h")).otherwise(-F.col("h")))).alias("value"))


def exponent_shift(pairs: DataFrame, ref: str, least: int = 10) -> DataFrame:
    """anchor, window and value: the change of the exponent of a power law fitted to the share of cited refs that have k citations or more.

    pairs: anchor, window, side and ref for each edge. Degrees are counted by aggregates; only how many refs have each degree reaches a task. Null with fewer than
    least cited refs or two degrees on a side.
    """
    d = pairs.groupBy(*PAIR, "side", ref).agg(F.count("*").alias("d")).groupBy(*PAIR, "side", "d").agg(F.count("*").alias("n"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for side in ("before", "after"):
            r = rows[rows["side"] == side].sort_values("d")
            k, n = r["d"].to_numpy(float), r["n"].to_numpy(float)
            found.append(power_law(k, n[::-1].cumsum()[::-1] / n.sum()) if n.sum() >= least and len(k) > 1 else None)
        value = None if None in found else abs(found[1] - found[0])
        return pd.DataFrame({"anchor": [key[0]], "window": [key[1]], "value": [value]}).astype({"value": "float64"})

    return d.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, value double")


def power_law(x: np.ndarray, y: np.ndarray, steps: int = 500) -> float | None:
    """The exponent a of c * x^-a by least squares on y, from a = 1.5 and c = 1 on; c follows from a, and a is sought by damped Newton steps. Null where none is found."""

    def parts(a: float) -> tuple[float, np.ndarray, np.ndarray]:
        p = x**-a
        c = (p @ y) / (p @ p)
        slope = -np.log(x) * p
        turn = (slope @ y - 2 * c * (slope @ p)) / (p @ p)  # how c moves with a
        return float(((y - c * p) ** 2).sum()), y - c * p, turn * p + c * slope

    a, damp = 1.5, 1e-3
    cost, rest, slope = parts(a)
    for _ in range(steps):
        step = (slope @ rest) / (slope @ slope * (1 + damp) + 1e-300)
        better, r, s = parts(a + step)
        if not np.isfinite(better):
            return None
        if better <= cost:
            done = abs(step) < 1e-12 * max(1.0, abs(a))
            a, cost, rest, slope, damp = a + step, better, r, s, damp / 3
            if done:
                break
        else:
            damp = max(damp, 1e-9) * 4
            if damp > 1e12:
                break
    return float(a)


def _citers_by_ref(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and far, the other nodes that share a ref; node and j, those of them that cite the node: by listing every two sources of a ref."""
    cites = e.toDF("node", "r")
    meet = cites.join(e.toDF("citer", "r"), "r").where("citer <> node").select("node", "citer").distinct()
    met = meet.join(e.toDF("citer", "node").withColumn("direct", F.lit(1)), ["node", "citer"], "left")
    return met.groupBy("node").agg(F.count("*").alias("far")), met.where("direct = 1").groupBy("node").agg(F.count("*").alias("j"))


def _citers_by_source(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As _citers_by_ref, by listing every two refs of a source.

    The sources of a node's refs are summed with their repeats, which are known from the sources that share two refs or more: those that meet on two of their refs. A citer
    shares a ref with what it cites where one of its refs cites another."""
    pairs = e.toDF("src", "lo").join(e.toDF("src", "hi"), "src").where("lo < hi").select("src", "lo", "hi")
    twice = pairs.join(pairs.withColumnRenamed("src", "citer"), ["lo", "hi"]).where("src <> citer").groupBy("src", "citer").agg(F.count("*").alias("t"))  # of c refs shared, c (c - 1) / 2
    more = twice.groupBy(F.col("src").alias("node")).agg(F.sum(F.round((F.sqrt(1 + 8 * F.col("t")) - 1) / 2).cast("long")).alias("more"))
    cited = e.groupBy("ref").agg((F.count("*") - 1).alias("n"))
    far = e.join(cited, "ref").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n")).join(more, "node", "left").select("node", (F.col("n") - F.coalesce("more", F.lit(0))).alias("far"))
    links = e.where("src <> ref").select(F.least("src", "ref").alias("lo"), F.greatest("src", "ref").alias("hi"), F.col("src").alias("node"))
    own = e.join(e.where("src = ref").select("ref"), "ref").where("src <> ref").select(F.col("ref").alias("node"), F.col("src").alias("citer"))  # a loop is a ref shared with every citer
    both = pairs.join(links, ["lo", "hi"]).select("node", F.col("src").alias("citer")).where("node <> citer").union(own).distinct()
    return far, both.groupBy("node").agg(F.count("*").alias("j"))


def disruption(edges: DataFrame, alone: bool = False) -> DataFrame:
    """node and cd: (i - j) / (i + j + k) of nodes that cite and are cited; i citers cite it alone, j also cite what it cites, k cite only that.

    alone: nodes that only cite or only are cited count as well, where anything is left to divide by. Citers and refs meet by joins on the edges, in the way that lists fewer pairs; nothing is gathered by node.
    """
    e = graph.written(edges.select("src", "ref").distinct())
    listed = lambda key: e.groupBy(key).agg(F.count("*").cast("double").alias("d")).agg(F.sum(F.col("d") * (F.col("d") - 1))).first()[0] or 0.0
    far, both = (_citers_by_source if listed("src") <= listed("ref") else _citers_by_ref)(e)
    direct = e.groupBy(F.col("ref").alias("node")).agg(F.count("*").alias("d"))
    cites = e.select(F.col("src").alias("node")).distinct()
    n = direct.join(far, "node", "full") if alone else direct.join(cites, "node", "left_semi").join(far, "node", "left")
    n = n.join(both, "node", "left").select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("d", "far", "j")))
    return n.where("d + far > 0").select("node", ((F.col("d") - 2 * F.col("j")) / (F.col("d") + F.col("far") - F.col("j"))).alias("cd"))


def yearly_disruption(edges: DataFrame, years: DataFrame) -> DataFrame:
    """year and value: the mean disruption of the nodes of a year (node, year); null in a year without any that has one."""
    each = years.select("node", "year").distinct().join(disruption(edges, alone=True), "node", "left")
    return each.groupBy("year").agg(F.avg("cd").alias("value"))


def crossing_share(edges: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """Per group of edges (a, b, by): the share whose ends differ in label."""
    e = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    return e.groupBy(by).agg(F.avg(F.expr("CASE WHEN la <> lb THEN 1.0D ELSE 0.0D END")).alias("value"))


def distinctive_terms(works: DataFrame, weights: DataFrame, key: str, cluster: str, k: int) -> DataFrame:
    """cluster, term, score and place: the k terms of most mean weight in a cluster beyond that in the whole corpus."""
    total = works.agg(F.count("*").alias("all"))
    size = works.groupBy(cluster).agg(F.count("*").alias("n"))
    w = works.join(weights, key).groupBy(cluster, "term").agg(F.sum("w").alias("s"))
    whole = w.groupBy("term").agg(F.sum("s").alias("t"))
    score = F.round(F.col("s") / F.col("n") - F.col("t") / F.col("all"), 6)
    each = w.join(F.broadcast(size), cluster).join(whole, "term").crossJoin(F.broadcast(total)).select(cluster, "term", score.alias("score"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "term"))
    return each.withColumn("place", place).where(F.col("place") <= k)
