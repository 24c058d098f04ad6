"""Greedy matching of two sides by score, in rounds of mutual bests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import graph


def greedy(pairs: DataFrame) -> DataFrame:
    """a, b and score of the pairs (a, b, score) that a walk down all pairs would take, each a and each b once.

    The walk is by score, the greatest first, then by the smaller a, then the smaller b. A pair that is first for both its sides
    is taken whatever stands above it, so all such pairs are taken at once, and what shares a side with them goes: the result is that of
    the walk. Each round takes the first pair of all at least, and of scores in no order some half of what is left.
    """
    left = graph.settle(pairs.select("a", "b", F.col("score").cast("double").alias("score")).where("a IS NOT NULL AND b IS NOT NULL AND score IS NOT NULL").groupBy("a", "b").agg(F.max("score").alias("score")))
    taken = None
    while not left.isEmpty():
        first = F.min(F.struct((-F.col("score")).alias("m"), "a", "b")).alias("first")
        by_a = left.groupBy("a").agg(first).select("first.a", "first.b", "first.m")
        by_b = left.groupBy("b").agg(first).select("first.a", "first.b")
        won = graph.settle(by_a.join(by_b, ["a", "b"]).select("a", "b", (-F.col("m")).alias("score")))
        taken = won if taken is None else taken.unionByName(won)
        left = graph.settle(left.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti").select("a", "b", "score"))
    return left if taken is None else taken


def assign(scores: DataFrame, other: str = "other") -> DataFrame:
    """a and label of every a of scores (a, b, score): the b that greedy matching by positive score gives it, or other."""
    won = greedy(scores.where("score > 0"))
    return scores.select("a").distinct().join(won.select("a", F.col("b").alias("label")), "a", "left").select("a", F.coalesce("label", F.lit(other)).alias("label"))


def _jaccard(x: DataFrame, y: DataFrame) -> DataFrame:
    """a, b and j of labelings (node, label) that share a node."""
    both = x.toDF("node", "a").join(y.toDF("node", "b"), "node").groupBy("a", "b").agg(F.count("*").alias("n"))
    size = lambda d, c: d.groupBy(F.col(d.columns[1]).alias(c)).agg(F.count("*").alias(f"n{c}"))
    return both.join(size(x, "a"), "a").join(size(y, "b"), "b").select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))


def _best(pairs: DataFrame, of: str, to: str, least: float) -> DataFrame:
    """of and to: the to of greatest j, the smallest among equals, where j reaches least."""
    top = F.min(F.struct((-F.col("j")).alias("m"), to)).alias("top")
    return pairs.where(F.col("j") >= least).groupBy(of).agg(top).select(of, F.col(f"top.{to}").alias(to))


def align(windows: Sequence[DataFrame], least: float = 0.05) -> DataFrame:
    """One row a chain of communities through windows of labelings (node, label), as columns w0, w1 and on; null where a window has no match.

    From each community of the last window back, every step to the community of greatest Jaccard index with the one before it, if it reaches least.
    Communities of earlier windows that no chain holds start chains of their own, forward, each window matched with the start itself. Equal chains count once.
    """
    windows = [graph.settle(w.toDF("node", "label").where("node IS NOT NULL AND label IS NOT NULL").distinct()) for w in windows]
    names = [f"w{i}" for i in range(len(windows))]
    none = F.lit(None).cast(dict(windows[0].dtypes)["label"])
    chains = windows[-1].select(F.col("label").alias(names[-1])).distinct()
    for i in range(len(windows) - 2, -1, -1):
        step = _best(_jaccard(windows[i], windows[i + 1]).toDF("to", "of", "j"), "of", "to", least)
        chains = chains.join(step.toDF(names[i + 1], names[i]), names[i + 1], "left")
    chains = graph.settle(chains.select(*names))
    for i in range(len(windows) - 1):
        alone = windows[i].select(F.col("label").alias(names[i])).distinct().join(chains.select(names[i]).where(F.col(names[i]).isNotNull()).distinct(), names[i], "left_anti")
        for k in range(i + 1, len(windows)):
            alone = alone.join(_best(_jaccard(windows[i], windows[k]).toDF("of", "to", "j"), "of", "to", least).toDF(names[i], names[k]), names[i], "left")
        chains = graph.settle(chains.unionByName(alone.select(*(F.col(c) if c in alone.columns else none.alias(c) for c in names))))
    return chains.distinct()


def anchored(nodes: DataFrame, anchors: dict[str, Sequence[str]], label: str, text: Column) -> DataFrame:
    """a (label), b (the name of a group of anchors) and score: how many rows of nodes with that label hold one of the group's anchors in their text; all pairs of labels and groups."""
    counts = [F.count_if(F.greatest(*(F.contains(text, F.lit(t)) for t in ts), F.lit(False))).alias(k) for k, ts in anchors.items()]
    each = nodes.groupBy(F.col(label).alias("a")).agg(*counts)
    return each.select("a", F.explode(F.array(*(F.struct(F.lit(k).alias("b"), F.col(k).alias("score")) for k in anchors))).alias("x")).select("a", "x.b", "x.score")


def anchor_labels(nodes: DataFrame, given: dict[str, Sequence], anchors: dict[str, Sequence[str]]) -> DataFrame:
    """node and label of nodes (node, text): the group that is given the node itself, the last of several; else the one group whose anchors stand in the lower-cased text. Nodes of no group or of two go."""
    own = {v: k for k, vs in given.items() for v in vs}
    kind = dict(nodes.dtypes)["node"]
    told = nodes.sparkSession.createDataFrame([(k, v) for k, v in own.items()], f"node {kind}, own string")
    text = F.lower("text")
    hit = F.array_compact(F.array(*(F.when(F.greatest(*(F.contains(text, F.lit(t)) for t in ts), F.lit(False)), F.lit(k)) for k, ts in anchors.items())))
    label = F.coalesce("own", F.when(F.size(hit) == 1, F.get(hit, F.lit(0))))
    return nodes.select("node", "text").join(F.broadcast(told), "node", "left").select("node", label.alias("label")).where("label IS NOT NULL")
