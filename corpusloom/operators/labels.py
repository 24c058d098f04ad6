"""Names of clusters: words and pairs of words that tell a cluster's documents from the rest, without saying one thing twice."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import counting, graph
from corpusloom.operators import divergence as D

#: Candidates of a cluster, and words of its label.
PAIRS, WORDS, MOST = 20, 30, 10


def terms(docs: DataFrame, key: str, text: Column, stops: list[str], word: str = r"\w{2,}") -> DataFrame:
    """key, term and n: how often a key's texts have each word, without stop words, and each two that then stand side by side."""
    away = frozenset(stops)

    def found() -> Callable[[str], Counter]:
        find = re.compile(word).findall

        def tell(t: str) -> Counter:
            w = [x for x in find(t) if x not in away]
            return Counter(w + list(map(" ".join, itertools.pairwise(w))))

        return tell

    return counting.counts(docs, key, text, found, counting.once(docs.where(text.isNotNull()), key))


def known(each: DataFrame, key: str, n_docs: int, least: int, share: float = 0.8, most: int = 8000) -> DataFrame:
    """The terms, with df, that stand in least documents at least and in no more than a share of them: the most frequent, of equal ones the first."""
    n = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
    return graph.settle(n.where((F.col("df") >= least) & (F.col("df") <= share * n_docs)).orderBy(F.desc("n"), "term").limit(most).select("term", "df"))


def fold(candidates: list[tuple[str, float]], most: int = MOST) -> list[str]:
    """The parts of a label from scored words and pairs: pairs at least half as strong as their stronger word come first, then words, each only if one of
    its stems (without final s) is new; then two words give way to a pair no weaker than the weaker of them, and what this frees is filled again."""
    score = dict(candidates)
    ranked = sorted((t for t in score if score[t] > 0), key=lambda t: (-score[t], t))
    words = [t for t in ranked if " " not in t][:WORDS]
    strong = {w: score[w] for w in words}
    pairs = [t for t in ranked if " " in t][:PAIRS]
    pairs = [t for t in pairs if 0 < max(strong.get(w, 0) for w in t.split()) <= 2 * score[t]]
    label, used = [], set()

    def fill() -> None:
        for t in pairs + words:
            stems = {w.rstrip("s") for w in t.split()}
            if sum(len(x.split()) for x in label) + len(t.split()) <= most and not stems <= used:
                label.append(t)
                used.update(stems)

    def merged() -> bool:
        singles = [t for t in label if " " not in t]
        for i, a in enumerate(singles):
            for b in singles[i + 1 :]:
                pair = next((p for p in (f"{a} {b}", f"{b} {a}") if p in score and score[p] >= min(score[a], score[b])), None)
                if pair:
                    label[label.index(a)] = pair
                    label.remove(b)
                    return True
        return False

    fill()
    while merged():
        pass
    fill()
    return label


def labels(works: DataFrame, each: DataFrame, names: DataFrame, key: str, cluster: str) -> DataFrame:
    """cluster and label (parts joined by ' / ', empty if no term tells it apart) of works (key, cluster), from the counts each (key, term, n) of the terms names.

    A term's score is its mean weight in a cluster beyond that in all works. To a cluster's task come its candidates and the pairs of them, some 1,000 rows at most.
    Works without a cluster count in the corpus alone.
    """
    n = works.count()
    weights = D.unit_weights(each.join(F.broadcast(names), "term").select(key, "term", ((1 + F.ln("n")) * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w")), key, "term")
    size = works.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    sums = works.join(weights, key).groupBy(cluster, "term").agg(F.sum("w").alias("s"))
    whole = sums.groupBy("term").agg(F.sum("s").alias("t"))
    score = sums.join(size, cluster).join(whole, "term").select(cluster, "term", F.round(F.col("s") / F.col("n") - F.col("t") / n, 9).alias("score")).where("score > 0")
    paired = F.instr("term", " ") > 0
    place = F.row_number().over(Window.partitionBy(cluster, paired).orderBy(F.desc("score"), "term"))
    placed = score.withColumn("place", place)
    top = placed.where(F.col("place") <= F.when(paired, PAIRS).otherwise(WORDS))
    words = top.where(~paired).select(cluster, "term")
    part = F.split("term", " ")
    rest = placed.where(paired & (F.col("place") > PAIRS)).withColumn("x", part[0]).withColumn("y", part[1])
    rest = rest.join(words.withColumnRenamed("term", "x"), [cluster, "x"], "left_semi").join(words.withColumnRenamed("term", "y"), [cluster, "y"], "left_semi")
    both = top.select(cluster, "term", "score").unionByName(rest.select(cluster, "term", "score"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        said = fold(list(zip(group["term"], group["score"], strict=True)))
        return pd.DataFrame({cluster: group[cluster].iloc[:1], "label": [" / ".join(said)]})

    found = both.groupBy(cluster).applyInPandas(one, f"{cluster} {dict(works.dtypes)[cluster]}, label string")
    return size.select(cluster).join(found, cluster, "left").select(cluster, F.coalesce("label", F.lit("")).alias("label"))
