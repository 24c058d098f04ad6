"""Names of clusters against plain counts and a plain reading of the rules."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.operators import labels

STOPS = ["the", "of"]


def plain_terms(text):
    w = [x for x in re.findall(r"\w{2,}", text.lower()) if x not in STOPS]
    return w + [" ".join(p) for p in zip(w, w[1:])]


def plain(docs, least):
    """By cluster the scores of all terms, by TF-IDF of whole texts."""
    counts = {i: Counter(plain_terms(t)) for i, _, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    total = sum(counts.values(), Counter())
    fit = sorted((t for t in df if least <= df[t] <= 0.8 * len(docs)), key=lambda t: (-total[t], t))[:8000]
    mean, whole = defaultdict(Counter), Counter()
    size = Counter(c for _, c, _ in docs)
    for i, c, _ in docs:
        w = {t: (1 + math.log(counts[i][t])) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in fit if t in counts[i]}
        length = math.sqrt(sum(x * x for x in w.values())) or 1
        for t in w:
            mean[c][t] += w[t] / length / size[c]
            whole[t] += w[t] / length / len(docs)
    return {c: [(t, round(mean[c][t] - whole[t], 9)) for t in mean[c]] for c in size}


def test_labels_equal_plain_scores(spark):
    r = random.Random(3)
    topics = {1: "carbon market carbon price trading scheme", 2: "solar panels solar cell wind farms wind farm", 3: "green bonds bond green bond funds"}
    docs = [(i, c, " ".join(r.choice(topics[c].split()) if r.random() < 0.6 else r.choice("the of study paper result data model".split()) for _ in range(30)) + " " + topics[c]) for i in range(90) for c in [1 + i % 3]]
    docs += [(900, 3, ""), (901, 1, "the")]
    df = spark.createDataFrame(docs, "doc_id bigint, c bigint, text string")
    each = labels.terms(df, "doc_id", F.col("text"), STOPS)
    got = {r.c: r.label for r in labels.labels(df.select("doc_id", "c"), each, labels.known(each, "doc_id", df.count(), 3), "doc_id", "c").collect()}
    want = {c: " / ".join(labels.fold(s)) for c, s in plain(docs, 3).items()}
    assert got == want and all(len(x.replace(" / ", " ").split()) <= 10 for x in got.values()) and any(" " in p for x in got.values() for p in x.split(" / "))


def test_fold():
    assert labels.fold([("carbon market", 0.5), ("carbon", 0.9), ("market", 0.2)]) == ["carbon market"]
    # A pair weaker than half its stronger word gives way to the word.
    assert labels.fold([("carbon market", 0.4), ("carbon", 0.9), ("tax", 0.3)]) == ["carbon", "tax"]
    # Stems without final s are said once.
    assert labels.fold([("bond", 0.5), ("bonds", 0.4), ("fund", 0.3)]) == ["bond", "fund"]
    # Two words give way to a pair no weaker than the weaker one, in either order.
    assert labels.fold([("wind", 0.9), ("farm", 0.2), ("farm wind", 0.25)]) == ["farm wind"]
    assert labels.fold([(f"w{i:02}", 1 - i / 100) for i in range(20)]) == [f"w{i:02}" for i in range(10)]
    assert labels.fold([]) == [] and labels.fold([("a", -0.1)]) == []


def test_empty_and_unclustered(spark):
    df = spark.createDataFrame([(1, None, "alpha beta"), (2, "x", None)], "doc_id bigint, c string, text string")
    each = labels.terms(df, "doc_id", F.col("text"), [])
    assert sorted(r.term for r in each.collect()) == ["alpha", "alpha beta", "beta"]
    got = labels.labels(df.select("doc_id", "c"), each, labels.known(each, "doc_id", 2, 1), "doc_id", "c").collect()
    assert [tuple(r) for r in got] == [("x", "")]
