"""Methods in one contract, degree laws, yearly disruption, communities of windows and language by grams against plain computations."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import divergence as D
from corpusloom.operators import kernels, language
from corpusloom.plans import catalog, methods

SF = "/root/testdata/sf0.001"


def test_power_law_is_the_least_squares_one():
    rng = np.random.default_rng(1)
    for turn in range(20):
        k = np.unique(rng.integers(1, 30, 12)).astype(float)
        y = np.sort(rng.random(len(k)))[::-1] if turn % 2 else 0.8 * k**-1.7
        a = D.power_law(k, y)
        cost = lambda a, k=k, y=y: (((y - (k**-a @ y) / (k**-a @ k**-a) * k**-a)) ** 2).sum()
        near = a + np.linspace(-0.5, 0.5, 4001)
        assert cost(a) <= min(cost(x) for x in near) + 1e-12
    assert D.power_law(np.arange(1.0, 9), 0.5 * np.arange(1.0, 9) ** -1.3) == pytest.approx(1.3)


def sided(spark, seed=2):
    rng = np.random.default_rng(seed)
    rows = sorted({(2000 + int(a), 1, s, int(x), int(100 + y)) for a in range(2) for s in ("before", "after") for x, y in zip(rng.integers(0, 30, 90), rng.zipf(1.6, 90) % 25, strict=True)})
    return rows, spark.createDataFrame(rows, "anchor long, window int, side string, src long, ref long").repartition(3)


def test_exponent_shift(spark):
    rows, df = sided(spark)
    got = {r.anchor: r.value for r in D.exponent_shift(df, "ref").collect()}
    for anchor in (2000, 2001):
        found = []
        for side in ("before", "after"):
            d = np.array(list(Counter(r[4] for r in rows if r[0] == anchor and r[2] == side).values()))
            k = np.unique(d).astype(float)
            found.append(D.power_law(k, np.array([(d >= x).mean() for x in k])))
        assert got[anchor] == pytest.approx(abs(found[1] - found[0]))
    assert [r.value for r in D.exponent_shift(df.where("src < 2"), "ref").collect()] == [None, None]


def test_yearly_disruption(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 25, (80, 2)) if a > b})
    years = {i: 2000 + i % 3 for i in range(28)}
    refs = {i: {b for a, b in edges if a == i} for i in years}
    citers = {i: {a for a, b in edges if b == i} for i in years}
    want = {}
    for i, y in years.items():
        j = sum(bool(refs[c] & refs[i]) for c in citers[i])
        k = len(set().union(*(citers[r] for r in refs[i])) - citers[i] - {i}) if refs[i] else 0
        n = len(citers[i]) + k
        if n:
            want.setdefault(y, []).append((len(citers[i]) - 2 * j) / n)
    got = {r.year: r.value for r in D.yearly_disruption(spark.createDataFrame(edges, "src long, ref long"), spark.createDataFrame([*years.items(), (99, 2010)], "node long, year long")).collect()}
    assert got.pop(2010) is None and got == pytest.approx({y: np.mean(v) for y, v in want.items()})


def test_crossing_shares(spark):
    edges = [(a, b, 2000 + (a + b) % 3) for a, b in itertools.combinations(range(8), 2)] + [(1, 77, 2000)]
    labels = {i: "xyx"[i % 3] for i in range(8)}
    got = {r.y: r.value for r in D.crossing_share(spark.createDataFrame(edges, "a long, b long, y long"), spark.createDataFrame(list(labels.items()), "node long, label string"), "y").collect()}
    for y in (2000, 2001, 2002):
        mine = [labels[a] != labels[b] for a, b, z in edges if z == y and b in labels]
        assert got[y] == pytest.approx(np.mean(mine))


def divergence(p, q):
    m = (p + q) / 2
    return sum((x[x > 0] * np.log(x[x > 0] / m[x > 0])).sum() for x in (p, q)) / 2


def test_community_divergence(spark):
    """Two cliques that a single edge joins: the communities are plain, so the value is that of the cliques' shares of the sides."""
    cliques = [list(range(5)), list(range(10, 15))]
    every = [(b, a) for c in cliques for a, b in itertools.combinations(c, 2)] + [(10, 0)]
    before = [e for e in every if max(e) < 5] + [(11, 10)]
    after = [e for e in every if min(e) >= 10] + [(1, 0), (2, 1)]
    rows = [(2000, 1, s, *e) for s, es in (("before", before), ("after", after)) for e in es]
    got = kernels.community_divergence(spark.createDataFrame(rows, "anchor long, window int, side string, src long, ref long"), spark.createDataFrame([*every, (500, 0)], "src long, ref long")).collect()
    shares = [np.array([np.mean([v >= 10 for v in n]), np.mean([v < 10 for v in n])]) for n in ({x for e in es for x in e} for es in (before, after))]
    assert len(got) == 1 and got[0].value == pytest.approx(divergence(*shares))


def test_rank_shift(spark):
    rows, df = sided(spark, 4)
    got = {r.anchor: r.value for r in kernels.rank_shift(df).collect()}
    for anchor in (2000, 2001):
        ranks = []
        for side in ("before", "after"):
            edges = {(r[3], r[4]) for r in rows if r[0] == anchor and r[2] == side}
            nodes = sorted({x for e in edges for x in e})
            at = {v: i for i, v in enumerate(nodes)}
            m = np.zeros((len(nodes), len(nodes)))
            for a, b in edges:
                m[at[b], at[a]] = 1
            out = m.sum(axis=0)
            m[:, out == 0] = 1
            m /= m.sum(axis=0)
            r = np.full(len(nodes), 1 / len(nodes))
            for _ in range(500):
                r = 0.15 / len(nodes) + 0.85 * m @ r
            ranks.append(r)
        top = max(r.max() for r in ranks)
        p, q = (np.histogram(r, 20, (0, top))[0] / len(r) for r in ranks)
        assert got[anchor] == pytest.approx(divergence(p, q), abs=1e-6)


def test_contract(spark):
    df = methods.series(spark, SF, "L2")
    assert df.columns == methods.CONTRACT and dict(df.dtypes) == {"year": "bigint", "channel": "string", "window": "string", "hyperparams": "string", "value": "double"}
    plain = {(r.anchor, str(r.window)): r for r in catalog.QUERIES["div_l2"](spark, SF).collect()}
    rows = df.collect()
    assert len(rows) == 3 * len(plain) and all(r.value == plain[r.year, r.window][r.hyperparams] and r.channel == "lexical" for r in rows)
    assert {r.window for r in methods.series(spark, SF, "G3_coupling_age").collect()} == {"cumulative"}
    with pytest.raises(ValueError, match="no method"):
        methods.series(spark, SF, "S9")
    assert len(methods.METHODS) == 18 and all(m.query in catalog.QUERIES for m in methods.METHODS.values())


def test_change_points_of_any_method(spark):
    s = methods.all_series(spark, SF, ("S2_energy", "G3_coupling_age")).fillna("default", ["hyperparams"])
    got = kernels.change_points(s, "year", "value", ["method", "window", "hyperparams"]).toPandas()
    one = s.where("method = 'G3_coupling_age'").toPandas()
    alone = kernels.change_points(spark.createDataFrame(one), "year", "value", ["method", "window", "hyperparams"]).toPandas()
    order = ["method", "window", "hyperparams", "detector", "parameter"]
    mine = got[got["method"] == "G3_coupling_age"].sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(mine, alone.sort_values(order).reset_index(drop=True))
    assert len(mine)


def test_language_by_grams(spark):
    rows = [(1, "en", "the cat and the dog"), (2, "fr", "le chat et le chien"), (3, "en", "a dog and a cat"), (4, None, "the dog"), (5, None, "LE CHIEN!"), (6, None, "12 %"), (7, None, None), (8, None, "ж")]
    got = {r.id: r.detected for r in language.detect(spark.createDataFrame(rows, "id long, lang string, t string"), "id", "t", spark.createDataFrame([(i, g) for i, g, _ in rows], "id long, lang string")).collect()}
    grams = lambda w: [f"_{w}_"[i : i + 3] for i in range(len(w))]
    c = {g: Counter(x for _, lang, t in rows if lang == g for w in t.split() for x in grams(w)) for g in ("en", "fr")}
    seen = set(c["en"]) | set(c["fr"])
    for i, _, t in rows:
        words = [w for w in "".join(x if x.isalpha() else " " for x in (t or "").lower()).split()]
        known = [x for w in words for x in grams(w) if x in seen]
        score = {g: round(sum(math.log((c[g][x] + 0.5) / (sum(c[g].values()) + 0.5 * (len(seen) + 1))) for x in known), 4) for g in c}
        assert got[i] == (min(score, key=lambda g: (-score[g], g)) if known else None)


def test_language_of_held_out_documents(spark):
    rows = [r for r in catalog.QUERIES["fn_detect_lang"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 200 and np.mean([r.lang == r.detected for r in rows]) >= 0.95


def test_pagerank_comes_to_rest(spark):
    from corpusloom.operators import graph

    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 20, (60, 2)) if a != b})
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, ref long"), 200, tolerance=1e-12).collect()}
    nodes = sorted({x for e in edges for x in e})
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in edges:
        m[nodes.index(b), nodes.index(a)] = 1
    m[:, m.sum(axis=0) == 0] = 1
    m /= m.sum(axis=0)
    r = np.linalg.solve(np.eye(len(nodes)) - 0.85 * m, np.full(len(nodes), 0.15 / len(nodes)))
    assert [got[v] for v in nodes] == pytest.approx(r, abs=1e-9)


def test_texts_are_repaired(spark):
    from corpusloom.functions import text as T

    plain = ["é à ç", "it’s — “so”", "Zürich €5 ß", "naïve œuvre", "日本 и русский", "a & b < c", "Âme Ã", "plain"]
    garbled = [t.encode().decode("latin-1") for t in plain]
    for want, bad in zip(plain[:-2], garbled[:-2], strict=True):
        assert T.repair(bad) == want
    assert T.repair("it’s é".encode().decode("cp1252")) == "it’s é" and T.repair("é".encode().decode("latin-1").encode().decode("latin-1")) == "é"
    assert T.repair("Âme Ã plain café") == "Âme Ã plain café"
    assert T.repair("&amp;#43; &amp;eacute; &nbsp;&hellip; &Aacute;") == "+ é  … Á"
    rows = [(1, "a\\nb &amp;lt; ​c   d"), (2, None), (3, ""), (4, "cafÃ©  x\ty"), (5, "  ")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id long, t string").select("id", T.norm_text_whole(F.col("t")).alias("t")).collect()}
    assert got == {1: "a b < c d", 2: "", 3: "", 4: "café x y", 5: ""}
