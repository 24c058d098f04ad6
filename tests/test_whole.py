"""Queries that must use every row, against brute force."""

import re

import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import kernels
from corpusloom.plans import catalog, divergence_queries, inference_queries, kernel_queries

SF = "/root/testdata/sf0.001"


def every_edge(spark):
    e = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").toPandas()
    return {(a, b) for a, b in e.itertuples(index=False) if a != b}


def test_graphs_hold_every_edge(spark):
    e = every_edge(spark)
    assert {(r.src, r.ref) for r in kernel_queries.edge_pairs(spark, SF).select("src", "ref").collect()} <= e
    years = {r.year for r in kernel_queries.edges(spark, SF).select("year").distinct().collect()}
    wide = kernel_queries.W.sliding_pairs(kernel_queries.edges(spark, SF), "year", (1, 2)).where("src <> ref").count()
    assert years and kernel_queries.edge_pairs(spark, SF).count() == wide
    undirected = {(min(x), max(x)) for x in e}
    assert catalog.QUERIES["gr_rewire"](spark, SF).count() == len(undirected)
    nodes = {x for p in undirected for x in p}
    for name in ("gr_louvain", "ml_spectral"):
        assert {r.node for r in catalog.QUERIES[name](spark, SF).select("node").distinct().collect()} == nodes


def test_kernels_of_edges():
    rng = np.random.default_rng(3)
    a = (rng.random((60, 60)) < 0.06).astype(float)
    np.fill_diagonal(a, 0)
    i, j = np.nonzero(a)
    g = kernels._adjacency(pd.DataFrame({"src": i, "ref": j}))
    assert kernels.spectral_gap(g, 0) == pytest.approx(kernels.spectral_gap(a), abs=1e-7)
    two = np.kron(np.eye(2), np.ones((4, 4)) - np.eye(4))
    two[3, 4] = two[4, 3] = 1
    assert kernels.spectral_gap(two, 0) == pytest.approx(kernels.spectral_gap(two), abs=1e-9)
    path = np.diag(np.ones(3), 1)
    assert kernels.betweenness(path) == pytest.approx((0 + 4 + 4 + 0) / 4 / 6)
    assert kernels.rank_histogram(g).sum() == pytest.approx(1)
    assert kernels._largest(np.array([[0, 0, 0], [0, 0, 1.0], [0, 0, 0]])).n == 2


def test_lexical_samples_come_from_every_document(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    worded = {d.doc_id for d in docs if re.search(r"\w\w", (d.text or "").lower())}
    assert {r.doc_id for r in divergence_queries.every_term(spark, SF).select("doc_id").distinct().collect()} == worded
    seen = []
    keep = lambda p, *_: seen.append(p) or p
    monkeypatch.setattr(divergence_queries.W, "equal_n", keep)
    divergence_queries.lexical_sample(spark, SF)
    catalog.QUERIES["div_c2st_lex"](spark, SF)
    long = {d.doc_id for d in docs if len(d.text or "") >= 1500}
    for p in seen:
        assert long & {r.doc_id for r in p.select("doc_id").distinct().collect()}
    assert len(seen) == 2


def test_samples_and_rounds_are_the_references(spark, monkeypatch):
    most, rounds = [], []
    monkeypatch.setattr(kernel_queries.W, "equal_n", lambda p, i, seed, n, real=kernel_queries.W.equal_n: most.append(n) or real(p, i, seed, n))
    for name, at in (("permutation", 3), ("permutation_energy", 2), ("bootstrap", 3)):
        real = getattr(kernels, name)
        monkeypatch.setattr(kernels, name, lambda *a, real=real, at=at, name=name: rounds.append((name, a[at] if len(a) > at else real.__defaults__[0])) or real(*a))
    for name in ("div_s4", "div_c2st_emb", "div_c2st_lex", "rs_perm", "rs_perm_sem", "rs_perm_lex", "rs_perm_c2st", "rs_boot", "rs_summary", "ml_jl"):
        catalog.QUERIES[name](spark, SF)
    assert set(most) == {2000}
    assert set(rounds) == {("permutation", 500), ("permutation_energy", 500), ("bootstrap", 200)}


def test_components_of_every_edge(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in every_edge(spark):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {(r.node, r.component) for r in catalog.QUERIES["gr_components"](spark, SF).collect()} == {(x, find(x)) for x in root}


def test_kernel_distances():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(40, 3)) + [2.0, 0, 0]
    far, near = (kernels.sliced_wasserstein(x, z, np.random.default_rng(1), 400) for z in (x + [2.0, 0, 0], x[::-1]))
    assert near == pytest.approx(0) and far == pytest.approx(2 / 3**0.5, rel=0.1)
    d2 = ((np.vstack([x, y])[:, None] - np.vstack([x, y])[None]) ** 2).sum(axis=2)
    k = np.exp(-d2 / 4)
    slow = [k[i, j] for i in range(80) for j in range(80) if i != j and (i < 40) == (j < 40)]
    assert kernels.mmd(d2, 40, 2.0) == pytest.approx(2 * np.mean(slow) - 2 * np.mean([k[i, j] for i in range(40) for j in range(40, 80)]))


def test_cosine_moments(spark):
    from corpusloom.operators import divergence

    rng = np.random.default_rng(6)
    v, labels = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    rows = [(int(g), x.tolist()) for g, x in zip(labels, v, strict=True)] + [(0, [0.0] * 4), (None, [1.0] * 4), (1, None)]
    got = {r.same: r for r in divergence.cosine_moments(spark.createDataFrame(rows, "g int, v array<double>").repartition(3), "g", "v").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for same in (True, False):
        c = [u[i] @ u[j] for i in range(30) for j in range(i) if (labels[i] == labels[j]) == same]
        assert (got[same].n, got[same].mean, got[same].sd) == (len(c), pytest.approx(np.mean(c)), pytest.approx(np.std(c, ddof=1)))
    assert divergence.cosine_moments(spark.createDataFrame([], "g int, v array<double>"), "g", "v").collect() == []


def test_similar_pairs_and_overlaps(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import resolve

    rng = np.random.default_rng(7)
    sets = {i: {"common", *(f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 9)))} for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "id int, t string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r.a, r.b) for r in resolve.similar_pairs(df, "id", F.split("t", " "), 0.7).collect()} == want
    items = spark.createDataFrame([(f"n{i}", x) for i, s in sets.items() for x in s], "name string, item string")
    share = {(f"n{a}", f"n{b}") for a in sets for b in sets if f"n{a}" < f"n{b}" and len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) > 0.8}
    assert {(r.a, r.b) for r in resolve.overlapping_sets(items, "name", "item", 3, 0.8).collect()} == share


def test_numbered_and_equal_samples(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import windows

    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id")
    rows = sorted((r.k, r.id, r.place) for r in windows.numbered(df, [F.col("k"), F.col("id")], "place").collect())
    assert [r[2] for r in rows] == list(range(1, 1001))
    p = spark.range(300).selectExpr("1 AS anchor", "1 AS window", "CASE WHEN id < 100 THEN 'before' ELSE 'after' END AS side", "id AS k")
    for most, n in ((30, 30), (500, 100)):
        assert {r.side: r["count"] for r in windows.equal_n(p, "k", 1, most).groupBy("side").count().collect()} == {"before": n, "after": n}


def test_tails():
    from corpusloom.functions import special

    for got, want in (
        (special.chi2_sf(3.841458820694124, 1), 0.05), (special.chi2_sf(18.307038053275146, 10), 0.05), (special.chi2_sf(2.0, 2), np.exp(-1)), (special.chi2_sf(200.0, 100), 1.2e-8),
        (special.f_sf(4.102821015, 2, 10), 0.05), (special.f_sf(1.0, 7, 7), 0.5), (special.t_sf(2.776445105, 4), 0.025), (special.t_sf(-2.776445105, 4), 0.975),
        (special.t_sf(1.0, 1), 0.25), (special.t_quantile(0.975, 4), 2.776445105), (special.t_quantile(0.5, 9), 0.0),
    ):
        assert got == pytest.approx(want, rel=0.05 if want == 1.2e-8 else 1e-6, abs=1e-6 if want != 1.2e-8 else 0)


def test_fold_spread():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5))
    apart, alike = (kernels.auc_spread(kernels.fold_aucs(x, y, np.random.default_rng(1))) for y in (x + 1.5, rng.normal(size=(60, 5))))
    assert apart[0] > 0.9 and apart[2] <= apart[0] <= apart[3] and apart[5] < 0.01 and apart[4] == 5
    assert alike[5] > 0.05
    assert kernels.auc_spread(np.array([0.7, 0.7])) == (0.7, 0.0, 0.7, 0.7, 2, None)


def test_kernel_change_points():
    rng = np.random.default_rng(9)
    y = np.r_[rng.normal(0, 0.1, 12), rng.normal(3, 0.1, 12), rng.normal(0, 0.1, 12)]
    y = (y - y.mean()) / y.std()
    cost = kernels.gaussian(y)
    k = np.exp(-((y[:, None] - y[None, :]) ** 2) / np.median([(a - b) ** 2 for i, a in enumerate(y) for b in y[:i]]))
    assert cost(3, 9) == pytest.approx(6 - k[3:9, 3:9].sum() / 6)
    assert kernels.best_splits(y, 2, cost) == [12, 24] == kernels.penalised_splits(y, 1.0, cost=cost)
    assert kernels.penalised_splits(rng.normal(size=30), 5.0, cost=kernels.gaussian(rng.normal(size=30))) == []


def test_files(spark, tmp_path):
    from corpusloom.sources import readers, sinks

    df = spark.createDataFrame([(1, 'a "quoted", line\nbroken'), (2, None)], "id int, t string")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True, multiLine=True, escape='"').count() == 2
    sinks.write_parquet(df, f"file://{tmp_path}/p", "id")
    assert {(r.id, r.t) for r in spark.read.parquet(f"file://{tmp_path}/p").collect()} == {(r.id, r.t) for r in df.collect()}
    rows = spark.createDataFrame([("b", 1.5), ("a: x", None)], "metric string, value double")
    assert sinks.yaml_vars(rows) == '"a: x": null\n"b": 1.5\n'
    (tmp_path / "m.yaml").write_text("stages:\n  first:\n    cmd: run\n    deps:\n      - x.csv\n  merge-all:\n    cmd: run\n    deps:\n    - data/a.csv\n    - 'data/b.csv'\n    outs:\n    - out.csv\n")
    assert {r.input for r in readers.manifest(spark, f"file://{tmp_path}/m.yaml", "merge-all").collect()} == {"data/a.csv", "data/b.csv"}
    assert {r.input for r in readers.manifest(spark, f"file://{tmp_path}/m.yaml", "first").collect()} == {"x.csv"}
    assert readers.manifest(spark, f"file://{tmp_path}/m.yaml", "none").count() == 0
