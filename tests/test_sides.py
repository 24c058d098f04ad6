"""The graphs of a window pair's sides: distances in place of paths, packed edges, and a basis that isn't kept."""

import numpy as np
import pytest

from corpusloom.operators import kernels
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


def by_paths(a):
    """Mean betweenness, each path counted (Brandes)."""
    u = kernels._largest(a)
    near = [[] for _ in range(u.n)]
    for x, y in zip(u.a.tolist(), u.b.tolist(), strict=True):
        near[x].append(y)
        near[y].append(x)
    total = np.zeros(u.n)
    for s in range(u.n):
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total.mean() / ((u.n - 1) * (u.n - 2))


def test_distances_are_enough():
    rng = np.random.default_rng(2)
    for p in (0.01, 0.02, 0.2):
        a = (rng.random((120, 120)) < p).astype(float)
        np.fill_diagonal(a, 0)
        assert kernels.betweenness(a) == pytest.approx(by_paths(a), rel=1e-12)


def test_the_gap_without_a_basis(monkeypatch):
    rng = np.random.default_rng(3)
    e = rng.integers(0, 400, (1600, 2))
    e = e[e[:, 0] != e[:, 1]]
    g = kernels.Graph(400, e[:, 0], e[:, 1])
    want = kernels.spectral_gap(g)
    monkeypatch.setattr(kernels, "HELD", 400 * 5)
    monkeypatch.setattr(kernels, "MEET", 64)
    assert kernels.spectral_gap(g, 0) == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("name", ["div_g2", "div_g8"])
def test_a_task_holds_one_side(spark, monkeypatch, name):
    metric = {"div_g2": "spectral_gap", "div_g8": "betweenness"}[name]
    edges = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey AS src", "l_partkey AS ref").distinct()
    edges = edges.join(spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey AS src", "year(o_orderdate) AS year"), "src").where("src <> ref").toPandas()
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    got = {(r.anchor, r.window): r.value for r in df.collect()}
    want = {}
    for w in (1, 2):
        for anchor in range(int(edges["year"].min()) + w, int(edges["year"].max()) - w):
            sides = [edges[edges["year"].between(*r)] for r in ((anchor - w, anchor - 1), (anchor + 1, anchor + w))]
            if all(len(s) for s in sides):
                v = [getattr(kernels, metric)(kernels._adjacency(s)) for s in sides]
                want[anchor, w] = abs(v[1] - v[0])
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-9)
