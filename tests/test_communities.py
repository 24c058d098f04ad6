"""Communities of graphs too large for one task: moved by rounds of joins, against those of one task."""

import numpy as np
import pandas as pd

from corpusloom.operators import kernels


def modularity(e, label, resolution=1.0):
    k = pd.Series(1.0, index=np.arange(len(e) * 2)).groupby(pd.Series(e.ravel()).map(label).to_numpy()).sum()
    return np.mean([label[a] == label[b] for a, b in e]) - resolution * ((k / k.sum()) ** 2).sum()


def planted(rng, groups, size, p, out):
    e = [(a, b) for a in range(groups * size) for b in range(a) if rng.random() < (p if a // size == b // size else out)]
    return np.array(e)


def test_communities_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    graphs = {"x": planted(rng, 8, 20, 0.4, 0.005), "y": planted(rng, 3, 30, 0.3, 0.02), "z": np.array([(1, 2)])}
    df = spark.createDataFrame([(g, int(a), int(b), 1) for g, e in graphs.items() for a, b in e], "g string, a long, b long, n int")
    alone = kernels.communities(df, ["g"], (0.5, 1.0)).collect()
    largest, by_one = [], kernels.louvain

    def seen(rows, resolution):
        if len(rows) > 100:
            raise ValueError("a large graph in one task")
        return by_one(rows, resolution)

    monkeypatch.setattr(kernels, "SMALL", 100)
    monkeypatch.setattr(kernels, "louvain", seen)
    joined = kernels.communities(df, ["g"], (0.5, 1.0)).collect()
    assert {(r.g, r.resolution, r.node) for r in joined} == {(r.g, r.resolution, r.node) for r in alone} and len(joined) == len(alone)
    for g, e in graphs.items():
        for r in (0.5, 1.0):
            one, many = ({x.node: x.community for x in rows if (x.g, x.resolution) == (g, r)} for rows in (alone, joined))
            assert modularity(e, many, r) > modularity(e, one, r) - 0.02
    found = {x.node: x.community for x in joined if (x.g, x.resolution) == ("x", 1.0)}
    assert len({found[v] for v in found}) == 8 and all(found[v] == found[v // 20 * 20] for v in found)


def test_loops_count_twice_in_one_task():
    """Two nodes with a loop of one, joined by an edge of 2.5: apart they have modularity 2 / 4.5 - 1 / 2, together 0. Joined by an edge of 1.5 they have 2 / 3.5 - 1 / 2 apart."""
    for n, together in ((2.5, True), (1.5, False)):
        got = kernels.louvain(pd.DataFrame([(0, 0, 1), (1, 1, 1), (0, 1, n)], columns=["a", "b", "n"]))
        assert (got[0] == got[1]) == together


def test_graphs_of_some_size_take_no_rounds(spark, monkeypatch):
    """120,000 edges, which took rounds of joins: four planted groups are found in one task, which looks again only at nodes beside those that moved."""
    rng = np.random.default_rng(7)
    group = rng.integers(0, 4, 120_000)
    e = 2500 * np.where(rng.random((120_000, 2)) < 0.95, group[:, None], rng.integers(0, 4, (120_000, 2))) + rng.integers(0, 2500, (120_000, 2))
    e = np.unique(np.sort(e[e[:, 0] != e[:, 1]], axis=1), axis=0)
    monkeypatch.setattr(kernels, "_moved", lambda *a: 1 / 0)
    rows = kernels.communities(spark.createDataFrame(pd.DataFrame(e, columns=["a", "b"])).selectExpr("'x' AS g", "a", "b", "1 AS n"), ["g"]).toPandas()
    found = dict(zip(rows["node"], rows["community"], strict=True))
    assert len(e) > 100_000 and len(rows) == len(np.unique(e)) and set(found.values()) <= set(found)
    truth = {v: v // 2500 for v in found}
    assert modularity(e, found) > modularity(e, truth) - 0.005
