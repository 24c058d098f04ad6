"""PageRank that has come to rest."""

import numpy as np

from corpusloom.operators import graph
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(e, steps):
    nodes = np.unique(e)
    src, ref = np.searchsorted(nodes, e).T
    d, r = np.bincount(src, minlength=len(nodes)), np.full(len(nodes), 1 / len(nodes))
    for _ in range(steps):
        r = 0.15 / len(nodes) + 0.85 * (np.bincount(ref, (r / np.maximum(d, 1))[src], len(nodes)) + r[d == 0].sum() / len(nodes))
    return dict(zip(nodes.tolist(), r.tolist(), strict=True))


def test_pagerank_query_rests(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").where("l_orderkey <> l_partkey").distinct().collect()
    want = plain(np.array(rows), 300)
    got = {r.node: r["rank"] for r in catalog.QUERIES["gr_pagerank"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[v] - 1000 * want[v]) for v in want) < 1e-7


def test_pagerank_steps_of_the_core_are_those_of_all(spark):
    rng = np.random.default_rng(3)
    for e in (rng.integers(0, 60, (150, 2)), np.array([(1, 2), (2, 3), (1, 3)]), np.array([(1, 2), (3, 2)])):
        e = np.unique(e[e[:, 0] != e[:, 1]], axis=0)
        df = spark.createDataFrame(e.tolist(), "src long, ref long")
        for steps in (1, 2, 3, 7):
            want, got = plain(e, steps), {r.node: r["rank"] for r in graph.pagerank(df, steps).collect()}
            assert got.keys() == want.keys() and max(abs(got[v] - want[v]) for v in want) < 1e-14
    assert graph.pagerank(df.limit(0), 5).collect() == []
