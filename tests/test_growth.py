"""Steps that must hold no whole graph in one task: the same results as a plain computation, from joins alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clusters, graph, kernels

SIDED = "anchor long, window int, side string, src long, ref long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_come_from_joins(spark):
    rng = np.random.default_rng(8)
    rows = [(2000, 1, s, int(a), int(b)) for s in ("before", "after") for a, b in np.sort(rng.integers(0, 40, (90, 2)), axis=1)] + [(2000, 1, s, 39, 3) for s in ("before", "after")] + [(2001, 1, "before", 7, 8)]
    df = spark.createDataFrame(rows, SIDED)
    x = graph.resting_ranks(df, ["anchor", "window", "side"])
    assert "FlatMapGroupsInPandas" not in plan(x)
    got = {}
    for r in x.collect():
        got.setdefault((r.anchor, r.side), {})[r.node] = r.x
    for side in ("before", "after"):
        e = pd.DataFrame([r[3:] for r in rows if r[0] == 2000 and r[2] == side], columns=["src", "ref"])
        nodes = np.unique(e.to_numpy())
        mine = np.array([got[2000, side][v] for v in nodes])
        assert len(got[2000, side]) == len(nodes) and mine / mine.sum() == pytest.approx(kernels.rank_histogram(kernels._adjacency(e)), abs=1e-9)
    shift = kernels.rank_shift(df)
    assert "FlatMapGroupsInPandas" not in plan(shift)
    values = {r.anchor: r.value for r in shift.collect()}
    assert values[2000] >= 0 and values[2001] is None


def test_power_iteration(spark):
    block = [(a, b) for a in range(12) for b in range(a)]
    links = [*block, *[(a + 20, b + 20) for a, b in block if (a + b) % 3 == 0], (0, 20)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in links], "a long, b long, n double")
    sides = {r.node: r.cluster for r in clusters.spectral(df, 2).collect()}
    assert len({sides[i] for i in range(12)}) == 1 and sides[5] != sides[25] and set(sides) == {x for e in links for x in e}


def test_power_iteration_holds_no_graph_in_memory(spark, monkeypatch):
    from pyspark.ml.clustering import PowerIterationClustering

    monkeypatch.setattr(PowerIterationClustering, "assignClusters", lambda *a: pytest.fail("a graph of objects"))
    assert clusters.spectral(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (4, 3, 1.0)], "a long, b long, n double"), 2).count() == 4


def test_shuffles_grow_with_the_table(spark, monkeypatch):
    from corpusloom.plans import session, standins

    sf, keys = "/root/testdata/sf0.001", ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        small = {tuple(r) for r in graph.degrees(standins.edges(spark, sf)).collect()}
        assert spark.conf.get(keys[0]) == before[0]
        monkeypatch.setattr(session, "ROWS", 500)
        df = graph.degrees(standins.edges(spark, sf))
        assert int(spark.conf.get(keys[0])) >= spark.read.parquet(f"{sf}/lineitem.parquet").count() / 500 > int(before[0])
        assert {tuple(r) for r in df.collect()} == small
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shuffled_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        one, two = (kernels.shuffled(np.arange(n), n, np.random.default_rng(s).integers(0, 2**62, 6)) for s in (1, 2))
        assert sorted(one) == list(range(n)) and (n < 17 or (one != two).any())


def test_entropy_permutation(spark):
    rng = np.random.default_rng(4)
    rows = [(2000, 1, "before", s, 100 + int(r)) for s in range(60) for r in rng.integers(0, 4, 5)] + [(2000, 1, "after", 50 + s, 100 + int(r)) for s in range(60) for r in rng.integers(0, 60, 5)]
    rows += [(2001, 1, side, (0 if side == "before" else 500) + s, 900 + int(r)) for side in ("before", "after") for s in range(60) for r in rng.integers(0, 30, 5)]
    df = spark.createDataFrame(rows, SIDED)
    assert "FlatMapGroupsInPandas" not in plan(kernels.entropy_permutation(df, 3))
    got, old = ({r.anchor: r for r in f(df).orderBy("anchor").collect()} for f in (lambda d: kernels.entropy_permutation(d, 70), lambda d: kernels.graph_permutation(d, kernels.degree_entropy, 70)))
    for anchor in (2000, 2001):
        assert got[anchor].observed == pytest.approx(old[anchor].observed, abs=1e-12)
        assert abs(got[anchor].null_mean - old[anchor].null_mean) < (got[anchor].null_std + old[anchor].null_std) / 2 and 0.5 < got[anchor].null_std / old[anchor].null_std < 2


def test_the_sweep_meets_in_tiles(spark, monkeypatch):
    from corpusloom.operators import windows
    from corpusloom.plans import catalog, kernel_queries

    sf = "/root/testdata/sf0.001"
    v = clusters.project(kernel_queries.vectors(spark, sf).select("vec_id", "year", "v"), "v", 32)
    p = windows.sliding_pairs(v, "year", (2,)).select("anchor", "side", "vec_id", "projected").toPandas()
    monkeypatch.setattr(kernels, "by_pair", lambda *a: pytest.fail("a window pair's rows in one task"))
    got = {(r.anchor, r.dims): r.value for r in catalog.QUERIES["ml_pca_sweep"](spark, sf).collect()}
    assert set(got) == {(a, d) for a in set(p["anchor"]) for d in (8, 32)}
    for (anchor, dims), value in got.items():
        x, y = (np.array(p.loc[(p["anchor"] == anchor) & (p["side"] == s), "projected"].tolist())[:, :dims] for s in ("before", "after"))
        assert value == pytest.approx(kernels.energy(x, y), abs=1e-7)


def test_disruption_lists_no_pair_of_a_refs_citers(spark, monkeypatch):
    from corpusloom.operators import divergence as D

    rng = np.random.default_rng(6)
    loose = sorted({(int(a), int(b)) for a, b in rng.integers(0, 25, (160, 2))})  # with loops, both directions and many shared refs
    refs = {v: {b for a, b in loose if a == v} for v in range(25)}
    citers = {v: {a for a, b in loose if b == v} for v in range(25)}
    want = {}
    for v in range(25):
        far = set().union(*(citers[r] for r in refs[v])) - {v} if refs[v] else set()
        j, n = len(citers[v] & far), len(citers[v] | far)
        if n:
            want[v] = (len(citers[v]) - 2 * j) / n
    df = spark.createDataFrame(loose, "src long, ref long")
    ways = D._citers_by_source, D._citers_by_ref
    for way in ways:
        monkeypatch.setattr(D, "_citers_by_source", way)
        monkeypatch.setattr(D, "_citers_by_ref", way)
        assert {r.node: r.cd for r in D.disruption(df, alone=True).collect()} == pytest.approx(want)
        assert {r.node: r.cd for r in D.disruption(df).collect()} == pytest.approx({v: x for v, x in want.items() if refs[v] and citers[v]})
    monkeypatch.setattr(D, "_citers_by_source", ways[0])
    monkeypatch.setattr(D, "_citers_by_ref", lambda e: pytest.fail("every two of 300 citers listed"))
    star = spark.createDataFrame([(i, 0) for i in range(1, 301)] + [(i, -1) for i in range(1, 9)], "src long, ref long")
    assert D.disruption(star, alone=True).count() == 302


def test_swaps_at_once_reach_every_graph_alike():
    rng = np.random.default_rng(0)
    ring = np.array([(i, (i + 1) % 6) for i in range(6)])  # 60 rings and 10 pairs of triangles have its degrees
    seen = pd.Series([tuple(sorted(tuple(sorted(x)) for x in kernels.rewire(ring, 90, rng).tolist())) for _ in range(3500)]).value_counts()
    assert len(seen) == 70 and ((seen - 50) ** 2 / 50).sum() < 69 + 4 * (2 * 69) ** 0.5
    sided = kernels.rewire(np.array([(i, 100 + j) for i in range(9) for j in range(9) if (i + j) % 3]), 500, rng, True)
    assert (sided[:, 0] < 100).all() and (sided[:, 1] >= 100).all()


def test_rewiring_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(1)
    e = np.unique(np.sort(rng.integers(0, 150, (1500, 2)), axis=1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    df = spark.createDataFrame(e.tolist(), "a long, b long")
    monkeypatch.setattr(kernels, "CELL", 200)
    rewired = kernels.rewired(df)
    assert plan(rewired).count("FlatMapGroupsInPandas") >= kernels.DEALS
    r = np.array([(x.a, x.b) for x in rewired.collect()])
    assert (np.bincount(r.ravel(), minlength=150) == np.bincount(e.ravel(), minlength=150)).all()
    got = np.unique(np.sort(r, axis=1), axis=0)
    assert len(got) == len(e) and (r[:, 0] != r[:, 1]).all()
    common = lambda x: len({tuple(p) for p in x.tolist()} & {tuple(p) for p in e.tolist()}) / len(e)
    assert common(got) < 1.5 * common(np.sort(kernels.rewire(e, 10 * len(e), rng), axis=1))


def test_rewiring_takes_steps_not_single_swaps():
    class Counted:
        def __init__(self):
            self.rng, self.steps = np.random.default_rng(2), 0

        def permutation(self, n):
            self.steps += 1
            return self.rng.permutation(n)

        def random(self, n):
            return self.rng.random(n)

    rng = Counted()
    e = np.array([(i, i + d) for i in range(5000) for d in (1, 3)])
    r = kernels.rewire(e, 10 * len(e), rng)
    assert rng.steps == 20 and (np.bincount(r.ravel()) == np.bincount(e.ravel())).all()


def test_records_are_parsed_in_many_tasks(spark):
    from corpusloom.plans import catalog

    df = catalog.QUERIES["src_tei"](spark, "/root/testdata/sf0.001")
    assert len({r[0] for r in df.groupBy(F.spark_partition_id()).count().collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_components_compute_each_round_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "settle", lambda df: pytest.fail("a checkpoint, whose last stage is computed twice"))
    got = graph.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 9), (7, 7)], "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 4)}


def test_repeated_codes():
    rng = np.random.default_rng(3)
    codes = np.concatenate([rng.integers(0, 2**62, 200_000), np.arange(500), np.arange(100)])
    inverse = pow(0x9E3779B97F4A7C15, -1, 2**64)
    same = np.array([(h * inverse) % 2**64 for h in (1, 2, 3)], np.uint64).view(np.int64)  # other codes of one hash in 32 bits
    codes = np.concatenate([codes, same])
    n = pd.Series(codes).map(pd.Series(codes).value_counts()).to_numpy()
    assert (kernels._repeated(codes) == (n > 1)).all() and not kernels._repeated(np.array([], np.int64)).any()


def test_the_rewiring_null_numbers_its_nodes_once(spark, monkeypatch):
    monkeypatch.setattr(kernels, "rewire", lambda *a: pytest.fail("nodes numbered anew for each graph"))
    rng = np.random.default_rng(5)
    e = np.unique(np.sort(rng.integers(0, 60, (300, 2)), axis=1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    r = kernels.rewiring_null(spark.createDataFrame(e.tolist(), "a long, b long"), spark.createDataFrame([(i, f"l{i % 4}") for i in range(60)], "node long, label string"), 30).first()
    assert r.observed == pytest.approx((e[:, 0] % 4 == e[:, 1] % 4).mean()) and abs(r.null_mean - 0.25) < 0.05


def test_equal_sets_meet_once(spark, monkeypatch):
    from corpusloom.operators import resolve

    written, settle = [], graph.settle
    monkeypatch.setattr(resolve.graph, "settle", lambda df: written.append(settle(df)) or written[-1])
    rows = [(i, ("a b c d", "d c b a", "a b c d e", "x y")[i % 4]) for i in range(40)] + [(40, "a b c"), (41, ""), (42, None)]
    got = {(r.a, r.b): r.jaccard for r in resolve.similar_pairs(spark.createDataFrame(rows, "id long, t string"), "id", F.split("t", " "), 0.7).collect()}
    sets = {i: set(t.split()) for i, t in rows if t}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == pytest.approx({p: j for p, j in want.items() if j >= 0.7})
    assert min(df.count() for df in written) == 4  # of 41 rows with words, the sets that are compared
