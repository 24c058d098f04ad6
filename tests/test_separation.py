"""The null of separation, with both statistics."""

import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import kernels


def test_both_statistics(spark):
    rng = np.random.default_rng(5)
    e = np.unique(np.sort(rng.integers(0, 60, (400, 2)), axis=1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    label = {i: f"l{i % 3}" for i in range(50)}
    edges, labels = spark.createDataFrame(e.tolist(), "a long, b long"), spark.createDataFrame(list(label.items()), "node long, label string")
    got = {r.statistic: r for r in kernels.separation_null(edges, labels, 200).collect()}
    e = e[(e < 50).all(axis=1)]
    same = np.mean([label[a] == label[b] for a, b in e])
    chance = (pd.Series(e.ravel()).map(label).value_counts(normalize=True) ** 2).sum()
    share, q = got["within_share"], got["modularity"]
    assert share.observed == pytest.approx(same) and q.observed == pytest.approx(same - chance) and q.null_mean == pytest.approx(share.null_mean - chance)
    assert (q.z_score, q.p_value, q.null_std) == (share.z_score, share.p_value, share.null_std) and share.n_perm == 200
    assert share.n_edges == len(e) and share.n_nodes == len(np.unique(e)) and abs(share.null_mean - chance) < 0.03
    assert [(r.observed, r.n_perm, r.n_edges) for r in kernels.separation_null(edges, labels.limit(0), 8).collect()] == [(None, 0, 0)] * 2


def test_a_graph_travels_packed_and_once_a_task(spark, monkeypatch):
    """A replicate more doesn't copy the graph: tasks are told by cores, and a row holds many edges."""
    rows = []
    packed = kernels.packed
    monkeypatch.setattr(kernels, "packed", lambda df: rows.append(packed(df)) or rows[-1])
    e = [(i, (i * 7 + 1) % 3000) for i in range(3000) if i != (i * 7 + 1) % 3000]
    plan = kernels.rewiring_null(spark.createDataFrame(e, "a long, b long"), spark.createDataFrame([(i, i % 5) for i in range(3000)], "node long, label long"), 1000)
    assert rows[0].count() <= 20 and "applyInPandas" not in plan._jdf.queryExecution().toString()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [chunk#" in text and f", {4 * spark.sparkContext.defaultParallelism}" in text
