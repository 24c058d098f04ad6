"""The vocabulary rule and the kernels of sparse weights against plain computations."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.functions.vocabulary import STOPS
from corpusloom.operators import divergence as D
from corpusloom.operators import kernels

SF = "/root/testdata/sf0.001"


def test_vocabulary_and_weights(spark):
    docs = {r.doc_id: re.findall(r"\w\w+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, df = Counter(t for w in docs.values() for t in w), Counter(t for w in docs.values() for t in set(w))
    want = sorted((t for t in n if df[t] >= 3 and t not in STOPS), key=lambda t: (-n[t], t))[:300]
    rows = spark.createDataFrame([(d, t) for d, w in docs.items() for t in w], "doc long, term string")
    names = D.vocabulary(rows, "doc", "term", STOPS, 3, 300)
    got = {r.term: r.i for r in names.collect()}
    assert got == {t: i for i, t in enumerate(want)} and len(got) == 300
    every = spark.createDataFrame([(d,) for d in docs], "doc long")
    w = D.tfidf(rows.join(names, "term"), "doc", "term", every)
    v = {r.doc: dict(zip(r.ix, r.w, strict=True)) for r in D.sparse_vectors(every, w, names, "doc").collect()}
    assert set(v) == set(docs)
    for d, words in docs.items():
        tf = Counter(t for t in words if t in got)
        raw = {got[t]: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in tf.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        assert v[d] == pytest.approx({i: x / length for i, x in raw.items()}) and list(v[d]) == sorted(v[d])


def sparse(x):
    return kernels.Sparse([np.flatnonzero(r) for r in x], [r[r != 0] for r in x], x.shape[1])


def test_sparse_rows():
    rng = np.random.default_rng(1)
    x = rng.random((30, 12)) * (rng.random((30, 12)) < 0.3)
    x[4] = 0
    s, u, v = sparse(x), rng.random(30), rng.random(12)
    assert s.times(v) == pytest.approx(x @ v) and s.turned(u) == pytest.approx(x.T @ u) and (s.dense() == x).all()
    keep = rng.random(30) < 0.5
    assert (s.rows(keep).dense() == x[keep]).all()
    y = rng.random(30) < 0.4
    assert kernels.sparse_logistic(s, y) == pytest.approx(kernels.logistic(x, y), abs=1e-5)
    p, q = x[y].mean(axis=0), x[~y].mean(axis=0)
    assert kernels._js_rows(p[None], q[None])[0] == pytest.approx(kernels.mean_js(x[y], x[~y]))


def paired(spark, apart):
    rng = np.random.default_rng(2)
    rows = []
    for anchor, shift in ((2000, 0.0), (2001, apart)):
        for i in range(120):
            x = rng.random(10) * (rng.random(10) < 0.5)
            x[0] += shift * (i % 2)
            rows.append((anchor, 2, "after" if i % 2 else "before", i, np.flatnonzero(x).tolist(), x[x != 0].tolist()))
    return rows, spark.createDataFrame(rows, "anchor long, window int, side string, doc long, ix array<int>, w array<double>").repartition(4)


def test_sparse_tests_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(kernels, "ROUNDS", 40)
    rows, df = paired(spark, 2.0)
    got = {r.anchor: r for r in kernels.sparse_permutation(df, "doc", 10, 100).collect()}
    for anchor in (2000, 2001):
        x = {s: sparse_dense([r for r in rows if r[0] == anchor and r[2] == s]) for s in ("before", "after")}
        assert got[anchor].observed == pytest.approx(kernels.mean_js(x["before"], x["after"]))
    assert got[2001].p_value == 0 and got[2001].z_score > 5 and got[2000].p_value > 0.02
    again = {r.anchor: r for r in kernels.sparse_permutation(df.repartition(2), "doc", 10, 100).collect()}
    assert again[2000].p_value == got[2000].p_value and again[2000].null_mean == pytest.approx(got[2000].null_mean)
    auc = {r.anchor: r for r in kernels.sparse_two_sample(df, "doc", 10).collect()}
    assert auc[2001].value > 0.95 and auc[2001].n_folds == 5 and 0.2 < auc[2000].value < 0.8
    few = kernels.sparse_two_sample(df.where("doc < 6"), "doc", 10).collect()
    assert all(r.value is None for r in few)


def sparse_dense(rows):
    out = np.zeros((len(rows), 10))
    for i, r in enumerate(rows):
        out[i, r[4]] = r[5]
    return out


def test_shift_limits(spark, monkeypatch):
    monkeypatch.setattr(kernels, "ROUNDS", 30)
    rows, df = paired(spark, 0.0)
    x, side = sparse_dense(rows), np.array([r[2] == "after" for r in rows])
    rng = np.random.default_rng(0)
    tops = []
    for _ in range(2000):
        s = rng.permutation(side)
        tops.append(np.abs(x[s].mean(axis=0) - x[~s].mean(axis=0)).max())
    got = kernels.shift_limits(df.select("side", (df.anchor * 1000 + df.doc).alias("doc"), "ix", "w"), "doc", 10, 600).first()
    assert got.p95 == pytest.approx(np.quantile(tops, 0.95), rel=0.1) and got.p99 == pytest.approx(np.quantile(tops, 0.99), rel=0.15)
