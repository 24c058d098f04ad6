"""The two labelings whose separation is tested."""

import numpy as np
import pytest

from corpusloom.operators import kernels, matching
from corpusloom.plans import catalog
from corpusloom.plans.inference_queries import ANCHORS, GIVEN

SF = "/root/testdata/sf0.001"


def test_anchor_labels(spark):
    rows = [(1, "Red plate"), (2, "hot bolt"), (3, "old rod"), (4, None), (5, "red widget"), (6, "HOT ring")]
    got = matching.anchor_labels(spark.createDataFrame(rows, "node long, text string"), {"metal": (3, 5), "warm": (5,)}, {"warm": ("red", "hot"), "metal": ("bolt",)})
    assert {r.node: r.label for r in got.collect()} == {1: "warm", 3: "metal", 5: "warm", 6: "warm"}


def test_the_run_has_two_labelings_and_two_statistics(spark, monkeypatch):
    null = kernels.separation_null
    asked = []
    monkeypatch.setattr(kernels, "separation_null", lambda e, labels, n: asked.append(n) or null(e, labels, 40))
    rows = catalog.QUERIES["rs_null_sep_run"](spark, SF).collect()
    assert {(r.labelling, r.statistic) for r in rows} == {(x, y) for x in ("louvain_anchored", "a_priori_anchors") for y in ("within_share", "modularity")} and asked == [1000, 1000]
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    own = {v: k for k, vs in GIVEN.items() for v in vs}
    hits = {v: [k for k, ts in ANCHORS.items() if any(t in n for t in ts)] for v, n in parts.items()}
    label = {v: own.get(v, h[0] if len(h) == 1 else None) for v, h in hits.items()}
    e = {tuple(sorted(r)) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect() if r[0] != r[1]}
    e = [x for x in e if label.get(x[0]) and label.get(x[1])]
    mine = next(r for r in rows if (r.labelling, r.statistic) == ("a_priori_anchors", "within_share"))
    assert mine.n_edges == len(e) and mine.observed == pytest.approx(np.mean([label[a] == label[b] for a, b in e]))
