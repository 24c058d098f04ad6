"""The language model, the classifier and the pipeline."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import elias_fano, lm, quality, queries
from tests.llm.conftest import ROWS


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def grams(t):
    x = tokens(t)
    return list(zip([None, None, *x][:-2], [None, *x][:-1], x, strict=True))


def model_by_force(rows):
    """The counts of words, and functions of a word and of a trigram."""
    count, pairs, triples, one, two = (Counter() for _ in range(5))
    for t in rows:
        count.update(tokens(t))
        for n, (u, v, w) in enumerate(grams(t)):
            start = (None, None) if n == 0 else (u, v)
            pairs[v, w] += 1
            triples[start, w] += 1
            one[v] += 1
            two[start] += 1
    total, distinct = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.1) / (total + 0.1 * (distinct + 1))
    second = lambda v, w: pairs[v, w] / (one[v] + lm.M) if pairs[v, w] else (lm.M / (one[v] + lm.M) if one[v] else 1) * base(w)
    third = lambda uv, w: triples[uv, w] / (two[uv] + lm.M) if triples[uv, w] else (lm.M / (two[uv] + lm.M) if two[uv] else 1) * second(uv[1], w)
    return count, base, third


def check_lm(got, rows, trained, step=1e-9):
    count, base, joint = model_by_force(trained)
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        x = tokens(t)
        score = sum(math.log10(joint((None, None) if n == 0 else (u, v), w)) for n, (u, v, w) in enumerate(grams(t)))
        want[i, len(x), sum(count[w] > 0 for w in x)] = sum(math.log10(base(w)) for w in x), score
    for r in got:
        b, s = want[r.doc_id, r.n_tokens, r.n_known]
        assert r.base_score == pytest.approx(b, rel=1e-9, abs=1e-9)
        assert abs(r.score - s) <= step * r.n_tokens


@pytest.mark.parametrize("hot", [0, lm.HOT])
def test_lm_on_the_table(spark, sf, documents, monkeypatch, hot):
    """With many shards; once with all words sent to them, once with the frequent ones summed in place and frequent contexts split."""
    monkeypatch.setattr(lm, "HOT", hot or 1)
    monkeypatch.setattr(lm, "LEAST", 64 if hot else 1 << 60)
    monkeypatch.setattr(lm, "OFTEN", 4)
    monkeypatch.setattr(lm, "SHARD", 1 << 17)
    monkeypatch.setattr(lm, "PIECE", 1 << 16)
    got = queries.op2_lm_score(spark, sf).collect()
    out = {i for i, _ in documents if zlib.crc32(str(i).encode()) % 10 == 0}
    # 64 even steps over the rarer values' range of some two
    check_lm(got, documents, [t for i, t in documents if i not in out], 0.01)
    assert {r.doc_id for r in got if r.held_out} == out
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd_rows(odd):
    from pyspark.sql import functions as F

    got = lm.score(odd.withColumn("learn", F.col("doc_id") > 3))[0].collect()
    check_lm(got, ROWS, [t for i, t in ROWS if i is not None and i > 3])


def test_lm_mass_is_one_at_most():
    rows = ["a b a b a b c", "a b c c", "b a b a", "a b"]
    count, _, joint = model_by_force(rows)
    for u in [*count, b"unseen"]:
        for v in [*count, b"unseen"]:
            assert 0.3 < sum(joint((u, v), w) for w in count) + joint((u, v), b"new") <= 1 + 1e-9


def test_lm_tells_texts_seen_twice(spark):
    rng = np.random.default_rng(3)
    text = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 5000) for _ in range(120)]
    rows = [(i, t, True) for i, t in enumerate([*text, *text[:30]])]
    got = {r.doc_id: r.score / r.n_tokens - r.base_score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"))[0].collect()}
    once, twice = [got[i] for i in range(30, 120)], [got[i] for i in range(30)]
    assert np.mean(twice) > np.mean(once) + 0.1


def test_lm_without_training(spark, empty):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b", False), (2, None, False), (3, "c", None)], "doc_id long, text string, learn boolean")
    got, tokens = lm.score(docs)
    assert tokens == 0
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got.collect()} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0), (3, 2, 0, 0.0, 0.0)}
    assert lm.score(empty.withColumn("learn", F.lit(True)))[0].count() == 0
    assert lm.train_and_score(empty).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 1 << 63), (7, 3), (500, (1 << 64) - 1), (5000, 1 << 45), (900, 900)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = elias_fano.EliasFano.of(v)
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, (1 << 64) - 1], np.uint64)])
    place, same = e.successor(q)
    assert (place == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()


@pytest.mark.parametrize("contexts", [50, 3000])
def test_trie_survives_its_file(contexts):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, contexts, (8 * contexts, 2)).astype(np.uint64), axis=0)
    value, weight = rng.normal(size=len(pairs)), rng.normal(size=len(np.unique(pairs[:, 0])))
    trie = elias_fano.Trie.load(elias_fano.mapped(elias_fano.Trie.of(pairs[:, 0], pairs[:, 1], value, weight).dump()))
    found, got = trie.find(pairs[:, 0], pairs[:, 1])
    assert found.all() and np.abs(got - value).max() <= (value.max() - value.min()) / 126 + 1e-9
    known, heavy = {tuple(p) for p in pairs.tolist()}, dict(zip(np.unique(pairs[:, 0]).tolist(), weight, strict=True))
    grid = np.array([(a, b) for a in range(55) for b in range(55)], np.uint64)
    found, got = trie.find(grid[:, 0], grid[:, 1])
    assert found.tolist() == [tuple(p) in known for p in grid.tolist()]
    for (a, _), f, x in zip(grid.tolist(), found, got, strict=True):
        assert f or abs(x - heavy.get(a, 0)) <= (weight.max() - weight.min()) / 126 + 1e-9


def test_quality_gradients():
    rng = np.random.default_rng(2)
    x, each, y = rng.normal(size=(9, quality.FEATURES)), np.array([2, 1, 4, 2]), np.array([0.0, 1, 1, 0])
    m = quality.fit(x.astype(np.float32), each, y, epochs=1)
    m.w = {k: v.astype(np.float64) + rng.normal(size=v.shape) / 9 for k, v in m.w.items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := m.forward(x, each)["p"], 1 - p)))
    g = m.gradients(m.forward(x, each), each, y)
    for k, a in m.w.items():
        at = tuple(rng.integers(0, s) for s in a.shape)
        old, eps = a[at], 1e-5
        a[at] = old + eps
        up = loss()
        a[at] = old - eps
        down = loss()
        a[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2 / eps, abs=1e-6)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    held = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(y == r.predicted for y, r in held) >= 0.97 * len(held)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None), (99, 1), (4, 1)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_passages_do_not_depend_on_neighbours():
    texts = [(t or "").encode() for _, t in ROWS]
    x, each = quality.passages(texts)
    at = 0
    for t, n in zip(texts, each, strict=True):
        alone, one = quality.passages([t])
        assert one[0] == n and np.allclose(alone, x[at : at + n])
        at += n


def test_pipeline(spark, sf, documents):
    import corpus_pipeline
    from tests.llm.test_dedup import exact_by_force, near_by_force
    from tests.llm.test_text import contaminated_by_force

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, dict(documents)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in docs.collect()}
            assert sum((i in kept) == (y == 1) for i, y in labels.items()) >= 0.9 * len(labels)
            left = {i: t for i, t in left.items() if i in kept}
        elif name == "exact_dedup":
            left = {i: left[i] for i, _, _, stays, _ in exact_by_force(left.items()) if stays}
        elif name == "near_dedup":
            left = {i: left[i] for i, (_, _, stays) in near_by_force(left.items(), 80).items() if stays}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            left = {r[0]: left[r[0]] for r in contaminated_by_force(left.items(), items) if not r[5]}
        assert {r.doc_id: r.text or "" for r in docs.collect()} == left
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == {*left} and all(r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {*left}


def test_pipeline_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "short")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = [r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]
    assert out and len(out) <= len(ROWS) and {*out} <= {i for i, _ in ROWS}
    texts = {i: t for i, t in ROWS}
    assert len({(texts[i] or "").encode().lower() for i in out if i is not None}) == len({i for i in out if i is not None})
    for name in ("labels", "benchmark"):
        assert os.path.isdir(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/{name}.parquet").write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_quality_learns_from_bounded_bytes(spark, monkeypatch):
    rows = [(i, f"{'good words here' if i % 2 else '#### 0000'} {i} " * 20) for i in range(200)] + [(1, "long " * 100), (1, "good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, n, y, real=quality.fit: seen.append(n) or real(x, n, y))
    quality.learn(docs, labels)
    monkeypatch.setattr(quality, "BYTES", 4000)
    quality.learn(docs, labels)
    assert len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200)) and 0 < len(seen[1]) <= 20


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for top, _, names in os.walk(f"{root}/corpusloom"):
        if not top.endswith("llm"):
            assert not any("corpusloom.llm" in open(f"{top}/{n}").read() for n in names if n.endswith(".py"))
