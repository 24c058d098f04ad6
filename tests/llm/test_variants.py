"""Spelling variants, nearest neighbours and periodic runs against plain computations."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from corpusloom.llm import neighbours, periodic, queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    """word, form, root, n, n_near, form_n by comparing every two words."""
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in form.items() if n[v] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def told(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 64])
def test_every_pair_of_words(spark, most):
    rnd = random.Random(most)
    words = {"".join(rnd.choice("abÉ") for _ in range(rnd.randint(6, 9))) for _ in range(220)}
    words |= {"samehalf" + "".join(rnd.choice("xyzw") for _ in range(rnd.randint(6, 8))) for _ in range(150)}  # one segment that many share
    words |= {"q" * 3000 + x for x in ("abc", "abd", "ab", "zz")}
    n = {w: rnd.choice([5, 6, 25, 30, 125, 700]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert told(spelling.group_variants(df, most)) == grouped(n)


def variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return grouped({w: c for w, c in n.items() if len(w) >= 6 and c >= 5})


def test_variants_of_odd_texts(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(spelling.spelling_variants(odd)) == variants(rows)
    assert told(spelling.spelling_variants(empty)) == set()


def test_variants_of_the_table(spark, sf, documents):
    got = told(queries.op11_spelling(spark, sf))
    assert got == variants(documents) and sum(r[1] is not None for r in got) > 10
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = con.sql(queries.ORACLES["op11_spelling"])
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and set(df.fetchall()) == got


def exact(rows, k, every):
    """query_id -> ranked (id, score), by comparing all; rows: id and vector."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = {}
            for i, x in rows:
                if i != q:
                    s = 0.0
                    for a, b in zip(v, x, strict=True):
                        s += a * b
                    scored[i] = max(s, scored.get(i, -np.inf))
            out[q] = sorted(scored.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) <= set(want)
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in x}) for q, x in want.items()) / sum(map(len, want.values()))


def embedded(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, v int").repartition(5)


def test_neighbours_of_the_table(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = ranked(queries.op12_neighbours(spark, sf)), exact(rows, 20, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values()) and recall(got, want) >= 0.9
    scores = {q: dict(exact([(i, v) for i, v in rows], len(rows), 20)[q]) for q in list(want)[:3]}
    assert all(scores[q][i] == s for q in scores for i, s in got[q])


def test_neighbours_of_clusters_and_unequal_lengths(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 24)), 50, axis=0) + rng.normal(size=(3000, 24)) * 0.15
    x *= rng.uniform(0.5, 2, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(ranked(neighbours.nearest(embedded(spark, rows), 10, 20)), exact(rows, 10, 20)) >= 0.9


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    few = rng.integers(-2, 3, size=(12, 4)).astype(float)
    few = few[(few != 0).any(axis=1)]
    rows = [(i, few[i % len(few)].tolist()) for i in range(400)]
    got = ranked(neighbours.nearest(embedded(spark, rows + rows[:50]), 20, 20))
    want = exact(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:  # what is missed may only be whole vectors: the ids of those found are the smallest
        assert recall({q: got[q]}, {q: want[q]}) >= 0.9


def test_vectors_that_take_no_part(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [])]
    real = [(i, [1.0, i / 10]) for i in range(20, 45)]
    got = ranked(neighbours.nearest(embedded(spark, odd + real), 30, 20))
    assert {i for q in got.values() for i, _ in q} <= {i for i, _ in real} and set(got) == {20, 40} and all(len(x) == 24 for x in got.values())
    assert ranked(neighbours.nearest(embedded(spark, odd[:5]), 3, 20)) == {}
    one = ranked(neighbours.nearest(embedded(spark, [(20, [1.0, 2.0])]), 3, 20))
    assert one == {}


def test_large_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[:300] = x[0] + rng.normal(size=(300, 8)) * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    whole = ranked(neighbours.nearest(embedded(spark, rows), 5, 20))
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "ASKED", 7)
    assert ranked(neighbours.nearest(embedded(spark, rows), 5, 20)) == whole


def plain_runs(x):
    best = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                best[s, i - s + q] = min(q, best.get((s, i - s + q), q))
            i += 1
    return sorted((s, q, n) for (s, n), q in best.items())


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs(letters):
    rnd = random.Random(letters)
    for turn in range(400):
        x = [rnd.randrange(letters) for _ in range(rnd.randint(0, 80))]
        if turn % 2 and len(x) > 8:
            a, p = rnd.randrange(len(x)), 1 + rnd.randrange(len(x) // 3)
            x = (x[:a] + x[a : a + p] * len(x))[: len(x)]
        s, n, q = periodic.runs(np.array(x, np.int64))
        assert list(zip(s.tolist(), q.tolist(), n.tolist(), strict=True)) == plain_runs(x)


def run_row(i, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(b"" if i is None else str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    found = plain_runs(w)
    gone = {j for s, q, m in found for j in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if found else None
    four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, q, m in found)
    return (i, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_runs_of_odd_texts(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 10_000]
    got = periodic.periodic_runs(odd, plant=True).collect()
    assert in_order(r for r in got if r.doc_id not in (6, 7)) == in_order(run_row(*r) for r in rows)
    long = {r.doc_id: r for r in periodic.periodic_runs(odd).collect()}
    assert (long[6].n_runs, long[6].start, long[6].length, long[6].period) == (1, 0, 24_000, 6) and long[7].n_runs == 1 and long[7].length == 24_000
    assert periodic.periodic_runs(empty).collect() == []


def test_runs_of_the_table(spark, sf, documents):
    short = [d for d in documents if len(d[1]) < 6000]
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(documents) and in_order(got[i] for i, _ in short) == in_order(run_row(*d) for d in short)
    assert sum(r.n_runs > 0 for r in got.values()) > 5
