"""Joins of similar titles, decompositions, sums over pairs, weighted bootstraps and greedy matching against plain computations."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from corpusloom.operators import factor, matching, resample, similar, tiles
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


def common(a, b):
    """The longest common subsequence, by the plain table."""
    x, old = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.zeros(len(b) + 1, int)
    for c in a:
        new = old.copy()
        new[1:] = np.maximum.accumulate(np.maximum(old[1:], old[:-1] + (x == ord(c))))
        old = new
    return int(old[-1])


def ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b))


def titles(n, seed):
    rnd = random.Random(seed)
    words = ["climate", "finance", "adaptation", "fonds", "accès", "market", "carbon", "équité", "of", "the", "in", "risk", "global", "landscape"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 9))) for _ in range(n // 2)]
    while len(out) < n:
        t = list(rnd.choice(out))
        for _ in range(rnd.randint(0, 8)):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "é", " "])
        out.append(" ".join(sorted("".join(t).split())))
    return out


@pytest.mark.parametrize("rows", [9, 1024])
def test_links_are_those_of_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "ROWS", rows)
    data = [(i, t, 2000 + i % 4 if i % 13 else None) for i, t in enumerate(titles(160, 1))] + [(900, None, 2000), (901, "", 2001)]
    df = spark.createDataFrame(data, "id long, s string, year int").repartition(3)
    got = {r.ref: (r.work, r.score) for r in similar.link_titles(df, df).collect()}
    want = {}
    for (i, a, y), (j, b, z) in itertools.permutations(data, 2):
        if a and b and len(a) > 10 and len(b) > 10 and y and z and abs(y - z) <= 1:
            both, n = common(a, b), len(a) + len(b)
            if 200 * both >= 85 * n:
                want[i] = min(want.get(i, (0.0, 0)), (-200.0 * both / n, j))
    assert len(want) > 15 and got == {i: (j, -s) for i, (s, j) in want.items()}


def grouped(rows, percent, words):
    """Component by single linkage of all pairs."""
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    fit = [(i, s) for i, s in rows if s and len(s.split(" ")) >= words]
    for (i, a), (j, b) in itertools.combinations(fit, 2):
        if 200 * common(a, b) >= percent * (len(a) + len(b)):
            x, y = root(i), root(j)
            label[max(x, y)] = min(x, y)
    return {i: root(i) for i in label}


@pytest.mark.parametrize("rows", [7, 1024])
def test_groups_are_those_of_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "ROWS", rows)
    data = list(enumerate(titles(140, 2) + titles(20, 2))) + [(900, None), (901, "")]
    got = {r.id: r.component for r in similar.title_groups(spark.createDataFrame(data, "id long, s string").repartition(3), 85).collect()}
    want = grouped(data, 85, 4)
    assert got == want and 10 < len(set(want.values())) < len(want) - 10


def test_empty_titles(spark):
    none = spark.createDataFrame([], "id long, s string, year int")
    assert similar.link_titles(none, none).collect() == [] and similar.title_groups(none).collect() == []


def test_titles_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    mine = sorted(i for i in docs if i % 5 == 0)
    first = {i: (docs[i] or "").split("\n")[0] for i in mine}
    want = grouped([(i, " ".join(sorted(first[i].lower().split()))) for i in mine], 75, 4)
    members = {c: [i for i in mine if want[i] == c] for c in set(want.values())}
    got = {r.component: r for r in catalog.QUERIES["ded_fuzzy_group"](spark, SF).collect()}
    assert set(got) == set(members)
    for c, ids in members.items():
        assert got[c].n == len(ids) and got[c].title == first[min(ids, key=lambda i: (-len(first[i]), i))]
        courses = sorted({f"course {i % 7}" for i in ids} | {f"course {i % 11}" for i in ids})
        assert got[c].courses == " ; ".join(courses) and got[c].n_courses == len(courses)


def test_common_subsequences():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 150))) for _ in range(2))
        want = common(a, b)
        assert similar.lcs(similar.places(a), len(a), b, 0) == want and similar.lcs(similar.places(a), len(a), b, want) == want
        assert similar.lcs(similar.places(a), len(a), b, len(a) + 1) == -1
        assert similar.bounds(similar.bags([a]), similar.bags([b]))[0, 0] <= len(a) + len(b) - 2 * want


def bipartite(spark, shape, share, seed):
    a = (np.random.default_rng(seed).random(shape) < share).astype(float)
    i, j = np.nonzero(a)
    return a, spark.createDataFrame([(int(x), int(1000 + y)) for x, y in zip(i, j, strict=True)], "src long, ref long").repartition(3)


def test_coupling_space(spark):
    a, edges = bipartite(spark, (60, 40), 0.12, 1)
    a = a[a.any(axis=1)]
    c = a @ a.T
    np.fill_diagonal(c, 0)
    values = np.linalg.eigvalsh(c)
    want = values[np.argsort(-np.abs(values))][:12]
    f = factor.coupling(edges, 12, block=6, steps=12)
    assert np.abs(f.values) == pytest.approx(np.abs(want), abs=1e-6) and f.residuals.max() < 1e-6
    rows = {r.node: np.array(r.v) for r in f.vectors.collect()}
    v = np.array([rows[k] for k in sorted(rows)])
    nodes = sorted({r.src for r in edges.collect()})
    assert sorted(rows) == nodes and v.T @ v == pytest.approx(np.eye(12), abs=1e-8) and c @ v == pytest.approx(v * f.values, abs=1e-5)
    unit = [np.array(r.v) for r in factor.unit_rows(f).collect()]
    assert all(np.linalg.norm(u) == pytest.approx(1) for u in unit)


def test_singular_values(spark):
    rng = np.random.default_rng(3)
    a = rng.random((50, 30)) * (rng.random((50, 30)) < 0.3)
    i, j = np.nonzero(a)
    entries = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "row long, col long, w double")
    f, left = factor.singular(entries, 6, block=8, steps=10)
    u, s, _ = np.linalg.svd(a)
    assert f.values == pytest.approx(s[:6], abs=1e-6)
    got = {r.node: np.array(r.v) for r in left.collect()}
    want = u[:, :6] * s[:6]
    assert all(np.abs(got[n]) == pytest.approx(np.abs(want[n]), abs=1e-5) for n in got)
    assert len(factor.singular(entries.limit(0), 3)[0].values) == 0
    few = factor.singular(spark.createDataFrame([(0, 0, 2.0), (1, 1, 1.0)], "row long, col long, w double"), 5)[0]
    assert few.values == pytest.approx([2, 1])


def test_lexical_axes(spark):
    rnd = np.random.default_rng(4)
    rows, axis = [], []
    for d in range(80):
        side = d % 2
        axis.append((d, float(side) + rnd.normal() * 0.1))
        rows += [(d, f"{'left' if side else 'right'}{k}", 1.0 + rnd.random()) for k in range(6)] + [(d, f"all{k}", 1.0 + rnd.random()) for k in range(6)]
    out = factor.lexical_axes(spark.createDataFrame(rows, "doc long, term string, w double"), "doc", "term", spark.createDataFrame(axis, "doc long, axis double"), 3, terms=6).collect()
    m = np.zeros((80, 18))
    at = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
    for d, t, w in rows:
        m[d, at[t]] = w
    s = np.linalg.svd(m, compute_uv=False)[:3]
    by = {r.component: r for r in out}
    assert [by[f"PC{i + 1}"].singular_value for i in range(3)] == pytest.approx(s, rel=1e-6)
    assert out[0].component == "PC2" and out[0].abs_corr_with_axis > 0.95
    ends = {out[0].top_positive_terms.split("; ")[0][:4], out[0].top_negative_terms.split("; ")[0][:4]}
    assert ends == {"left", "righ"} and all(t.startswith("all") for t in by["PC1"].top_positive_terms.split("; "))
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    scores = u * s
    assert by["PC2"].explained_variance_ratio == pytest.approx(scores[:, 1].var() / m.var(axis=0).sum(), rel=1e-5)


def energy(x, y):
    d = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2)).mean()
    return 2 * d(x, y) - d(x, x) - d(y, y)


@pytest.mark.parametrize("most", [None, 5])
def test_grid_of_windows_and_gaps(spark, most):
    rng = np.random.default_rng(6)
    data = [(i, 2000 + i % 8, (rng.normal(size=6) + (i % 8) * 0.2).tolist()) for i in range(90)]
    df = spark.createDataFrame([*data, (900, None, [0.0] * 6), (901, 2001, None)], "id long, year int, v array<double>").repartition(3)
    got = {(r.dim, r.window, r.gap, r.anchor): r for r in tiles.energy_grid(df, "year", (1, 2, 3), (0, 1, 2, 3), (2, 6), 3 if most else 1, most, least=12).collect()}
    seen = 0
    series = {}
    for dim, w, g in itertools.product((2, 6), (1, 2, 3), (0, 1, 2, 3)):
        for anchor in range(2000, 2008):
            near = max(g, 1)
            sides = [[r for r in data if near <= s * (r[1] - anchor) <= w] for s in (-1, 1)]
            if near > w or min(map(len, sides)) < 12:
                assert (dim, w, g, anchor) not in got
                continue
            values = []
            for k in range(3 if most else 1):
                def chosen(rows, k=k):
                    if most is None:
                        return rows
                    return [r for y in {r[1] for r in rows} for r in sorted((r for r in rows if r[1] == y), key=lambda r: (hashlib.md5(f"42|{k}|{r[0]}".encode()).hexdigest(), r[0]))[:most]]
                values.append(energy(*(np.array([r[2][:dim] for r in chosen(s)]) for s in sides)))
            r = got[dim, w, g, anchor]
            assert r.value == pytest.approx(np.median(values), abs=1e-9) and (r.n_before, r.n_after) == tuple(map(len, sides))
            series.setdefault((dim, w, g), []).append((r.value, r.z_score))
            seen += 1
    for rows in series.values():
        v = np.array([x for x, _ in rows])
        if len(v) > 1:
            assert [z for _, z in rows] == pytest.approx(((v - v.mean()) / v.std(ddof=1)).tolist())
    assert seen == len(got) > 20


def test_tiles_meet_once(spark):
    rng = np.random.default_rng(7)
    data = [(i, int(rng.integers(3)), rng.normal(size=5).tolist()) for i in range(70)]
    df = spark.createDataFrame([*data, (99, 1, [0.0] * 5), (98, None, [1.0] * 5)], "id long, label int, v array<double>").repartition(4)
    h = tiles.cosine_histogram(df, "label", 3, 16)
    r = tiles.rank_statistic(h).first()
    within, between = [], []
    for (_, a, x), (_, b, y) in itertools.combinations(data, 2):
        x, y = np.array(x), np.array(y)
        (within if a == b else between).append(round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) * 1000))
    u = sum((w > b) + (w == b) / 2 for w in within for b in between)
    n, m = len(within), len(between)
    counts = np.unique(within + between, return_counts=True)[1]
    sd = math.sqrt(n * m / 12 * (n + m + 1 - (counts**3 - counts).sum() / ((n + m) * (n + m - 1))))
    assert (r.n_within, r.n_between, r.u) == (n, m, u) and r.z == pytest.approx((u - n * m / 2) / sd) and r.auc == pytest.approx(u / n / m)


def test_weights_are_poisson(spark):
    ids = spark.range(3000).union(spark.range(5))
    w = np.array([r.w for r in resample.poisson_weights(ids, 50).collect()])
    assert w.shape == (3000, 50) and w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.005)
    assert resample.poisson_weights(spark.range(0), 4).collect() == []
    text = spark.createDataFrame([("a",), (None,), ("a",)], "id string")
    assert [r.id for r in resample.poisson_weights(text, 3).collect()] == ["a"]


def test_presence_and_rates(spark):
    rnd = random.Random(8)
    edges = [(s, r) for s in range(60) for r in range(20) if rnd.random() < (r + 1) / 40] + [(None, 3), (3, None)]
    df = spark.createDataFrame(edges, "src long, ref long")
    w = {r.id: r.w for r in resample.poisson_weights(df.selectExpr("src AS id"), 30).collect()}
    boot = {r: [sum(w[s][k] for s, x in edges if x == r and s is not None) for k in range(30)] for r in {r for s, r in edges if s is not None and r is not None}}
    for r in resample.presence(df, 8, 30).collect():
        assert r.presence == pytest.approx(sum(x >= 8 for x in boot[r.ref]) / 30) and (r.boot_q025, r.boot_q975) == pytest.approx(tuple(np.quantile(boot[r.ref], [0.025, 0.975])))
    marked = spark.createDataFrame([(r, f"m{r % 3}") for r in range(20)], "ref long, mark string")
    for r in resample.rates(df, 8, marked, 3, 30).collect():
        mine = [boot[x] for x in boot if f"m{x % 3}" == r.mark]
        assert r.rate == pytest.approx(sum(sum(b[k] >= 8 for b in mine) >= 3 for k in range(30)) / 30)


def walk(pairs):
    out, a, b = set(), set(), set()
    for s, x, y in sorted((-s, x, y) for x, y, s in pairs):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.add((x, y, -s))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_matching(spark, seed):
    rnd = random.Random(seed)
    pairs = [(i, j, float(rnd.randint(0, 6))) for i in range(14) for j in range(11) if rnd.random() < 0.5]
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    assert {(r.a, r.b, r.score) for r in matching.greedy(df).collect()} == walk(pairs)
    assert matching.greedy(df.limit(0)).collect() == []


def test_anchors_are_assigned(spark):
    names = {r.p_partkey: (r.p_brand, r.p_name) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    groups = {"warm": ("red", "hot"), "metal": ("bolt", "gear"), "plain": ("widget", "gizmo"), "cold": ("blue", "cold")}
    scores = [(b, k, float(sum(any(t in n for t in ts) for x, n in names.values() if x == b))) for b in {b for b, _ in names.values()} for k, ts in groups.items()]
    want = {a: b for a, b, _ in walk([p for p in scores if p[2] > 0])}
    got = {r.brand: r.label for r in catalog.QUERIES["gr_anchor_assign"](spark, SF).collect()}
    assert got == {b: want.get(b, "other") for b, _ in names.values()} and len(want) > 1


def plain_dip(x):
    """The least distance at which some mode parts a convex from a concave function, by halving."""
    from corpusloom.operators import kernels

    v, n = np.unique(x, return_counts=True)
    upto = np.cumsum(n) / len(x)
    below = np.append(0, upto[:-1])

    def fits(d):
        for m in range(len(v)):
            low, high = upto - d, below + d
            low[m], high[m] = -9, below[m] + d
            ok = kernels._convex(v[: m + 1], low[: m + 1], high[: m + 1])
            low[m], high[m] = upto[m] - d, 9
            if ok and kernels._convex(-v[m:][::-1], -high[m:][::-1], -low[m:][::-1]):
                return True
        return False

    a, b = 0.0, 0.5
    for _ in range(24):
        a, b = (a, (a + b) / 2) if fits((a + b) / 2) else ((a + b) / 2, b)
    return max(b, 0.5 / len(x))


def test_dips():
    from corpusloom.operators import kernels, modes

    rng = np.random.default_rng(9)
    for turn in range(60):
        n = int(rng.integers(1, 40))
        x = rng.random(n) if turn % 3 else rng.integers(0, 6, n).astype(float)
        if turn % 2:
            x = np.concatenate([x, x + 4])
        assert modes.dip(x) == pytest.approx(plain_dip(x), abs=1e-6)
        if turn % 3:
            assert modes.dip(x) == pytest.approx(kernels.dip(x), abs=1e-6)
    v, c = np.unique(rng.integers(0, 9, 200), return_counts=True)
    assert modes.dip(v, c) == pytest.approx(modes.dip(np.repeat(v, c)))


def test_dips_of_groups(spark, monkeypatch):
    from corpusloom.operators import modes

    monkeypatch.setattr(modes, "NULL_SIZE", 64)
    rng = np.random.default_rng(10)
    one, two = rng.normal(size=400), np.concatenate([rng.normal(size=200), rng.normal(size=200) + 6])
    rows = [("one", float(x)) for x in one] + [("two", float(x)) for x in two] + [("few", 1.0), ("few", None), ("two", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in modes.dips(df, "x", ["g"], 50).collect()}
    assert set(got) == {"one", "two", "few", None} and got["few"].p is None and got["two"].n == 400
    assert got["one"].dip == pytest.approx(modes.dip(one)) and got["two"].dip == pytest.approx(modes.dip(two)) and got["two"].error == 0
    assert got["two"].p == 0 and got["one"].p > 0.05
    rough = {r.g: r for r in modes.dips(df, "x", ["g"], 5, parts=50).collect()}
    assert all(abs(rough[g].dip - got[g].dip) <= rough[g].error == 8 / 400 for g in ("one", "two"))
    assert modes.dips(df.limit(0), "x", ["g"], 5).collect() == []
