"""Statistics without a relational form: NumPy kernels over the groups of a window pair, a series or a replicate.

Each group is bounded before it reaches a kernel: pairs are drawn to equal samples (windows.equal_n), graphs are those of one window,
held as edges, series have a row a year. Groups are independent, so they spread over the cluster, and a lost executor costs its
groups alone. Randomness comes from a seed and the group's key.
"""

from __future__ import annotations

import collections
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import special
from corpusloom.operators import divergence, graph, windows

PAIR = ["anchor", "window"]


def _rng(seed: int, *key: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])


def _split(rows: pd.DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values([c for c in rows.columns if c != vector])
    side = rows["side"].to_numpy() == "before"
    v = np.array(rows[vector].tolist(), float).reshape(len(rows), -1)
    return v[side], v[~side]


def by_pair(pairs: DataFrame, vector: str, kernel: Callable[[np.ndarray, np.ndarray, np.random.Generator], float], seed: int = 42) -> DataFrame:
    """anchor, window and value of a kernel of the sides' vectors; null where it has none."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _split(rows, vector)
        value = kernel(x, y, _rng(seed, *key)) if len(x) > 1 and len(y) > 1 else np.nan
        return pd.DataFrame({"anchor": [key[0]], "window": [key[1]], "value": [None if np.isnan(value) else float(value)]})

    return pairs.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, value double")


def frechet(x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None, dims: int = 256, ridge: float = 1e-6) -> float:
    """Squared Frechet distance of two normal distributions fitted after a common projection on principal components."""
    both = np.vstack([x, y])
    centred = both - both.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[: max(1, min(dims, len(x) - 1, len(y) - 1))].T
    x, y = (x - both.mean(axis=0)) @ axes, (y - both.mean(axis=0)) @ axes
    a, b = (np.atleast_2d(np.cov(z, rowvar=False)) + ridge * np.eye(axes.shape[1]) for z in (x, y))
    w, u = np.linalg.eigh(a)
    root = (u * np.sqrt(np.maximum(w, 0))) @ u.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b @ root), 0)).sum()
    return float(((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * cross)


def _auc(score: np.ndarray, label: np.ndarray) -> float:
    values, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n = label.sum()
    return float((rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression with classes of equal weight, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold_aucs(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, dims: int = 32, folds: int = 5) -> np.ndarray:
    """How well a classifier tells the sides apart: the area under the curve of each stratified fold, after principal components."""
    both, label = np.vstack([x, y]), np.r_[np.zeros(len(x), bool), np.ones(len(y), bool)]
    if min(len(x), len(y)) < folds:
        return np.zeros(0)
    centred = both - both.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    z = centred @ axes[:dims].T
    fold = np.empty(len(both), int)
    for c in (False, True):
        at = rng.permutation(np.flatnonzero(label == c))
        fold[at] = np.arange(len(at)) % folds
    out = []
    for f in range(folds):
        w = logistic(z[fold != f], label[fold != f])
        out.append(_auc(z[fold == f] @ w[:-1] + w[-1], label[fold == f]))
    return np.array(out)


def two_sample_auc(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> float:
    """The mean area under the curve over folds."""
    each = fold_aucs(x, y, rng)
    return float(each.mean()) if len(each) else np.nan


def auc_spread(each: np.ndarray) -> tuple[float, float, float, float, int, float | None]:
    """Mean, deviation, 95 % interval and number of the folds' areas, and the one-sided p of a mean above one half, by Student's t."""
    n, mean, sd = len(each), float(each.mean()), float(each.std(ddof=1)) if len(each) > 1 else 0.0
    if n < 2 or sd == 0:
        return mean, sd, mean, mean, n, None
    half = special.t_quantile(0.975, n - 1) * sd / n**0.5
    return mean, sd, max(0.0, mean - half), min(1.0, mean + half), n, special.t_sf((mean - 0.5) / (sd / n**0.5), n - 1)


def two_sample(pairs: DataFrame, vector: str, seed: int = 42) -> DataFrame:
    """anchor, window, value (the mean area under the curve), auc_std, auc_q025, auc_q975, n_folds and p_value_vs_chance; null where a side is too small."""
    names = ["value", "auc_std", "auc_q025", "auc_q975", "n_folds", "p_value_vs_chance"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _split(rows, vector)
        each = fold_aucs(x, y, _rng(seed, *key))
        return pd.DataFrame([(*key, *(auc_spread(each) if len(each) else [None] * 6))], columns=[*PAIR, *names]).astype({"n_folds": "Int32"})

    return pairs.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, value double, auc_std double, auc_q025 double, auc_q975 double, n_folds int, p_value_vs_chance double")


def energy(x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> float:
    d = _distances(np.vstack([x, y]))
    n = len(x)
    return float(2 * d[:n, n:].mean() - d[:n, :n].mean() - d[n:, n:].mean())


def _distances(v: np.ndarray) -> np.ndarray:
    sq = (v * v).sum(axis=1)
    return np.sqrt(np.maximum(0, sq[:, None] + sq[None, :] - 2 * v @ v.T))


def mmd(d2: np.ndarray, n: int, bandwidth: float) -> float:
    """Squared maximum mean discrepancy, unbiased, of a Gaussian kernel; not below 0. d2: squared distances of all, the first n of one side."""
    k = np.exp(-d2 / (2 * bandwidth)) if bandwidth > 0 else np.exp(-d2)
    m = len(d2) - n
    within = [(x.sum() - np.trace(x)) / (c * (c - 1)) for x, c in ((k[:n, :n], n), (k[n:, n:], m))]
    return max(0.0, float(sum(within) - 2 * k[:n, n:].mean()))


def mmd_by_pair(pairs: DataFrame, vector: str, factors: Sequence[float]) -> DataFrame:
    """anchor, window, hyperparams and value: mmd at multiples of the median of the pair's squared distances."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _split(rows, vector)
        d2 = _distances(np.vstack([x, y])) ** 2
        enough = len(x) > 1 and len(y) > 1
        middle = float(np.median(d2[np.triu(np.ones(d2.shape, bool), 1)])) if enough else 0.0
        out = [(*key, f"bw={f}x_median", mmd(d2, len(x), f * middle) if enough else None) for f in factors]
        return pd.DataFrame(out, columns=[*PAIR, "hyperparams", "value"])

    return pairs.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, hyperparams string, value double")


def sliced_wasserstein(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, directions: int = 100) -> float:
    """Root mean square, over random directions, of the distance of the projected sides matched by rank; sides must be of equal size."""
    u = rng.normal(size=(x.shape[1], directions))
    u /= np.sqrt((u * u).sum(axis=0))
    return float(np.sqrt(((np.sort(x @ u, axis=0) - np.sort(y @ u, axis=0)) ** 2).mean()))


def permutation_energy(pairs: DataFrame, vector: str, rounds: int = 500, seed: int = 42) -> DataFrame:
    """Per pair: the energy distance, its mean and deviation when works change sides, z and p. All rounds share one matrix of distances:
    with c = 1/n before and -1/m after, the distance is -c'Dc."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _split(rows, vector)
        d, n, m = _distances(np.vstack([x, y])), len(x), len(y)
        c = np.r_[np.full(n, 1 / n), np.full(m, -1 / m)]
        rng = _rng(seed, *key)
        null = np.array([-(s @ d @ s) for s in (rng.permutation(c) for _ in range(rounds))])
        observed, mean, sd = float(-(c @ d @ c)), float(null.mean()), float(null.std())
        z = (observed - mean) / sd if sd > 0 else 0.0
        return pd.DataFrame([(*key, observed, mean, sd, z, float((null >= observed).mean()))], columns=["anchor", "window", "observed", "null_mean", "null_std", "z_score", "p_value"])

    return pairs.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, observed double, null_mean double, null_std double, z_score double, p_value double")


def bootstrap(pairs: DataFrame, vector: str, kernel: Callable, rounds: int = 200, seed: int = 42) -> DataFrame:
    """anchor, window, replicate and value: the kernel of works drawn anew with replacement on each side."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _split(rows, vector)
        rng = _rng(seed, *key)
        values = [float(kernel(x[rng.integers(0, len(x), len(x))], y[rng.integers(0, len(y), len(y))], rng)) for _ in range(rounds)]
        return pd.DataFrame({"anchor": key[0], "window": key[1], "replicate": range(rounds), "value": values})

    return pairs.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, replicate int, value double")


class Graph:
    """A directed graph of n nodes: distinct edges without loops, by number of source and target."""

    def __init__(self, n: int, src: np.ndarray, ref: np.ndarray) -> None:
        self.n, self.src, self.ref = n, src, ref


def _adjacency(edges: pd.DataFrame) -> Graph:
    nodes, index = np.unique(edges[["src", "ref"]].to_numpy().ravel(), return_inverse=True)
    index = np.unique(index.reshape(-1, 2), axis=0)
    index = index[index[:, 0] != index[:, 1]]
    return Graph(len(nodes), index[:, 0], index[:, 1])


def _graph(a: Graph | np.ndarray) -> Graph:
    return a if isinstance(a, Graph) else Graph(len(a), *np.nonzero(a))


#: Neighbours that are looked up at a time, and numbers of a basis that a task keeps to be orthogonal to.
MEET, HELD = 1 << 20, 1 << 22


def _coded(a: np.ndarray, b: np.ndarray, turn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of numbers in order; turn: the smaller of a pair first. Few copies stand beside the arrays."""
    code = np.minimum(a, b, dtype=np.int64) if turn else a.astype(np.int64)
    code <<= 32
    code |= np.maximum(a, b) if turn else b
    code.sort()
    if len(code) and not (fresh := np.r_[True, code[1:] != code[:-1]]).all():
        code = code[fresh]
    low = code.astype(np.int32)
    code >>= 32
    return code.astype(np.int32), low


class Links:
    """An undirected graph of n nodes: distinct edges (a < b, in order) without loops, by the smaller and by the greater node."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray) -> None:
        self.n, self.degree, self.halves = n, np.zeros(n, np.int32), []
        for turned in (False, True):
            x, far = _coded(b, a) if turned else (a, b)
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            node, start = x[start], np.r_[start, len(x)]
            self.degree[node] += np.diff(start).astype(np.int32)
            self.halves.append((far, node, start))

    @property
    def a(self) -> np.ndarray:
        return np.repeat(self.halves[0][1], np.diff(self.halves[0][2]))

    @property
    def b(self) -> np.ndarray:
        return self.halves[0][0]

    def around(self, ufunc: np.ufunc, x: np.ndarray) -> np.ndarray:
        """Of each node what ufunc makes of 0 and the values x of its neighbours."""
        out = np.zeros(self.n, x.dtype)
        for far, node, start in self.halves:
            cuts = np.unique(np.r_[np.searchsorted(start, np.arange(0, len(far), MEET)), len(node)])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                at = node[i:j]
                out[at] = ufunc(out[at], ufunc.reduceat(x[far[start[i] : start[j]]], start[i:j] - start[i]))
        return out


def _largest(a: Graph | np.ndarray) -> Links:
    """The largest connected part."""
    g = _graph(a)
    n = g.n
    x, y = _coded(g.src, g.ref, True)
    if not (apart := x != y).all():
        x, y = x[apart], y[apart]
    label = np.arange(n, dtype=np.int32)
    while True:
        new = label.copy()
        for i in range(0, len(x), MEET):
            p, q = x[i : i + MEET], y[i : i + MEET]
            least = np.minimum(label[p], label[q])
            np.minimum.at(new, p, least)
            np.minimum.at(new, q, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inside = label == np.bincount(label, minlength=1).argmax()
    number = (np.cumsum(inside) - 1).astype(np.int32)
    if not inside.all():
        kept = inside[x]
        x = x[kept]
        y = y[kept]
        x = number[x]
        y = number[y]
    return Links(int(inside.sum()), x, y)


def rank_histogram(a: Graph | np.ndarray) -> np.ndarray:
    """PageRank of each node."""
    g = _graph(a)
    n, out = g.n, np.bincount(g.src, minlength=g.n)
    r = np.full(n, 1 / n)
    for _ in range(200):
        new = 0.15 / n + 0.85 * (np.bincount(g.ref, (r / np.where(out > 0, out, 1))[g.src], n) + r[out == 0].sum() / n)
        if np.abs(new - r).sum() < 1e-10:
            break
        r = new
    return r


def spectral_gap(a: Graph | np.ndarray, dense: int = 2000) -> float:
    """The second smallest eigenvalue of the normalised Laplacian of the largest part; of more than so many nodes by Lanczos steps, which keep a basis of HELD numbers at most."""
    u = _largest(a)
    if u.n < 3:
        return np.nan
    d, root = u.degree, np.sqrt(u.degree)
    if u.n <= dense:
        m = np.eye(u.n)
        weight = 1 / (root[u.a] * root[u.b])
        m[u.a, u.b] -= weight
        m[u.b, u.a] -= weight
        return float(np.linalg.eigvalsh(m)[1])
    top = np.sqrt(d / d.sum())  # belongs to the smallest eigenvalue, 0
    q = np.random.default_rng(42).normal(size=u.n)
    q -= top * (top @ q)
    q /= np.linalg.norm(q)
    before, basis, alpha, beta = np.zeros(u.n), [], [], []
    while True:
        if (len(basis) + 1) * u.n <= HELD:
            basis.append(q)
        w = u.around(np.add, q / root) / root
        alpha.append(w @ q)
        w -= alpha[-1] * q + (beta[-1] * before if beta else 0.0)
        for _ in range(2):
            w -= top * (top @ w)
            for known in basis:
                w -= known * (known @ w)
        beta.append(np.linalg.norm(w))
        k = len(alpha)
        # without the whole basis, values come again; the second smallest is as exact
        last = beta[-1] < 1e-12 or (k >= u.n - 1 and len(basis) == k)
        if k % 20 == 0 or last:
            values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
            if last or beta[-1] * abs(vectors[-1, -1]) < 1e-8:
                return float(1 - values[-1])
        before, q = q, w / beta[-1]


def power_law(a: Graph | np.ndarray) -> float:
    """The slope of the logarithm of the share of in-degrees of at least k against that of k; needs ten positive degrees."""
    g = _graph(a)
    d = np.bincount(g.ref, minlength=g.n)
    d = np.sort(d[d > 0])
    k = np.unique(d)
    if len(d) < 10 or len(k) < 2:
        return np.nan
    tail = 1 - np.searchsorted(d, k) / len(d)
    return float(-np.polyfit(np.log(k), np.log(tail), 1)[0])


def betweenness(a: Graph | np.ndarray, pivots: int = 500) -> float:
    """Mean betweenness in the largest part, from at most so many sources.

    Of a source, all nodes' betweenness adds up to the nodes within its shortest paths: distances less one. So distances are enough, and 64 sources are searched at once, a bit each."""
    u = _largest(a)
    n = u.n
    if n < 3:
        return np.nan
    sources = np.arange(n) if n <= pivots else np.linspace(0, n - 1, pivots).astype(int)
    total = 0
    for at in range(0, len(sources), 64):
        some = sources[at : at + 64]
        seen = np.zeros(n, np.uint64)
        np.bitwise_or.at(seen, some, np.uint64(1) << np.arange(len(some), dtype=np.uint64))
        front, depth = seen.copy(), 0
        while front.any():
            total += max(0, depth - 1) * int(np.bitwise_count(front).sum())
            front = u.around(np.bitwise_or, front) & ~seen
            seen |= front
            depth += 1
    return total / len(sources) / ((n - 1) * (n - 2))


def graph_shift(edges: DataFrame, windows_: Sequence[int], metric: Callable[[Graph], float]) -> DataFrame:
    """anchor, window and value: the change of a metric of the graphs of the two sides. edges: src, ref (long) and year.

    A task holds the graph of one side, whose edges come packed, as numbers of their nodes in order of four bytes each."""
    e = graph.written(edges.where("src <> ref").select("src", "ref", F.col("year").cast("int").alias("year")).distinct())
    nodes = graph.written(windows.numbered(e.select(F.explode(F.array("src", "ref")).alias("node")).distinct(), [F.col("node")], "number"))
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("number").cast("int").alias(f"n{c}"))
    held = graph.written(packed(e.join(number("src"), "src").join(number("ref"), "ref").select(F.col("year").alias("kind"), F.col("nsrc").alias("x"), F.col("nref").alias("y"))))
    sides = windows.sliding_pairs(held.withColumnRenamed("kind", "year"), "year", windows_)
    sides = sides.select("anchor", F.col("window").cast("int").alias("window"), "side", F.lit(0).alias("kind"), "x", "y")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = unpacked(rows, 0)
        there = np.zeros(max(int(x.max()), int(y.max())) + 1, bool)
        there[x] = there[y] = True
        place = np.cumsum(there, dtype=np.int32) - np.int32(1)
        x = place[x]
        y = place[y]
        del place
        v = metric(Graph(int(there.sum()), x, y))
        anchor, window, side = (k.as_py() for k in key)
        return pa.table({"anchor": pa.array([anchor], pa.int64()), "window": pa.array([window], pa.int32()), "side": [side], "value": pa.array([None if np.isnan(v) else float(v)], pa.float64())})

    each = graph.spread(sides, *PAIR, "side").groupBy(*PAIR, "side").applyInArrow(run, "anchor long, window int, side string, value double")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    return each.groupBy(*PAIR).agg(F.abs(side("after") - side("before")).alias("value"))


def rank_shift(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """anchor, window and value: Jensen-Shannon divergence of the histograms of PageRank of the sides, in bins from 0 to the largest. Ranks come from joins on the edges; no task holds a graph."""
    x = graph.written(graph.resting_ranks(pairs, [*PAIR, "side"]))
    total = x.groupBy(*PAIR, "side").agg(F.sum("x").alias("t"), F.max("x").alias("m"))  # a row a side
    top = total.groupBy(*PAIR).agg(F.max(F.col("m") / F.col("t")).alias("top"), F.count("*").alias("sides"))
    each = x.join(F.broadcast(total.join(top.where("sides = 2"), PAIR)), [*PAIR, "side"])
    found = each.select(*PAIR, "side", F.least(F.floor(F.col("x") / F.col("t") / F.col("top") * bins), F.lit(bins - 1)).alias("bin"))
    return top.select(*PAIR).join(divergence.share_divergence(found, "bin", F.ln), PAIR, "left").select(*PAIR, "value")


def squares(y: np.ndarray) -> Callable[[int, int], float]:
    """The cost of a part: squared deviation from its mean."""
    s, q = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(y * y)]
    return lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)


def gaussian(y: np.ndarray) -> Callable[[int, int], float]:
    """The cost of a part: squared deviation from its mean in the space of a Gaussian kernel, whose width is the median distance."""
    d2 = (y[:, None] - y[None, :]) ** 2
    apart = d2[np.triu_indices(len(y), 1)]
    middle = np.median(apart) if len(apart) else 0.0
    k = np.exp(-d2 / (middle or 1.0))
    sums = np.zeros((len(y) + 1, len(y) + 1))
    sums[1:, 1:] = k.cumsum(axis=0).cumsum(axis=1)
    return lambda a, b: (b - a) - (sums[b, b] - sums[a, b] - sums[b, a] + sums[a, a]) / (b - a)


def best_splits(y: np.ndarray, k: int, cost: Callable[[int, int], float] | None = None) -> list[int]:
    """Where k breaks leave the least cost (squares) of the parts: the places where parts begin."""
    n, cost = len(y), cost or squares(y)
    best = [[(cost(0, b), []) if b else (0.0, []) for b in range(n + 1)]]
    for j in range(1, k + 1):
        best.append([min(((best[j - 1][a][0] + cost(a, b), [*best[j - 1][a][1], a]) for a in range(j, b)), default=(np.inf, [])) for b in range(n + 1)])
    return best[k][n][1]


def penalised_splits(y: np.ndarray, penalty: float, least: int = 2, cost: Callable[[int, int], float] | None = None) -> list[int]:
    """Breaks of least cost (squares) plus a penalty for each, with parts of at least so many points; candidates that can't win are pruned."""
    n, cost = len(y), cost or squares(y)
    f, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    f[0] = -penalty
    for b in range(least, n + 1):
        at = [a for a in open_ if b - a >= least]
        values = [f[a] + cost(a, b) + penalty for a in at]
        i = int(np.argmin(values))
        f[b], last[b] = values[i], at[i]
        keep = {a for a, v in zip(at, values, strict=True) if v - penalty <= f[b]}
        open_ = [a for a in open_ if a in keep or b - a < least] + [b - least + 1]
    out, b = [], n
    while b > 0:
        b = int(last[b])
        if b > 0:
            out.append(b)
    return out[::-1]


def change_points(series: DataFrame, year: str, value: str, by: Sequence[str], ks: Sequence[int] = (1, 2, 3), penalties: Sequence[float] = (1.0, 3.0, 5.0)) -> DataFrame:
    """by, detector, parameter and break_years (joined by ;) of each series of at least five known values, scaled to mean 0 and deviation 1.

    dynp: so many breaks, squares; kernelcpd: so many breaks, Gaussian kernel; pelt: a penalty for each break, Gaussian kernel."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[value]).sort_values(year)
        y, years, out = rows[value].to_numpy(float), rows[year].to_numpy(), []
        if len(y) >= 5:
            y = (y - y.mean()) / (y.std() or 1.0)
            kernel = gaussian(y)
            found = [(name, f"k={k}", best_splits(y, k, cost)) for name, cost in (("dynp", None), ("kernelcpd", kernel)) for k in ks if k < len(y)]
            found += [("pelt", f"pen={p:g}", penalised_splits(y, p, cost=kernel)) for p in penalties]
            out = [(*key, d, p, ";".join(str(years[i]) for i in at)) for d, p, at in found]
        return pd.DataFrame(out, columns=[*by, "detector", "parameter", "break_years"])

    kinds = dict(series.dtypes)
    return series.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", detector string, parameter string, break_years string")


def louvain(edges: pd.DataFrame, resolution: float = 1.0) -> pd.Series:
    """Communities, by node, of one weighted undirected graph (a, b, n): nodes move while modularity rises, then communities become nodes.

    A level's nodes are looked at in their order, and again once a node beside them has moved to another community. Edges are held as arrays, each in both directions."""
    nodes = np.union1d(edges["a"], edges["b"])
    a, b = (np.searchsorted(nodes, edges[c]).astype(np.int32) for c in ("a", "b"))
    w = edges["n"].to_numpy(float)
    member = np.arange(len(nodes), dtype=np.int32)
    names = nodes
    while True:
        n = len(names)
        degree = np.bincount(a, w, n) + np.bincount(b, w, n)
        label, moved = _settled(a, b, w, degree, resolution)
        if not moved:
            return pd.Series(names[member], nodes)
        kept, label = np.unique(label, return_inverse=True)
        names, member = names[kept], label[member].astype(np.int32)
        a, b = label[a].astype(np.int32), label[b].astype(np.int32)
        code, at = np.unique((np.minimum(a, b).astype(np.int64) << 32) | np.maximum(a, b), return_inverse=True)
        w = np.bincount(at, w)
        a, b = (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32)
        del code, at


def _settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, degree: np.ndarray, resolution: float) -> tuple[np.ndarray, bool]:
    """The community of each node, named by one of them, and whether any node moved: a level of louvain on edges (a, b, w) between numbers of nodes."""
    n, apart = len(degree), a != b
    if not apart.all():
        a, b, w = a[apart], b[apart], w[apart]
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), out=start[1:])
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    far = np.concatenate([b, a])[order]
    weight = None if len(w) and (w == w[0]).all() else np.concatenate([w, w])[order]
    one = float(w[0]) if len(w) else 1.0
    del order, apart, a, b, w
    price = resolution / max(degree.sum(), 1e-300)
    label, total, own, start = array("i", range(n)), array("d", degree.tobytes()), array("d", degree.tobytes()), array("q", start.tobytes())
    queue, waits, moved = collections.deque(), bytearray(b"\1" * n), False

    def turns() -> Iterator[int]:
        yield from range(n)
        while queue:
            yield queue.popleft()

    for v in turns():
        waits[v] = 0
        near = far[start[v] : start[v + 1]].tolist()
        around: dict[int, float] = {}
        if weight is None:
            for u in near:
                c = label[u]
                around[c] = around.get(c, 0.0) + one
        else:
            for u, x in zip(near, weight[start[v] : start[v + 1]].tolist(), strict=True):
                c = label[u]
                around[c] = around.get(c, 0.0) + x
        here, cost = label[v], price * own[v]
        total[here] -= own[v]
        stay = around.pop(here, 0.0) - cost * total[here]
        best, to = stay + 1e-12, here
        for c, x in around.items():
            gain = x - cost * total[c]
            if gain > best or (gain == best and to != here and c < to):
                best, to = gain, c
        total[to] += own[v]
        if to != here:
            label[v], moved = to, True
            for u in near:
                if not waits[u] and label[u] != to:
                    waits[u] = 1
                    queue.append(u)
    return np.array(label, np.int64), moved


#: Edges of a graph that one task's louvain takes; rounds of a level at most; the share of a graph's nodes that move in a round of a level which has come to rest; and the part of a
#: node's weight that a move must gain where nodes move at once, since less would have them follow each other to whichever community was smallest before the round.
SMALL, TURNS, REST, LEAST = 5_000_000, 125, 0.01, 0.001


def _quality(edges: DataFrame, resolution: dict[int, float]) -> dict[int, tuple[int, float]]:
    """The number of edges, and the modularity of nodes as communities, of each graph (_g, a, b, n); an edge within a node is one of the community's."""
    degree = edges.select("_g", "n", F.explode(F.array("a", "b")).alias("node"), (F.col("a") == F.col("b")).cast("double").alias("loop"))
    degree = degree.groupBy("_g", "node").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("loop")).alias("inside"))
    each = degree.groupBy("_g").agg(F.sum("k").alias("m2"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.sum("inside").alias("inside"))
    each = each.join(edges.groupBy("_g").agg(F.count("*").alias("edges")), "_g")
    return {r["_g"]: (r["edges"], r["inside"] / r["m2"] - resolution[r["_g"]] * r["squares"] / r["m2"] ** 2) for r in each.collect()}  # a row a graph


def _moved(edges: DataFrame, resolution: dict[int, float]) -> DataFrame:
    """_g, node and label: the nodes of each graph (_g, a, b, n) moved to the communities around them, a drawn half in each round, while that raises modularity."""
    both = edges.select("_g", "a", "b", "n").unionByName(edges.select("_g", F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    degree = both.groupBy("_g", F.col("a").alias("node")).agg(F.sum("n").alias("k"))
    e = graph.written(both.where("a <> b"))
    whole = {r["_g"]: r["m2"] for r in edges.groupBy("_g").agg((2 * F.sum("n")).alias("m2")).collect()}  # a row a graph
    price = F.create_map(*(F.lit(x) for g, m2 in whole.items() for x in (g, resolution[g] / m2)))
    nodes = graph.written(degree.select("_g", "node", "k", (price[F.col("_g")] * F.col("k")).alias("cost"), F.col("node").alias("label")))
    still = 0
    for t in range(TURNS):
        turn = lambda c: F.pmod(F.xxhash64(c, F.lit(t)), F.lit(2)) == 0  # noqa: E731, B023
        named = graph.written(nodes.join(nodes.groupBy("_g", "label").agg(F.sum("k").alias("total")), ["_g", "label"]).select("_g", "node", "k", "cost", "label", "total"))
        near = e.where(turn("a")).join(named.select("_g", F.col("node").alias("b"), F.col("label").alias("to"), F.col("total").alias("there")), ["_g", "b"])
        near = near.groupBy("_g", "a", "to").agg(F.sum("n").alias("w"), F.max("there").alias("there"))
        near = near.join(named.where(turn("node")).withColumnRenamed("node", "a"), ["_g", "a"])
        same = F.col("to") == F.col("label")
        gain = F.col("w") - F.col("cost") * (F.col("there") - F.when(same, F.col("k")).otherwise(0.0))
        near = near.select("_g", "a", "to", same.alias("same"), gain.alias("gain"), (-F.col("cost") * (F.col("total") - F.col("k"))).alias("alone"), (LEAST * F.col("k")).alias("least"))
        other = lambda c: F.when(~F.col("same"), c)
        best = near.groupBy("_g", F.col("a").alias("node")).agg(
            F.max_by(other(F.col("to")), other(F.struct("gain", -F.col("to")))).alias("to"), F.max(other(F.col("gain"))).alias("gain"), F.coalesce(F.max(F.when(F.col("same"), F.col("gain"))), F.max("alone")).alias("stay"), F.max("least").alias("least"))
        best = best.where("gain > stay + least").select("_g", "node", "to")
        nodes = graph.written(named.join(best, ["_g", "node"], "left").select("_g", "node", "k", "cost", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")))
        busiest = nodes.groupBy("_g").agg(F.avg(F.col("moved").cast("double")).alias("share")).agg(F.max("share")).first()[0]
        still = still + 1 if busiest < REST else 0
        if still == 2:  # either half
            break
    return nodes.select("_g", "node", "label")


def communities(edges: DataFrame, by: Sequence[str], resolutions: Sequence[float] = (1.0,)) -> DataFrame:
    """by, resolution, node and community of each group of distinct edges (by, a, b, n): one graph a group.

    Nodes of graphs of more than SMALL edges move by rounds of joins, then communities become nodes, until the graph is small or its modularity rises no more; small graphs are one task's.
    Communities are named by one of their nodes, or by one that was theirs."""
    keys = [*by, "resolution"]
    spark = edges.sparkSession
    every = graph.written(edges.select(*by, "a", "b", F.col("n").cast("double").alias("n")))
    graphs = [(i, *r, x) for i, (r, x) in enumerate((r, float(x)) for r in every.select(*by).distinct().collect() for x in resolutions)]  # a row a graph
    kinds = dict(edges.dtypes)
    names = F.broadcast(spark.createDataFrame(graphs, "_g int, " + "".join(f"{c} {kinds[c]}, " for c in by) + "resolution double"))
    resolution = {g[0]: g[-1] for g in graphs}
    now = graph.written(every.join(names, list(by)).select("_g", "a", "b", "n"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        g = key[0].as_py()
        found = louvain(pd.DataFrame({c: rows.column(c).to_numpy() for c in ("a", "b", "n")}, copy=False), resolution[g])
        each = pa.array(found.index.to_numpy()), pa.array(found.to_numpy())
        return pa.table({"_g": pa.array(np.full(len(found), g, np.int32)), "node": each[0], "community": each[1]})

    def small(df: DataFrame) -> DataFrame:
        return graph.spread(df, "_g").groupBy("_g").applyInArrow(run, "_g int, node long, community long")

    quality, member = _quality(now, resolution), None
    while big := [g for g, (n, _) in quality.items() if n > SMALL]:
        part = now.where(F.col("_g").isin(big))
        labels = _moved(part, resolution)
        ends = part.join(labels.toDF("_g", "a", "la"), ["_g", "a"]).join(labels.toDF("_g", "b", "lb"), ["_g", "b"])
        coarse = graph.written(ends.groupBy("_g", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("n").alias("n")))
        after = _quality(coarse, resolution)
        better = [g for g in big if after[g][1] > quality[g][1] + 1e-7]
        if member is None:
            member = now.select("_g", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node"))
        step = labels.where(F.col("_g").isin(better)).toDF("_g", "community", "label")
        member = graph.written(member.join(step, ["_g", "community"], "left").select("_g", "node", F.coalesce("label", "community").alias("community")))
        now = graph.written(coarse.where(F.col("_g").isin(better)).unionByName(now.where(~F.col("_g").isin(big))))
        quality = {g: after[g] if g in better else q for g, q in quality.items() if g in better or g not in big}
    found = small(now)
    if member is not None:
        found = member.join(found.toDF("_g", "community", "label"), ["_g", "community"], "left").select("_g", "node", F.coalesce("label", "community").alias("community"))
    return found.join(names, "_g").select(*keys, "node", "community")


def community_divergence(pairs: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """anchor, window and value: Jensen-Shannon divergence of the shares that communities have of the sides' nodes.

    pairs: anchor, window, side, src, ref. The communities are those of the united graph: all edges (src, ref) between nodes of either side.
    """
    node = F.explode(F.array("src", "ref")).alias("node")
    nodes = graph.written(pairs.select(*PAIR, "side", node).distinct())
    there = nodes.select(*PAIR, "node").distinct()
    e = edges.select("src", "ref").distinct().join(there.withColumnRenamed("node", "src"), "src").join(there.withColumnRenamed("node", "ref"), [*PAIR, "ref"])
    e = e.select(*PAIR, F.least("src", "ref").alias("a"), F.greatest("src", "ref").alias("b"), F.lit(1.0).alias("n")).distinct()
    found = graph.written(nodes.join(communities(e, PAIR, (resolution,)), [*PAIR, "node"]).select(*PAIR, "side", "community"))
    both = found.groupBy(*PAIR).agg(F.count_distinct("side").alias("sides")).where("sides = 2").select(*PAIR)
    value = divergence.share_divergence(found.join(F.broadcast(both), PAIR), "community", F.ln)
    return there.select(*PAIR).distinct().join(value, PAIR, "left").select(*PAIR, "value")


def rewire(pairs: np.ndarray, swaps: int, rng: np.random.Generator, sided: bool = False) -> np.ndarray:
    """Undirected edges after swaps of ends that keep every degree and make neither loops nor repeated edges; sided: each node stays in its column."""
    if len(pairs) < 2:
        return pairs.copy()
    nodes, index = np.unique(pairs, return_inverse=True)
    return nodes[swapped(index.reshape(-1, 2), swaps, rng, sided)]


#: Codes handled at a time.
LOOK = 1 << 16


def _repeated(codes: np.ndarray) -> np.ndarray:
    """Which of these are there more than once: told by 32 bits of a hash, and those that share these by themselves."""
    short = np.empty(len(codes), np.uint32)
    for i in range(0, len(codes), LOOK):  # a piece at a time fits the nearest cache
        short[i : i + LOOK] = (codes[i : i + LOOK].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    every = np.sort(short)
    shared = every[1:][every[1:] == every[:-1]]
    out = np.zeros(len(codes), bool)
    if len(shared):
        low = np.zeros(1 << 16, bool)  # few hashes are shared, and this fits the nearest cache
        low[shared & np.uint32(0xFFFF)] = True
        at = np.concatenate([i + np.flatnonzero(low[short[i : i + LOOK] & np.uint32(0xFFFF)]) for i in range(0, len(codes), LOOK)])
        _, which, n = np.unique(codes[at], return_inverse=True, return_counts=True)
        out[at] = n[which] > 1
    return out


def swapped(index: np.ndarray, swaps: int, rng: np.random.Generator, sided: bool = False) -> np.ndarray:
    """rewire on nodes that are numbers below 2^31; edges come in another order.

    All edges are paired at random, half their number of swaps at once: those of the first half of a new order with those of the second. A pair swaps where nothing that it gives
    or makes is any other edge, given or made: so a step and its reverse are as likely, as with single swaps."""
    m, low = len(index), np.int64(0xFFFFFFFF)
    half = m // 2
    if not half:
        return index.copy()
    edge = (index[:, 0].astype(np.int64) << 32) | index[:, 1]
    code = lambda a, b: (np.minimum(a, b) << 32) | np.maximum(a, b)
    for _ in range(-(-swaps // half)):
        edge = rng.permutation(edge)
        left, right = edge >> 32, edge & low
        a, b, c, d = left[:half], right[:half], left[half : 2 * half], right[half : 2 * half]
        if not sided:
            turn = rng.random(half) < 0.5
            c, d = np.where(turn, d, c), np.where(turn, c, d)
        taken = _repeated(np.concatenate([code(left, right), code(a, d), code(c, b)]))
        free = (a != d) & (c != b) & ~(taken[:half] | taken[half : 2 * half] | taken[m : m + half] | taken[m + half :])
        edge[:half] = np.where(free, (a << 32) | d, edge[:half])
        edge[half : 2 * half] = np.where(free, (c << 32) | b, edge[half : 2 * half])
    return np.stack([edge >> 32, edge & low], axis=1)


#: Edges of a cell of a graph that is rewired in parts, about, and rounds in which nodes are dealt anew.
CELL, DEALS = 250_000, 10


def rewired(edges: DataFrame, factor: int = 10, seed: int = 42) -> DataFrame:
    """Distinct undirected edges (a, b, long) after factor swaps an edge, as rewire makes them; no task holds the graph.

    In each round nodes get a colour by hash, and edges whose ends have the same two colours are a cell. Swaps that keep colours stay in the cell, which has every edge that they could repeat."""
    e = graph.written(edges.select("a", "b"))
    colours = int(np.ceil(np.sqrt(2 * e.count() / CELL)))
    rounds = DEALS if colours > 1 else 1

    def run(r: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def swap(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            e = rows.sort_values(["a", "b"])[["a", "b"]].to_numpy()
            return pd.DataFrame(rewire(e, -(-factor * len(e) // rounds), _rng(seed, "rewire", r, *key), key[0] != key[1]), columns=["a", "b"])

        return swap

    for r in range(rounds):
        colour = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(r)), F.lit(colours))  # noqa: E731, B023
        e = e.select(colour("a").alias("p"), colour("b").alias("q"), "a", "b")
        turned = F.col("p") > F.col("q")
        e = e.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
        e = e.groupBy("p", "q").applyInPandas(run(r), "a long, b long")
    return e


#: Rewired graphs that one task draws at least, tasks for each core of the session at most, and pairs of numbers that a row holds packed.
GRAPHS, TASKS, PACKED = 8, 4, 1 << 14


def packed(pairs: DataFrame) -> DataFrame:
    """kind, x and y: the pairs (kind, x, y; int) as binary columns of up to PACKED numbers a row."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def row(kind: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(kind))
            x, y = (t.column(c).to_numpy().tobytes() for c in ("x", "y"))
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([x]), pa.array([y])], ["kind", "x", "y"])

        for batch in it:
            for kind in pc.unique(batch.column("kind")).to_pylist():
                held.setdefault(kind, []).append(batch.filter(pc.equal(batch.column("kind"), kind)))
                if sum(b.num_rows for b in held[kind]) >= PACKED:
                    yield row(kind)
        for kind in list(held):
            yield row(kind)

    return pairs.select("kind", "x", "y").mapInArrow(pack, "kind int, x binary, y binary")


def unpacked(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a kind."""
    part = rows if pc.all(same := pc.equal(rows.column("kind"), kind)).as_py() else rows.filter(same)
    return tuple(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(v.as_buffer(), np.int32) for v in part.column(c))]) for c in ("x", "y"))


def separation_null(edges: DataFrame, labels: DataFrame, replicates: int = 100, seed: int = 42, factor: int = 10) -> DataFrame:
    """Two rows, of the share of edges (a, b) within a label and of Newman's modularity: statistic, observed, null_mean and null_std (sample deviation) over rewired graphs, z_score, p_value,
    n_perm, n_nodes and n_edges of the graph of labelled nodes.

    Rewiring keeps all degrees, so modularity is the share less what the labels' degrees alone make. A task holds the graph, once for as many replicates as leave TASKS tasks a
    core, GRAPHS at least: numbers of nodes and codes of labels of four bytes each. Each replicate has a random stream of its own."""
    spark = edges.sparkSession
    named = labels.toDF("node", "label").where("label IS NOT NULL")
    both = named.toDF("a", "la"), named.toDF("b", "lb")
    e = graph.written(edges.select("a", "b").join(both[0], "a").join(both[1], "b"))
    ends = e.select(F.col("a").alias("node"), F.col("la").alias("label")).union(e.select("b", "lb")).distinct()
    codes = windows.numbered(ends.select("label").distinct(), [F.col("label")], "code")
    nodes = graph.written(windows.numbered(ends.join(codes, "label"), [F.col("node")], "number"))
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("number").alias(f"n{c}"))
    pairs = e.select("a", "b").join(number("a"), "a").join(number("b"), "b").select(F.lit(0).alias("kind"), F.col("na").cast("int").alias("x"), F.col("nb").cast("int").alias("y"))
    held = graph.written(packed(pairs.union(nodes.select(F.lit(1), F.col("number").cast("int"), F.col("code").cast("int")))))
    each = max(GRAPHS, -(-(replicates + 1) // (TASKS * spark.sparkContext.defaultParallelism)))
    chunks = -(-(replicates + 1) // each)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        (x, y), (at, code) = unpacked(rows, 0), unpacked(rows, 1)
        first = int(at.min())
        label = np.empty(len(at), np.int32)
        label[at - first] = code
        whole = np.sort((x.astype(np.int64) - first << 32) | (y - first))
        whole, out, chunk = np.stack([whole >> 32, whole & 0xFFFFFFFF], axis=1).astype(np.int32), [], key[0].as_py()
        for r in range(each * chunk, min(each * (chunk + 1), replicates + 1)):
            g = swapped(whole, factor * len(whole), _rng(seed, r)) if r else whole
            out.append((r, float((label[g[:, 0]] == label[g[:, 1]]).mean())))
        degree = np.bincount(label[whole.ravel()]) / (2 * len(whole))
        out = np.array(out)
        return pa.table({"replicate": out[:, 0].astype(np.int32), "share": out[:, 1], "chance": np.full(len(out), (degree**2).sum()), "nodes": np.full(len(out), len(at)), "m": np.full(len(out), len(whole))})

    s = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks, "chunk")
    s = s.groupBy("chunk").applyInArrow(run, "replicate int, share double, chance double, nodes long, m long")
    null = F.when(F.col("replicate") > 0, F.col("share"))
    r = s.agg(F.max(F.when(F.col("replicate") == 0, F.col("share"))).alias("o"), F.avg(null).alias("mean"), F.stddev_samp(null).alias("sd"), F.collect_list(null).alias("n"), *(F.max(c).alias(c) for c in ("chance", "nodes", "m")))
    p = (F.size(F.filter("n", lambda x: x >= F.col("o"))) + 1) / (F.size("n") + 1)
    of = F.explode(F.array(F.struct(F.lit("within_share").alias("statistic"), F.lit(0.0).alias("less")), F.struct(F.lit("modularity").alias("statistic"), F.coalesce("chance", F.lit(0.0)).alias("less")))).alias("s")
    z = F.when(F.col("sd") > 0, (F.col("o") - F.col("mean")) / F.col("sd"))
    r = r.select("*", z.alias("z"), p.alias("p"), F.size("n").alias("k"), of)
    return r.selectExpr("s.statistic", "o - s.less AS observed", "mean - s.less AS null_mean", "sd AS null_std", "z AS z_score", "p AS p_value", "k AS n_perm", "coalesce(nodes, 0) AS n_nodes", "coalesce(m, 0) AS n_edges")


def rewiring_null(edges: DataFrame, labels: DataFrame, replicates: int = 100, seed: int = 42, factor: int = 10) -> DataFrame:
    """One row: the share of edges within a label, its mean and sample deviation over rewired graphs, z and p."""
    s = separation_null(edges, labels, replicates, seed, factor).where("statistic = 'within_share'")
    return s.select("observed", "null_mean", "null_std", "z_score", "p_value")


def dip(x: np.ndarray) -> float:
    """Hartigan's dip: the largest distance of the empirical distribution from the nearest unimodal one, by bisection over its size."""
    x = np.sort(x)
    n = len(x)
    values, first = np.unique(x, return_index=True)
    if len(values) < 3:
        return 1 / (2 * n)
    below, upto = first / n, np.append(first[1:], n) / n

    def fits(d: float) -> bool:
        """Whether a function convex up to some mode and concave after it stays within d of the empirical one."""
        low, high = upto - d, below + d
        for mode in range(len(values)):
            if _convex(values[: mode + 1], low[: mode + 1], high[: mode + 1]) and _convex(-values[mode:][::-1], -high[mode:][::-1], -low[mode:][::-1]):
                return True
        return False

    a, b = 0.0, 0.5
    for _ in range(24):
        d = (a + b) / 2
        a, b = (a, d) if fits(d) else (d, b)
    return b


def _convex(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
    """Whether the greatest convex function below high is nowhere below low."""
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1 and (high[hull[-1]] - high[hull[-2]]) * (x[i] - x[hull[-2]]) >= (high[i] - high[hull[-2]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    return bool((np.interp(x, x[hull], high[hull]) >= low - 1e-12).all())


def quota_selection(rows: pd.DataFrame, n: int, quotas: dict[str, int], score: str, key: str) -> pd.DataFrame:
    """The n best rows of which at least so many fulfil each quota's boolean column: quotas are filled first, best first."""
    rows = rows.sort_values([score, key], ascending=[False, True], kind="stable")
    chosen: list = []
    for c, least in quotas.items():
        have = sum(bool(rows.loc[i, c]) for i in chosen)
        chosen += [i for i in rows.index if rows.loc[i, c] and i not in chosen][: max(0, least - have)]
    chosen += [i for i in rows.index if i not in chosen][: max(0, n - len(chosen))]
    return rows.loc[sorted(chosen[:n], key=list(rows.index).index)]


def mean_js(x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None, epsilon: float = 1e-10) -> float:
    """Jensen-Shannon distance of the sides' mean weights, smoothed."""
    p, q = (v.mean(axis=0) + epsilon for v in (x, y))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(np.sqrt(max(0.0, ((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2)))


_NULL = "anchor long, window int, observed double, null_mean double, null_std double, z_score double, p_value double"


def _against(key: tuple, observed: float, null: np.ndarray) -> pd.DataFrame:
    null = null[~np.isnan(null)]
    columns = ["anchor", "window", "observed", "null_mean", "null_std", "z_score", "p_value"]
    if np.isnan(observed) or not len(null):
        return pd.DataFrame([(*key, *[None] * 5)], columns=columns)
    mean, sd = float(null.mean()), float(null.std())
    return pd.DataFrame([(*key, observed, mean, sd, (observed - mean) / sd if sd > 0 else 0.0, float((null >= observed).mean()))], columns=columns)


def permutation(pairs: DataFrame, vector: str, kernel: Callable, rounds: int = 500, seed: int = 42) -> DataFrame:
    """Any kernel of the sides' vectors against works that change sides; energy has a quicker form of its own."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = _split(rows, vector)
        rng, both = _rng(seed, *key), np.vstack([x, y])
        null = [kernel(both[o[: len(x)]], both[o[len(x) :]], rng) for o in (rng.permutation(len(both)) for _ in range(rounds))]
        return _against(key, float(kernel(x, y, rng)), np.array(null))

    return pairs.groupBy(*PAIR).applyInPandas(run, _NULL)


def graph_permutation(pairs: DataFrame, metric: Callable[[Graph], float], rounds: int = 100, seed: int = 42) -> DataFrame:
    """The change of a graph metric against citing works that change sides and take their edges along."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "src", "ref"])
        works = rows[["side", "src"]].drop_duplicates()
        of = rows.merge(works.assign(w=range(len(works))), on=["side", "src"])["w"].to_numpy()
        side = works["side"].to_numpy() == "before"

        def shift(side: np.ndarray) -> float:
            v = [metric(_adjacency(part)) if len(part := rows[side[of] == s]) else np.nan for s in (True, False)]
            return abs(v[1] - v[0])

        rng = _rng(seed, *key)
        return _against(key, shift(side), np.array([shift(rng.permutation(side)) for _ in range(rounds)]))

    return pairs.groupBy(*PAIR).applyInPandas(run, _NULL)


#: Bits of a long that stand for rounds.
BITS = 62


def shuffled(i: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 to n - 1 told by keys takes each of i, without the others: Feistel rounds on the least even number of bits, repeated while beyond n."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys.astype(np.uint64):
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ (h >> np.uint64(33)) & mask
        return left << half | right

    x = once(i.astype(np.uint64))
    while (far := x >= np.uint64(n)).any():
        x[far] = once(x[far])
    return x.astype(np.int64)


def entropy_permutation(pairs: DataFrame, rounds: int = 100, seed: int = 42) -> DataFrame:
    """As graph_permutation with degree_entropy, by aggregates: a work's bits say of which rounds' earlier side it is, and no task holds a window's edges.

    Works are numbered by pair; each round's permutation of the numbers is told by keys, so a side keeps its number of works."""
    works = windows.numbered(pairs.select(*PAIR, "side", "src").distinct(), [*map(F.col, PAIR), F.col("side"), F.col("src")], "place")
    works = graph.written(works)
    sizes = works.groupBy(*PAIR).agg(F.min("place").alias("first"), F.count("*").alias("n"), F.count_if(F.col("side") == "before").alias("early"))  # a row a pair
    words = rounds // BITS + 1

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (anchor, window), rows in batch.groupby(PAIR):
                n, early = int(rows["n"].iloc[0]), int(rows["early"].iloc[0])
                i, m = (rows["place"] - rows["first"]).to_numpy(), np.zeros((words, len(rows)), np.int64)
                m[0] = rows["side"].to_numpy() == "before"  # round 0 is what is observed
                for r in range(1, rounds + 1):
                    m[r // BITS] |= (shuffled(i, n, _rng(seed, anchor, window, r).integers(0, 2**62, 6)) < early).astype(np.int64) << (r % BITS)
                yield rows[[*PAIR, "side", "src"]].assign(**{f"m{k}": m[k] for k in range(words)})

    each = ", ".join(f"m{k} long" for k in range(words))
    marks = works.join(F.broadcast(sizes), PAIR).mapInPandas(drawn, f"anchor long, window int, side string, src {dict(pairs.dtypes)['src']}, {each}")
    e = graph.spread(pairs.where("src <> ref").join(marks, [*PAIR, "side", "src"]).drop("side"), *PAIR, "ref")
    both = [f"bit_or({'~' * late}m{k}) AS {'ab'[not late]}{k}" for k in range(words) for late in (False, True)]
    e = e.groupBy(*PAIR, "ref", "src").agg(*map(F.expr, both))  # a work that stands on both sides cites once where they meet
    of = lambda side, r: F.sum(F.expr(f"shiftright({side}{r // BITS}, {r % BITS}) & 1"))
    degree = e.groupBy(*PAIR, "ref").agg(F.array(*(F.array(of("b", r), of("a", r)) for r in range(rounds + 1))).alias("d"))
    degree = degree.select(*PAIR, F.posexplode("d").alias("round", "d")).select(*PAIR, "round", F.posexplode("d").alias("late", "d")).where("d > 0")
    n = degree.groupBy(*PAIR, "round", "late", "d").agg(F.count("*").alias("n"))
    h = n.groupBy(*PAIR, "round", "late").agg(F.expr("CASE WHEN sum(n) >= 3 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) END AS h"))
    shift = h.groupBy(*PAIR, "round").agg(F.expr("abs(max(CASE WHEN late = 1 THEN h END) - max(CASE WHEN late = 0 THEN h END)) AS value"))
    observed = shift.where("round = 0 AND value IS NOT NULL").select(*PAIR, F.col("value").alias("observed"))
    null = shift.where("round > 0 AND value IS NOT NULL").join(F.broadcast(observed), PAIR).groupBy(*PAIR, "observed")
    null = null.agg(F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), F.avg((F.col("value") >= F.col("observed")).cast("double")).alias("p_value"))
    z = F.when(F.col("null_std") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_std")).when(F.col("null_std").isNotNull(), 0.0)
    return sizes.select(*PAIR).join(null, PAIR, "left").select(*PAIR, "observed", "null_mean", "null_std", z.alias("z_score"), "p_value")


def degree_entropy(a: Graph | np.ndarray) -> float:
    """Of the distribution of positive in-degrees; needs three of them."""
    g = _graph(a)
    d = np.bincount(g.ref, minlength=g.n)
    d = d[d > 0]
    if len(d) < 3:
        return np.nan
    p = np.unique(d, return_counts=True)[1] / len(d)
    return float(-(p * np.log(p)).sum())


class Sparse:
    """Rows of a matrix by the places and values of what isn't 0."""

    def __init__(self, ix: Sequence[np.ndarray], w: Sequence[np.ndarray], width: int) -> None:
        n = np.array([len(x) for x in ix], np.int64)
        self.row, self.width, self.n = np.repeat(np.arange(len(n)), n), width, len(n)
        self.ix = np.concatenate([np.asarray(x, np.int64) for x in ix]) if len(n) else np.zeros(0, np.int64)
        self.w = np.concatenate([np.asarray(x, float) for x in w]) if len(n) else np.zeros(0)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.w * v[self.ix], self.n)

    def turned(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.ix, self.w * u[self.row], self.width)

    def rows(self, keep: np.ndarray) -> Sparse:
        """The rows where keep holds."""
        out, at = Sparse([], [], self.width), np.cumsum(keep) - 1
        mine = keep[self.row]
        out.row, out.ix, out.w, out.n = at[self.row[mine]], self.ix[mine], self.w[mine], int(keep.sum())
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.width))
        out[self.row, self.ix] = self.w
        return out


def sparse_logistic(x: Sparse, y: np.ndarray, ridge: float = 1.0, steps: int = 20) -> np.ndarray:
    """As logistic, for sparse rows: each Newton step is solved by conjugate gradients, so only products with the rows are taken."""
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    penalty = np.full(x.width + 1, ridge)
    penalty[-1] = 1e-9
    w = np.zeros(x.width + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -30, 30)))
        curve, error = weight * p * (1 - p), weight * (y - p)

        def hessian(v: np.ndarray, curve: np.ndarray = curve) -> np.ndarray:
            u = curve * (x.times(v[:-1]) + v[-1])
            return np.append(x.turned(u), u.sum()) + penalty * v

        rest = np.append(x.turned(error), error.sum()) - penalty * w
        step, way, size = np.zeros_like(w), rest, rest @ rest
        least = size * 1e-12
        for _ in range(200):
            if size <= least or size == 0:
                break
            h = hessian(way)
            far = size / (way @ h)
            step, rest = step + far * way, rest - far * h
            size, before = rest @ rest, size
            way = rest + size / before * way
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _split_sparse(rows: pd.DataFrame, key: str, width: int) -> tuple[Sparse, np.ndarray]:
    """All rows of a pair (ix, w), in the order of key, and which are of the later side."""
    rows = rows.sort_values(["side", key])
    return Sparse(rows["ix"].tolist(), rows["w"].tolist(), width), (rows["side"] == "after").to_numpy()


def sparse_two_sample(pairs: DataFrame, key: str, width: int, folds: int = 5, seed: int = 42) -> DataFrame:
    """As two_sample, for works as sparse rows (ix, w) of so many features, all of them used."""
    names = ["value", "auc_std", "auc_q025", "auc_q975", "n_folds", "p_value_vs_chance"]

    def run(pair: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, label = _split_sparse(rows, key, width)
        each = []
        if min(label.sum(), (~label).sum()) >= folds:
            rng, fold = _rng(seed, *pair), np.empty(len(label), int)
            for c in (False, True):
                at = rng.permutation(np.flatnonzero(label == c))
                fold[at] = np.arange(len(at)) % folds
            for f in range(folds):
                w = sparse_logistic(x.rows(fold != f), label[fold != f])
                each.append(_auc(x.rows(fold == f).times(w[:-1]) + w[-1], label[fold == f]))
        out = auc_spread(np.array(each)) if each else [None] * 6
        return pd.DataFrame([(*pair, *out)], columns=[*PAIR, *names]).astype({"n_folds": "Int32"})

    return pairs.groupBy(*PAIR).applyInPandas(run, "anchor long, window int, value double, auc_std double, auc_q025 double, auc_q975 double, n_folds int, p_value_vs_chance double")


def _js_rows(p: np.ndarray, q: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
    """Jensen-Shannon distances of the rows of two matrices of mean weights, smoothed."""
    p, q = p + epsilon, q + epsilon
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
    m = (p + q) / 2
    return np.sqrt(np.maximum(0, ((p * np.log(p / m)).sum(axis=1) + (q * np.log(q / m)).sum(axis=1)) / 2))


#: Rounds of a permutation that one task draws.
ROUNDS = 125


def _rounds(pairs: DataFrame, rounds: int) -> DataFrame:
    """pairs once for each chunk of rounds."""
    return pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // ROUNDS) - 1))))


def _sides(rng: np.random.Generator, label: np.ndarray, n: int) -> np.ndarray:
    """n draws of which works are of the later side, as rows of 0 and 1."""
    return np.array([rng.permutation(label) for _ in range(n)], float).reshape(n, len(label))


def sparse_permutation(pairs: DataFrame, key: str, width: int, rounds: int = 500, seed: int = 42) -> DataFrame:
    """The Jensen-Shannon distance of the sides' mean weights against works (ix, w) that change sides. Chunks of rounds are drawn in tasks of their own, with random streams of their own."""
    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *pair, chunk = group
        x, label = _split_sparse(rows, key, width)
        n = min(ROUNDS, rounds - ROUNDS * int(chunk))
        drawn = np.vstack([label.astype(float), _sides(_rng(seed, *pair, chunk), label, n)])
        dense = x.dense()
        after, whole = drawn @ dense, dense.sum(axis=0)
        late = label.sum()
        values = _js_rows((whole - after) / (len(label) - late), after / late)
        return pd.DataFrame({"anchor": pair[0], "window": pair[1], "observed": values[0], "value": values[1:]})

    each = graph.spread(_rounds(pairs, rounds), *PAIR, "chunk").groupBy(*PAIR, "chunk").applyInPandas(run, "anchor long, window int, observed double, value double")
    sd = F.stddev_pop("value")
    out = each.groupBy(*PAIR).agg(F.max("observed").alias("observed"), F.avg("value").alias("null_mean"), sd.alias("null_std"), (F.count_if(F.col("value") >= F.col("observed")) / F.count("*")).alias("p_value"))
    z = F.when(F.col("null_std") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_std")).otherwise(0.0)
    return out.select(*PAIR, "observed", "null_mean", "null_std", z.alias("z_score"), "p_value")


def shift_limits(works: DataFrame, key: str, width: int, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """One row: the 95th and 99th percentile of the largest mean difference of any term when works change sides. works: side and
    sparse rows (ix, w), drawn to a bounded sample beforehand; chunks of rounds are drawn in tasks of their own."""
    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, label = _split_sparse(rows, key, width)
        drawn = _sides(_rng(seed, "shift", *group), label, min(ROUNDS, rounds - ROUNDS * int(group[0])))
        late, dense = label.sum(), x.dense()
        after = drawn @ dense
        return pd.DataFrame({"top": np.abs(after / late - (dense.sum(axis=0) - after) / (len(label) - late)).max(axis=1)})

    tops = graph.spread(_rounds(works, rounds), "chunk").groupBy("chunk").applyInPandas(run, "top double")
    return tops.agg(F.percentile("top", F.lit(0.95)).alias("p95"), F.percentile("top", F.lit(0.99)).alias("p99"))
