"""Runs of repeated word sequences, found by Karp-Miller-Rosenberg names of power-of-two blocks.

Words of a text are numbered exactly, by a dictionary. The block of 2^(k+1) words at a place is named by the pair of names of its two halves, equal blocks
alike; a pair with a half that stands nowhere else needs no naming. How far two places agree is then read off by going
down the levels, from the largest block to the single word. A stretch of period q with at least 4 q words holds, for 2^k <= q < 2^(k+1), a place on the grid of
step 2^(k+1) whose block of 2^k equals the one q further on; those places are extended both ways by
their common extensions, for many texts at once. No hashes and no suffix sorting.

A text of n words takes at most 4 n log2(n) bytes of names (less where few blocks repeat), and texts are worked through one
Arrow batch at a time, in blocks of about BLOCK words.

Defined cases: null and empty texts have no words and no runs; repeated rows are told one by one; a null doc_id counts as an empty one
where its crc32 is asked for. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches, raw_texts, tune

#: The least words and periods of a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words worked through together (a longer text is worked through alone), and pairs of places compared at a time.
BLOCK, PAIRS = 1 << 16, 1 << 20


def names(first: np.ndarray) -> list[np.ndarray]:
    """For each level k, the name of the block of 2^k items at each place. Names of blocks that stand once are negative and all differ.

    first: exact numbers of the items, at least 0. The levels end where no block stands twice; a block that passes the end stands once.
    """
    n = len(first)
    alone = -1 - np.arange(n, dtype=np.int32)
    counts = np.bincount(first, minlength=1)
    level = np.where(counts[first] > 1, first, alone).astype(np.int32)
    out = [level]
    while True:
        half = 1 << (len(out) - 1)
        at = np.flatnonzero(level[: max(0, n - half)] >= 0)
        at = at[level[at + half] >= 0]
        _, number, times = np.unique(level[at].astype(np.int64) << 32 | level[at + half], return_inverse=True, return_counts=True)
        again = times[number] > 1
        if not again.any():
            return out
        level = alone.copy()
        level[at[again]] = number[again]
        out.append(level)


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items from i and from j on agree (i < j)."""
    n, i, j, start = len(levels[0]), i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        inside = j < n
        a, b = levels[k][np.where(inside, i, 0)], levels[k][np.where(inside, j, 0)]
        same = (inside & (a == b)).astype(np.int64) << k
        i, j = i + same, j + same
    return i - start


def extend_back(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items before i and before j agree (i < j)."""
    i, j, start = i.copy(), j.copy(), i
    for k in range(len(levels) - 1, -1, -1):
        inside = i >= 1 << k
        a, b = levels[k][np.where(inside, i - (1 << k), 0)], levels[k][np.where(inside, j - (1 << k), 0)]
        same = (inside & (a == b)).astype(np.int64) << k
        i, j = i - same, j - same
    return start - i


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of the rows (start, length, period) with equal start and length, the one of smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of every run, by start and period. first: exact numbers of the items, at least 0."""
    levels, n, found = names(first), len(first), []
    for k, level in enumerate(levels):
        step = 1 << (k + 1)
        grid = np.arange(0, n, step)
        grid = grid[level[grid] >= 0]
        for c in range(0, len(grid), max(1, PAIRS >> k)):
            i = grid[c : c + max(1, PAIRS >> k), None]
            j = i + np.arange(1 << k, step)
            ok = j < n
            ok &= level[i] == level[np.where(ok, j, 0)]
            row, col = np.nonzero(ok)
            i, q = i[row, 0], col + (1 << k)
            ahead, behind = extend(levels, i, i + q), extend_back(levels, i, i + q)
            length = q + ahead + behind
            keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(_smallest(np.stack([(i - behind)[keep], length[keep], q[keep]], axis=1)))
    out = _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as given, or made periodic from a place on, as the crc32 of doc_id tells."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def _greatest(start: list[int], length: list[int], period: list[int]) -> int:
    """The place of the run of greatest length / period, the first of equal ones; fractions are compared exactly."""
    best = 0
    for i in range(1, len(start)):
        if length[i] * period[best] > length[best] * period[i]:
            best = i
    return best


FIELDS = {**dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), pa.int64()), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _told(texts: list[list[bytes]]) -> Iterator[tuple]:
    """Of each text: n_runs, the greatest run's four figures, and the digests."""
    numbers: list[int] = []
    fresh, begins = 0, []
    for words in texts:
        begins.append(len(numbers))
        known: dict[bytes, int] = {}
        numbers.extend(known.setdefault(w, fresh + len(known)) for w in words)
        fresh += len(known) + 1
        numbers.append(fresh - 1)  # an item of its own, so that no run passes the text's end
    start, length, period = runs(np.array(numbers, np.int64))
    cuts = np.searchsorted(start, [*begins, len(numbers)]).tolist()
    for d, words in enumerate(texts):
        lo, hi = cuts[d], cuts[d + 1]
        if lo == hi:
            yield 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
            continue
        s, n, q = (start[lo:hi] - begins[d]).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist()
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start[lo:hi] - begins[d] + period[lo:hi], 1)
        np.add.at(edge, start[lo:hi] - begins[d] + length[lo:hi], -1)
        stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
        best = _greatest(s, n, q)
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q, strict=True))
        collapsed = b" ".join([words[i] for i in stay])
        yield hi - lo, s[best], n[best], q[best], 1000 * n[best] // q[best], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def _blocks(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, total = [], 0
    for words in texts:
        if held and total + len(words) > BLOCK:
            yield held
            held, total = [], 0
        held.append(words)
        total += len(words)
    if held:
        yield held


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli), and digests of all runs and of the words kept.

    A word is dropped if a run holds it beyond the run's first period. plant: texts are first made periodic as their doc_id tells.
    """
    tune(docs.sparkSession)

    def told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            ids = b.column("doc_id").to_pylist()
            words = (planted(t.split(), i) if plant else t.split() for t, i in zip(raw_texts(b.column("text")), ids, strict=True))  # bytes.split() cuts at 20 and 09-0D alone
            rows = [r for block in _blocks(words) for r in _told(block)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *FIELDS])

    return docs.select("doc_id", "text").mapInArrow(told, COLUMNS)
