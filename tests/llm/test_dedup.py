"""Exact, near and line deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import bloom, exact_dedup, line_dedup, minhash, queries
from tests.llm.conftest import ROWS


def lower(t):
    return (t or "").encode().lower()


def exact_by_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return Counter((i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], hashlib.sha256(lower(t)).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("size", [1, 16])
def test_exact(odd, size):
    got = exact_dedup.exact_dedup(odd, size).collect()
    assert Counter(map(tuple, got)) == exact_by_force(ROWS)


def test_exact_digests_that_collide_are_lengthened(spark):
    rows = [(i, f"text number {i % 300} " * 30) for i in range(600)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert Counter(map(tuple, got)) == exact_by_force(rows)


def test_chunks_depend_on_the_text_alone():
    rng = np.random.default_rng(1)
    texts = [rng.bytes(n) for n in (0, 1, 511, 513, 40_000, 7)] + [b"a" * 100_000]
    alone = [next(exact_dedup._chunks([t])) for t in texts]
    assert alone == list(exact_dedup._chunks(texts))
    assert [b"".join(c) for c in alone] == texts
    assert all(len(c) <= exact_dedup.MOST for cs in alone for c in cs)


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = lower(t).split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def near_by_force(rows, percent=85):
    sets = sets_of(rows)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i in sorted(sets):
        both = Counter(j for x in sets[i] for j in by[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for x in sets[i]:
            by[x].append(i)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_near_on_the_table(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_minhash(spark, sf).collect()}
    assert got == near_by_force(documents)


def test_near_odd_rows(odd):
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == near_by_force(rows)


@pytest.mark.parametrize("members", [4, 256])
def test_near_group_whose_first_member_is_not_its_centre(spark, members, monkeypatch):
    """A chain: each text resembles the next, the ends don't resemble each other; and a star around a late centre."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"x{j}" for j in range(2 * i)] + base[2 * i :])) for i in range(14)]
    for i in range(14):  # two words changed each
        w = list(base)
        w[8 * i % 110] = w[(8 * i + 3) % 110] = f"y{i}"
        rows.append((100 + i, " ".join(w).replace("w", "s")))
    rows.append((200, " ".join(base).replace("w", "s")))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near_by_force(rows)


def test_near_estimate_follows_similarity(spark):
    from pyspark.sql import functions as F

    w = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join(w[40:])), (3, " ".join(w[200:])), (4, " ".join(f"v{i}" for i in range(400)))]
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    (out,) = minhash.signatures(iter([b]))
    df = spark.createDataFrame([(x["signature"], out.to_pylist()[0]["signature"]) for x in out.to_pylist()], "a array<long>, b array<long>")
    got = [r.e for r in df.select(minhash.estimate(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got[0] == 1 and abs(got[1] - 0.9) < 0.1 and abs(got[2] - 0.5) < 0.15 and abs(got[3]) < 0.1


def lines_by_force(rows, least=40, documents=5):
    space = b"\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda x: x.strip(space).lower()
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            if i is not None and len(key(x).decode()) >= least:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < documents or i == max(held[key(x)])]
        out.append((i, b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_lines(spark, odd):
    assert Counter(map(tuple, line_dedup.dedup_lines(odd).collect())) == lines_by_force(ROWS)
    shared = "  Ünïcode line that many documents share, forty points or more\t"
    rows = [(i, f"own {i}\n{shared}\n{shared.upper() if i % 2 else shared}\n\nshort") for i in range(7)] + [(7, None), (8, shared), (8, shared), (None, shared), (9, "é" * 39), (10, "é" * 40)]
    rows += [(20 + i, "é" * (39 + i % 2)) for i in range(12)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == lines_by_force(rows)


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.fixture
def no_whole_filter(monkeypatch):
    """As on an input that no filter of bounded size can serve."""
    monkeypatch.setattr(bloom, "MOST_BITS", 0)
    monkeypatch.setattr(bloom, "LEAST_BITS", 1 << 18)


def test_exact_beyond_the_filter(no_whole_filter, odd):
    for size in (1, 16):
        assert Counter(map(tuple, exact_dedup.exact_dedup(odd, size).collect())) == exact_by_force(ROWS)


def test_near_beyond_the_filter(no_whole_filter, odd):
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = minhash.near_duplicates(odd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == near_by_force(rows)


def test_lines_beyond_the_filter(no_whole_filter, spark, odd, sf, documents, monkeypatch):
    monkeypatch.setattr(bloom, "RANGE", 1 << 6)
    assert Counter(map(tuple, line_dedup.dedup_lines(odd).collect())) == lines_by_force(ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    assert Counter(map(tuple, line_dedup.dedup_lines(docs).collect())) == lines_by_force(documents)


@pytest.mark.parametrize("size", [1 << 12, 1 << 21])
def test_ranges_suspect_repeated_keys_alone(spark, monkeypatch, size):
    monkeypatch.setattr(bloom, "RANGE", size)
    digest = lambda k: hashlib.sha256(str(k).encode()).digest()
    pairs = [(i, digest(i)) for i in range(20000)] + [(i + 1, digest(i)) for i in range(0, 20000, 100)] + [(i, digest("hot")) for i in range(3000)]
    got = bloom.twice_seen(spark.createDataFrame(pairs, "doc_id long, key binary").repartition(6), len(pairs)).collect()
    repeated = {digest(i) for i in range(0, 20000, 100)} | {digest("hot")}
    found = Counter((r.doc_id, bytes(r.key)) for r in got)
    assert all(found[p] == 1 for p in pairs if p[1] in repeated)
    assert sum(bytes(r.key) not in repeated for r in got) < 0.01 * len(pairs)
    assert bloom.twice_seen(spark.createDataFrame([], "doc_id long, key binary"), 0).count() == 0
