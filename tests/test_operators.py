"""Closed forms, planted signals, edges of windows, missing values and reconciliation."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import describe, graph, kernels, quality_flags, resolve, windows
from corpusloom.sources import contracts, paged, readers, sinks
from corpusloom.streaming import incremental


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("https://doi.org/10.1/AB", "10.1/ab"), ("http://dx.doi.org/10.1/x", "10.1/x"), ("DOI: 10.1/Y ", "10.1/y"), ("10.1/z", "10.1/z"), (None, None)])
def test_doi(spark, raw, want):
    assert one(spark, T.norm_doi(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("L'Été, à Paris!", "lété à paris"), ("A  b\tc", "a b c"), ("", ""), ("x_y-z", "x_yz")])
def test_title(spark, raw, want):
    assert one(spark, T.norm_title(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("eng", "en"), ("pt-BR", "pt"), (" French ", "fr"), ("xx", None), ("", None), (None, None), ("zh_CN", "zh")])
def test_language(spark, raw, want):
    assert one(spark, T.norm_language(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("n", "want"), [(0, []), (3, ["aaa"]), (10, ["a" * 10]), (11, ["a" * 10, "a" * 3]), (18, ["a" * 10, "a" * 10])])
def test_chunks(spark, n, want):
    assert one(spark, T.chunks(F.col("c"), 10, 2), c="a" * n) == want


def test_concentration_of_one_venue_and_of_equal_venues(spark):
    df = spark.createDataFrame([(2000, "a")] * 4 + [(2001, v) for v in "abcd"] + [(2002, None), (None, "a"), (2003, " ")], "year int, venue string")
    got = {r.year: r for r in describe.concentration(df, "year", "venue").collect()}
    assert set(got) == {2000, 2001}
    assert (got[2000].hhi, got[2000].shannon_entropy) == (1.0, 0.0)
    assert got[2001].hhi == 0.25 and got[2001].shannon_entropy == pytest.approx(math.log(4), abs=1e-6)


def test_flags_are_never_null(spark):
    df = spark.createDataFrame([(None, None, None, None), ("", "", "", 2000), ("Report on the sea", None, "x" * 60, None), ("noise", "a", "x" * 60, 2000)], "title string, author string, abstract string, year int")
    c = F.col
    got = df.select(
        quality_flags.missing_metadata(c("title"), c("author"), c("year"), ["report"]).alias("a"), quality_flags.no_abstract(c("abstract"), c("title"), ["report"]).alias("b"),
        quality_flags.blacklisted(c("title"), ["noise"], ["report"], ["index"]).alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (True, True, False), (False, False, False), (False, False, True)]


def test_floor_overrides_protection(spark):
    df = spark.createDataFrame([(True, True, 1950), (True, False, 2000), (True, True, 2000), (False, False, None)], "f boolean, p boolean, y int")
    got = [r.x for r in df.select(quality_flags.policy(F.col("f"), F.col("p"), F.col("y"), 1960).alias("x")).collect()]
    assert got == ["remove", "remove", "keep", "keep"]


def test_merge_reconciles(spark):
    rows = [(1, "10.1/a", "T", 2000, None, 5, 1), (2, "10.1/a", "t!", 2001, "A", 9, 0), (3, None, "Same", 1999, "B", 1, 0), (4, None, "same", 1999, None, 2, 0), (5, None, "", None, None, 1, 0), (6, None, "Same", 2000, None, 0, 0)]
    df = spark.createDataFrame(rows, "id long, doi string, title string, year int, author string, cited int, rank int")
    got = {r.merge_key: r for r in resolve.two_pass(df, "doi", "title", "year", F.struct("rank", "id"), ["title", "author"], ["cited"]).collect()}
    assert set(got) == {"d:10.1/a", "t:same|1999", "t:same|2000"}
    assert (got["d:10.1/a"].title, got["d:10.1/a"].author, got["d:10.1/a"].cited) == ("t!", "A", 9)
    dropped = df.count() - sum(r.n for r in got.values())
    assert sum(r.n - 1 for r in got.values()) + dropped + len(got) == df.count()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 30), (7, 8), (8, 6), (6, 5), (5, 4)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_leave_out_the_anchor(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2011)], "year long")
    got = windows.sliding_pairs(df, "year", [2]).collect()
    assert {r.anchor for r in got} == {*range(2002, 2008)}  # the upper end is exclusive
    assert {(r.year, r.side) for r in got if r.anchor == 2005} == {(2003, "before"), (2004, "before"), (2006, "after"), (2007, "after")}
    assert {r.year for r in windows.sliding_pairs(df, "year", [3], gap=2).collect() if r.anchor == 2005} == {2002, 2003, 2007, 2008}


def test_interpolation_and_trim(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in enumerate([None, 1.0, None, None, 4.0, None])] + [("b", 0, None)], "k string, year int, v double")
    got = {(r.k, r.year): r.v for r in windows.interpolate(df, "year", "v", "k").collect()}
    assert [got["a", i] for i in range(6)] == [1, 1, 2, 3, 4, 4] and got["b", 0] is None
    df = spark.createDataFrame([("a", float(v)) for v in range(10)] + [("b", 1.0), ("b", 3.0)], "k string, v double")
    assert {r.k: (r.lo, r.hi, r.median) for r in windows.trimmed(df, "v", 2, "k").collect()} == {"a": (2, 7, 4.5), "b": (1, 3, 2)}


def test_supported_peaks_keep_their_distance(spark):
    df = spark.createDataFrame([(2000, "a"), (2001, "b"), (2002, "a"), (2005, "a"), (2006, "b"), (2010, "a")], "year long, kind string")
    assert {(r.year, r.n) for r in windows.supported(df, "year", "kind", 1, 2).collect()} == {(2000, 2), (2002, 2), (2005, 2)}


def pairs(spark, shift, n=60):
    rng = np.random.default_rng(1)
    rows = [(2000, 1, s, i, (rng.normal(size=4) + (shift if s == "after" else 0)).tolist()) for s in ("before", "after") for i in range(n)]
    return spark.createDataFrame(rows, "anchor long, window int, side string, id long, v array<double>")


def test_planted_shift(spark):
    same, moved = pairs(spark, 0.0), pairs(spark, 1.5)
    for kernel, low, high in ((kernels.frechet, 0.6, 4), (kernels.energy, 0.2, 1), (kernels.two_sample_auc, 0.65, 0.9)):
        assert kernels.by_pair(same, "v", kernel).first().value < low
        assert kernels.by_pair(moved, "v", kernel).first().value > high
    assert kernels.permutation_energy(moved, "v", 100).first().p_value == 0
    assert abs(kernels.permutation_energy(same, "v", 100).first().z_score) < 3
    boot = [r.value for r in kernels.bootstrap(moved, "v", kernels.energy, 20).collect()]
    assert len(boot) == 20 and min(boot) > 0.5


def test_frechet_of_shifted_copies():
    x = np.random.default_rng(2).normal(size=(200, 3))
    assert kernels.frechet(x, x + 2.0) == pytest.approx(12, rel=1e-3)


def test_graph_kernels():
    star = np.zeros((6, 6))
    star[1:, 0] = 1
    assert kernels.rank_histogram(star).sum() == pytest.approx(1) and kernels.rank_histogram(star).argmax() == 0
    assert kernels.spectral_gap(star) == pytest.approx(1)
    assert kernels.betweenness(star) == pytest.approx(1 / 6)
    assert math.isnan(kernels.power_law(star))


def test_louvain_finds_cliques():
    e = [(a, b, 1) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 10, 1)]
    got = kernels.louvain(pd.DataFrame(e, columns=["a", "b", "n"]))
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_rewiring_keeps_degrees():
    rng = np.random.default_rng(3)
    e = np.array(sorted({tuple(sorted(x)) for x in rng.integers(0, 20, (60, 2)).tolist() if x[0] != x[1]}))
    r = kernels.rewire(e, 500, rng)
    assert (np.bincount(e.ravel(), minlength=20) == np.bincount(r.ravel(), minlength=20)).all()
    assert len({tuple(sorted(x)) for x in r.tolist()}) == len(e) and (r[:, 0] != r[:, 1]).all()
    assert {tuple(sorted(x)) for x in r.tolist()} != {tuple(x) for x in e.tolist()}


def test_change_points():
    y = np.r_[np.zeros(10), np.full(10, 5.0), np.full(10, 1.0)] + np.random.default_rng(1).normal(0, 0.1, 30)
    assert kernels.best_splits(y, 2) == [10, 20]
    assert kernels.penalised_splits(y, 3.0) == [10, 20]
    assert kernels.penalised_splits(np.zeros(12), 1.0) == []


def test_dip():
    rng = np.random.default_rng(4)
    one_, two = rng.normal(size=200), np.r_[rng.normal(-4, 1, 100), rng.normal(4, 1, 100)]
    assert kernels.dip(two) > 2 * kernels.dip(one_) > 0


def test_quotas():
    rows = pd.DataFrame({"id": range(10), "s": range(10, 0, -1), "q": [False] * 7 + [True] * 3})
    got = kernels.quota_selection(rows, 4, {"q": 2}, "s", "id")
    assert got["id"].tolist() == [0, 1, 7, 8]


def test_auc_of_ties_and_of_order(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (0, False)], "s int, p boolean")
    assert describe.auc(df, "s", "p").first().auc == pytest.approx(0.875)


def test_contract(spark):
    good = spark.createDataFrame([(2000, 0.5, 1.0, 3, 9)], "year int, hhi double, shannon_entropy double, n_venues int, n_papers int")
    assert contracts.validate(good, contracts.CONCENTRATION).dtypes[0] == ("year", "bigint")
    bad = good.union(good).withColumn("hhi", F.lit(2.0)).withColumn("more", F.lit(1))
    assert {r.rule: r.n for r in contracts.violations(bad, contracts.CONCENTRATION).collect()} == {"surplus more": 1, "check hhi": 2, "unique year": 1}
    with pytest.raises(ValueError, match="check hhi: 2"):
        contracts.validate(bad, contracts.CONCENTRATION)


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "grey_works.csv").write_text('title,abstract\n"A, ""quoted""","two\nlines"\nB,\n')
    got = readers.read_csv(spark, [f"file://{tmp_path}/grey_works.csv"], ["title", "abstract"]).collect()
    assert [tuple(r) for r in got] == [('A, "quoted"', "two\nlines", "grey"), ("B", None, "grey")]


def test_pool_and_broken_lines(spark, tmp_path):
    path = f"file://{tmp_path}/pool"
    sinks.append_pool(spark.createDataFrame([(1, "a")], "id long, t string"), path)
    sinks.append_pool(spark.createDataFrame([(2, "b")], "id long, t string"), path)
    (tmp_path / "pool" / "broken.json").write_text('{"id": 3, "t": "c"}\n{oops\n')
    pool = readers.read_jsonl(spark, path, "id long, t string")
    assert {(r.id, r.t) for r in pool.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert [r.id for r in sinks.new_only(spark.createDataFrame([(1,), (9,)], "id long"), pool, "id").collect()] == [9]


def test_ris_file(spark, tmp_path):
    (tmp_path / "x.ris").write_text("TY  - JOUR\nTI  - One\nAU  - A, B\nAU  - C\nPY  - 2001\nER  - \n\nTY  - BOOK\nT1  - Two\nER  - \n")
    assert [(r.title, r.authors, r.year) for r in readers.read_ris(spark, f"file://{tmp_path}/x.ris").collect()] == [("One", "A, B ; C", "2001"), ("Two", "", None)]


def test_paged_source(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"results": [{"id": i, "title": f"t{i}"}, {"id": -i}]}))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(path=str(tmp_path), pages="2", fields="id,title").load()
    assert {tuple(r) for r in df.collect()} == {("1", "t1"), ("-1", None), ("2", "t2"), ("-2", None)}


def test_polite_retries_and_breaker():
    waits, calls = [], iter([OSError(), OSError(), b"ok"])

    def get():
        x = next(calls)
        if isinstance(x, OSError):
            raise x
        return x

    assert paged.polite(get, sleep=waits.append) == b"ok" and len(waits) == 2 and waits[1] > waits[0]
    with pytest.raises(OSError):
        paged.polite(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)
    b = paged.Breaker(2)
    b.saw(True)
    assert not b.open
    b.saw(True)
    assert b.open
    b.saw(False)
    assert not b.open


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert sinks.markdown(df) == "| x | y |\n| --- | --- |\n| a\\|b |  |"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(3), 2)


def test_stream_merges_by_batch(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1, "2024-01-01 00:00:00"), ("d1", 5, "2024-01-01 01:00:00"), ("d2", 2, "2024-01-01 02:00:00")], "doi string, cited int, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = incremental.merge_batches(stream, lambda b: b.groupBy("doi").agg(F.max("cited").alias("cited")), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    q.awaitTermination()
    assert {(r.doi, r.cited) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {("d1", 5), ("d2", 2)}
    first = incremental.drain(spark, incremental.first_seen(stream, "doi", "t", "1 day"), "first_seen_test", f"file://{tmp_path}/c2", "append")
    assert first.count() == 2


def test_permutation_of_words(spark):
    x, y = np.array([[1.0, 0], [1, 0]]), np.array([[0, 1.0], [0, 1]])
    assert kernels.mean_js(x, y) == pytest.approx(math.sqrt(math.log(2)), rel=1e-6) and kernels.mean_js(x, x) == 0
    got = kernels.permutation(pairs(spark, 2.0, 30), "v", kernels.frechet, 30).first()
    assert got.p_value == 0 and got.z_score > 5


def test_graph_permutation(spark):
    rows = [(2000, 1, "before", s, 100) for s in range(20)] + [(2000, 1, "after", 50 + s, 200 + s % 7) for s in range(20)]
    got = kernels.graph_permutation(spark.createDataFrame(rows, "anchor long, window int, side string, src long, ref long"), kernels.degree_entropy, 30).first()
    assert got.null_std is None or got.null_std >= 0


def test_density_clusters(spark):
    from corpusloom.operators import clusters

    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(scale=0.05, size=3) + (0 if i < 20 else 5)).tolist()) for i in range(40)] + [(99, [50.0, 50.0, 50.0])]
    got = {r.id: r.cluster for r in clusters.density(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.5, 4).collect()}
    assert len({got[i] for i in range(20)}) == 1 and len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[30] and got[99] is None
