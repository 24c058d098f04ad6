"""Blocks of vectors: their number stays the same as the table grows, and sums by parts of a tile equal plain ones."""

import numpy as np
import pytest

from corpusloom.operators import hierarchy, tiles


def test_rows_moved_grow_with_the_table(spark):
    moved = {}
    for n in (30_000, 60_000, 120_000):
        rows = spark.range(n).selectExpr("id", "0 AS g", "array(1.0D) AS v")
        moved[n] = tiles._pairs_of_blocks(rows, "g", tiles.block_rows(rows))[0].count() / n
    assert moved[120_000] == pytest.approx(moved[30_000], rel=0.05)
    wide = spark.range(4).selectExpr("id", "array_repeat(1.0D, 4096) AS v")
    assert tiles.block_rows(wide) == tiles.ROWS and tiles.block_rows(wide.limit(0)) == tiles.ROWS
    assert tiles.block_rows(spark.range(1_000_000).selectExpr("id", "array(1.0D) AS v"), hierarchy.MOST) == hierarchy.MOST


def test_distances_by_parts_of_a_tile(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 50)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(41, 3))
    df = spark.createDataFrame([(i, 2000 + i % 2, 0, v[i].tolist()) for i in range(41)], "id long, year long, replicate int, v array<double>")
    got = {(r.ya, r.yb, r.dim): (r.pairs, r.total) for r in tiles.distance_cube(df, "year", (1, 3)).collect()}
    for dim in (1, 3):
        d = np.sqrt(((v[:, None, :dim] - v[None, :, :dim]) ** 2).sum(axis=2))
        for a, b in ((0, 0), (0, 1), (1, 1)):
            pairs, total = got[2000 + a, 2000 + b, dim]
            part = d[a::2, b::2]
            assert pairs == part.size and total == pytest.approx(part.sum())
