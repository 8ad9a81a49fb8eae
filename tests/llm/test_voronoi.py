"""Exact top-k search against a plain loop: clusters, repeated rows and ids, odd vectors, ties, wide numbers and cells that are left out."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import voronoi

KIND = "vec_id long, embedding array<double>, label int, uid string, cell string, n long"


def plain(rows, every, k):
    usable = [(i, [math.floor(1024 * float(v)) for v in e]) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for i, q in usable:
        if i is not None and i % every == 0:
            other = [(-sum(a * b for a, b in zip(q, x)), j is None, j or 0) for j, x in usable if j != i]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(other)[:k])]
    return sorted(out, key=repr)


def found(spark, rows, every=10, k=10, **more):
    df = spark.createDataFrame([(i, e, 1, "x", "y", 2) for i, e in rows], KIND).repartition(3)
    got = voronoi.top_k(df, F.col("vec_id") % every == 0, k, **more).collect()
    return sorted([tuple(r) for r in got], key=repr)


def clusters(n, dim, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), (centres[i % 6] * (1 + i % 3) + noise * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_clusters_and_odd_rows(spark):
    rows = clusters(600, 8, 0.05, 1)
    rows += [(1000 + i, rows[10][1]) for i in range(40)]  # ties
    rows += [(20, rows[20][1])] * 3 + [(21, rows[21][1])] * 3 + [(50, rows[7][1])]  # repeated rows, ids with two vectors
    rows += [(2000, None), (2010, []), (2020, [1.0, None] + [0.0] * 6), (2030, [math.nan] * 8), (2040, [math.inf] * 8), (2050, [0.0] * 8), (2060, [1.0, 2.0]), (None, rows[3][1]), (None, rows[3][1])]
    assert found(spark, rows, cell=20, piece_bytes=16 * 64) == plain(rows, 10, 10)


def test_few_rows_wide_numbers_and_nothing(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1.0]), (2, [-1e6, 5e5]), (10, [3.0, 4.0])]
    assert found(spark, rows) == plain(rows, 10, 10)
    assert found(spark, []) == [] and found(spark, [(10, [1.0])]) == [] and found(spark, [(3, [1.0]), (None, [1.0])]) == []


def test_bounds_leave_out_cells_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = 4096 * rng.normal(size=(12, 16))
    x = np.floor(np.concatenate([c + 20 * rng.normal(size=(50, 16)) for c in centres]))
    pivots = x[::50]
    cell, away = voronoi.nearest(x, pivots)
    least = np.stack([np.sort(np.r_[away[cell == c], np.full(11, np.inf)])[:11] for c in range(12)])
    radius = np.array([away[cell == c].max() for c in range(12)])
    cells = voronoi.Cells(pivots, radius, least, np.ones(12, dtype=int), radius)
    left = cells.left(x) & cells.needed[cell]
    best = np.argsort(-(x @ x.T), axis=1)[:, :11]
    assert left[np.arange(len(x))[:, None], cell[best]].all() and left.mean() < 0.3


def test_sums_beyond_doubles_are_exact():
    q, x = np.array([[2.0**52, 1.0, 3.0]]), np.array([[512.0, 1.0, 1.0], [512.0, 0.0, 1.0]])
    assert voronoi.scores(q, x).tolist() == [[2**61 + 4, 2**61 + 3]]
    row, col = voronoi.best(voronoi.scores(q, x), np.array([7]), np.array([1, 2]), 1)
    assert col.tolist() == [0]
    with pytest.raises(OverflowError):
        voronoi.scores(np.array([[2.0**60]]), np.array([[2.0**10]]))
    assert voronoi.integers(pa.array([[0.5], [1.0, -0.0001]]), 2).tolist() == [[512, 0], [1024, -1]]
