"""Whitening: factors and components against NumPy, exact sums against Python integers, odd rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from wiregrain.llm import whitening as W
from wiregrain.session import Scratch


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (6, 6), (12, 5), (40, 40)])
def test_factor_and_rotations_equal_numpy(d, rank):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, rank)) * np.exp(rng.normal(size=rank) * 1.5)
    matrix = half @ half.T
    factor, order = W.cholesky(matrix)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, matrix[np.ix_(order, order)])
    assert np.allclose(np.triu(factor[:rank], 1), 0)
    turned = W.jacobi(factor)
    norms = (turned * turned).sum(axis=0)
    assert np.allclose(norms, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-9)
    unit = turned / np.sqrt(norms)
    assert np.abs(unit.T @ unit - np.eye(rank)).max() < 1e-12


def brute(vectors):
    """Whole vectors, covariance by fractions, components by NumPy."""
    whole = {}
    for i, v in vectors:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            whole[i] = [math.floor(256 * c) for c in v]
    fit = sorted(set(map(tuple, whole.values())))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    d = len(sums)
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, columns = np.linalg.eigh(cov)
    return whole, n, sums, mean, values[::-1], columns[:, ::-1]


def compare(found, vectors, most=4):
    whole, n, sums, mean, values, columns = brute(vectors)
    k = min(most, int((values > 1e-10 * max(values)).sum()))
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, c + 1) for i in whole for c in range(k))
    sign = {}
    for r in found:
        x = whole[r.vec_id]
        c = r.component - 1
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        expected = float(np.array([float(a - m) for a, m in zip(x, mean, strict=True)]) @ columns[:, c] / np.sqrt(values[c]))
        if abs(expected) > 1e-6:
            assert sign.setdefault(c, np.sign(expected * r.whitened)) == np.sign(expected * r.whitened)
        assert abs(abs(r.whitened) - abs(expected)) < 1e-8
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_whitened_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 7)) @ np.diag([9, 5, 3, 2, 1, 0.5, 0.1]) + np.array([1e5, 0, -3, 0, 0, 7, 1e-3])
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(100 + i, vectors[0][1]) for i in range(30)]
    vectors += [(200, None), (201, [None] * 7), (202, [float("nan")] * 7), (203, [float("inf"), *[0.0] * 6]), (204, [-0.0] * 7)]
    rows = spark.createDataFrame([(i, v, "clash", 1) for i, v in vectors], "vec_id long, embedding array<double>, x string, key int").repartition(4)
    with Scratch(spark) as scratch:
        compare(W.whiten(rows, scratch).collect(), vectors)


def test_large_entries_stay_exact(spark):
    vectors = [(i, [float(2**40 + i * i), float(-(2**39) - 3 * i), float(i % 3)]) for i in range(9)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    with Scratch(spark) as scratch:
        compare(W.whiten(rows, scratch).collect(), vectors)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    with Scratch(spark) as scratch:
        run = lambda rows: W.whiten(make(rows), scratch).collect()
        assert run([]) == [] and run([(1, None), (2, [])]) == [] and run([(1, [1.0, 2.0])] * 3) == []
        # On one line: one component. The vector of another length is dropped; rows without an id stay.
        found = run([(1, [0.0, 0.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [5.0])])
        assert sorted((str(r.vec_id), r.component, round(abs(r.whitened), 9), r.explained) for r in found) == [("1", 1, 1.0, 1.0), ("2", 1, 1.0, 1.0), ("None", 1, 1.0, 1.0)]


def test_query_on_whole_table(spark):
    from wiregrain.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, folder).collect(), rows)
