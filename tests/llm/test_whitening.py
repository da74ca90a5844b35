"""Whitening against a plain eigendecomposition with exact integers."""

import numpy as np
import pytest
from mediaops.llm import spectrum, whitening
from pyspark.sql import functions as F


def plain(rows, most=16):
    """{id: (deviation, projections)}, eigenvalue shares and vectors of rows (id, vector)."""
    usable = [(i, [int(np.floor(64.0 * c)) + 1_000_000 for c in v]) for i, v in rows
              if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    off = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
    centred = np.array([off(x) for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), off(x) @ vectors[:, order] / np.sqrt(values[order])) for i, x in usable]
    return out, values[order] / values.sum(), n


def vectors(seed=3, n=400, d=24):
    draw = np.random.Generator(np.random.PCG64(seed))
    data = draw.standard_normal((n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(draw.standard_normal((d, d)))[0]
    return [(i, row.astype(np.float32).astype(float).tolist()) for i, row in enumerate(data)]


def test_whitened_rows(spark):
    rows = vectors()
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(5, rows[9][1]), (None, rows[3][1])]
    odd = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan"), *[0.0] * 23]), (2004, [float("inf"), *[0.0] * 23]), (2005, [1.0, 2.0]), (2006, [1e300] * 24)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("id", "vector", "x", "size", "n", "block")})
    out = whitening.whiten(table.repartition(5)).collect()
    expected, explained, n = plain(rows)
    assert len(out) == 16 * len(rows) and {r.n for r in out} == {n} == {400}
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-10
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.deviation, r.component), []).append(r.whitened)
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
    signs = np.sign([by[(0, expected[0][1], k + 1)][0] * expected[0][2][k] for k in range(16)])
    for i, deviation, projected in expected:
        for k in range(16):
            assert any(abs(v - signs[k] * projected[k]) < 1e-9 for v in by[(i, deviation, k + 1)])


def test_few_rows_and_flat_dimensions(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0, -2.0 * i]) for i in range(6)], schema)).collect()
    assert sorted(r.component for r in line) == [1] * 6 and line[0].identity_error < 1e-10 and abs(line[0].explained - 1) < 1e-12


def test_deviations_beyond_64_bits():
    rows = [[0, 1], [1 << 55, 3], [5, 5]]
    centre = whitening.Centre(3, [sum(c) for c in zip(*rows, strict=True)])
    found = centre.deviations(np.array(rows)).tolist()
    sums = [sum(c) for c in zip(*rows, strict=True)]
    exact = [sum((3 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in rows]
    assert found == [v if v < 1 << 63 else None for v in exact] and found[0] is None


@pytest.mark.parametrize("values", [
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5], [5, 5, 5, 2, 2, 1, 1e-3, 0, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5 + 1e-13, 1e-7, 1e-8, 0, 0, 0],
    [3] * 10, [1e6, 1, 1, 1, 1, 1e-2, 1e-2, 1e-3, 1e-3, 1e-4]])
def test_leading_pairs(values):
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(len(values))).standard_normal((10, 10)))[0]
    matrix = turn * np.array(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, x = spectrum.leading(matrix, 6)
    expected = np.sort(values)[::-1][:6]
    kept = expected[expected > 1e4 * 10 * np.finfo(float).eps * expected[0]]
    assert np.allclose(found, kept, rtol=0, atol=1e-13 * max(values)) and np.allclose(x.T @ x, np.eye(len(kept)), atol=1e-12)
    assert np.abs(matrix @ x - x * found).max() < 1e-12 * max(values)
    for shift in (-1.0, 0.25, 1 - 0.5e-9, 1 - 1.5e-9, 2.5, 5.5, 1e7):
        assert spectrum.above(matrix, shift) == sum(v > shift for v in values)
