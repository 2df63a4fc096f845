"""Whitening, held against an eigendecomposition of the covariance from exact sums."""

from fractions import Fraction

import numpy as np
import pytest

from lexiforge.llm import whitening
from tests.llm import cases


def grid(v):
    return tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)


def brute(vectors, most=16):
    """Per x-vector: n, deviation, and its projections, by whole-number covariances n^2 V."""
    fit = sorted(set(map(grid, vectors)))
    n, x = len(fit), np.array(fit, object)
    sums = x.sum(axis=0)
    centred = n * x - sums
    cov = (centred.T @ centred).astype(float) / float(n) ** 3
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    return n, sums, values, turn, float(np.trace(cov))


def check(spark, vectors, rows=None):
    docs = spark.createDataFrame(rows or list(enumerate(vectors)), "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "'k' AS key", "'v' AS vector")
    made = whitening.whiten(docs.repartition(3)).collect()
    good = [v for v in vectors if v]
    n, sums, values, turn, trace = brute(good)
    assert len(made) == len(good) * len(values) and all(r.n == n for r in made)
    own = {}
    for r in made:
        own.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for vec_id, v in rows or enumerate(vectors):
        if vec_id not in own:
            continue
        x = np.array(grid(v), object)
        centred = n * x - sums
        assert all(r.deviation == int((centred * centred).sum()) for r in own[vec_id].values())
        expected = (centred.astype(float) / n) @ turn / np.sqrt(values)
        for k, e in enumerate(expected, 1):
            r = own[vec_id][k]
            if abs(e) > 1e-3:
                sign = signs.setdefault(k, np.sign(e * r.whitened))
                assert np.sign(e * r.whitened) == sign
            assert abs(abs(r.whitened) - abs(e)) < 1e-6 * max(1, abs(e))
            assert abs(r.explained - values[k - 1] / trace) <= 1e-9 and r.identity_error < 1e-9
    return made


def test_flat_spectrum_goes_to_the_full_dimension(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(v) for v in row] for row in rng.standard_normal((400, 40)) / 3]
    check(spark, vectors + vectors[:50])


def test_steep_spectrum_stays_narrow(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    scale = np.array([40 * 0.7**i for i in range(20)] + [1e-9] * 60)
    x = np.round(rng.standard_normal((600, 80)) * scale @ turn * 1e6)
    fit = spark.createDataFrame([([int(v) for v in r],) for r in x], "x array<long>")
    found = whitening.components(fit, 80, most=6, oversample=18, passes=8)
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    assert np.allclose(found.values, values[::-1][:6], rtol=1e-12)
    assert np.allclose(np.abs((found.vectors * vectors[:, ::-1][:, :6]).sum(axis=0)), 1, atol=1e-12)
    assert found.passes <= 9 and whitening.identity_error(fit, found) < 1e-9


def test_documents_table(spark):
    rows = spark.read.parquet(f"{cases.SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(spark, [list(r.embedding) for r in rows], [(r.vec_id, list(r.embedding)) for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(v) for v in row] for row in rng.standard_normal((30, 4))]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None, 1.0, 1.0], [nan, 1.0, 1.0, 1.0], [1.0, inf, 1.0, 1.0], [1.0, 1.0], [1e30, 0.0, 0.0, 0.0]]
    rows = list(enumerate(vectors)) + [(1000 + i, v) for i, v in enumerate(odd)] + [(2000, vectors[0])]
    check(spark, vectors + [vectors[0]], rows)
    null = spark.createDataFrame([(None, v) for v in vectors], "vec_id long, embedding array<float>")
    assert whitening.whiten(null).where("vec_id IS NULL").count() == 30 * 4


def test_no_variance_and_rank(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    made = whitening.whiten(same).collect()
    assert len(made) == 10 and all(r.whitened is None and r.explained is None and r.n == 1 and r.deviation == 0 for r in made)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    made = whitening.whiten(line).collect()
    assert {r.component for r in made if r.whitened is not None} == {1} and made[0].identity_error < 1e-12
    for schema in ("vec_id long, embedding array<float>", "vec_id int, embedding array<double>"):
        assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_sums_beyond_64_bits():
    at = whitening.Centre(10**10, np.array([10**16 * 7, 5 * 10**16], object))
    x = np.array([[10_000_000, -3]], np.int64)
    exact = [10**10 * 10_000_000 - 7 * 10**16, -3 * 10**10 - 5 * 10**16]
    assert at.deviations(x) == [sum(v * v for v in exact)]
    assert at.rows(x)[0].tolist() == [float(Fraction(v, 10**10)) for v in exact]
