import numpy as np
import pytest

from pricegrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, z long, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def whole(v):
    return np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(int) + 100_000


def spectrum(x):
    """Covariance and its eigenvectors by LAPACK, largest variance first."""
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return centred, values[::-1], vectors[:, ::-1]


def test_components_equal_a_numerical_eigensolver(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) / 5).astype(np.float32)
    out, found = whitening.whiten(table(spark, [(i, r.tolist()) for i, r in enumerate(v)]))
    x = whole(v)
    centred, values, vectors = spectrum(x.astype(float))
    rows = {r["vec_id"]: r for r in out.collect()}
    assert found.n == 300 and len(rows) == 300
    sums = x.sum(axis=0)
    for i in range(300):
        assert rows[i]["deviation"] == int(((300 * x[i] - sums) ** 2).sum())
        for k in range(8):
            z = centred[i] @ vectors[:, k] / values[k] ** 0.5
            assert abs(abs(rows[i]["z"][k]) - abs(z)) < 1e-8
    assert np.allclose(found.shares, values[:8] / values.sum(), rtol=1e-10)
    assert whitening.identity_error(out, 8) < 1e-10


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 7):
        a = rng.integers(-9, 9, (d, d))
        m = (a.T @ a).tolist()
        c = whitening.characteristic_polynomial(spark, m)
        # det(x I - m) at more places than the degree
        for x in range(d + 2):
            minor = [[x * (i == j) - m[i][j] for j in range(d)] for i in range(d)]
            assert sum(v * x**k for k, v in enumerate(c)) == round(np.linalg.det(np.array(minor, float)))
    # (x - 9)(x - 5)^4 x: whole roots, one of them four times, and one that is zero
    c = np.round(np.poly([9, 5, 5, 5, 5, 0]))[::-1].astype(int).tolist()
    roots = [(a / (1 << s), n) for a, s, n in whitening.largest_roots(c, 8)]
    assert roots == [(9.0, 1), (pytest.approx(5, abs=1e-50), 4)]
    assert [whitening.roots_above(c, a, 1) for a in (-1, 0, 9, 10, 17, 18)] == [6, 5, 5, 1, 1, 0]


def test_equal_variances_give_orthonormal_vectors():
    m = [[5 * (i == j) for j in range(6)] for i in range(6)]
    m[0][0] = 9
    v = np.array(whitening.null_vectors(m, 5, 0, 5))
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-14) and np.allclose(v[:, 0], 0)


def test_unusable_vectors_are_dropped_and_the_rest_pass_through(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (6, [-inf, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-0.0001, 3.0])]
    out, found = whitening.whiten(table(spark, rows))
    ids = sorted((r["vec_id"] or 0) for r in out.collect())
    assert found.n == 4 and ids == [0, 1, 1, 9] and len(found.shares) == 2
    assert found.sums == (whole([[0.5, 1.0], [0.5, 1.0], [0.25, -1.0], [-0.0001, 3.0]]).sum(axis=0) - 400_000).tolist()


def test_tables_without_variance_or_rows(spark):
    out, found = whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)]))
    assert found.shares == [] and [r["z"] for r in out.collect()] == [[]] * 5
    assert {r["deviation"] for r in out.collect()} == {0}
    out, found = whitening.whiten(table(spark, []))
    assert out.count() == 0 and found.n == 0
    assert whitening.identity_error(out, 0) is None


def test_entries_beyond_doubles_stay_exact(spark):
    rows = [(0, [1e12, 1.0]), (1, [-1e12, 2.0]), (2, [3e11, 0.5]), (3, [1e30, 0.0])]
    out, found = whitening.whiten(table(spark, rows))
    x = [[max(-(1 << 61), min(1 << 61, int(np.floor(1024 * float(np.float32(c)))))) for c in v] for _, v in rows]
    assert found.sums == [sum(r[k] for r in x) for k in (0, 1)]
    assert all(r["deviation"] is None for r in out.collect())
    assert whitening.identity_error(out, 2) < 1e-6
