from math import prod

import numpy as np
import pytest

from parcelweave.llm import whitening


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")


def whole(vectors):
    return np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors])


def test_primes_and_remainders():
    bound = 10**40
    moduli = whitening.primes(bound)
    assert prod(moduli) > bound and len(set(moduli)) == len(moduli) and all(all(p % q for q in range(2, 2000)) for p in moduli)
    values = np.array([[bound // 3, -bound // 3], [0, -1]], object)
    residues = np.array([[[int(v) % p for v in row] for row in values] for p in moduli], object)
    assert (whitening.reconstructed(residues, moduli) == values).all()


@pytest.mark.parametrize("far", [1, 10**6])
def test_scatter_is_exact(spark, far):
    r = np.random.default_rng(far)
    x = r.integers(-1000 * far, 1000 * far, (3000, 5))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(5)
    n, sums, lo, hi = whitening._sums(fit)
    assert (n, sums, lo, hi) == (3000, x.sum(0).tolist(), x.min(0).tolist(), x.max(0).tolist())
    y = n * x.astype(object) - np.array(sums, object)
    assert (whitening.scatter(fit, n, sums, int(abs(y).max())) == y.T.dot(y)).all()


def test_against_numpy(spark):
    r = np.random.default_rng(3)
    v = (r.normal(size=(300, 20)) @ r.normal(size=(20, 20))).round(3)
    rows = [*v, *v[:50], v[0], None, [], [None, *v[1][1:]], [float("nan"), *v[1][1:]], [float("inf"), *v[1][1:]], v[0][:7]]
    got = whitening.whiten(table(spark, rows, ids=[*range(299), None, *range(1000, 1000 + len(rows) - 300)])).toPandas()
    x = whole([*v, *v[:50], v[0]])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = ((x - fit.mean(0)) @ vectors[:, :16]) / np.sqrt(values[:16])
    assert len(got) == 16 * len(x) and (got.n == n).all() and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert got.vec_id.isna().sum() == 16
    by = got[got.vec_id == 7].sort_values("component")
    assert np.allclose(np.abs(by.whitened), np.abs(want[7]), atol=1e-8) and np.allclose(by.explained, values[:16] / values.sum(), rtol=1e-9)
    assert set(by.deviation) == {int(((n * x[7] - sums) ** 2).sum())}
    signs = np.sign(by.whitened.to_numpy() * want[7])
    other = got[got.vec_id == 1000].sort_values("component")  # the same signs for all rows; a copy gets the same values
    assert np.allclose(other.whitened * signs, want[300], atol=1e-8) and np.allclose(want[300], want[0])


def test_components_without_variance(spark):
    got = whitening.whiten(table(spark, [[1, 2, 5], [2, 4, 5], [3, 6, 5], [3, 6, 5]])).toPandas()
    assert got.component.tolist() == [1] * 4 and got.identity_error.max() < 1e-12 and abs(got.explained[0] - 1) < 1e-12
    assert whitening.whiten(table(spark, [[1, 2], [1, 2]])).count() == 0


def test_nothing_left(spark):
    got = whitening.whiten(table(spark, [None, [None], []]))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [None]).limit(0)).count() == 0


def test_one_common_vector_counts_once(spark):
    got = whitening.whiten(table(spark, [[0, 1]] * 500 + [[1, 0], [2, 5]])).toPandas()
    assert (got.n == 3).all() and len(got) == 502 * 2
