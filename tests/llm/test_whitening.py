import math
from fractions import Fraction

import numpy as np
import pytest
from citeflow.llm import queries, whitening


def fixed_matrix(seed, n, d, low):
    r = np.random.default_rng(seed)
    y = (r.integers(-90, 90, (n, low)) @ r.integers(-2, 3, (low, d))).astype(object)
    s = y.sum(axis=0)
    return n * (y.T @ y) - np.outer(s, s)


def determinant(m):
    """By fractions: an independent check of a polynomial's values."""
    m, out = [[Fraction(int(v)) for v in row] for row in m], Fraction(1)
    for k in range(len(m)):
        i = next((i for i in range(k, len(m)) if m[i][k]), None)
        if i is None:
            return 0
        if i != k:
            m[i], m[k], out = m[k], m[i], -out
        out *= m[k][k]
        for j in range(k + 1, len(m)):
            f = m[j][k] / m[k][k]
            m[j] = [a - f * b for a, b in zip(m[j], m[k])]
    return out


@pytest.mark.parametrize("n, d, low", [(30, 5, 5), (12, 7, 3), (9, 1, 1), (3, 6, 6)])
def test_characteristic_polynomial_is_exact(n, d, low):
    m = fixed_matrix(d, n, d, low)
    poly = whitening.characteristic(m)
    for x in (0, 1, -3, 1000):
        assert sum(c * x**k for k, c in enumerate(poly)) == determinant(x * np.eye(d, dtype=object) - m)


def test_repeated_roots_and_zero_roots():
    values = [9, 9, 9, 4, 4, 1, 0, 0]
    m = np.diag(values).astype(object)
    m[[0, 7]] = m[[7, 0]]
    m[:, [0, 7]] = m[:, [7, 0]]
    roots = whitening.positive_roots(whitening.characteristic(m), 36)
    assert [(r / 2**whitening.PLACES, k) for r, k in roots] == [(9, 3), (4, 2), (1, 1)]
    for root, k in roots:
        v = np.array(whitening.null_vectors(m, root, k), float)
        assert np.allclose(v @ v.T, np.eye(k), atol=1e-15)
        assert np.allclose(v @ m.astype(float), v * (root / 2**whitening.PLACES), atol=1e-12)


def test_close_roots_have_components_of_their_own():
    """Eigenvalues 1 apart at 10^12: in doubles they can't be told apart."""
    big = 10**12
    m = np.array([[big, 1, 0], [1, big, 0], [0, 0, 3]], object)
    roots = whitening.positive_roots(whitening.characteristic(m), 2 * big + 3)
    assert [round(r / 2**whitening.PLACES - big) for r, _ in roots[:2]] == [1, -1]
    v = np.array([whitening.null_vectors(m, r, 1)[0] for r, _ in roots], float)
    assert np.allclose(np.abs(v), [[0.5**0.5, 0.5**0.5, 0], [0.5**0.5, 0.5**0.5, 0], [0, 0, 1]], atol=1e-15)


def test_exact_products_of_any_size():
    for most in (100, 10**7, 2**40):
        y = np.random.default_rng(1).integers(-most, most, (300, 4))
        assert (whitening._exact_products(y).astype(object) == y.astype(object).T @ y.astype(object)).all()


def reference(rows, most=32):
    """Plain numpy over the shifted integers."""
    x = np.array([[math.floor(64 * float(c)) for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(v) ** 2 for v in n * row - s) for row in x]
    centred = (n * x - s).astype(float) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(most, int((value > value[0] * 1e-12).sum()))
    return n, deviation, centred @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


def compared(got, rows, most=32):
    n, deviation, w, share = reference(rows, most)
    k = w.shape[1]
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    out = np.array([[by[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in rows])
    sign = np.sign((out * w).sum(axis=0))
    assert np.allclose(out * sign, w, atol=1e-6)
    for (i, _), dev in zip(rows, deviation):
        assert all(by[i][c]["deviation"] == dev and by[i][c]["n"] == n for c in range(1, k + 1))
    assert np.allclose([by[rows[0][0]][c]["explained"] for c in range(1, k + 1)], share, rtol=1e-6)
    assert np.abs(out.T @ out / n - np.eye(k)).max() < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whole_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compared(queries.op13_whitening(spark, sf_dir).collect(), rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(5)
    good = [(i, [float(x) for x in r.normal(3e4, 2, 3)]) for i in range(40)]
    good += [(90, good[3][1]), (91, good[3][1])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [float("-inf"), 1.0, 1.0]), (54, []), (55, [1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, n string, component int")
    compared(whitening.whiten(df).collect(), good)
    compared(whitening.whiten(df, most=2).collect(), good, 2)


def test_no_equal_and_dependent_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = [(i, [float(i % 7), 2.0 * (i % 7), 5.0]) for i in range(20)]
    compared(whitening.whiten(spark.createDataFrame(line, kind)).collect(), line)


def test_entries_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        whitening.whiten(df).collect()
