"""Whitening against eigenvectors of the covariance in exact numbers, and its edge cases."""

from fractions import Fraction

import numpy as np
import pytest

from sigspark.llm import whitening as m

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def brute(vectors):
    """{row: (deviation, whitened)} up to sign, and shares, from exact sums and a covariance matrix."""
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = len(s)
    centred = [[Fraction(v[i] * n - s[i], n) for i in range(d)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    z = [[n * v[i] - s[i] for i in range(d)] for v in x]
    white = (np.array(z, dtype=float) / n) @ axes[:, :4] / np.sqrt(e[:4])
    return n, [sum(v * v for v in r) for r in z], white, e[:4] / e.sum()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def test_equals_the_covariances_eigenvectors(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(300, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1]) / 4
    vectors = [list(map(float, v)) for v in np.vstack([base, np.repeat(base[:1], 150, axis=0)])]  # a third of all rows are copies
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    rows = [*enumerate(vectors), *bad, (None, vectors[3]), (7, vectors[8])]
    got = m.whiten(table(spark, rows).repartition(11)).collect()
    n, deviation, white, share = brute([*vectors, vectors[3], vectors[8]])
    assert len(got) == 4 * (len(vectors) + 2)
    want = {}
    for (i, _), dv, w in zip([*enumerate(vectors), (None, 0), (7, 0)], deviation, white, strict=True):
        want.setdefault(i, []).append((dv, w))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(1, 5):
        own = [r for r in got if r.component == c]
        first = next(r for r in own if r.vec_id == 20)
        sign = np.sign(first.whitened * want[20][0][1][c - 1])
        for r in own:
            assert any(dv == r.deviation and abs(w[c - 1] * sign - r.whitened) < 1e-9 for dv, w in want[r.vec_id])
            assert abs(r.explained - share[c - 1]) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, rows):
    got = m.whiten(table(spark, rows))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_have_no_rows(spark):
    got = m.whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [-0.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got) == [(i, 1, 2, 65536, 1.0, 1.0) for i in (1, 2, 3)]


def test_commonest_length_and_ties(spark):
    got = m.whiten(table(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 3.0])])).collect()
    assert {r.vec_id for r in got} == {3, 4}


def test_large_entries_stay_exact(spark):
    big = [2.0**60, 2.0**80, -(2.0**80), 3.0]
    rows = spark.createDataFrame([(i, [v, 1.0]) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in m.whiten(rows).collect()}
    assert {i: r.deviation for i, r in got.items()} == {0: None, 1: None, 2: None, 3: 1537**2}  # the others saturate, their sum is 767
    assert m.squares(np.array([[2**31, 2**31], [2**32, 0], [3, 4]], dtype=object)) == [None, None, 25]
    assert m.squares(np.array([[2**31, 2**30], [2**32, 1], [3037000499, 0]], dtype=np.int64)) == [2**62 + 2**60, None, 3037000499**2]


def test_tree_merge_equals_one_qr(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = draw.integers(-50, 50, size=(200, 5))
    fit = spark.createDataFrame([(list(map(int, v)),) for v in x], "x array<long>").repartition(23)
    n, sums = m.exact_sums(fit)
    assert n == 200 and sums == x.sum(axis=0).tolist()
    r = m.tsqr(fit, n, sums)
    centred = x - x.mean(axis=0)
    assert r.shape == (5, 5) and np.allclose(r.T @ r, centred.T @ centred)
