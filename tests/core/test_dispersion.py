"""Dispersions against a direct maximisation over all cells, the Wald test against a dense fit, and the trend, prior and filter against their definitions."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sigspark.operators import differential, dispersion
from sigspark.operators.rna import size_factors


def planted(spark, n=50, genes=40):
    draw = np.random.default_rng(5)
    x = (draw.random((n, 2)) < 0.4).astype(int)
    size = draw.uniform(0.5, 2, n)
    mu = np.outer(size, np.exp(draw.uniform(0.5, 6, genes)))
    mu[:, 0] *= np.where(x[:, 0], 5, 1)
    alpha = 2 / mu.mean(axis=0) + 0.1
    y = draw.poisson(draw.gamma(1 / alpha, mu * alpha))
    alts = spark.createDataFrame([(f"S{i:02}", f"A{j}") for i, j in zip(*np.nonzero(x), strict=True)], "sample string, feature string")
    counts = spark.createDataFrame([(f"S{i:02}", f"G{j:02}", int(y[i, j])) for i in range(n) for j in range(genes)], "sample string, gene string, count long")
    return x, y, alts, counts


def likelihood(k, mu, alpha, x):
    ll = sum(math.lgamma(a + 1 / alpha) - math.lgamma(1 / alpha) + a * math.log(alpha * m / (1 + alpha * m)) - math.log1p(alpha * m) / alpha for a, m in zip(k, mu, strict=True))
    w, d = mu / (1 + alpha * mu), np.stack([np.ones(len(x)), x], axis=1)
    return ll - 0.5 * math.log(np.linalg.det((d * w[:, None]).T @ d))


def test_log_gamma():
    x = np.array([1e-6, 0.01, 0.5, 1, 2.5, 10, 1e3, 1e8])
    assert np.allclose(dispersion.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


@pytest.fixture(scope="module")
def fitted(spark):
    x, y, alts, counts = planted(spark)
    sizes = size_factors(counts)
    rows = {(r.alt, r.gene): r for r in dispersion.dispersions(alts, counts, sizes, ["A0", "A1"]).collect()}
    s = {r["sample"]: r["size_factor"] for r in sizes.collect()}
    return x, y, rows, np.array([s[f"S{i:02}"] for i in range(len(x))])


def first_pass(x, y, size):
    """Direct maximisation on a fine grid over all cells."""
    grid, out = np.linspace(math.log(1e-4), math.log(50), 400), []
    for g in range(y.shape[1]):
        q = np.array([(y[x == c, g] / size[x == c]).mean() for c in (0, 1)])
        mu = np.maximum(size * q[x], 0.5)
        value = [likelihood(y[:, g], mu, math.exp(a), x) for a in grid]
        out.append((mu, grid, np.array(value)))
    return out


def test_dispersions_equal_a_direct_maximisation(fitted):
    x, y, rows, size = fitted
    direct = first_pass(x[:, 0], y, size)
    first = np.array([math.exp(grid[v.argmax()]) for _, grid, v in direct])
    mean = (y / size[:, None]).mean(axis=0)
    p = dispersion.priors(pd.DataFrame({"alt": "A0", "mean": mean, "alpha": first, "df": float(len(x) - 2)})).iloc[0]
    trend = p.a0 + p.a1 / mean
    for g, (_, grid, v) in enumerate(direct):
        want = first[g] if math.log(first[g]) > math.log(trend[g]) + p.far else math.exp(grid[(v - (grid - math.log(trend[g])) ** 2 / (2 * p.variance)).argmax()])
        assert abs(math.log(rows["A0", f"G{g:02}"].alpha / want)) < 0.05, g
    assert 0.03 < p.a0 < 0.3 and 0.3 < p.a1 < 6


def test_fold_changes_equal_a_dense_fit(fitted):
    x, y, rows, size = fitted
    for g in range(0, 40, 3):
        r, d = rows["A1", f"G{g:02}"], np.stack([np.ones(len(x)), x[:, 1]], axis=1)
        b = np.array([math.log(max((y[:, g] / size).mean(), 0.05)), 0.0])
        for _ in range(100):
            mu = np.maximum(size * np.exp(d @ b), 0.5)
            w = mu / (1 + r.alpha * mu)
            b = np.linalg.solve((d * w[:, None]).T @ d, d.T @ (w * (np.log(mu / size) + (y[:, g] - mu) / mu)))
        error = math.sqrt(np.linalg.inv((d * w[:, None]).T @ d)[1, 1])
        assert r.lfc == pytest.approx(b[1], abs=1e-5) and r.se == pytest.approx(error, rel=1e-4)


def test_bins_of_size_factors_are_close_to_all_samples(monkeypatch):
    draw = np.random.default_rng(2)
    sizes, k = draw.lognormal(0, 0.6, 3000), draw.poisson(0.3, 3000)
    on = np.flatnonzero(k)
    make = lambda: [dispersion.Group(np.zeros(len(on), dtype=int), k[on].astype(float), sizes[on], sizes, 1)]
    binned = dispersion.gene_wise(make())
    monkeypatch.setattr(dispersion, "BINS", 3000)
    assert abs(math.log(binned[0] / dispersion.gene_wise(make())[0])) < 0.01


def test_trend_falls_back_to_a_level():
    assert dispersion.trend_of(np.array([1.0, 2.0]), np.array([0.1, 0.3])) == pytest.approx((0.2, 0.0))
    mean = np.linspace(1, 100, 50)
    assert dispersion.trend_of(mean, 0.05 + 3 / mean) == pytest.approx((0.05, 3), rel=1e-4)


def test_wald_finds_what_is_planted_and_filters(spark):
    x, y, alts, counts = planted(spark)
    got = differential.wald(alts, counts)
    assert got.columns == ["alt", "gene", "log2fc", "stat", "pvalue", "padj"]
    rows = {(r.alt, r.gene): r for r in got.collect()}
    assert len(rows) == 80 and rows["A0", "G00"].padj < 1e-6 and rows["A0", "G00"].log2fc == pytest.approx(math.log2(5), abs=0.6)
    assert sum(r.padj is not None and r.padj < 0.05 for r in rows.values()) <= 6


def test_filter_leaves_low_means_out_when_that_finds_more():
    draw = np.random.default_rng(3)
    mean = np.concatenate([draw.uniform(0, 1, 900), draw.uniform(50, 100, 100)])
    p = np.concatenate([draw.uniform(0, 1, 900), draw.uniform(0, 0.02, 100)])
    got = dispersion.filtered(pd.DataFrame({"mean": mean, "pvalue": p}))
    assert got["padj"].isna().sum() > 300 and (pd.to_numeric(got["padj"]) < 0.05).sum() > 80


def cohort_rows(copies):
    draw = np.random.default_rng(5)
    n = 400
    size, cols, k = draw.lognormal(0, 0.3, n), [np.flatnonzero(draw.random(2) < 0.4) for _ in range(n)], draw.poisson(6, (2, n))
    bins = np.floor(np.log(size) * dispersion.FINE).astype(int)
    table = pa.table({"gene": ["G0"] * n * copies + ["G1"] * n * copies, "count": np.concatenate([np.tile(v, copies) for v in k]), "size": np.tile(size, 2 * copies), "bin": np.tile(bins, 2 * copies), "cols": [c.tolist() for c in cols] * 2 * copies}, schema=pa.schema({"gene": pa.string(), "count": pa.int64(), "size": pa.float64(), "bin": pa.int32(), "cols": pa.list_(pa.int32())}))
    low = bins.min()
    wide = bins.max() - low + 1
    rows = list(dispersion._each(dispersion._gene_sums(2, low, wide)(table.to_batches(max_chunksize=70))))
    carrier = np.stack([*([j in c for c in cols] for j in range(2)), [True] * n])
    at = bins - low
    of = lambda v: np.stack([np.bincount(at, v * c, minlength=wide) for c in carrier]) * copies
    return k, size, carrier, [r for _, r in rows], of(np.ones(n)), of(size)


def test_a_task_holds_sums_whose_number_does_not_grow_with_the_samples():
    once, many = cohort_rows(1)[3], cohort_rows(12)[3]
    assert [r["gene"] for r in many] == ["G0", "G1"]
    for a, b in zip(once, many, strict=True):
        assert len(a["code"]) == len(b["code"]) < 3 * 30 and len(a["bin"]) == len(b["bin"])
        assert np.allclose(12 * a["marks"], b["marks"]) and np.allclose(12 * a["total"], b["total"])


def test_sums_give_the_dispersions_of_all_cells(monkeypatch):
    monkeypatch.setattr(dispersion, "BINS", 1000)
    k, size, carrier, rows, samples, samples_size = cohort_rows(1)
    for g, row in enumerate(rows):
        got = dispersion._groups(row, np.array([0, 1]), 2, samples, samples_size)
        alpha = dispersion.gene_wise(got)
        change = dispersion.fold_changes(got, alpha)
        for j in range(2):
            exact = [dispersion.Group(np.zeros((k[g][c] > 0).sum(), dtype=int), k[g][c][k[g][c] > 0].astype(float), size[c][k[g][c] > 0], size[c], 1) for c in (carrier[j], ~carrier[j])]
            assert np.log(alpha[j]) == pytest.approx(np.log(dispersion.gene_wise(exact)[0]), abs=1e-4)
            assert [v[j] for v in change] == pytest.approx([v[0] for v in dispersion.fold_changes(exact, alpha[j : j + 1])], abs=1e-5)
