"""Sums of blocks and tasks against dense computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sigspark.operators import deconfounder, differential, linear, rna, support, voom


@pytest.fixture(scope="module")
def cohort(spark):
    draw = np.random.default_rng(5)
    x, y = draw.random((60, 5)) < 0.3, draw.normal(size=(60, 4))
    x[:3] = False
    y = np.maximum(y + 2 * x[:, :4], 0)
    alts = spark.createDataFrame([(f"s{i:02}", f"a{j}") for i, j in zip(*np.nonzero(x), strict=True)], "sample string, feature string")
    cells = spark.createDataFrame([(f"s{i:02}", f"g{g}", float(y[i, g])) for i, g in zip(*np.nonzero(y), strict=True)], "sample string, gene string, u double")
    return x.astype(float), y, alts, cells, spark.createDataFrame([(f"s{i:02}",) for i in range(60)], "sample string")


@pytest.mark.parametrize("numbers", (linear.NUMBERS, 1))
def test_cross_sums_equal_dense_products(cohort, monkeypatch, numbers):
    x, y, alts, cells, samples = cohort
    monkeypatch.setattr(linear, "NUMBERS", numbers)
    parts = linear.halves(samples, 3)
    rows = linear.cross_sums(alts.union(alts), cells, parts, [f"a{j}" for j in range(5)], 3).toPandas()
    member = {(r.part, int(r.sample[1:])) for r in parts.collect()}
    for g in range(4):
        xy, yy = linear._assembled(rows[rows["gene"] == f"g{g}"], 3)
        for k in range(3):
            on = np.array([(k, i) in member for i in range(60)])
            assert np.allclose(xy[k], np.hstack([x, np.ones((60, 1))])[on].T @ y[on, g]) and np.isclose(yy[k], (y[on, g] ** 2).sum())


def test_factors_are_taken_out_by_sums_as_from_dense_expression(spark, cohort):
    x, y, alts, cells, samples = cohort
    got = {(r.gene, r.alt): r.weight for r in deconfounder.deconfounded(alts, cells, samples, candidates=(2,)).collect()}
    cov, means, names, _ = deconfounder.covariance(alts, samples)
    z = (x - means) @ deconfounder.ppca(cov, means, names, 2).project.T
    left = y - z @ (np.linalg.pinv(z.T @ z) @ (z.T @ y))
    rest = spark.createDataFrame([(f"s{i:02}", f"g{g}", float(left[i, g])) for i in range(60) for g in range(4)], "sample string, gene string, u double")
    want = {(r.gene, r.alt): r.weight for r in linear.penalised(alts, rest, samples).collect()}
    assert got.keys() == want.keys() and len(want) > 3 and all(abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_the_deconfounder_makes_no_dense_table(cohort, monkeypatch):
    """Once 300 genes times all samples times the factors were rows of a join: what is fitted are the cells as they came."""
    _, _, alts, cells, samples = cohort
    seen = []
    monkeypatch.setattr(deconfounder, "penalised", lambda a, c, s, **k: seen.append(c.count()) or c.select("gene", F.lit("").alias("alt"), F.col("u").alias("weight")))
    deconfounder.deconfounded(alts, cells, samples, candidates=(2,))
    assert seen == [cells.count()]


def test_weighted_t_is_the_same_from_blocks_of_samples(spark, cohort, monkeypatch):
    _, _, alts, cells, _ = cohort
    counts = cells.select("sample", "gene", F.ceil(F.col("u") * 20).alias("count")).localCheckpoint()
    sizes = []
    real = voom.each_alone
    monkeypatch.setattr(voom, "each_alone", lambda *a: sizes.append(voom.BLOCK) or real(*a))
    runs = []
    for block in (20_000, 13):
        monkeypatch.setattr(voom, "BLOCK", block)
        runs.append({(r.alt, r.gene): (r.log2fc, r.stat, r.pvalue) for r in differential.moderated_t(alts, counts).collect()})
    assert sizes == [20_000, 13] and runs[0].keys() == runs[1].keys() and len(runs[0]) == 20
    assert all(np.allclose(runs[0][k], runs[1][k], rtol=1e-9) for k in runs[0])


def test_the_joint_weighted_t_is_the_same_from_blocks_of_samples(spark, cohort, monkeypatch):
    _, _, alts, cells, _ = cohort
    counts = cells.select("sample", "gene", F.ceil(F.col("u") * 20).alias("count")).localCheckpoint()
    runs, dealt, real = [], [], voom.together
    monkeypatch.setattr(voom, "together", lambda left, right, tasks, *keys: dealt.append((keys, left.select(*keys).distinct().count())) or real(left, right, tasks, *keys))
    for block in (20_000, 13):
        monkeypatch.setattr(voom, "BLOCK", block)
        runs.append({(r.alt, r.gene): (r.log2fc, r.stat, r.pvalue) for r in differential.moderated_t_joint(alts, counts).collect()})
    assert all(keys == ("genes", "block") for keys, _ in dealt) and dealt[1][1] >= 4 * dealt[0][1]
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) == 20
    assert all(np.allclose(runs[0][k], runs[1][k], rtol=1e-9) for k in runs[0])


def test_the_joint_quasi_likelihood_model_is_the_same_from_blocks_of_samples(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, ids = rng.random((40, 3)) < 0.4, [f"s{i:02}" for i in range(40)]
    y = rng.poisson(np.exp(0.5 * x[:, :1] + np.array([[2.0, 3.0, -2.5]])))
    alts = spark.createDataFrame([(s, f) for s, row in zip(ids, x, strict=True) for f, on in zip("ABC", row, strict=True) if on], "sample string, feature string")
    counts = spark.createDataFrame([(s, f"g{g}", float(v)) for s, row in zip(ids, y, strict=True) for g, v in enumerate(row) if v], "sample string, gene string, count double")
    offsets = spark.createDataFrame([(s, 0.1 * i % 1) for i, s in enumerate(ids)], "sample string, offset double")
    offset = np.array([0.1 * i % 1 for i in range(40)])
    start = {f"g{g}": (0.1, np.array([0.0, 0, 0, np.log(y[:, g].sum() / np.exp(offset).sum())])) for g in range(3)}
    monkeypatch.setattr(differential, "BLOCK", 5)
    monkeypatch.setattr(differential, "GENES", 2)
    got = {g: rest for g, *rest in differential.nb_fits(alts, counts, offsets, ["A", "B", "C"], start)}
    for g in range(3):
        b, cov, deviance = differential._nb_fit(np.column_stack([x, np.ones(40)]).astype(float), y[:, g].astype(float), offset, 0.1)
        assert np.allclose(got[f"g{g}"][0], b, rtol=1e-8) and np.allclose(got[f"g{g}"][1], np.diag(cov), rtol=1e-8) and np.isclose(got[f"g{g}"][2], deviance)


def test_support_vectors_hold_fewer_genes_of_more_samples(spark, cohort, monkeypatch):
    """Once a task held all genes whatever the samples."""
    _, _, alts, cells, samples = cohort
    parts = samples.withColumn("part", F.lit(0))
    fitted = []
    for most in (10_000, 60):
        monkeypatch.setattr(support, "CELLS", most)
        rows = support.support_vectors(alts, cells, samples, parts)[0].collect()
        fitted.append({g: np.array(r.w).reshape(-1, len(r.names))[:, i] for r in rows for i, g in enumerate(r.names)})
    assert len(rows) > 1 and fitted[0].keys() == fitted[1].keys()
    assert all(np.allclose(fitted[0][g], w) for g, w in fitted[1].items())


def test_normalised_values_fill_in_absent_cells_where_the_sample_lies(spark):
    rna_rows = spark.createDataFrame([("s1", "a", 2), ("s1", "b", 0), ("s2", "b", 4), ("s2", "x", 9), ("s3", "x", 5)], "sample string, gene string, count long")
    genes = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    made = rna.normalised(rna_rows, genes)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample" in plan and "hashpartitioning(sample#" in plan and ", gene#" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(sample" in line)
    size = {r["sample"]: r["size_factor"] for r in rna.size_factors(rna_rows).collect()}
    count = {("s1", "a"): 2, ("s2", "b"): 4}
    got = {(r["sample"], r["gene"]): r["value"] for r in made.collect()}
    assert got.keys() == {(s, g) for s in ("s1", "s2", "s3") for g in "abc"}
    assert all(abs(v - np.log(2 + count.get(k, 0) / size[k[0]])) < 1e-12 for k, v in got.items())
