import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import cooccurrence, deconfounder, differential, evaluate, knn, linear, simulate, support, theory


def test_fisher_and_pairs(spark):
    t = spark.createDataFrame([("x", 6, 2, 1, 4), ("y", 0, 5, 5, 0), ("z", 3, 0, 0, 0)], "key string, a int, b int, c int, d int")
    got = {r.key: r.p for r in cooccurrence.fisher(t, "key").collect()}
    assert got["x"] == pytest.approx(132 / 1287) and got["y"] == pytest.approx(2 / 252) and got["z"] == pytest.approx(1)
    one = spark.createDataFrame([("S1", "A")], "sample string, feature string")
    assert cooccurrence.fisher_pairs(one, one).collect() == []


def test_scores(spark):
    genes = spark.createDataFrame([(g,) for g in "ABCDEF"], "gene string")
    truth = spark.createDataFrame([("x", g) for g in "ABC"], "alt string, gene string")
    said = spark.createDataFrame([("m", "x", g) for g in "BCDD"] + [("other", "y", "A")], "method string, alt string, gene string")
    got = {r.method: r for r in evaluate.signature_metrics(said, truth, genes).collect()}
    r = got["m"]
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert (r.precision, r.recall, r.f1, r.accuracy, r.jaccard, r.mcc) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 4 / 6, 0.5, 3 / 9))
    assert got["other"].f1 == 0 and got["other"].fn == 3
    with pytest.raises(Exception, match="outside the universe"):
        evaluate.signature_metrics(said.union(spark.createDataFrame([("m", "x", "Z")], said.schema)), truth, genes, check=True).collect()


def test_adjusted(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "k string, pvalue double")
    got = {r.k: r.padj for r in evaluate.adjusted(df).collect()}
    assert [got[k] for k in "abcd"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5]) and got["e"] is None


def test_orientation(spark):
    truth = spark.createDataFrame([("KRAS_GOF",)], "alt string")
    a = spark.createDataFrame([("KRAS_GOF", "Lasso", ["G"])], "outer string, inner string, genes array<string>")
    assert evaluate.orientation(a, truth) == "alt_first" and evaluate.method_first(a, truth).first()["method"] == "Lasso"
    b = spark.createDataFrame([("Lasso", "KRAS_GOF", ["G"])], a.schema)
    assert evaluate.orientation(b, truth) == "method_first" and evaluate.method_first(b, truth).first()["method"] == "Lasso"
    assert evaluate.orientation(a.limit(0), truth) == "unknown" and evaluate.orientation(a, None) == "method_first"


def test_tails():
    assert differential.normal_p(np.array([1.959964])) == pytest.approx(0.05, abs=1e-6)
    assert differential.t_p(np.array([2.228139, 0.0]), np.array([10.0, 3.0])) == pytest.approx([0.05, 1.0], abs=1e-6)
    assert differential.f_p(np.array([4.964603]), 1.0, 10.0) == pytest.approx(0.05, abs=1e-6)
    assert differential.trigamma(1.0) == pytest.approx(math.pi**2 / 6) and differential.digamma(1.0) == pytest.approx(-0.5772156649)
    assert differential.trigamma_inverse(differential.trigamma(3.7)) == pytest.approx(3.7, rel=1e-6)


def planted(spark, n=120, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 4)) < 0.4).astype(int)
    mu = np.full((n, 12), 200.0)
    mu[:, 0] *= np.where(x[:, 0], 4, 1)
    mu[:, 1] *= np.where(x[:, 1], 0.25, 1)
    y = rng.poisson(rng.gamma(10, mu / 10))
    alts = spark.createDataFrame([(f"S{i:03}", f"A{j}_GOF") for i, j in zip(*np.nonzero(x), strict=True)], "sample string, feature string")
    counts = spark.createDataFrame([(f"S{i:03}", f"G{j:02}", int(y[i, j])) for i in range(n) for j in range(12)], "sample string, gene string, count long")
    return alts, counts


def test_differential_expression_finds_planted_effects(spark):
    alts, counts = planted(spark)
    for test in (differential.wald, differential.moderated_t, differential.quasi_f, differential.moderated_t_joint):
        best = {r.alt: r for r in test(alts, counts).orderBy("pvalue").collect()[::-1]}
        assert best["A0_GOF"].gene == "G00" and best["A0_GOF"].padj < 1e-4 and best["A0_GOF"].log2fc > 1
        assert best["A1_GOF"].gene == "G01" and best["A1_GOF"].log2fc < -1


def test_linear_methods_find_planted_effects(spark):
    alts, counts = planted(spark)
    cells, samples = evaluate._cells(counts, 1.0), counts.select("sample").distinct()
    w = linear.all_weights(alts, cells, samples, options={"RandomForest": {"trees": 5, "depth": 3, "n": 4}, "SVM": {"n": 4}, "Ridge": {"n": 6}})
    found = {(r["method"], r.alt, r.gene) for r in linear.all_signatures(w, 0.6).collect()}
    for method in linear.METHODS:
        assert (method, "A0_GOF", "G00") in found and (method, "A1_GOF", "G01") in found
    with pytest.raises(ValueError):
        linear.all_weights(alts, cells, samples, "none")
    left = deconfounder.deconfounded(alts, cells, samples, candidates=(2,))
    assert left.count() >= 0
    assert {r.status for r in linear.alteration_gate(alts, samples, alts.select(F.col("feature").alias("alt")).union(spark.createDataFrame([("no",)], "alt string"))).collect()} == {"ok", "SKIPPED: constant or low variance"}


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 6)), rng.normal(size=(80, 3))
    y[:, 0] += 2 * x[:, 1]
    x -= x.mean(axis=0)
    y -= y.mean(axis=0)
    b = linear.coordinate_descent(x.T @ x, x.T @ y, 80, 0.1, 1.0, np.zeros((6, 3)), tol=1e-9)
    grad = x.T @ (y - x @ b) / 80
    assert (np.abs(grad) <= 0.1 + 1e-6).all() and np.abs(np.abs(grad[b != 0]) - 0.1).max() < 1e-6 and abs(b[1, 0]) > 1


def test_support_vectors_and_masks():
    rng = np.random.default_rng(3)
    x = (rng.random((200, 4)) < 0.5).astype(np.float32)
    y = 2 * x[:, 0] - x[:, 2] + rng.normal(0, 0.05, 200)
    w, _ = support.alone(support.Block([np.flatnonzero(r) for r in x], 4, y[:, None], 1.0, 0.1))
    assert w[:-1, 0] == pytest.approx([2, 0, -1, 0], abs=0.15)
    assert linear.score_mask([1, 2, 9, np.nan]).tolist() == [False, False, True, False]
    with pytest.raises(ValueError):
        linear.score_mask([1.0], "none")


def test_factors():
    rng = np.random.default_rng(4)
    data = rng.normal(size=(500, 2)) @ rng.normal(size=(2, 6)) + rng.normal(0, 0.1, (500, 6))
    cov, names = np.cov(data.T, bias=True), [f"f{i}" for i in range(6)]
    f = deconfounder.ppca(cov, data.mean(axis=0), names, 2)
    assert f.w.shape == (6, 2) and f.score_covariance.shape == (2, 2) and f.w @ f.w.T + f.noise * np.eye(6) == pytest.approx(cov, abs=0.05)
    with pytest.raises(ValueError):
        deconfounder.ppca(cov, data.mean(axis=0), names, 6)


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, (40, 3)).astype(float)
    df = spark.createDataFrame([(f"{i:03}", v[i].tolist()) for i in range(40)], "id string, vec array<double>")
    got = {(r.query, r.rank): (r.neighbor, r.distance) for r in knn.nearest(df, df, 5).collect()}
    for i in range(40):
        want = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), f"{j:03}") for j in range(40))[:5]
        assert [got[(f"{i:03}", r + 1)] for r in range(5)] == [(j, d) for d, j in want]


def test_simulation(spark):
    mu = spark.createDataFrame([("S1", "G1", 10.0), ("S2", "G1", 10.0), ("S1", "G2", 8.0), ("S2", "G2", 8.0)], "sample string, gene string, mu double")
    alts = spark.createDataFrame([("S1", "ALT1_GOF", 1)], "sample string, feature string, value int")
    sig = spark.createDataFrame([("ALT1_GOF", "G1", 1.0), ("ALT1_GOF", "G2", -1.0)], "alt string, gene string, log2fc double")
    assert sorted(map(tuple, simulate.induced(mu, alts, sig).collect())) == [("S1", "G1", 20.0), ("S1", "G2", 4.0), ("S2", "G1", 10.0), ("S2", "G2", 8.0)]
    summary = spark.createDataFrame([("a", 2.0, 1.0, 20.0), ("b", 2.0, None, 9.0), ("c", None, None, 5.0)], "alt string, mean_abs_log2fc double, median_abs_log2fc double, max_abs_log2fc double")
    got = {r.alt: r for r in simulate.alteration_params(summary).collect()}
    assert got["a"].abs_mu == 0 and got["a"].abs_sigma == pytest.approx(math.sqrt(2 * math.log(2))) and got["a"].abs_cap == got["b"].abs_cap == got["c"].abs_cap == 12
    assert got["b"].abs_mu is None and got["a"].size_mean is None
    genes = spark.createDataFrame([(f"G{i}",) for i in range(20)], "gene string")
    params = spark.createDataFrame([("G1_GOF", None, 0.0, 0.5, 3.0), ("G1_AMP", None, 0.0, 0.5, 3.0), ("G2_LOF", None, None, None, 3.0), ("X_MUT", None, None, None, 3.0)], "alt string, size_mean double, abs_mu double, abs_sigma double, abs_cap double")
    made = simulate.signatures(params, genes, sizes=(10, 10)).collect()
    by = {a: {r.gene: r.log2fc for r in made if r.alt == a} for a in ("G1_GOF", "G1_AMP", "G2_LOF", "X_MUT")}
    assert all(len(s) == 10 for s in by.values()) and by["G1_GOF"]["G1"] > 0 and by["G1_AMP"]["G1"] > 0 and by["G2_LOF"]["G2"] < 0
    assert all(e < 0 for e in by["X_MUT"].values()) and len(by["G1_GOF"].keys() & by["G1_AMP"].keys()) >= 6 and all(abs(e) <= 3 for s in by.values() for e in s.values())


def test_negative_binomial_counts(spark):
    mu = spark.range(4000).select(F.concat(F.lit("S"), "id").alias("sample"), F.lit("G").alias("gene"), F.lit(50.0).alias("mu"))
    d = spark.createDataFrame([("G", 0.2)], "gene string, dispersion double")
    r = simulate.nb_counts(mu, d).agg(F.avg("count"), F.var_samp("count")).first()
    assert r[0] == pytest.approx(50, rel=0.05) and r[1] == pytest.approx(50 + 0.2 * 2500, rel=0.15)
    assert simulate.nb_counts(mu, d).agg(F.sum("count")).first() == simulate.nb_counts(mu.repartition(7), d).agg(F.sum("count")).first()
    with pytest.raises(Exception, match="finite"):
        simulate.nb_counts(mu.withColumn("mu", F.lit(float("nan"))), d).collect()


def test_theory(spark):
    r = theory.replicates(spark, 300, 300, reps=10).agg(F.avg("slope_x"), F.avg("slope_z"), F.max("theory_z")).first()
    assert r[0] == pytest.approx(1, abs=0.05) and r[1] == pytest.approx(r[2], abs=0.05)


def test_adjusted_values_over_range_partitions(spark):
    draw = np.random.default_rng(9)
    p = [*np.round(draw.uniform(0, 1, 400), 3).tolist(), *[1.0] * 200, *[0.0] * 3, *draw.uniform(0, 1e-4, 20).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(-1, None)], "i int, pvalue double").repartition(7)
    got = {r.i: r.padj for r in evaluate.adjusted(df).collect()}
    order, low = sorted(range(len(p)), key=lambda i: p[i]), 1.0
    for k in range(len(p), 0, -1):
        last = max(j for j in range(k - 1, len(p)) if p[order[j]] == p[order[k - 1]]) + 1 if k < len(p) and p[order[k]] == p[order[k - 1]] else k
        low = min(low, p[order[k - 1]] * len(p) / last)
        assert got[order[k - 1]] == pytest.approx(low, abs=1e-12)
    assert got[-1] is None and len(got) == len(p) + 1
    assert evaluate.adjusted(df.where("i = -1")).collect()[0].padj is None and evaluate.adjusted(df.limit(0)).collect() == []


def test_signal_to_noise_reads_its_counts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    rng = np.random.default_rng(6)
    y = rng.poisson(4, (30, 5))
    y[29], y[0, :] = 0, [3, 3, 0, 0, 0]
    cells = [(f"s{i:02}", f"g{j}", int(y[i, j])) for i in range(30) for j in range(5)]
    rna = spark.createDataFrame(cells, "sample string, gene string, count long").mapInPandas(counted, "sample string, gene string, count long")
    x = {"A": range(10), "B": range(5, 29), "one": [3], "gone": [29]}
    alts = spark.createDataFrame([(f"s{i:02}", a) for a, on in x.items() for i in on], "sample string, feature string")
    targets = {"A": [0, 1], "B": [1, 4], "one": [2], "gone": [3], "none": [0]}
    truth = spark.createDataFrame([(a, f"g{j}", 1.0) for a, js in targets.items() for j in js], "alt string, gene string, log2fc double")
    got = {r["alteration"]: r for r in evaluate.snr(alts, rna, truth).collect()}
    assert seen.value == len(cells)
    with np.errstate(divide="ignore"):
        centre = np.array([np.exp(np.log(c[c > 0]).mean()) for c in y.T])
    factor = np.array([np.median((r / centre)[r > 0]) for r in y[:29]])
    u = np.log(2 + y[:29] / factor[:, None])
    for a, js in targets.items():
        on = np.isin(np.arange(29), list(x.get(a, [])))
        one, rest = u[on], u[~on]
        want = np.mean([abs(one[:, j].mean() - rest[:, j].mean()) / np.sqrt((one[:, j].var(ddof=1) + rest[:, j].var(ddof=1)) / 2) for j in js]) if on.sum() > 1 else None
        assert got[a]["n_targets"] == len(js) and got[a]["snr"] == (want if want is None else pytest.approx(want, rel=1e-9))
    assert {r["sample"]: r["size_factor"] for r in rna_factors(spark, cells)} == pytest.approx({f"s{i:02}": f for i, f in enumerate(factor)}, rel=1e-12)


def rna_factors(spark, cells):
    from sigspark.operators import rna

    return rna.size_factors(spark.createDataFrame(cells, "sample string, gene string, count long")).collect()


def test_an_evaluation_computes_its_design_once(spark, monkeypatch):
    from sigspark.operators import design
    from sigspark.plans import workflows

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    made = spark.createDataFrame([("A_GOF", "kept", 0), ("B_GOF", "constant", None)], "feature string, fate string, place int")
    monkeypatch.setattr(design, "sanitised", lambda *a, **k: made.mapInPandas(counted, made.schema))
    alts = spark.createDataFrame([("s1", "A_GOF"), ("s2", "B_GOF")], "sample string, feature string")
    truth = spark.createDataFrame([("A_GOF", "g1", 1.0), ("B_GOF", "g1", 1.0)], "alt string, gene string, log2fc double")
    genes = truth.select("gene")
    found = workflows.evaluate_predictions("d", alts, alts, genes, truth, truth.selectExpr("'m' AS method", "alt", "gene"), genes, with_robustness=False)
    assert [(r["alt"], r["tp"]) for r in found.individual.collect()] == [("A_GOF", 1)] and seen.value == 2
