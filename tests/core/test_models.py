"""Forests and support vectors against brute force and direct optimisation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import cohort, forest, linear, support


def tree(x, w, y, depth):
    score = np.zeros(x.shape[1])

    def grow(rows, left):
        found = {}
        for j in range(x.shape[1]) if left else ():
            a, b = [i for i in rows if x[i, j]], [i for i in rows if not x[i, j]]
            if w[a].sum() and w[b].sum():
                square = lambda r: (w[r] * y[r]).sum() ** 2 / w[r].sum()
                found[j] = (square(a) + square(b) - square(rows), a, b)
        most = max((v[0] for v in found.values()), default=0)
        if most > 1e-9:
            j = min(k for k, v in found.items() if v[0] >= most - 1e-9)
            score[j] += most
            grow(found[j][1], left - 1)
            grow(found[j][2], left - 1)

    grow([i for i in range(len(y)) if w[i]], depth)
    return score / max(score.sum(), 1e-12)


def made(seed, n=36, p=6, genes=3, share=0.6):
    draw = np.random.default_rng(seed)
    x, y = draw.random((n, p)) < 0.3, draw.normal(size=(genes, n)) * (draw.random((genes, n)) < share)
    return x, y, cohort.Sparse([np.flatnonzero(r) for r in x], p)


@pytest.mark.parametrize("seed", range(4))
def test_importances_equal_trees_grown_one_by_one(seed):
    x, y, sparse = made(seed)
    y[0] = np.round(y[0])  # ties
    w = forest.bootstraps(36, 4, seed)
    got = forest.importances(sparse, w, y, 4)
    assert np.allclose(got, [np.mean([tree(x, w[t], v, 4) for t in range(4)], axis=0) for v in y])


@pytest.mark.parametrize("small", [1, 8, 10**6])
def test_nodes_read_alone_and_with_others_grow_the_same_trees(monkeypatch, small):
    monkeypatch.setattr(forest, "SMALL", small)
    monkeypatch.setattr(forest, "ROWS", 5)
    x, y, sparse = made(7, n=60, share=0.9)
    w = forest.bootstraps(60, 3, 7)
    assert np.allclose(forest.importances(sparse, w, y, 6, forest.carriers(sparse, w)), [np.mean([tree(x, w[t], v, 6) for t in range(3)], axis=0) for v in y])


def test_a_gene_without_expression_among_the_drawn_samples_has_no_importance():
    _, _, sparse = made(1)
    assert not forest.importances(sparse, forest.bootstraps(36, 4, 1), np.zeros((1, 36)), 4).any()


def test_constant_expression_and_alterations_without_a_split():
    sparse = cohort.Sparse([np.array([0]), np.array([0]), np.array([0])], 2)
    w = np.ones((2, 3), dtype=int)
    assert not forest.importances(sparse, w, np.array([[1.0, 2, 3], [2, 2, 2], [0, 0, 0]]), 8).any()


def frames(spark, seed=1, n=40):
    x, y, _ = made(seed, n=n, genes=5)
    y += 6 * x[:, 1]
    alts = spark.createDataFrame([(f"s{i:02}", f"a{j}") for i, j in zip(*np.nonzero(x), strict=True)], "sample string, feature string")
    cells = spark.createDataFrame([(f"s{i:02}", f"g{g}", float(y[g, i])) for g, i in zip(*np.nonzero(y), strict=True)], "sample string, gene string, u double")
    return x, y, alts, cells, spark.createDataFrame([(f"s{i:02}",) for i in range(n)], "sample string")


def test_forest_stability_equals_its_parts(spark):
    x, y, alts, cells, samples = frames(spark)
    got = {(r.gene, r.alt): r.weight for r in forest.forest_stability(alts.union(alts), cells, samples, trees=3, depth=3, n=4).collect()}
    halves = {}
    for r in linear.halves(samples, 4).collect():
        halves.setdefault(r.part, []).append(int(r.sample[1:]))
    want = {}
    for part, rows in halves.items():
        rows = sorted(rows)
        w = forest.bootstraps(len(rows), 3, 44, part)
        for g in range(5):
            mask = linear.score_mask(np.mean([tree(x[rows], w[t], y[g, rows], 3) for t in range(3)], axis=0))
            for j in np.flatnonzero(mask):
                want[f"g{g}", f"a{j}"] = want.get((f"g{g}", f"a{j}"), 0) + 0.25
    assert got == want


def objective(x, y, w, c, epsilon):
    return 0.5 * w @ w + c * np.maximum(np.abs(y - np.hstack([x, np.ones((len(x), 1))]) @ w) - epsilon, 0).sum()


def test_support_vectors_reach_their_gap_and_no_neighbour_is_better():
    x, y, _ = made(7, n=60)
    w, gaps = support.alone(support.Block([np.flatnonzero(r) for r in x], 6, y.T.copy(), 1.0, 0.1))
    assert gaps.max() <= support.GAP
    draw = np.random.default_rng(1)
    for g in range(3):
        own = objective(x, y[g], w[:, g], 1.0, 0.1)
        for scale in (1e-3, 1e-2, 0.1, 1):
            for _ in range(200):
                assert objective(x, y[g], w[:, g] + scale * draw.normal(size=7), 1.0, 0.1) >= own * (1 - support.GAP)


def test_several_blocks_make_the_same_steps_as_one(spark, monkeypatch):
    x, y, alts, cells, samples = frames(spark)
    monkeypatch.setattr(support, "SAMPLES", 9)
    monkeypatch.setattr(support, "ROUNDS", 3)
    parts = samples.withColumn("part", F.lit(0))
    fits, names = support.support_vectors(alts, cells, samples, parts)
    rows = fits.collect()
    block = support.Block([np.flatnonzero(r) for r in x], 6, y.T.copy(), 1.0, 0.1)
    w, _ = support.alone(block, iterations=3, gap=0.0)
    assert names == [f"a{j}" for j in range(6)] and len(rows) == 1 and rows[0].names == [f"g{g}" for g in range(5)]
    assert np.allclose(np.array(rows[0].w).reshape(7, 5), w)


def test_models_of_nothing(spark):
    alts, cells = spark.createDataFrame([], "sample string, feature string"), spark.createDataFrame([], "sample string, gene string, u double")
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample string")
    for fit in (forest.forest_stability, support.svr_stability):
        assert fit(alts, cells, samples, n=2).collect() == []
        assert fit(spark.createDataFrame([("s1", "a")], "sample string, feature string"), cells, samples, n=2).collect() == []


def test_svr_stability_finds_the_alteration_that_acts(spark):
    _, _, alts, cells, samples = frames(spark)
    got = support.svr_stability(alts, cells, samples, n=6)
    assert got.columns == ["gene", "alt", "weight"]
    weight = {(r.gene, r.alt): r.weight for r in got.collect()}
    assert all(weight.get((f"g{g}", "a1"), 0) == max(v for (k, _), v in weight.items() if k == f"g{g}") >= 0.5 for g in range(5))


def test_equal_rows_are_one(spark):
    draw = np.random.default_rng(3)
    x, y = draw.random((200, 11)) < 0.1, np.round(draw.normal(size=(2, 200)))
    packed = cohort.bits([np.flatnonzero(r) for r in x], 11)
    assert (np.unpackbits(packed, axis=1, count=11) == x).all()
    first, kind = cohort.alike(packed, *y)
    assert (x[first[kind]] == x).all() and (y[:, first[kind]] == y).all()
    assert len(first) == len({(*a, *b) for a, b in zip(x.tolist(), y.T.tolist(), strict=True)})


def test_rows_that_stand_for_several_samples_make_the_steps_of_these():
    x, y, _ = made(5, n=50)
    cols, times = [np.flatnonzero(r) for r in x], np.random.default_rng(5).integers(1, 4, 50)
    one = support.alone(support.Block(cols, 6, y.T.copy(), 1.0, 0.1, times=times), iterations=30, gap=0.0)
    more = np.repeat(np.arange(50), times)
    each = support.alone(support.Block([cols[i] for i in more], 6, y.T[more].copy(), 1.0, 0.1), iterations=30, gap=0.0)
    assert np.allclose(one[0], each[0]) and np.allclose(one[1], each[1])


def test_samples_have_their_places_by_name(spark):
    names = [f"s{i}" for i in range(300)]
    got, n = cohort.placed(spark.createDataFrame([(s,) for s in names + names[:9]], "sample string").repartition(7))
    assert n == 300 and {r.sample: r.place for r in got.collect()} == {s: i for i, s in enumerate(sorted(names))}


def test_a_large_cohort_is_solved_without_tables_of_its_state(spark, monkeypatch):
    monkeypatch.setattr(support, "_stored", None)  # calling it fails
    n = 101_000
    samples = spark.range(n).select(F.format_string("s%06d", "id").alias("sample"))
    alts = samples.where(F.substring("sample", 7, 1) == "1").withColumn("feature", F.lit("a"))
    cells = alts.select("sample", F.lit("g").alias("gene"), F.lit(3.0).alias("u"))
    fits, names = support.support_vectors(alts, cells, samples, samples.withColumn("part", F.lit(0)))
    row = fits.first()
    assert names == ["a"] and row.names == ["g"] and row.gap <= support.GAP
    assert sum(row.w) == pytest.approx(3, abs=0.11) and abs(row.w[1]) <= 0.11


def test_rounds_leave_no_states_on_disk(spark, monkeypatch):
    left = []
    real = support._stored

    def noted(df):
        out = real(df)
        if "z" in df.columns:
            left.append(out)
        return out

    monkeypatch.setattr(support, "_stored", noted)
    monkeypatch.setattr(support, "SAMPLES", 9)
    monkeypatch.setattr(support, "ROUNDS", 2)
    _, _, alts, cells, samples = frames(spark)
    parts = samples.withColumn("part", F.lit(0)).union(samples.where("sample < 's20'").withColumn("part", F.lit(3)))
    fits, _ = support.support_vectors(alts, cells, samples, parts)
    assert sorted(r.part for r in fits.collect()) == [0, 3] and len(left) == 6
    for df in left:
        at = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_rows_that_stand_for_several_samples_grow_the_trees_of_these():
    draw = np.random.default_rng(9)
    x, y = draw.random((80, 5)) < 0.2, np.round(draw.normal(size=(2, 80)), 1)
    w = forest.bootstraps(80, 4, 9)
    packed = cohort.bits([np.flatnonzero(r) for r in x], 5)
    first, kind = cohort.alike(packed)
    assert len(first) < 40
    weight = np.stack([np.bincount(kind, t, minlength=len(first)).astype(int) for t in w])
    gene, sample = np.nonzero(y)
    got = forest.grown(forest.sparse(packed[first], 5), weight, gene, kind[sample], y[gene, sample], 2, w[:, sample], 4)
    assert np.allclose(got, [[tree(x, t, v, 4) for t in w] for v in y])


def test_a_forest_drawn_a_tree_at_a_time_is_the_same(spark, monkeypatch):
    _, _, alts, cells, samples = frames(spark)
    rows = lambda: {tuple(r) for r in forest.forest_stability(alts, cells, samples, trees=3, depth=3, n=3).collect()}
    want = rows()
    monkeypatch.setattr(forest, "CELLS", 20)
    assert want and rows() == want


def test_a_forests_draws_and_rows_take_few_bytes():
    import tracemalloc

    n, p = 60_000, 30
    draw = np.random.default_rng(2)
    x = np.zeros((n, p), dtype=bool)
    x[np.arange(n), draw.integers(0, p, n)] = True
    own = pd.DataFrame({"chunk": [0], "x": [np.packbits(x, axis=1).tobytes()], "parts": [np.full(n, 128, dtype=np.uint8).tobytes()]})
    tracemalloc.start()
    cohort_ = cohort.Cohort(own, p, 1)
    first, kind = cohort.alike(cohort_.x)
    w = forest.bootstraps(n, 50, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(first) == p and len(kind) == n and w.sum() == 50 * n
    assert most < 3 * 50 * n  # 8 bytes a draw before
