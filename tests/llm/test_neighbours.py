"""Nearest neighbours against brute force: recall, scores, ties, copies and edge cases."""

import numpy as np
import pytest

from sigspark.llm import neighbours as m

SCHEMA = "vec_id long, embedding array<float>, shard string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, asked, k=20):
    out = {}
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for q in asked:
        hits = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in hits]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in out.items() if [x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1))}


def vectors(n, d=24, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, list(map(float, v * r))) for i, (v, r) in enumerate(zip(draw.normal(size=(n, d)), draw.uniform(0.2, 2, n), strict=True))]


def test_recall_and_scores_over_several_shards_of_unequal_lengths(spark):
    rows = vectors(3000)
    df = frame(spark, rows).repartition(5)
    got, want = found(m.nearest(df, df.where("vec_id % 20 = 0"))), brute(rows, range(0, 3000, 20))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    x = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(abs(s - x[q] @ x[i]) < 1e-12 for q, hits in got.items() for i, s in hits)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall > 0.95


def test_a_third_are_copies(spark):
    rows = vectors(600)
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(2000 + i, rows[20][1]) for i in range(3)]
    df = frame(spark, rows).repartition(7)
    got, want = found(m.nearest(df, df.where("vec_id in (0, 20, 40, 1000, 1399, 2001)"))), brute(rows, (0, 20, 40, 1000, 1399, 2001))
    for q in (0, 1000, 1399):  # ties go to the smaller id, the own row aside
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert set(got) == set(want) and all(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) >= 18 for q in want)


def test_few_candidates_ties_and_rows_without_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 5.0]), (4, [0.5, -5.0]), (5, None), (6, [0.0, -0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (10, [-0.0, 2.0]), (2, [1.0, 0.0])]
    df = frame(spark, rows)
    got = found(m.nearest(df, df))
    assert set(got) == {1, 2, 3, 4, 10}
    assert got[1] == [(2, 1.0), (3, 0.5), (4, 0.5), (10, 0.0)] and got[2] == [(1, 1.0), (3, 0.5), (4, 0.5), (10, 0.0)]
    assert got[10] == [(3, 10.0), (1, 0.0), (2, 0.0), (4, -10.0)]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None), (2, [0.0])]])
def test_nothing_to_find(spark, rows):
    df = frame(spark, rows)
    got = m.nearest(df, df)
    assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_one_id_of_two_vectors(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 3.0])])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in m.nearest(df, df.where("vec_id = 1")).collect())
    assert got == [(1, 1, 2, 2.0), (1, 1, 2, 3.0), (1, 2, 1, 0.0), (1, 2, 1, 0.0)]


def test_every_node_can_be_reached():
    draw = np.random.default_rng(4)
    tight = np.vstack([draw.normal(size=(1, 8)) + 1e-4 * draw.normal(size=(300, 8)) for _ in range(6)])
    for v in (tight, np.vstack([draw.normal(size=(500, 3)), 50 * draw.normal(size=(5, 3))])):
        out, start = m.index(v)
        assert m._reached(out, start).all() and (np.sort(out, axis=1)[:, -1] >= 0).all()


def test_pruning_follows_its_rule():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(40, 5))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    ids = np.arange(1, 40)[None, :].astype(np.int32)
    kept = [i for i in m._pruned(x, 1.0, ids, (x[ids[0]] @ x[0])[None, :])[0].tolist() if i >= 0]
    left, want = sorted(range(1, 40), key=lambda i: -float(x[i] @ x[0])), []
    while left and len(want) < m.DEGREE:
        want.append(left.pop(0))
        left = [i for i in left if m.RELAXED**2 * (1 - float(x[i] @ x[want[-1]])) > 1 - float(x[i] @ x[0])]
    assert kept == want
