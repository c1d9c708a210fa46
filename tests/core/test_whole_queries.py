import numpy as np

from sigspark.operators import deconfounder, linear, support
from sigspark.plans import queries


def options_of(spark, monkeypatch, query, module, operator):
    seen = {}
    monkeypatch.setattr(module, operator, lambda *a, **options: seen.update(options, positional=len(a)))
    monkeypatch.setattr(queries, "rounded", lambda df, *a: df)
    getattr(queries, query)(spark, "/root/testdata/sf0.001")
    return seen


def test_models_are_registered_with_the_operators_defaults(spark, monkeypatch):
    for query, module, operator in (("rf_stability", linear, "forest_stability"), ("svr_stability", linear, "svr_stability"), ("deconfounder_weights", deconfounder, "deconfounded")):
        assert options_of(spark, monkeypatch, query, module, operator) == {"positional": 3}


def test_support_vectors_are_fitted_to_their_gap():
    rnd = np.random.default_rng(3)
    x = rnd.random((120, 30)) < 0.3
    y = (x @ rnd.normal(size=30) + rnd.normal(size=120))[:, None]
    fit = lambda **k: support.alone(support.Block([np.flatnonzero(r) for r in x], 30, y, 1.0, 0.1), **k)
    (w, gap), (best, least) = fit(), fit(gap=1e-9)
    assert gap.max() <= support.GAP and least.max() <= 1e-9 and np.abs(w - best).max() < 0.05
    assert fit(iterations=5)[1].max() > support.GAP


def test_moderated_t_tests_take_all_alterations(spark):
    found = queries.moderated_t_tests(spark, "/root/testdata/sf0.001").select("alt").distinct().count()
    assert found == queries.wald_tests(spark, "/root/testdata/sf0.001").select("alt").distinct().count() > 6
