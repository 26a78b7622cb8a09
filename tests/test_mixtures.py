import math

import numpy as np
import pytest

from tessella.operators import mixtures


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "sample long, values array<double>")


def test_one_component_has_the_closed_form(spark):
    x = np.random.default_rng(1).normal(size=(80, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.4]]) + 50
    fits, n, means = mixtures.fitted(frame(spark, x), 1)
    assert n == 80 and np.allclose(means, x.mean(0)) and len(fits) == len(mixtures.MODELS)
    s = np.cov(x, rowvar=False, bias=True)
    forms = {"full": (s, 6), "diagonal": (np.diag(np.diag(s)), 3), "spherical": (np.eye(3) * np.trace(s) / 3, 1)}
    for f in fits:
        c, free = forms[mixtures.MODELS[f.model][1]]
        assert f.free() == 3 + free
        assert f.history[-1] == pytest.approx(-n / 2 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, s))), rel=1e-9)


def test_likelihoods_never_fall_and_planted_groups_are_found(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.5 + c for c in ([0, 0], [6, 1], [1, 7])])
    rows = frame(spark, x)
    fits, n, means = mixtures.fitted(rows, 4, ("full", "diagonal", "shared_spherical"), restarts=2, steps=30)
    assert len(fits) == 3 * 4 * 2
    for f in fits:
        assert all(b >= a - 1e-7 for a, b in zip(f.history, f.history[1:], strict=False)) and f.weights.sum() == pytest.approx(1)
    table = mixtures.scores(rows, fits, n).orderBy("bic", ascending=False).collect()
    assert (table[0]["components"], table[0]["model"]) == (3, "shared_spherical")
    got = {r["sample"]: r["cluster"] for r in mixtures.best_clusters(rows, fits, n, means).collect()}
    assert sorted(got) == list(range(120)) and len(set(got.values())) == 3
    assert all(len({got[i] for i in range(g * 40, g * 40 + 40)}) == 1 for g in range(3))


def test_equal_rows_and_no_rows(spark):
    rows = frame(spark, np.ones((6, 2)))
    fits, n, means = mixtures.fitted(rows, 2, ("full", "shared_diagonal"), steps=3)
    assert all(math.isfinite(v) for f in fits for v in f.history)
    assert mixtures.best_clusters(rows, fits, n, means).count() == 6
    fits, n, means = mixtures.fitted(rows.limit(0), 2)
    assert not fits and mixtures.best_clusters(rows.limit(0), fits, n, means).count() == 0
