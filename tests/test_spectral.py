import random

import numpy as np
import pytest

from tessella.operators import spectral


def test_values_and_vectors_against_the_dense_laplacian(spark):
    rng = random.Random(9)
    n, k = 60, 3
    edges = [(a, b, float(rng.randint(1, 4))) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.5 if a % 3 == b % 3 else 0.04)]
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    root = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(np.eye(n) - w / root[:, None] / root)
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found, got = spectral.eigenvectors(df, k)
    assert got == pytest.approx(values[:k], abs=1e-6)
    mine = np.array([[r[f"x{i}"] for i in range(k)] for r in sorted(found.collect())])
    assert np.abs(mine.T @ mine - np.eye(k)).max() < 1e-6
    assert np.abs(np.abs((mine * vectors[:, :k]).sum(0)) - 1).max() < 1e-4
    label = {r["sample"]: r["cluster"] for r in spectral.spectral_clusters(df, 3).collect()}
    assert all(len({label[s] for s in range(g, n, 3)}) == 1 for g in range(3)) and len(set(label.values())) == 3
