"""Spectral embedding of a weighted graph: subspace iteration on the normalised Laplacian, as sparse products over its edges.

The leading vectors of (I + D^-1/2 W D^-1/2) / 2 are those of the smallest eigenvalues of the Laplacian. A block of vectors
is a table of one column each; a product is one join of edges with it and one sum by node, and blocks are made orthogonal
with the sums of products of two columns, which are few numbers that the driver factorises. Nothing is dense but them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import uniform
from tessella.operators.communities import both_ways
from tessella.sources.shared import stored


def combined(names: list[str], weights: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in zip(names, weights, strict=True)])


def products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The sums over rows of each left column times each right one."""
    found = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in left for b in right]).first()
    return np.array([x or 0.0 for x in found]).reshape(len(left), len(right))


def turned(rows: DataFrame, names: list[str], by: np.ndarray, to: list[str] | None = None) -> DataFrame:
    """rows (node, names) with the columns multiplied by a small matrix."""
    return rows.select("node", *[combined(names, by[:, k]).alias(c) for k, c in enumerate(to or names)])


def eigenvectors(edges: DataFrame, k: int, seed: int = 7, spare: int = 6, powers: int = 4, rounds: int = 60, tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """((node, x0 .. x(k-1)), values): the k smallest eigenvalues of the normalised Laplacian of edges (src, dst, weight), in
    rising order, and their vectors of length 1, each pointing to where its summed cube is positive. Rounds of `powers`
    products end when no value moves by more than `tolerance`. Nodes are ends of edges; k at most their number."""
    sides = both_ways(edges)
    degrees = sides.groupBy(F.col("src").alias("node")).agg(F.sqrt(F.sum("w")).alias("root"))
    at = lambda c: degrees.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    half = sides.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("w") / (2 * F.col("root_src") * F.col("root_dst"))).alias("w"))
    scaled = stored(half.union(degrees.select("node", "node", F.lit(0.5))), "scaled")
    nodes = degrees.count()
    width = min(k + spare, nodes)
    names = [f"x{i}" for i in range(width)]
    product = lambda block: scaled.join(block.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
    # Cholesky's factor of the products makes a block orthogonal.
    orthogonal = lambda block: turned(block, names, np.linalg.inv(np.linalg.cholesky(products(block, names, names) + 1e-14 * np.eye(width))).T)
    # The first vector is known: the roots of the degrees.
    now = stored(degrees.select("node", *[(F.col("root") if i == 0 else uniform(f"{seed}v{i}", "node") - 0.5).alias(c) for i, c in enumerate(names)]), "block")
    now, before = stored(orthogonal(now), "block"), np.full(width, np.inf)
    for _ in range(rounds):
        for _ in range(powers):
            now = product(now)
        now = stored(orthogonal(stored(now, "block")), "block")
        far = product(now).select("node", *[F.col(c).alias(f"to_{c}") for c in names])
        inner = products(now.join(far, "node"), names, [f"to_{c}" for c in names])
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        if np.abs(values[:k] - before[:k]).max() < tolerance:
            break
        before = values
    now = stored(turned(now, names, vectors).select("node", *names[:k]), "vectors")
    cubes = now.agg(*[F.sum(F.col(c) * F.col(c) * F.col(c)).alias(c) for c in names[:k]]).first()
    signs = np.diag([-1.0 if cubes[c] < 0 else 1.0 for c in names[:k]])
    return turned(now, names[:k], signs), [float(2 - 2 * v) for v in values[:k]]


def embedding(edges: DataFrame, k: int, seed: int = 7, **limits) -> DataFrame:
    """(sample, coord): each node's place in the k eigenvectors of the smallest values, at length 1. limits: of `eigenvectors`."""
    vectors, _ = eigenvectors(edges, k, seed, **limits)
    names = [f"x{i}" for i in range(k)]
    size = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in names]))
    return vectors.select(F.col("node").alias("sample"), F.array(*[F.when(size > 0, F.col(c) / size).otherwise(0.0) for c in names]).alias("coord"))


def spectral_clusters(edges: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(sample, cluster from 1): Spark's k-means on the embedding in k vectors."""
    ready = stored(embedding(edges, k, seed), "embedding").withColumn("features", array_to_vector("coord"))
    return KMeans(k=k, seed=seed, maxIter=50).fit(ready).transform(ready).select("sample", (F.col("prediction") + 1).alias("cluster"))
