"""Normal mixtures of several covariance models, numbers of components and restarts at once, compared by BIC.

Each step is one pass over the rows (sample, values) for all fits that still improve: tasks add up, for every fit and
component, weights, sums and products of their rows, and Spark adds these up by (fit, position). The driver reads a fit's
sums and holds its parameters; their number depends on the fits, components and width and not on the rows.

Rows of null values are left out. Equal rows get equal clusters; components without rows keep weight 0. An empty table gives
no fits and no clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import draw_key
from tessella.sources.shared import stored

#: model: whether components share their covariances, and these' shape.
MODELS = {
    "full": (False, "full"), "diagonal": (False, "diagonal"), "spherical": (False, "spherical"),
    "shared_full": (True, "full"), "shared_diagonal": (True, "diagonal"), "shared_spherical": (True, "spherical"),
}
#: Least variance in any direction, as a share of the mean variance of all rows.
FLOOR = 1e-6


@dataclass
class Fit:
    components: int
    model: str
    restart: int
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float] = field(default_factory=list)

    def free(self) -> int:
        d, (shared, shape) = self.means.shape[1], MODELS[self.model]
        one = {"full": d * (d + 1) // 2, "diagonal": d, "spherical": 1}[shape]
        return self.components - 1 + self.components * d + one * (1 if shared else self.components)


def log_densities(fit: Fit, x: np.ndarray) -> np.ndarray:
    """Logarithms of weight times density, rows by components."""
    out = np.full((len(x), fit.components), -np.inf)
    for c in range(fit.components):
        if fit.weights[c] <= 0:
            continue
        lower = np.linalg.cholesky(fit.covariances[c])
        z = np.linalg.solve(lower, (x - fit.means[c]).T)
        out[:, c] = math.log(fit.weights[c]) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + (z * z).sum(0)) - np.log(np.diag(lower)).sum()
    return out


def totals(logs: np.ndarray) -> np.ndarray:
    top = logs.max(1)
    return top + np.log(np.exp(logs - top[:, None]).sum(1))


def sums(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """By fit: its log likelihood, then for each component the summed shares of the rows, their sums and products."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b["values"].to_numpy()).astype(float)
            for f, fit in fits.items():
                logs = log_densities(fit, x)
                each = totals(logs)
                share = np.exp(logs - each[:, None])
                products = [(share[:, c : c + 1] * x).T @ x for c in range(fit.components)]
                own = np.concatenate([[each.sum()], share.sum(0), (share.T @ x).ravel(), np.array(products).ravel()])
                found[f] = found[f] + own if f in found else own
        if found:
            yield pd.DataFrame({"fit": list(found), "v": list(found.values())})

    parts = rows.select("values").mapInPandas(run, "fit int, v array<double>")
    added = parts.select("fit", F.posexplode("v").alias("i", "v")).groupBy("fit", "i").agg(F.sum("v").alias("v"))
    out: dict[int, dict[int, float]] = {}
    for r in added.collect():
        out.setdefault(r["fit"], {})[r["i"]] = r["v"]
    return {f: np.array([v[i] for i in range(len(v))]) for f, v in out.items()}


def shaped(covariance: np.ndarray, shape: str, least: float) -> np.ndarray:
    d = len(covariance)
    if shape == "spherical":
        return np.eye(d) * max(np.trace(covariance) / d, least)
    if shape == "diagonal":
        return np.diag(np.maximum(np.diag(covariance), least))
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return (vectors * np.maximum(values, least)) @ vectors.T


def improved(fit: Fit, s: np.ndarray, least: float) -> Fit:
    """The parameters of largest likelihood for the rows' shares in s."""
    k, d = fit.means.shape
    n, total, products = s[1 : 1 + k], s[1 + k : 1 + k + k * d].reshape(k, d), s[1 + k + k * d :].reshape(k, d, d)
    shared, shape = MODELS[fit.model]
    some = n > 1e-12
    means = np.where(some[:, None], total / np.maximum(n, 1e-12)[:, None], fit.means)
    within = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    if shared:
        covariances = np.array([shaped(within[some].sum(0) / n.sum(), shape, least)] * k)
    else:
        covariances = np.array([shaped(within[c] / n[c], shape, least) if some[c] else fit.covariances[c] for c in range(k)])
    return Fit(k, fit.model, fit.restart, np.where(some, n, 0) / n.sum(), means, covariances, fit.history)


def fitted(rows: DataFrame, most: int, models: tuple[str, ...] = tuple(MODELS), restarts: int = 1, seed: int | str = 7, steps: int = 50, tolerance: float = 1e-6) -> tuple[list[Fit], int, list[float]]:
    """(fits, rows counted, the mean that was taken off): 1 to `most` components of each model from each restart. A fit begins
    with hashed samples as means and the rows' own covariances, and ends when a step gains less than `tolerance` a row."""
    rows = rows.where("values is not null").select("sample", "values")
    means = [r["m"] for r in rows.select(F.posexplode("values").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
    if not means:
        return [], 0, []
    d = len(means)
    centre = F.array(*[F.lit(m) for m in means])
    data = stored(rows.select("sample", F.zip_with("values", centre, lambda v, m: v - m).alias("values")), "mixture-rows")
    n = data.count()
    whole = sums(data, {0: Fit(1, "full", 0, np.ones(1), np.zeros((1, d)), np.eye(d)[None])})[0]
    spread = whole[2 + d :].reshape(d, d) / n
    least = FLOOR * max(np.trace(spread) / d, 1e-12)
    fits: dict[int, Fit] = {}
    for restart in range(1, restarts + 1):
        starts = data.orderBy(draw_key(f"{seed}start{restart}", "sample"), "sample").limit(most).collect()  # `most` rows
        for model in models:
            for k in range(1, min(most, len(starts)) + 1):
                first = np.array([r["values"] for r in starts[:k]]) if k > 1 else np.zeros((1, d))
                fits[len(fits)] = Fit(k, model, restart, np.full(k, 1 / k), first, np.array([shaped(spread, MODELS[model][1], least)] * k))
    live = dict(fits)
    for step in range(steps + 1):
        found = sums(data, live)
        for f, s in found.items():
            history = fits[f].history
            history.append(float(s[0]))
            if step == steps or (step and history[-1] - history[-2] < tolerance * n):
                del live[f]
            else:
                live[f] = fits[f] = improved(fits[f], s, least)
        if not live:
            break
    return list(fits.values()), n, means


def scores(rows: DataFrame, fits: list[Fit], n: int) -> DataFrame:
    """(components, model, restart, steps, log_likelihood, bic), a higher bic being better."""
    found = [(f.components, f.model, f.restart, len(f.history) - 1, f.history[-1], 2 * f.history[-1] - f.free() * math.log(n)) for f in fits]
    return rows.sparkSession.createDataFrame(found, "components int, model string, restart int, steps int, log_likelihood double, bic double")


def best_clusters(rows: DataFrame, fits: list[Fit], n: int, means: list[float]) -> DataFrame:
    """(sample, cluster from 1): each row's likeliest component in the fit of highest BIC (ties: the first)."""
    schema = f"sample {dict(rows.dtypes)['sample']}, cluster int"
    if not fits:
        return rows.sparkSession.createDataFrame([], schema)
    best, off = max(fits, key=lambda f: 2 * f.history[-1] - f.free() * math.log(n)), np.array(means)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not b.empty:
                logs = log_densities(best, np.stack(b["values"].to_numpy()).astype(float) - off)
                yield pd.DataFrame({"sample": b["sample"], "cluster": (logs.argmax(1) + 1).astype(np.int32)})

    return rows.where("values is not null").select("sample", "values").mapInPandas(run, schema)
