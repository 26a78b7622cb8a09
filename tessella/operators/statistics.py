"""Per-feature statistics of long matrices (sample, feature, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import signed_z, t_log_tail
from tessella.operators import blocks


def exact_zero(spread: Column, value: Column | str) -> Column:
    """spread, a sample variance or deviation of value, but 0 where all values are equal: when partial means of a constant
    are merged, rounding leaves a little."""
    return F.when((F.count(value) > 1) & (F.min(value) == F.max(value)), 0.0).otherwise(spread)


def moments(matrix: DataFrame, *keys: str) -> DataFrame:
    return matrix.groupBy(*(keys or ("feature",))).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), exact_zero(F.stddev_samp("value"), "value").alias("sd"))


def varying(matrix: DataFrame) -> DataFrame:
    """Without the features that do not vary."""
    kept = moments(matrix).where(F.col("sd") > 0).select("feature")
    return matrix.join(kept, "feature", "left_semi")


def top_variance(matrix: DataFrame, n: int) -> DataFrame:
    """(feature, variance, rank) of the n features that vary most; ties by feature."""
    found = matrix.groupBy("feature").agg(F.var_samp("value").alias("variance")).orderBy(F.desc("variance"), "feature").limit(n)
    return found.select("feature", "variance", F.row_number().over(Window.orderBy(F.desc("variance"), "feature")).alias("rank"))


def t_signature(test: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample, feature, t, df): each test value against the reference group, (x - mean) / (sd / sqrt(n)).

    The reference group enters by its moments: one aggregation, then a projection. Without spread t is null.
    """
    ref = moments(reference)
    t = (F.col("value") - F.col("mean")) / (F.when(F.col("sd") > 0, F.col("sd")) / F.sqrt("n"))
    return test.join(ref, "feature").select("sample", "feature", t.alias("t"), (F.col("n") - 1).alias("df"))


def z_signature(test: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample, feature, z): (x - mean) / sd of the reference group."""
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    return test.join(moments(reference), "feature").select("sample", "feature", z.alias("z"))


def signed_z_signature(test: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample, feature, z): the t signature as normal quantiles with its sign."""
    return t_signature(test, reference).select("sample", "feature", signed_z("t", F.col("df").cast("double")).alias("z"))


def welch(matrix: DataFrame) -> DataFrame:
    """(feature, t, df, log_p): Welch's test of group 1 against group 2 of matrix (sample, feature, value, grp).

    log_p is twice the log of the upper tail, signed against t; df is floored for it.
    """
    of = lambda g, f: f(F.when(F.col("grp") == g, F.col("value")))
    m = matrix.groupBy("feature").agg(*[of(g, f).alias(f"{name}{g}") for g in (1, 2) for name, f in (("n", F.count), ("m", F.avg), ("v", lambda c: exact_zero(F.var_samp(c), c)))])
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(a + b)
    df = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    found = m.where((F.col("n1") > 1) & (F.col("n2") > 1) & (a + b > 0)).select("feature", t.alias("t"), df.alias("df"))
    return found.withColumn("log_p", 2 * t_log_tail("t", F.floor("df").cast("double")) * -F.signum("t"))


def stouffer(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, total, stouffer): summed scores nes, and divided by the root of their number."""
    return scores.groupBy(*keys, "feature").agg(F.sum("nes").alias("total"), (F.sum("nes") / F.sqrt(F.count("nes"))).alias("stouffer"))


def banded(curve: DataFrame, width: float = 1.0) -> DataFrame:
    """curve (.., mean, sd) with the ends of the band of `width` deviations around the mean."""
    return curve.withColumns({"lower": F.col("mean") - width * F.col("sd"), "upper": F.col("mean") + width * F.col("sd")})


def log_normalised(counts: DataFrame) -> DataFrame:
    """(sample, feature, value): log2(x / size + 1) with median-of-ratios sizes over features that are positive throughout."""
    logs = counts.where("value > 0").withColumn("log", F.log("value"))
    whole = counts.select("sample").distinct().count()
    centre = logs.groupBy("feature").agg(F.avg("log").alias("centre"), F.count("*").alias("n")).where(F.col("n") == whole)
    sizes = logs.join(centre, "feature").groupBy("sample").agg(F.exp(F.expr("percentile(log - centre, 0.5)")).alias("size"))
    return counts.join(sizes, "sample", "left").select("sample", "feature", F.log2(F.col("value") / F.coalesce("size", F.lit(1.0)) + 1).alias("value"))


def square(x: Column) -> Column:
    return x * x


#: Samples of either side of a tile whose pairs are sorted, if a rounded number then comes so many times, and rows that go out at
#: a time. What sorting saves for the numbers it costs for the samples.
SORTED, REPEATS, BATCH = 3328, 2, 1 << 18


def rising(d: np.ndarray) -> np.ndarray:
    """The positions of d (2^24 at most) in rising order, to six decimals; NaN last. They are sorted as whole numbers, which takes a
    fraction of the time of sorting positions."""
    keys = np.fmin(d * 1e6, 2.0**38).astype(np.int64)
    keys <<= 24
    keys |= np.arange(len(d))
    keys.sort()
    keys &= (1 << 24) - 1
    return keys.astype(np.int32)


def distances(rows: DataFrame, metric: str = "euclid") -> DataFrame:
    """(a, b, dist) for a < b of rows (sample, values array): the matrix that clustering asks for, half of it. Rows that have
    a null, or not the same width, are null apart; Pearson's is NaN where a row has no spread.

    Its size is the square of the samples by definition; for neighbours use `knn`, which keeps k rows for each. Pairs are
    worked out in tiles of block pairs and not moved. Those of a large tile go out by their distance, as a file has numbers that
    come again at once, which rounded ones do, in few bytes.
    """
    kernel = {"euclid": blocks.euclid, "manhattan": blocks.manhattan, "pearson": blocks.pearson}[metric]

    def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (x, wx), (y, wy) = blocks.dense(a["values"]), blocks.dense(b["values"])
        one, two = a["sample"].to_numpy(), b["sample"].to_numpy()
        for p in np.unique(wx):
            for q in np.unique(wy):
                (i,), (j,) = np.nonzero(wx == p), np.nonzero(wy == q)
                xs, ys = x[i][:, : max(p, 0)], y[j][:, : max(q, 0)]
                for r in np.array_split(np.arange(len(i)), -(-len(i) // SORTED)):
                    for c in np.array_split(np.arange(len(j)), -(-len(j) // SORTED)):
                        yield from tile(one[i[r]], two[j[c]], xs[r], ys[c], same, p == q and p >= 0)

    def tile(ids: np.ndarray, others: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool, there: bool) -> Iterator[pa.RecordBatch]:
        if same and ids[0] >= others[-1]:
            return
        at = np.flatnonzero((ids[:, None] < others).ravel()) if same else None
        if there:
            d = np.empty((len(ids), len(others)))
            for r, c in blocks.tiles(len(ids), len(others), False):
                d[r, c] = kernel(x[r], y[c])
            d = d.ravel() if at is None else d.ravel()[at]
            if len(d) >= REPEATS * 4e6 * np.nanstd(d):  # numbers of six decimals that most of them take
                order = rising(d)
                d = d[order]
                at = order if at is None else at[order]
        at = np.arange(len(ids) * len(others)) if at is None else at
        for s in range(0, len(at), BATCH):
            row, col = np.divmod(at[s : s + BATCH], at.dtype.type(len(others)))
            u, v = ids[row], others[col]
            if not same:
                u, v = np.minimum(u, v), np.maximum(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d[s : s + BATCH]) if there else pa.nulls(len(u), pa.float64())], ["a", "b", "dist"])

    kind = dict(rows.dtypes)["sample"]
    return blocks.pairs(rows.select("sample", "values"), run, f"a {kind}, b {kind}, dist double")
