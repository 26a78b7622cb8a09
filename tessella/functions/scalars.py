"""Column functions: hashed draws, ranks, distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def draw_key(seed: int | str, *columns: Column | str) -> Column:
    """A hash to order rows by: the same on any partitioning, and in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A hashed number in [0, 1) with 32 bits."""
    return F.conv(F.substring(draw_key(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def average_rank(value: Column, *keys: str) -> Column:
    """Rank by rising value within keys, ties averaged."""
    of = Window.partitionBy(*keys)
    return F.rank().over(of.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def normal_upper_tail(x: Column, mean: Column, sd: Column) -> Column:
    """P(N(mean, sd) > x); with no spread 0 where x reaches the mean, else 1; null stays null."""
    z = (x - mean) / F.when(sd > 0, sd)
    return F.when(sd.isNull() | x.isNull() | mean.isNull(), None).when(sd <= 0, F.when(x >= mean, 0.0).otherwise(1.0)).otherwise(normal_tail(z))


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Infinite at 0 and 1."""
    inv = NormalDist().inv_cdf
    return p.map(lambda v: None if v is None or v != v else -math.inf if v <= 0 else math.inf if v >= 1 else inv(v))


def log_t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log P(T > |t|): half of the incomplete beta I_x(df / 2, 1 / 2) at x = df / (df + t^2), by its continued fraction."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    a, b = df / 2, np.full_like(df, 0.5)
    x = df / (df + t * t)
    near = x >= (a + 1) / (a + b + 2)  # there the fraction for the other side is used
    a, b, y = np.where(near, b, a), np.where(near, a, b), np.where(near, 1 - x, x)
    y = np.where(near, t * t / (df + t * t), y)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(y) + b * np.log1p(-y) - np.log(a)
        c, d = np.ones_like(y), 1 / (1 - (a + b) * y / (a + 1))
        h = d.copy()
        for m in range(1, 300):
            up = m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / (1 + up * d), 1 + up / c
            h = h * d * c
            down = -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / (1 + down * d), 1 + down / c
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        part = front + np.log(h)
        whole = np.where(near, np.log1p(-np.exp(np.minimum(part, 0))), part)
    return np.where(t == 0, 0.0, whole) - math.log(2)


@F.pandas_udf(DoubleType())
def t_log_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = log_t_tail(t[ok].to_numpy(), df[ok].to_numpy())
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def signed_z(t: pd.Series, df: pd.Series) -> pd.Series:
    """The normal quantile with the tail that t has, with t's sign; beyond what doubles hold the tail's asymptote is used."""
    inv = NormalDist().inv_cdf

    def one(log_p: float) -> float:
        if log_p > -700:
            return -inv(min(0.5, math.exp(log_p)))
        z = math.sqrt(-2 * log_p)
        for _ in range(20):  # log of the normal tail ~ -z^2 / 2 - log(z sqrt(2 pi))
            z = math.sqrt(-2 * (log_p + math.log(z * math.sqrt(2 * math.pi))))
        return z

    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        tails = log_t_tail(t[ok].to_numpy(), df[ok].to_numpy())
        out[ok] = [math.copysign(one(p), v) if v else 0.0 for p, v in zip(tails, t[ok], strict=True)]
    return out.where(ok, None)
