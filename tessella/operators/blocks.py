"""All pairs of samples as pairs of blocks: a pair is one task's, and a tile of it is worked out and passed on at a time.

Samples are dealt to blocks by a hash, as many blocks as the rows need; each sample goes once to each pair that its block
is in, and no pair of samples is moved. The tasks are given by number, as Spark would else put pairs of blocks together by
their bytes, which are few beside the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 16_384
LEAST = 16  # blocks of a small table, so that all cores have pairs
TILE = (256, 2048)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


def pairs(rows: DataFrame, kernel: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK, least: int = LEAST, parts: int | None = None, by: Column | None = None) -> DataFrame:
    """What kernel(a, b, same) yields for each two blocks of rows (sample, ...), each two once; same: they are one block. parts:
    the number of tasks. by: what deals a row to its block, if not the sample."""
    number = rows.agg(F.greatest(F.lit(least), F.ceil(F.count("*") / F.lit(float(block)))).cast("int").alias("blocks"))  # one row
    placed = rows.crossJoin(F.broadcast(number)).withColumn("own", F.pmod(F.xxhash64("sample") if by is None else by, F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = placed.select("*", other.alias("other")).drop("blocks")
    dealt = sides.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), *rows.columns)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)).sort_by("sample")
        if key[0].as_py() == key[1].as_py():
            yield from kernel(found, found, True)
        elif (b := found.filter(pc.field("second"))).num_rows and (a := found.filter(~pc.field("second"))).num_rows:
            yield from kernel(a, b, False)

    return dealt.repartition(parts or tasks(rows.sparkSession), "p", "q").groupBy("p", "q").applyInArrow(run, schema)


def tiles(a: int, b: int, same: bool) -> Iterator[tuple[slice, slice]]:
    """Parts of a times b; of one block with itself only those that hold the diagonal or lie above it."""
    for i in range(0, a, TILE[0]):
        for j in range(0, b, TILE[1]):
            if not same or j + TILE[1] > i:
                yield slice(i, min(a, i + TILE[0])), slice(j, min(b, j + TILE[1]))


def dense(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, width) of lists of numbers: shorter ones are filled with 0; a list that is null or has a null has width -1."""
    lists = lists.combine_chunks()
    width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = lists.flatten()
    of = np.repeat(np.arange(len(width)), width)
    out = np.zeros((len(width), width.max(initial=0)))
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    lost = pc.is_null(lists).to_numpy(zero_copy_only=False).copy()
    lost[of[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = True
    return out, np.where(lost, -1, width)


def euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between the rows of x and of y. Products give the squares, but where these are small beside the rows
    themselves, they are sums of squared differences, so that copies are 0 apart."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    whole = xx[:, None] + yy
    out = x @ y.T
    out *= -2
    out += whole
    i, j = np.nonzero(~(out >= 1e-2 * whole))
    for s in range(0, len(i), 1 << 14):
        at = slice(s, s + (1 << 14))
        out[i[at], j[at]] = ((x[i[at]] - y[j[at]]) ** 2).sum(1)
    return np.sqrt(out, out=out)


#: Widths up to which distances are sums of squared differences straight away, which take less than a product and its checks.
NARROW = 4


def euclid_tiles(x: np.ndarray, y: np.ndarray) -> Callable[..., np.ndarray]:
    """A function of two slices (and where to put the result): `euclid` of these rows of x and of y, whose squares come from one
    product; as there, those that are small beside the rows (here the largest of the tile) are sums of squared differences, and
    in narrow rows all are."""
    if 1 <= x.shape[1] <= NARROW:
        p, q = np.ascontiguousarray(x.T)[..., None], np.ascontiguousarray(y.T)

        def narrow(i: slice, j: slice, out: np.ndarray | None = None) -> np.ndarray:
            out = np.subtract(p[0, i], q[0, j], out=out)
            np.square(out, out=out)
            for f in range(1, len(p)):
                gap = p[f, i] - q[f, j]
                out += np.square(gap, out=gap)
            return np.sqrt(out, out=out)

        return narrow
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left, right = np.column_stack([-2 * x, xx, np.ones(len(x))]), np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), yy]).T)

    def tile(i: slice, j: slice, out: np.ndarray | None = None) -> np.ndarray:
        out = np.matmul(left[i], right[:, j], out=out)
        least = 1e-2 * (xx[i].max(initial=0) + yy[j].max(initial=0))
        near = np.flatnonzero(~(out >= least)) if not out.min(initial=np.inf) >= least else ()
        for s in range(0, len(near), 1 << 14):
            at = near[s : s + (1 << 14)]
            p, q = np.divmod(at, out.shape[1])
            out[p, q] = ((x[i][p] - y[j][q]) ** 2).sum(1)
        return np.sqrt(out, out=out)

    return tile


def summed_gaps(x: np.ndarray, y: np.ndarray, of: np.ufunc, out: np.ndarray | None = None) -> np.ndarray:
    """The sums of `of` the differences between all rows of x and of y."""
    out = np.empty((len(x), len(y))) if out is None else out
    gap, out[...] = np.empty(out.shape), 0
    for f in range(x.shape[1]):
        np.subtract(x[:, f, None], y[None, :, f], out=gap)
        out += of(gap, out=gap)
    return out


def manhattan(x: np.ndarray, y: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    return summed_gaps(x, y, np.abs, out)


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - r; NaN where a row has no spread."""
    unit = []
    for m in (x, y):
        m = m - m.mean(1, keepdims=True)
        size = np.sqrt((m * m).sum(1, keepdims=True))
        unit.append(np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0))
    return 1 - unit[0] @ unit[1].T
