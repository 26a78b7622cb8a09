"""Running counts over arriving clustering runs, with Structured Streaming: the sums that batch co-association takes are
commutative, so they can be kept up as runs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LISTS = "run long, cluster int, samples array<long>"


def run_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving Parquet files of (run, cluster, samples): a cluster of a run with its samples, complete in a row."""
    return spark.readStream.schema(RUN_LISTS).parquet(folder)


def pair_counts(lists: DataFrame) -> DataFrame:
    """(row_sample, col_sample, n): in how many clusters so far two samples were together."""
    pairs = lists.select("samples", F.explode("samples").alias("row_sample")).select("row_sample", F.explode("samples").alias("col_sample"))
    return pairs.groupBy("row_sample", "col_sample").agg(F.count("*").alias("n"))


def vote_counts(votes: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, feature, votes, sum_nes) of arriving votes (ts, feature, nes) by time window; rows later than `delay` go."""
    windows = votes.withWatermark("ts", delay).groupBy(F.window("ts", width), "feature").agg(F.count("*").alias("votes"), F.sum("nes").alias("sum_nes"))
    return windows.select(F.col("window.start").alias("start"), "feature", "votes", "sum_nes")


def written(counts: DataFrame, path: str, checkpoint: str):
    """The counts as a Parquet table that each batch replaces whole; the checkpoint must be in a shared folder."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()
