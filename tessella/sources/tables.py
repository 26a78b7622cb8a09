"""Reading measurements as long tables: one row for each (feature, sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long_from_arrays(rows: DataFrame, sample: str = "vec_id", values: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample, feature, value, *keep) from rows that hold a sample's features as an array; a null element stays null."""
    exploded = rows.select(F.col(sample).alias("sample"), *keep, F.posexplode(values).alias("feature", "value"))
    return exploded.select("sample", "feature", F.col("value").cast("double").alias("value"), *keep)


def long_from_text(spark: SparkSession, path: str, id_column: str = "feature") -> DataFrame:
    """(feature, sample, value) from a tab-separated matrix whose header names the samples and whose first column names
    the features. Names are values here, so they are kept as they are written."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *samples = wide.columns
    typed = wide.select(F.col(f"`{first}`").alias(id_column), *[F.col(f"`{s}`").cast("double").alias(s) for s in samples])
    return typed.unpivot([id_column], [F.col(f"`{s}`") for s in samples], "sample", "value") if samples else typed


def wide(matrix: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One row per `row`, one column for each of `columns`, summed. The columns are named, so no job looks for them."""
    return matrix.groupBy(row).pivot(column, columns).agg(F.sum(value))


def write_results(results: DataFrame, path: str, keys: tuple[str, ...] = ("pipeline_iter", "fold", "cluster")) -> None:
    """Results of some keys replace those of the same keys; reading prunes by key."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results that are there; files that vanish meanwhile are passed over."""
    return spark.read.option("ignoreMissingFiles", True).parquet(path)
