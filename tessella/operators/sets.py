"""Set algebra over cohorts (name, sample)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect_all(*cohorts: DataFrame) -> DataFrame:
    """Rows that all cohorts have, once each; one cohort alone gives itself."""
    if not cohorts:
        raise ValueError("at least one cohort")
    return reduce(DataFrame.intersect, cohorts[1:], cohorts[0].distinct())


def in_all(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Samples that are in every named cohort of members (name, sample): one aggregation for any number of cohorts."""
    found = members.select("name", "sample").distinct()
    n = (names if names is not None else found).select("name").distinct().count()
    if names is not None:
        found = found.join(names.select("name").distinct(), "name", "left_semi")
    return found.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") == n).select("sample")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b has not, once each."""
    return a.subtract(b)


def bag_union(*cohorts: DataFrame) -> DataFrame:
    """All rows, repeats included."""
    return reduce(DataFrame.unionByName, cohorts)
