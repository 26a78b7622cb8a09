"""Regulator activity from feature scores and networks (network_id, regulator, target, tfmode, likelihood)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import average_rank, normal_quantile
from tessella.operators.resampling import permuted_labels


def pruned(network: DataFrame, most: int) -> DataFrame:
    """The `most` likeliest targets of each regulator; ties by target."""
    w = Window.partitionBy("network_id", "regulator").orderBy(F.desc("likelihood"), "target")
    return network.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def activity(scores: DataFrame, network: DataFrame, least: int = 1) -> DataFrame:
    """(network_id, regulator, sample, nes) of scores (sample, feature, value), by rank-based enrichment.

    Ranks within a sample become normal quantiles, of the rank for signed targets and of its distance from the middle for
    unsigned ones. With weights w = likelihood / its maximum, s2 = sum(tfmode w q2) / sum(w), s1 = sum((1 - |tfmode|) w
    q1) / sum(w): the enrichment (|s2| + max(s1, 0)) sign(s2), times sqrt(sum(w^2)). Regulators with fewer than `least`
    scored targets are left out. One window, one join on the target, one aggregation.
    """
    n = F.count("value").over(Window.partitionBy("sample"))
    ranked = scores.where("value is not null").select("sample", "feature", (average_rank(F.col("value"), "sample") / (n + 1)).alias("p"))
    ranked = ranked.withColumn("q2", normal_quantile("p"))
    middle = F.abs(F.col("p") - 0.5) * 2
    top = F.max("middle").over(Window.partitionBy("sample"))
    ranked = ranked.withColumn("middle", middle).withColumn("q1", normal_quantile(F.col("middle") + (1 - top) / 2))
    weights = network.withColumn("w", F.col("likelihood") / F.max("likelihood").over(Window.partitionBy("network_id", "regulator")))
    rows = weights.join(ranked, weights["target"] == ranked["feature"])
    sums = rows.groupBy("network_id", "regulator", "sample").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"),
        F.sum(F.col("tfmode") * F.col("w") * F.col("q2")).alias("s2"), F.sum((1 - F.abs("tfmode")) * F.col("w") * F.col("q1")).alias("s1"),
    ).where(F.col("n") >= least)
    s1, s2 = F.col("s1") / F.col("w"), F.col("s2") / F.col("w")
    sign = F.when(s2 < 0, -1.0).otherwise(1.0)
    return sums.select("network_id", "regulator", "sample", ((F.abs(s2) + F.greatest(s1, F.lit(0.0))) * sign * F.col("size")).alias("nes"))


def correlation_network(matrix: DataFrame, parts: int = 1) -> DataFrame:
    """Networks from a long matrix (sample, feature, value): every feature regulates every other with their correlation as
    tfmode and its size as likelihood; one network for each part of the samples."""
    rows = matrix.withColumn("network_id", F.pmod("sample", F.lit(parts)).cast("int"))
    lists = rows.groupBy("network_id", "sample").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("x"))
    pairs = lists.select("network_id", "x", F.explode("x").alias("a")).select("network_id", "a", F.explode("x").alias("b"))
    pairs = pairs.select("network_id", F.col("a.feature").alias("regulator"), F.col("b.feature").alias("target"), F.col("a.value").alias("p"), F.col("b.value").alias("q"))
    found = pairs.where("regulator <> target").groupBy("network_id", "regulator", "target").agg(F.corr("p", "q").alias("tfmode"))
    return found.select("network_id", "regulator", "target", "tfmode", F.abs("tfmode").alias("likelihood"))


def group_signature(matrix: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(sample, feature, value): Welch's t of group 1 against group 2 of members (key, sample, grp), with the key as sample."""
    of = lambda g, f: f(F.when(F.col("grp") == g, F.col("value")))
    rows = matrix.join(members.select(key, F.col("sample").alias("member"), "grp"), F.col("sample") == F.col("member"))
    m = rows.groupBy(key, "feature").agg(*[of(g, f).alias(f"{name}{g}") for g in (1, 2) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    spread = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    return m.where(spread > 0).select(F.col(key).alias("sample"), "feature", ((F.col("m1") - F.col("m2")) / F.sqrt(spread)).alias("value"))


def activity_against_null(matrix: DataFrame, members: DataFrame, network: DataFrame, count: int, seed: int | str) -> DataFrame:
    """(network_id, regulator, nes, null_mean, null_sd, z): activity of the signature of group 1 against group 2, and how
    many standard deviations it lies from that of `count` signatures of permuted labels. The replicate is a key beside the
    features; replicate 0 has the true labels. z is null where the null has no spread."""
    permuted = permuted_labels(members, count, seed).select("replicate", "sample", F.col("pseudo").alias("grp"))
    labels = members.select(F.lit(0).alias("replicate"), "sample", "grp").unionByName(permuted)
    found = activity(group_signature(matrix, labels, "replicate"), network)
    null = lambda f: f(F.when(F.col("sample") > 0, F.col("nes")))
    out = found.groupBy("network_id", "regulator").agg(F.max(F.when(F.col("sample") == 0, F.col("nes"))).alias("nes"), null(F.avg).alias("null_mean"), null(F.stddev_samp).alias("null_sd"))
    return out.withColumn("z", (F.col("nes") - F.col("null_mean")) / F.when(F.col("null_sd") > 0, F.col("null_sd")))
