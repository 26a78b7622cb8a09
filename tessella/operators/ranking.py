"""Ranking features and judging rankings: rank orders, ROC areas, selection rules, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import average_rank, normal_upper_tail


def ranked(scores: DataFrame, how: str = "signed", *keys: str) -> DataFrame:
    """scores (keys, feature, score) with rank: by score, by size ('abs'), by rising size ('weak'), or 'interleaved': the
    largest, the smallest, the second largest, and so on, each feature once."""
    of = Window.partitionBy(*keys)
    if how in ("signed", "abs", "weak"):
        order = {"signed": F.desc("score"), "abs": F.desc(F.abs("score")), "weak": F.asc(F.abs("score"))}[how]
        return scores.withColumn("rank", F.row_number().over(of.orderBy(order, "feature")))
    if how != "interleaved":
        raise ValueError(f"no order {how}")
    both = scores.withColumn("top", F.row_number().over(of.orderBy(F.desc("score"), "feature"))).withColumn("n", F.count(F.lit(1)).over(of))
    low = F.col("n") - F.col("top") + 1
    place = F.when(F.col("top") <= low, 2 * F.col("top") - 1).otherwise(2 * low)
    return both.withColumn("rank", place.cast("int")).drop("top", "n")


def rank_sums(scores: DataFrame) -> DataFrame:
    """(feature, n_networks, rank_sum, rank) of scores (network, feature, score): ranks by falling score, ties averaged,
    summed over the networks; features that some network lacks are left out."""
    n = scores.select("network").distinct().count()
    ranks = scores.withColumn("r", average_rank(-F.col("score"), "network"))
    sums = ranks.groupBy("feature").agg(F.count("*").alias("n_networks"), F.sum("r").alias("rank_sum")).where(F.col("n_networks") == n)
    return sums.withColumn("rank", F.row_number().over(Window.orderBy("rank_sum", "feature")))


def mean_of_means(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, n_networks, mean) of scores (keys, network, feature, score): the mean over networks of each one's mean,
    so that a network with more scores weighs no more."""
    each = scores.groupBy(*keys, "network", "feature").agg(F.avg("score").alias("m"))
    return each.groupBy(*keys, "feature").agg(F.count("*").alias("n_networks"), F.avg("m").alias("mean"))


def auc(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc) of predictions (keys, truth 0/1, score), by rank sums; null where a class is absent."""
    rows = predictions.withColumn("r", average_rank(F.col("score"), *keys))
    one = F.col("truth") == 1
    sums = rows.groupBy(*keys).agg(F.sum(F.when(one, F.col("r"))).alias("s"), F.count(F.when(one, 1)).alias("n_pos"), F.count(F.when(~one, 1)).alias("n_neg"))
    area = (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("n_pos") * F.col("n_neg"))
    return sums.select(*keys, "n_pos", "n_neg", area.alias("auc"))


def roc(predictions: DataFrame, *keys: str) -> DataFrame:
    """(keys, threshold, sensitivity, specificity): scores at or above the threshold count as positive."""
    at = predictions.groupBy(*keys, F.col("score").alias("threshold")).agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
    down = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    whole = Window.partitionBy(*keys)
    return at.select(
        *keys, "threshold", (F.sum("pos").over(down) / F.sum("pos").over(whole)).alias("sensitivity"),
        (1 - F.sum("neg").over(down) / F.sum("neg").over(whole)).alias("specificity"),
    )


def partial_auc(predictions: DataFrame, low: float, high: float, *keys: str, correct: bool = True) -> DataFrame:
    """(keys, pauc): the area over specificities in [low, high], rescaled so that chance is 0.5 and the best 1."""
    curve = roc(predictions, *keys)
    start = curve.select(*keys, F.lit(1.0).alias("specificity"), F.lit(0.0).alias("sensitivity")).distinct()
    points = curve.select(*keys, "specificity", "sensitivity").unionByName(start)
    w = Window.partitionBy(*keys).orderBy(F.desc("specificity"), "sensitivity")
    seg = points.withColumn("x0", F.lag("specificity").over(w)).withColumn("y0", F.lag("sensitivity").over(w)).where("x0 > specificity")
    a, b = F.least(F.col("x0"), F.lit(high)), F.greatest(F.col("specificity"), F.lit(low))
    y = lambda x: F.col("y0") + (F.col("sensitivity") - F.col("y0")) * (F.col("x0") - x) / (F.col("x0") - F.col("specificity"))
    area = seg.withColumn("part", F.when(a > b, (a - b) * (y(a) + y(b)) / 2).otherwise(0.0)).groupBy(*keys).agg(F.sum("part").alias("area"))
    least, most = ((1 - low) ** 2 - (1 - high) ** 2) / 2, high - low
    value = (1 + (F.col("area") - least) / (most - least)) / 2 if correct else F.col("area")
    return area.select(*keys, value.alias("pauc"))


def curves(aucs: DataFrame, *keys: str) -> DataFrame:
    """One row per (keys, n_features): mean of the test areas, and mean and deviation of both controls, with the p values
    of the mean under each control's normal. aucs: (keys, kind test/neg/null, n_features, replicate, auc)."""
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("auc")))
    m = aucs.groupBy(*keys, "n_features").agg(
        of("test", F.avg).alias("mean_auc"), of("neg", F.avg).alias("neg_mean"), of("neg", F.stddev_samp).alias("neg_sd"),
        of("null", F.avg).alias("null_mean"), of("null", F.stddev_samp).alias("null_sd"),
    )
    return m.withColumns({"p_neg": normal_upper_tail(F.col("mean_auc"), F.col("neg_mean"), F.col("neg_sd")), "p_null": normal_upper_tail(F.col("mean_auc"), F.col("null_mean"), F.col("null_sd"))})


def inverted(aucs: DataFrame, share: float = 0.7, *keys: str) -> DataFrame:
    """aucs with all areas x of a key turned to 1 - x where more than `share` of its mean test areas are under 0.5."""
    tests = aucs.where("kind = 'test'").groupBy(*keys, "n_features").agg(F.avg("auc").alias("m"))
    flip = tests.groupBy(*keys).agg((F.avg(F.when(F.col("m") < 0.5, 1.0).otherwise(0.0)) > share).alias("inverted"))
    return aucs.join(flip, list(keys)).withColumn("auc", F.when(F.col("inverted"), 1 - F.col("auc")).otherwise(F.col("auc")))


def acceptable(threshold: float, use_null: bool = True):
    ok = F.col("mean_auc") >= F.col("neg_mean")
    return F.coalesce(ok & (F.col("mean_auc") >= F.col("null_mean")) & (F.col("p_null") < threshold) if use_null else ok, F.lit(False))


def prefix_size(curve: DataFrame, threshold: float = 0.05, use_null: bool = True, *keys: str) -> DataFrame:
    """(keys, size): the last n before a size that fails, from the smallest on; 0 if the first fails."""
    w = Window.partitionBy(*keys).orderBy("n_features").rowsBetween(Window.unboundedPreceding, 0)
    good = F.min(F.when(acceptable(threshold, use_null), 1).otherwise(0)).over(w)
    return curve.withColumn("good", good).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("good") == 1, F.col("n_features"))), F.lit(0)).cast("int").alias("size"))


def difference_size(curve: DataFrame, threshold: float = 0.05, *keys: str) -> DataFrame:
    """(keys, size): the size of the least p value against the null but the very first, that is good; 0 if none."""
    w = Window.partitionBy(*keys).orderBy("p_null", "n_features")
    good = (F.col("place") >= 2) & (F.col("mean_auc") >= F.col("neg_mean")) & (F.col("p_null") < threshold)
    rows = curve.where("p_null is not null").withColumn("place", F.row_number().over(w))
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(good, F.col("n_features")), F.when(good, F.col("place"))), F.lit(0)).cast("int").alias("size"))


def first_failure_size(curve: DataFrame, threshold: float = 0.05, *keys: str) -> DataFrame:
    """(keys, size): sizes up to before the first p value (column p) over the threshold; all of them if none is."""
    cut = F.min(F.when(F.col("p") > threshold, F.col("n_features")))
    return curve.groupBy(*keys).agg(F.coalesce(cut - 1, F.max("n_features")).cast("int").alias("size"))


def votes(rankings: DataFrame, sizes: DataFrame, keys: list[str], *group: str) -> DataFrame:
    """(group, feature, votes, mean_nes, sum_nes, rank): how often a feature is among the first `size` of a ranking
    (keys, feature, rank, nes), over the keys that are not in group."""
    kept = rankings.join(sizes, keys).where(F.col("rank") <= F.col("size"))
    found = kept.groupBy(*group, "feature").agg(F.count("*").alias("votes"), F.avg("nes").alias("mean_nes"), F.sum("nes").alias("sum_nes"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("votes"), F.desc("mean_nes"), "feature")))
