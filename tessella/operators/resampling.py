"""Reproducible resampling of members (sample, grp): draws are orders by a hash of seed, keys and sample, so folds do not
depend on partitions or on the order of rows, and any engine with md5 draws the same.

All functions take members with columns sample and grp (1 or 2) and return fold, role, grp, sample (and copy_no where a
sample may be drawn more than once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import draw_key


FOLDS, ROWS = 4096, 16_000_000


def ordered(members: DataFrame, seed: int | str, *keys: str) -> DataFrame:
    """members with rn, the place of a sample in the hashed order within keys, and n, the size of its keys."""
    w = Window.partitionBy(*keys)
    hashed = draw_key(seed, *keys, "sample")
    return members.withColumn("rn", F.row_number().over(w.orderBy(hashed, "sample"))).withColumn("n", F.count(F.lit(1)).over(w))


def numbered(members: DataFrame, seed: int | str) -> DataFrame:
    """members with rn, the place of a sample in the hashed order of all, and n, their number. The order is cut at the first
    three digits of the hash, each of the 4,096 parts is numbered by itself and begins where those before it end."""
    hashed = members.withColumn("_hash", draw_key(seed, F.lit(0), "sample")).withColumn("_part", F.substring("_hash", 1, 3))
    sizes = hashed.groupBy("_part").agg(F.count("*").alias("size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the 4,096 sizes only
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"), F.sum("size").over(whole).alias("n"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_hash", "sample"))
    return hashed.join(F.broadcast(starts), "_part").withColumn("rn", F.col("_before") + within).drop("_hash", "_part", "_before")


def pick(n: Column, seed: str, *columns: str) -> Column:
    """A hashed number from 1 to n."""
    return F.pmod(F.conv(F.substring(draw_key(seed, *columns), 1, 8), 16, 10).cast("long"), n) + 1


def folds_of(members: DataFrame, count: int) -> DataFrame:
    return members.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(count))))


def roles(rows: DataFrame, valid: Column, *more: str) -> DataFrame:
    return rows.select("fold", F.when(valid, "valid").otherwise("train").alias("role"), "grp", "sample", *more)


def k_fold(members: DataFrame, k: int, seed: int | str) -> DataFrame:
    """Validation sets of n div k samples that do not overlap; the n mod k samples left over are only trained on."""
    rows = folds_of(numbered(members, seed), k)
    return roles(rows, F.floor((F.col("rn") - 1) / F.floor(F.col("n") / k)) + 1 == F.col("fold"))


def leave_one_out(members: DataFrame, seed: int | str) -> DataFrame:
    """As many folds as samples. The rows are quadratic in the samples, as the scheme is, and so are the tasks: each makes some
    ROWS of them, from chunks of FOLDS folds of a sample. The driver reads the number of samples."""
    n, spark = members.count(), members.sparkSession
    rows = numbered(members, seed).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / FOLDS))))
    rows = rows.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-n * n // ROWS)), "sample", "chunk")
    rows = rows.withColumn("fold", F.explode(F.expr(f"sequence(cast(chunk * {FOLDS} + 1 as int), cast(least(n, (chunk + 1) * {FOLDS}) as int))")))
    return roles(rows, F.col("rn") == F.col("fold"))


def balanced_size(members: DataFrame) -> DataFrame:
    """m: the size of the smaller group, with each member."""
    least = members.groupBy("grp").agg(F.count("*").alias("size")).agg(F.min("size").alias("m"))
    return members.crossJoin(F.broadcast(least))  # one row


def k_fold_balanced(members: DataFrame, k: int, seed: int | str) -> DataFrame:
    """Of each group a subset of the smaller group's size m is split into k folds of m div k; what is left over of the
    subset is only trained on, what is beyond it is not used. Groups of one size are used whole."""
    rows = folds_of(ordered(balanced_size(members), seed, "grp").where(F.col("rn") <= F.col("m")), k)
    return roles(rows, F.floor((F.col("rn") - 1) / F.floor(F.col("m") / k)) + 1 == F.col("fold"))


def k_fold_oversampled(members: DataFrame, k: int, seed: int | str) -> DataFrame:
    """k folds of each group (n div k samples each, what is left over is only trained on); in each fold training samples of
    the smaller group are drawn again, with replacement, up to the larger one's number. copy_no is 0 for the samples
    themselves and counts the draws; what is validated is never drawn."""
    rows = folds_of(ordered(members, seed, "grp"), k).withColumn("size", F.floor(F.col("n") / k))
    valid = F.floor((F.col("rn") - 1) / F.col("size")) + 1 == F.col("fold")
    place = F.when(F.col("rn") <= (F.col("fold") - 1) * F.col("size"), F.col("rn")).otherwise(F.col("rn") - F.col("size"))
    rows = rows.select("fold", F.when(valid, "valid").otherwise("train").alias("role"), "grp", "sample", place.cast("long").alias("place"))
    train = rows.where("role = 'train'")
    sizes = train.groupBy("fold", "grp").agg(F.count("*").alias("own"))
    short = sizes.withColumn("most", F.max("own").over(Window.partitionBy("fold"))).where("own < most")
    draws = short.withColumn("copy_no", F.explode(F.expr("sequence(1, cast(most - own as int))")))
    draws = draws.select("fold", "grp", "copy_no", pick(F.col("own"), f"{seed}o", "fold", "grp", "copy_no").alias("place"))
    more = draws.join(train, ["fold", "grp", "place"]).select("fold", "role", "grp", "sample", "copy_no")
    return rows.select("fold", "role", "grp", "sample", F.lit(0).alias("copy_no")).union(more)


def three_way(members: DataFrame, test: float, valid: float, seed: int | str) -> DataFrame:
    """(sample, grp, role): of each group floor(n * test) samples to test, floor(n * valid) to validate, the rest to train."""
    rows, first = ordered(members, seed, "grp"), F.floor(F.col("n") * F.lit(test))
    role = F.when(F.col("rn") <= first, "test").when(F.col("rn") <= first + F.floor(F.col("n") * F.lit(valid)), "valid").otherwise("train")
    return rows.select("sample", "grp", role.alias("role"))


def monte_carlo_balanced(members: DataFrame, count: int, fraction: float, seed: int | str) -> DataFrame:
    """Per fold and group floor(m * fraction) samples to validate and m less that to train, without replacement."""
    rows = ordered(folds_of(balanced_size(members), count), seed, "fold", "grp").where(F.col("rn") <= F.col("m"))
    return roles(rows, F.col("rn") <= F.floor(F.col("m") * F.lit(fraction)))


def monte_carlo_with_replacement(members: DataFrame, count: int, fraction: float, seed: int | str) -> DataFrame:
    """Per fold floor(n * fraction) draws to validate, and n less that draws from the samples not drawn, with replacement."""
    rows = numbered(members, seed).select("sample", "grp", "rn", "n")
    total = rows.agg(F.count("*").alias("n"))
    size = F.floor(F.col("n") * F.lit(fraction))
    draws = total.select("n", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("fold"), size.cast("int").alias("size"))
    valid = draws.where("size > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("size")))).withColumn("rn", pick(F.col("n"), f"{seed}v", "fold", "copy_no"))
    drawn = valid.select("fold", "rn").distinct()
    rest = folds_of(rows.select("rn"), count).join(drawn, ["fold", "rn"], "left_anti")
    w = Window.partitionBy("fold")
    rest = rest.withColumn("place", F.row_number().over(w.orderBy("rn"))).withColumn("left", F.count(F.lit(1)).over(w))
    train = draws.withColumn("copy_no", F.explode(F.expr("sequence(1, cast(n - size as int))"))).join(rest.select("fold", "left").distinct(), "fold").withColumn("place", pick(F.col("left"), f"{seed}t", "fold", "copy_no"))
    train = train.join(rest.select("fold", "place", "rn"), ["fold", "place"])
    both = valid.select("fold", F.lit("valid").alias("role"), "rn", "copy_no").union(train.select("fold", F.lit("train"), "rn", "copy_no"))
    return both.join(rows.select("rn", "grp", "sample"), "rn").select("fold", "role", "grp", "sample", "copy_no")


def balanced_strata(members: DataFrame, count: int, stratum: str, seed: int | str) -> DataFrame:
    """Per fold as many samples of each (group, stratum) to train as the smallest has; all others validate."""
    rows = ordered(folds_of(members, count), seed, "fold", "grp", stratum)
    least = members.groupBy("grp", stratum).agg(F.count("*").alias("size")).agg(F.min("size").alias("least"))
    rows = rows.crossJoin(F.broadcast(least))
    return roles(rows, F.col("rn") > F.col("least"), stratum)


def holdouts(members: DataFrame, fraction: float, seed: int | str) -> DataFrame:
    """(pipeline_iter, grp, sample): sets of floor(fraction * n) of each group, which never overlap, for 1 / fraction
    iterations."""
    times = round(1 / fraction)
    if abs(1 / fraction - times) > 1e-9:
        raise ValueError("1 / fraction must be whole")
    rows = ordered(members, seed, "grp").withColumn("size", F.floor(F.col("n") / times))
    rows = rows.withColumn("pipeline_iter", (F.floor((F.col("rn") - 1) / F.col("size")) + 1).cast("int"))
    return rows.where(F.col("pipeline_iter") <= times).select("pipeline_iter", "grp", "sample")


def without_holdout(folds: DataFrame, held: DataFrame) -> DataFrame:
    """Folds (pipeline_iter, ...) without the samples held out in the same iteration."""
    return folds.join(held.select("pipeline_iter", "sample"), ["pipeline_iter", "sample"], "left_anti")


def permuted_labels(members: DataFrame, count: int, seed: int | str) -> DataFrame:
    """(replicate, sample, grp, pseudo): pseudo-groups of the true groups' sizes that complement each other."""
    rows = members.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(count))))
    first = F.sum(F.when(F.col("grp") == 1, 1).otherwise(0)).over(Window.partitionBy("replicate"))
    rows = ordered(rows, seed, "replicate").withColumn("first", first)
    return rows.select("replicate", "sample", "grp", F.when(F.col("rn") <= F.col("first"), 1).otherwise(2).alias("pseudo"))


def random_features(features: DataFrame, count: int, seed: int | str) -> DataFrame:
    """(replicate, feature, rank): all features in a random order for each replicate, as a negative control."""
    rows = features.select("feature").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(count))))
    w = Window.partitionBy("replicate").orderBy(draw_key(seed, "replicate", "feature"), "feature")
    return rows.select("replicate", "feature", F.row_number().over(w).alias("rank"))


def subsampled_runs(samples: DataFrame, runs: int, fraction: float, seed: int | str) -> DataFrame:
    """(run, sample): round(fraction * n) samples, half to even, for each run."""
    rows = samples.select("sample").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return ordered(rows, seed, "run").where(F.col("rn") <= F.bround(F.col("n") * F.lit(fraction))).select("run", "sample")


def drawn_runs(samples: DataFrame, runs: int, fraction: float, seed: int | str) -> DataFrame:
    """(run, copy_no, sample): round(fraction * n) draws with replacement, half to even, for each run."""
    rows = numbered(samples.select("sample"), seed)
    each = rows.agg(F.count("*").alias("n")).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).repartition("run")
    draws = each.withColumn("size", F.bround(F.col("n") * F.lit(fraction)).cast("int")).where("size > 0")
    draws = draws.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("size"))))
    return draws.select("run", "copy_no", pick(F.col("n"), f"{seed}r", "run", "copy_no").alias("rn")).join(rows.select("rn", "sample"), "rn").select("run", "copy_no", "sample")
