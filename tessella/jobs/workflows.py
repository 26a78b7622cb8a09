"""Whole workflows as functions of tables: supervised selection with held-out tests, and consensus clustering.

Every step is a DataFrame keyed by (pipeline_iter, fold); nothing is passed through files, and all iterations and folds
run in one application.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import draw_key
from tessella.operators import classify, consensus, ranking, resampling, statistics

KEYS = ("pipeline_iter", "fold")


@dataclass(frozen=True)
class Settings:
    folds: int = 5
    holdout: float = 0.25
    replicates: int = 5
    sizes: tuple[int, ...] = tuple(range(2, 51))
    method: str = "lda"
    threshold: float = 0.05
    order: str = "abs"
    seed: int = 7


def folds_with_holdout(members: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(held, folds): disjoint held-out sets, and per iteration k folds of the rest; no held-out sample is in a fold."""
    held = resampling.holdouts(members, settings.holdout, settings.seed)
    rest = members.crossJoin(held.select("pipeline_iter").distinct()).join(held.select("pipeline_iter", "sample"), ["pipeline_iter", "sample"], "left_anti")
    placed = resampling.ordered(rest, settings.seed, "pipeline_iter", "grp")
    size = F.floor(F.col("n") / settings.folds)
    rows = resampling.folds_of(placed, settings.folds)
    role = F.when(F.floor((F.col("rn") - 1) / size) + 1 == F.col("fold"), "valid").otherwise("train")
    return held, rows.select("pipeline_iter", "fold", role.alias("role"), "grp", "sample")


def signatures(matrix: DataFrame, train: DataFrame, *keys: str) -> DataFrame:
    """(keys, feature, nes): Welch's t of group 1 against group 2 on training members."""
    of = lambda g, f: f(F.when(F.col("grp") == g, F.col("value")))
    m = train.join(matrix, "sample").groupBy(*keys, "feature").agg(*[of(g, f).alias(f"{name}{g}") for g in (1, 2) for name, f in (("n", F.count), ("m", F.avg), ("v", lambda c: statistics.exact_zero(F.var_samp(c), c)))])
    spread = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    return m.where(spread > 0).select(*keys, "feature", ((F.col("m1") - F.col("m2")) / F.sqrt(spread)).alias("nes"))


def controlled(folds: DataFrame, rankings: DataFrame, settings: Settings, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Folds and rankings of the kinds test, null (labels permuted within the training members) and neg (features shuffled)."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(settings.replicates))).alias("replicate")
    unit = [*keys, "replicate"]
    test = folds.select("*", F.lit(1).alias("replicate"))
    many = folds.select("*", numbers)
    w = Window.partitionBy(*unit)
    train = many.where("role = 'train'")
    first = F.sum(F.when(F.col("grp") == 1, 1).otherwise(0)).over(w)
    place = F.row_number().over(w.orderBy(draw_key(f"{settings.seed}null", *unit, "sample"), "sample"))
    null = train.withColumn("grp", F.when(place <= first, 1).otherwise(2)).unionByName(many.where("role = 'valid'"))
    shuffled = rankings.select("*", numbers)
    order = Window.partitionBy(*unit).orderBy(draw_key(f"{settings.seed}neg", *unit, "feature"), "feature")
    neg = shuffled.withColumn("rank", F.row_number().over(order))
    kinds = lambda frames: reduce(DataFrame.unionByName, [d.withColumn("kind", F.lit(k)) for k, d in frames])
    columns = [*unit, "feature", "rank"]
    ranks = [("test", rankings.select("*", F.lit(1).alias("replicate")).select(columns)), ("null", shuffled.select(columns)), ("neg", neg.select(columns))]
    return kinds([("test", test), ("null", null), ("neg", many)]), kinds(ranks)


def select_features(matrix: DataFrame, members: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """From matrix (sample, feature, value) and members (sample, grp): held, folds, rankings, aucs, sizes, votes and, on
    the held-out sets with the voted features, final."""
    held, folds = folds_with_holdout(members, settings)
    scores = signatures(matrix, folds.where("role = 'train'"), *KEYS)
    rankings = ranking.ranked(scores.withColumnRenamed("nes", "score"), settings.order, *KEYS).withColumnRenamed("score", "nes")
    grid, ranks = controlled(folds, rankings.select(*KEYS, "feature", "rank"), settings, *KEYS)
    predictions = classify.sweep(matrix, grid, ranks, list(settings.sizes), settings.method, KEYS)
    aucs = ranking.auc(predictions, *KEYS, "kind", "replicate", "n_features")
    sizes = ranking.prefix_size(ranking.curves(aucs, *KEYS), settings.threshold, True, *KEYS)
    votes = ranking.votes(rankings, sizes, list(KEYS), "pipeline_iter")
    tested = held.select("pipeline_iter", F.lit("valid").alias("role"), "grp", "sample")
    rest = folds.where("fold = 1").select("pipeline_iter", F.lit("train").alias("role"), "grp", "sample")
    last_grid, last_ranks = controlled(tested.unionByName(rest), votes.select("pipeline_iter", "feature", "rank"), settings, "pipeline_iter")
    last = classify.sweep(matrix, last_grid, last_ranks, list(settings.sizes), settings.method, ("pipeline_iter",))
    final = ranking.auc(last, "pipeline_iter", "kind", "replicate", "n_features")
    return {"held": held, "folds": folds, "rankings": rankings, "aucs": aucs, "sizes": sizes, "votes": votes, "final": final}


def consensus_summary(members: DataFrame, clusters: DataFrame, threshold: float = 0.25) -> dict[str, DataFrame]:
    """From runs (run, sample, cluster) and a clustering (sample, cluster) of the samples: the co-association matrix,
    silhouettes by its complement, the matrix without samples of low confidence, and its graph."""
    matrix = consensus.coassociation(members)
    samples = members.select("sample").distinct()
    every = samples.select(F.col("sample").alias("row_sample")).crossJoin(samples.select(F.col("sample").alias("col_sample")))
    dist = every.join(matrix, ["row_sample", "col_sample"], "left").select("row_sample", "col_sample", (1 - F.coalesce("norm", F.lit(0.0))).alias("dist"))
    scores = consensus.confidence(consensus.silhouettes(dist, clusters), threshold)
    kept = consensus.masked(matrix, scores.where("not confident"))
    return {"matrix": matrix, "silhouettes": scores, "masked": kept, "edges": consensus.edges(kept.where("norm is not null"))}
