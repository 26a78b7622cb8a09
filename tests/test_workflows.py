import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessella.jobs import workflows
from tessella.streaming import counts


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(s, f, float(rng.normal() + (2.5 if f < 3 and s % 2 else 0))) for s in range(48) for f in range(12)]
    matrix = spark.createDataFrame(rows, "sample long, feature int, value double").cache()
    return matrix, spark.createDataFrame([(s, s % 2 + 1) for s in range(48)], "sample long, grp int").cache()


def test_selection_finds_what_parts_the_groups(data):
    matrix, members = data
    out = workflows.select_features(matrix, members, workflows.Settings(folds=3, holdout=0.5, replicates=4, sizes=(2, 3)))
    held = {(r["pipeline_iter"], r["sample"]) for r in out["held"].collect()}
    folds = {(r["pipeline_iter"], r["sample"]) for r in out["folds"].collect()}
    assert len(held) == 48 and not held & folds
    top = out["votes"].where("rank <= 2").collect()
    assert top and {r["feature"] for r in top} <= {0, 1, 2}
    final = {(r["kind"]): r["m"] for r in out["final"].groupBy("kind").agg(F.avg("auc").alias("m")).collect()}
    assert final["test"] > 0.85 and abs(final["null"] - 0.5) < 0.25


def test_consensus_summary(spark):
    runs = spark.createDataFrame([(r, s, s // 5) for r in range(4) for s in range(10)], "run int, sample long, cluster int")
    own = spark.createDataFrame([(s, s // 5) for s in range(10)], "sample long, cluster int")
    out = workflows.consensus_summary(runs, own)
    assert out["silhouettes"].where("confident").count() == 10 and out["edges"].count() == 2 * 5 * 4


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    lists = spark.createDataFrame([(r, c, [10 * c + i for i in range(3)]) for r in range(4) for c in range(2)], counts.RUN_LISTS)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for r in range(4):
        lists.where(F.col("run") == r).write.mode("append").parquet(source)
    counts.written(counts.pair_counts(counts.run_stream(spark, source)), path, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(spark.read.parquet(path).collect()) == sorted(counts.pair_counts(lists).collect())


def test_windowed_votes(spark):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1, 2.0), ("2024-01-01 11:00:00", 1, 3.0), ("2024-01-02 10:00:00", 2, 1.0)], "ts string, feature int, nes double")
    found = sorted((r["feature"], r["votes"], r["sum_nes"]) for r in counts.vote_counts(rows.withColumn("ts", F.to_timestamp("ts"))).collect())
    assert found == [(1, 2, 5.0), (2, 1, 1.0)]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
