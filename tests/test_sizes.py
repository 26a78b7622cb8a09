"""Steps that held only for small tables."""

from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessella.jobs import catalog
from tessella.operators import classify, clusters, consensus, dendrograms, medoids, resampling, statistics


def test_constant_in_parts_does_not_vary(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i, "c", 1.0) for i in range(147)], 3), "sample long, feature string, value double")
    assert rows.agg(F.stddev_samp("value")).first()[0] > 0  # what Spark makes of it
    rows = rows.union(rows.select("sample", F.lit("v"), F.when(F.col("sample") == 7, 2.0).otherwise(1.0)))
    assert {r["feature"] for r in statistics.varying(rows).select("feature").distinct().collect()} == {"v"}
    assert statistics.moments(rows.where("feature = 'c'")).first()["sd"] == 0


def test_draws_of_more_than_ten_thousand_members(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.0).cast("float")).alias("embedding"), (F.col("id") % 3).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["mc_with_replacement"]).df()
    found = catalog.mc_with_replacement(spark, str(tmp_path)).toPandas()
    assert len(found) == 4 * 26_667
    columns = sorted(want.columns)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (want, found))
    assert (a == b).all(axis=None)


def some_runs(spark, n=90, runs=5):
    rng = np.random.default_rng(3)
    rows = [(r, s, int(rng.integers(4))) for r in range(runs) for s in range(n) if rng.random() < 0.7]
    return rows, spark.createDataFrame(rows, "run int, sample long, cluster int")


def by_pair(rows, per_sampled=False):
    own = {}
    for r, s, c in rows:
        own.setdefault(s, {})[r] = c
    for a in own:
        for b in own:
            if n := sum(own[b].get(r) == c for r, c in own[a].items()):
                yield a, b, float(n), n / (len(own[a].keys() & own[b].keys()) if per_sampled else len(own[b]))


def test_shares_are_rounded_from_whole_numbers(spark, sf_dir):
    found = consensus.shares(200, 6)
    for whole in range(1, 201):
        for n in range(whole + 1):
            assert found[n, whole] == float((Decimal(n) / whole).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    assert found[1, 128] == 0.007813 and consensus.shares(200)[1, 3] == 1 / 3
    for name in ("coassociation", "coassociation_norm", "mask_low_confidence", "graph_edges"):
        assert "round(" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name


def moved_by_pair(df):
    """Whether a shuffle of the plan has the pairs as its keys."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("Exchange" in x and "_sample#" in x for x in plan.splitlines())


def test_coassociation_moves_no_pairs(spark):
    rows, members = some_runs(spark)
    found = consensus.coassociation(members)
    assert not moved_by_pair(found)
    assert sorted(map(tuple, found.collect())) == sorted(by_pair(rows))
    words = spark.createDataFrame([(f"r{r}", s, f"c{c}") for r, s, c in rows], "run string, sample long, cluster string")
    assert sorted(map(tuple, consensus.coassociation(words).collect())) == sorted(by_pair(rows))


def test_merged_counts_move_no_pairs(spark):
    _, members = some_runs(spark)
    found = consensus.merged_counts(members, 2)
    assert not moved_by_pair(found)
    want = consensus.merged([consensus.coassociation(members.where(F.col("run") % 2 == p)) for p in (0, 1)], "n")
    a, b = (d.toPandas().sort_values(["row_sample", "col_sample"]).reset_index(drop=True) for d in (found, want))
    pd.testing.assert_frame_equal(a, b)


def test_coassociation_by_common_runs_moves_no_pairs(spark):
    rows, members = some_runs(spark)
    found = consensus.coassociation(members, per_sampled=True)
    assert not moved_by_pair(found)
    assert sorted(map(tuple, found.collect())) == sorted(by_pair(rows, True))


def test_graph_edges_move_no_pairs(spark):
    rows, members = some_runs(spark)
    found = consensus.edges(consensus.coassociation(members))
    assert not moved_by_pair(found)
    assert sorted(map(tuple, found.collect())) == sorted((a, b, w) for a, b, _, w in by_pair(rows) if a != b)


def test_masked_columns_move_no_pairs(spark):
    rows, members = some_runs(spark)
    low = members.where("sample % 7 = 3").select("sample")
    found = consensus.coassociation(members, low=low)
    assert not moved_by_pair(found)
    key = lambda d: sorted(map(tuple, d.collect()), key=lambda r: r[:2])
    assert key(found) == key(consensus.masked(consensus.coassociation(members), low))


def test_consensus_of_own_runs_moves_no_pairs(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 7), 0.5 * (i % 2)]) for i in range(80)], "sample long, values array<double>")
    members = clusters.consensus_runs(rows, 4, 0.8, 3, 7)
    found = consensus.coassociation(members)
    assert not moved_by_pair(found)
    assert sorted(map(tuple, found.collect())) == sorted(by_pair([tuple(r) for r in members.select("run", "sample", "cluster").collect()]))


def points(spark, n=70, width=5):
    x = np.random.default_rng(4).normal(size=(n, width))
    x[7] = x[3]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample long, values array<double>")


def joins_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" in plan or any("NestedLoopJoin" in x and " < " in x for x in plan.splitlines())


def check_distances(spark, metric, of):
    x, rows = points(spark)
    found = statistics.distances(rows, metric)
    assert not joins_pairs(found)
    got = {(r["a"], r["b"]): r["dist"] for r in found.collect()}
    assert got.keys() == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x))}
    assert max(abs(d - of(x[a], x[b])) for (a, b), d in got.items()) < 1e-12
    return got


def test_euclid_distances_join_no_pairs(spark):
    got = check_distances(spark, "euclid", lambda p, q: np.sqrt(((p - q) ** 2).sum()))
    assert got[(3, 7)] == 0
    odd = spark.createDataFrame([(1, [0.0, 3.0]), (2, [4.0, 0.0]), (3, [1.0, None]), (4, None), (5, [1.0])], "sample long, values array<double>")
    assert {(r["a"], r["b"]): r["dist"] for r in statistics.distances(odd).collect()} == {(a, b): 5.0 if (a, b) == (1, 2) else None for a in range(1, 6) for b in range(a + 1, 6)}


def test_manhattan_distances_join_no_pairs(spark):
    check_distances(spark, "manhattan", lambda p, q: np.abs(p - q).sum())


def test_pearson_distances_join_no_pairs(spark):
    check_distances(spark, "pearson", lambda p, q: 1 - np.corrcoef(p, q)[0, 1])


def test_silhouettes_of_points_make_no_table_of_pairs(spark):
    _, rows = points(spark)
    named = rows.withColumn("cluster", F.when(F.col("sample") == 9, 8).otherwise(F.col("sample") % 3).cast("int"))
    half = statistics.distances(rows)
    both = half.select(F.col("a").alias("row_sample"), F.col("b").alias("col_sample"), "dist").union(half.select("b", "a", "dist"))
    want = {r["sample"]: (r["cluster"], r["silhouette"]) for r in consensus.silhouettes(both, named.select("sample", "cluster")).collect()}
    found = medoids.silhouettes(named.withColumn("run", F.lit(0)), least=4)
    got = {r["sample"]: (r["cluster"], r["silhouette"]) for r in found.collect()}
    assert got.keys() == want.keys() and got[9] == (8, 0.0)
    assert all(got[s][0] == want[s][0] and abs(got[s][1] - want[s][1]) < 1e-12 for s in want)


def test_silhouette_split_makes_no_table_of_pairs(spark, sf_dir):
    plan = catalog.silhouette_split(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "row_sample" not in plan and "Join Inner, (" not in plan


def merged_sets(tree):
    """Each merge's samples with its height, whatever the order of merges."""
    parts, out = {}, []
    for r in sorted(tree.collect(), key=lambda r: (r["turn"], r["height"], r["a"], r["b"])):
        parts[r["a"]] = parts.get(r["a"], {r["a"]}) | parts.get(r["b"], {r["b"]})
        out.append((sorted(parts[r["a"]]), r["height"]))
    return sorted(out)


def test_single_linkage_of_points_makes_no_table_of_pairs(spark):
    x, rows = points(spark)
    rows = rows.union(rows.where("sample < 12").select(F.col("sample") + 100, "values"))  # copies: ties
    found, want = dendrograms.point_tree(rows).collect(), dendrograms.merges(statistics.distances(rows), "single").collect()
    assert {(r["a"], r["b"]) for r in found} == {(r["a"], r["b"]) for r in want} and len(found) == 81
    assert np.allclose(sorted(r["height"] for r in found), sorted(r["height"] for r in want), atol=1e-12)


def test_ward_of_points_makes_no_table_of_pairs(spark):
    _, rows = points(spark, 40)
    found, want = merged_sets(dendrograms.point_ward(rows)), merged_sets(dendrograms.merges(statistics.distances(rows), "ward"))
    assert [s for s, _ in found] == [s for s, _ in want] and len(found) == 39
    assert np.allclose([h for _, h in found], [h for _, h in want], atol=1e-9)


def test_leave_one_out_has_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS", 500)
    monkeypatch.setattr(resampling, "FOLDS", 16)
    members = spark.createDataFrame([(i, 1 + i % 2) for i in range(100)], "sample long, grp int")
    found = resampling.leave_one_out(members, 7)
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 10_000 and max(r["count"] for r in sizes) < 2_000
    assert found.where("role = 'valid'").agg(F.countDistinct("sample"), F.countDistinct("fold")).first()[:] == (100, 100)


def sweep_of(spark, method):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) + (np.arange(60) % 2)[:, None]
    matrix = spark.createDataFrame([(i, f, float(x[i, f]) if (i, f) != (3, 1) else None) for i in range(60) for f in range(4)], "sample long, feature int, value double")
    folds = spark.createDataFrame([(1, "test", 1, "valid" if i < 15 else "train", 1 + i % 2, i) for i in range(60)], "fold int, kind string, replicate int, role string, grp int, sample long")
    ranks = spark.createDataFrame([(1, "test", 1, f, 4 - f) for f in range(4)], "fold int, kind string, replicate int, feature int, rank int")
    x[3, 1] = 0.0
    return x[:, ::-1], classify.sweep(matrix, folds, ranks, [2, 4], method)


def input_of_tasks(df):
    return next(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapGroupsInPandas" in x)


def test_sweep_tasks_get_a_row_a_sample(spark):
    x, found = sweep_of(spark, "lda")
    assert "rank#" not in input_of_tasks(found) and "values#" in input_of_tasks(found)
    got = {(r["n_features"], r["sample"]): r["score"] for r in found.collect()}
    train, y = x[15:], np.arange(15, 60) % 2
    for n in (2, 4):
        a, b = train[y == 0][:, :n], train[y == 1][:, :n]
        scatter = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / 43
        want = classify.lda_scores(scatter, a.mean(0), b.mean(0), y.mean(), x[:15, :n])
        assert np.allclose([got[n, i] for i in range(15)], want, atol=1e-12)


def test_forest_sizes_have_tasks_of_their_own(spark):
    _, found = sweep_of(spark, "forest")
    assert "slot#" in input_of_tasks(found).split("],")[0]
    assert found.groupBy("n_features").count().count() == 2 and found.count() == 30


def test_sweep_scores_go_out_a_size_at_a_time(spark):
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x, found = sweep_of(spark, "lda")
        assert found._jdf.queryExecution().logical().functionExpr().evalType() == PythonEvalType.SQL_GROUPED_MAP_PANDAS_ITER_UDF
        got = {(r["n_features"], r["sample"]): r["score"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    assert len(got) == 30
    _, whole = sweep_of(spark, "lda")
    assert got == {(r["n_features"], r["sample"]): r["score"] for r in whole.collect()}


def plain_forest(x, y, test, trees, seed):
    """As `forest_scores`, node by node over all drawn rows."""
    rng, votes, tries = np.random.default_rng(seed), np.zeros(len(test)), max(1, int(np.sqrt(x.shape[1])))
    for _ in range(trees):
        todo = [(rng.integers(0, len(x), len(x)), np.arange(len(test)))]
        while todo:
            own, asked = todo.pop()
            if not len(asked):
                continue
            n, whole, best = len(own), y[own].sum(), None
            if 0 < whole < n:
                for f in rng.permutation(x.shape[1])[:tries]:
                    order = own[np.argsort(x[own, f], kind="stable")]
                    v, c = x[order, f], np.cumsum(y[order])
                    for i in np.flatnonzero(v[1:] > v[:-1]):
                        p, q = c[i] / (i + 1), (whole - c[i]) / (n - i - 1)
                        impurity = (i + 1) * p * (1 - p) + (n - i - 1) * q * (1 - q)
                        if best is None or impurity < best[0]:
                            best = impurity, f, (v[i] + v[i + 1]) / 2
            if best is None:
                votes[asked] += whole / n > 0.5
                continue
            goes, to = x[own, best[1]] <= best[2], test[asked, best[1]] <= best[2]
            todo += [(own[goes], asked[to]), (own[~goes], asked[~to])]
    return votes / trees


def test_small_nodes_of_a_forest_sort_no_arrays(monkeypatch):
    rng, sorts, argsort = np.random.default_rng(2), [], np.argsort
    for n, p, digits in ((30, 1, 0), (400, 5, 9), (400, 20, 1), (900, 9, 9)):
        x, y = rng.normal(size=(n, p)).round(digits), (rng.random(n) < 0.4).astype(float)
        test = np.vstack([x[::3], rng.normal(size=(40, p))])
        want = plain_forest(x, y, test, 4, n)
        with monkeypatch.context() as m:
            m.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or argsort(*a, **b))
            assert (classify.forest_scores(x, y, test, 4, n) == want).all()
    assert len(sorts) < 1000  # a sort for each node and feature tried would be thousands


def test_runs_are_not_shuffled_whole(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 7), 0.5 * (i % 2)]) for i in range(80)], "sample long, values array<double>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clusters.consensus_runs(rows, 4, 0.8, 3, 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not any("SortMergeJoin [run" in x for x in plan.splitlines())


def test_medoid_steps_read_block_pairs_and_move_sums(spark):
    x, rows = points(spark)
    held = medoids.packed(rows.withColumn("run", F.lit(1)), 20)
    assert held.count() == 10  # 4 blocks of 70 samples
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    add = medoids.best_steps(held, {1: ([], [])}, {1: False}, "euclid")
    assert not any("hashpartitioning(run" in y and "sample" in y for y in add._jdf.queryExecution().executedPlan().toString().splitlines())
    best = min((r["change"], r["sample"]) for r in add.collect())
    assert best[1] == dist.sum(0).argmin() and abs(best[0] - dist.sum(0).min()) < 1e-8
    to = dist[:, [3, 9]]
    costs = {(s, c): np.minimum(dist[:, c], to[:, 1 - s]).sum() - to.min(1).sum() for s in (0, 1) for c in range(70) if c not in (3, 9)}
    swap = min((r["change"], r["sample"], r["slot"]) for r in medoids.best_steps(held, {1: ([3, 9], [x[3].tolist(), x[9].tolist()])}, {1: True}, "euclid").collect())
    assert abs(swap[0] - min(costs.values())) < 1e-8 and abs(costs[swap[2], swap[1]] - swap[0]) < 1e-8


def test_medoid_gains_use_one_room_for_all_tiles():
    import tracemalloc

    rng = np.random.default_rng(5)
    i, j = slice(0, 64), slice(0, 1024)
    for width, metric in ((2, "euclid"), (9, "euclid"), (9, "pearson")):
        x, y, centres = (rng.normal(size=(n, width)) for n in (64, 1024, 3))
        own, room = np.empty((2, 64, 1024))
        tile, gains = medoids.tile_distances(x, y, metric), medoids.Gains(x, centres, metric, True, 1024)
        tracemalloc.start()
        tile(i, j, own)
        if width > 4:  # narrow rows need an array of gaps
            assert tracemalloc.get_traced_memory()[1] < own.nbytes / 2
        tracemalloc.reset_peak()
        gains.add(own, i, j, True, room)
        assert tracemalloc.get_traced_memory()[1] < own.nbytes / 2
        tracemalloc.stop()
        to, dist = medoids.distances(x, centres, metric), medoids.distances(x, y, metric)
        want = [np.minimum(dist, np.delete(to, s, 1).min(1)[:, None]).sum(0) - to.min(1).sum() for s in range(3)]
        assert np.allclose(gains.change, want, atol=1e-10)


def test_tiles_of_distances_have_copies_at_zero():
    from tessella.operators import blocks

    x = np.random.default_rng(4).normal(size=(70, 5))
    x[7], x[50] = x[3], x[3] + 1e-9
    found = blocks.euclid_tiles(x, x)(slice(0, 60), slice(2, 70))
    assert found[3, 5] == 0 and np.abs(found - np.sqrt(((x[:60, None] - x[2:]) ** 2).sum(2))).max() < 1e-12


def test_average_linkage_of_points_makes_no_table_of_pairs(spark):
    _, rows = points(spark, 60)
    want = merged_sets(dendrograms.merges(statistics.distances(rows), "average"))
    for part, last in ((4, 12), (100, 2048)):
        found = merged_sets(dendrograms.point_average(rows, part, last, 16))
        assert [s for s, _ in found] == [s for s, _ in want] and len(found) == 59
        assert np.allclose([h for _, h in found], [h for _, h in want], atol=1e-9)
    assert dendrograms.point_average(rows.limit(0)).count() == 0 and dendrograms.point_average(rows.limit(1)).count() == 0


def test_average_linkage_of_shares_makes_no_table_of_pairs(spark):
    rows, members = some_runs(spark, 40, 6)  # many shares are equal
    members = members.where("sample <> 5")  # a sample of no run
    pairs = by_pair([r for r in rows if r[1] != 5], True)
    apart = {(a, b): 1.0 for a in range(40) for b in range(a + 1, 40)} | {(a, b): 1 - v for a, b, _, v in pairs if a < b}
    want = merged_sets(dendrograms.merges(spark.createDataFrame([(a, b, d) for (a, b), d in apart.items()], "a long, b long, dist double"), "average"))
    samples = spark.range(40).select(F.col("id").alias("sample"))
    for part, last in ((4, 30), (100, 2048)):
        found = merged_sets(consensus.average_tree(members, samples, part, last, 16))
        assert [s for s, _ in found] == [s for s, _ in want] and len(found) == 39
        assert np.allclose([h for _, h in found], [h for _, h in want], atol=1e-9)


def test_last_merges_take_one_pair_at_a_time():
    rng = np.random.default_rng(0)
    for k in range(20):
        x = rng.integers(0, 4 if k % 2 else 1000, size=(30, 2)).astype(float)
        total, n, want = np.abs(x[:, None] - x).sum(2), np.ones(30), []
        found = list(dendrograms.finished(total.copy(), n))
        while len(want) < 29:
            d = np.round(total / np.maximum(1, np.outer(n, n)), 9)
            d[np.tril_indices(30)] = np.inf
            d[n == 0], d[:, n == 0] = np.inf, np.inf
            a, b = divmod(int(d.argmin()), 30)
            want.append((a, b, d[a, b], n[a] + n[b]))
            total[a] += total[b]
            total[:, a] = total[a]
            n[a], n[b] = n[a] + n[b], 0
            total[b] = total[:, b] = np.inf
        assert found == want


def test_shared_counts_runs_of_more_than_a_byte():
    x, y = np.random.default_rng(1).integers(0, 2, size=(2, 600, 9)).astype(np.int8)
    assert (consensus.shared(x, y) == (x[:, :, None] == y[:, None]).sum(0)).all() and (consensus.shared(x, x).diagonal() == 600).all()


def test_nearest_rows_sort_few_of_many(monkeypatch):
    from tessella.operators import neighbours

    x = np.random.default_rng(5).integers(0, 4, (700, 3)).astype(float)  # copies: ties
    x[9] = np.nan
    ids, seen, sort = np.random.default_rng(6).permutation(700), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *b, **c: (seen.append(a.shape[1]), sort(a, *b, **c))[1])
    q, r, gap = neighbours.nearest_rows(x[:20], ids[:20], x, ids, 3)
    assert max(seen) < 100
    for i in range(20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((d[j], ids[j]) for j in range(700) if j != i and not np.isnan(d[j]))[:3]
        assert [(g, ids[j]) for g, j in zip(gap[q == i], r[q == i], strict=True)] == want


def test_block_pairs_of_runs_take_few_bytes(spark, monkeypatch):
    x = np.float32(np.random.default_rng(3).normal(size=(300, 8))).astype(float)
    rows = spark.createDataFrame([(r, i, v.tolist()) for r in (1, 2) for i, v in enumerate(x)], "run int, sample long, values array<double>")
    held = medoids.packed(rows, medoids.PACK)
    sizes = held.select(F.length("a.flat").alias("a"), F.length("b.flat").alias("b")).collect()
    assert len(sizes) == 2 and all(r["a"] == 1 + 300 * 8 * 4 and r["b"] is None for r in sizes)  # one block a run, four bytes a number
    monkeypatch.setattr(medoids, "SMALL", 50)
    assert medoids.packed(rows, medoids.PACK).count() == 2 * 21  # so few runs are cut, or few cores would have pairs
    for numbers in (x, x / 3):
        ids, found = medoids.unpacked(np.arange(300).tobytes(), medoids.number_bytes(numbers.ravel()))
        assert (found == numbers).all() and len(ids) == 300


def test_stored_tables_leave_no_shuffle_files(spark):
    from tessella.sources import shared

    kept = spark.conf.get(shared.DROPPED, None)
    with shared.shuffles_dropped(spark):
        assert spark.conf.get(shared.DROPPED) == "true"
    assert spark.conf.get(shared.DROPPED, None) == kept
    seen = []
    frame = spark.range(9).groupBy("id").count()
    write = type(frame.write).parquet
    try:
        type(frame.write).parquet = lambda self, path: (seen.append(spark.conf.get(shared.DROPPED)), write(self, path))[1]
        assert shared.stored(frame, "few").count() == 9 and seen == ["true"]
    finally:
        type(frame.write).parquet = write


@pytest.mark.parametrize(("width", "metric"), [(2, "euclid"), (6, "euclid"), (5, "pearson"), (3, "manhattan")])
def test_pieces_too_far_apart_change_no_gain(monkeypatch, width, metric):
    monkeypatch.setattr(medoids, "PIECE", 16)
    rng = np.random.default_rng(8)
    x, y = (rng.normal(size=(n, width)) + 9 * rng.integers(0, 4, size=(n, 1)) * np.arange(width) for n in (220, 190))
    for k, full in ((0, False), (4, False), (5, True), (1, True)):
        centres = x[rng.permutation(220)[:k]] if k else None
        (i, p), (j, q) = (medoids.arranged(m, centres, metric) for m in (x, y))
        a, b = x[i], y[j]
        assert sorted(i) == list(range(220)) and np.diff([*p, 220]).max() <= 16
        gains, dist, least = medoids.Gains(a, centres, metric, full, 190), medoids.distances(a, b, metric), medoids.far_apart(a, p, b, q, metric)
        assert (least <= np.minimum.reduceat(np.minimum.reduceat(dist, p, 0), q, 1) + 1e-12).all()
        near, far = gains.reach(p)
        some = least < far[:, None]
        assert metric == "pearson" or not some.all() or not k or (full and k == 1)  # some are passed over
        for r, c, s, t, own, room in medoids.piece_distances(a, p, b, q, metric, some):
            gains.add(own, s, t, True, room, least[r, c] < near[r])
        to = medoids.distances(a, centres, metric) if k else None
        if full and k > 1:
            want = np.array([np.minimum(dist, np.delete(to, s, 1).min(1)[:, None]).sum(0) for s in range(k)]) - to.min(1).sum()
        else:
            want = (np.minimum(dist, to.min(1)[:, None]) if k and not full else dist).sum(0)[None] - (to.min(1).sum() if k else 0)
        assert np.allclose(gains.change, want, atol=1e-9)


def test_best_k_moves_no_values(spark, monkeypatch):
    _, rows = points(spark)
    called = []
    monkeypatch.setattr(medoids, "by_block_pairs", lambda *a, **b: called.append(a))
    found = medoids.best_of(rows, [2, 3, 4], block=30)
    assert found.count() == rows.count() and not called
    k, score = found.select("k", "silhouette").first()
    monkeypatch.undo()
    own = found.select(F.lit(0).alias("run"), "sample", "cluster").join(rows, "sample")
    assert abs(medoids.silhouettes(own).agg(F.avg("silhouette")).first()[0] - score) < 1e-8


def test_cells_of_equal_values_lie_beside_each_other(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(r, s, int(c)) for r in range(5) for s, c in enumerate(rng.integers(0, 3, 400)) if rng.random() < 0.8]
    members = spark.createDataFrame(rows, "run int, sample long, cluster int")
    low = spark.createDataFrame([(s,) for s in range(0, 400, 7)], "sample long")
    for found in (consensus.coassociation(members, low=low), consensus.coassociation(members, True)):
        parts = found.withColumn("p", F.spark_partition_id()).toPandas()
        values = parts[["n", "norm"]].fillna(-1)
        assert (values.diff().abs().sum(axis=1) > 0).sum() < len(parts) / 10  # one row after another they nearly all differ
    rows = [r for r in rows if r[1] < 60]
    members, plain = members.where("sample < 60"), merged_of(rows, 5)
    for most in (2**40, 3):
        monkeypatch.setattr(consensus, "NUMBERS", most)
        found = {(r[0], r[1]): r[2:] for r in consensus.merged_counts(members, 5).collect()}
        assert found.keys() == plain.keys()
        assert all(found[k][0] == sum(v) and abs(found[k][1] - np.mean(v)) < 1e-12 and (found[k][2] is None if len(v) == 1 else abs(found[k][2] - np.std(v, ddof=1)) < 1e-12) for k, v in plain.items())


def merged_of(rows, parts):
    counts = {}
    for r, s, c in rows:
        for q, t, d in rows:
            if r == q and c == d:
                counts.setdefault((s, t), {}).setdefault(r % parts, []).append(1)
    return {k: [len(x) for x in v.values()] for k, v in counts.items()}


def test_distances_of_a_tile_rise(spark, monkeypatch):
    monkeypatch.setattr(statistics, "REPEATS", 0)
    x, rows = points(spark, 90)
    for metric in ("euclid", "manhattan", "pearson"):
        found = statistics.distances(rows, metric).withColumn("p", F.spark_partition_id()).toPandas()
        falls = (found["dist"].diff() < -1e-6) & (found["p"].diff() == 0)
        assert falls.sum() <= 136 < len(found) / 20  # one for each pair of blocks; about half of all rows where they are not sorted
    d = np.random.default_rng(1).normal(size=5000) ** 2
    d[7] = np.nan
    order = statistics.rising(d)
    assert sorted(order) == list(range(5000)) and order[-1] == 7 and (np.diff(d[order[:-1]]) > -1e-6).all()
