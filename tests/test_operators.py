"""Properties that hold for any data: folds, distributions, areas, neighbours, clusters, selections."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.operators import classify, clusters, consensus, enrichment, medoids, neighbours, ranking, resampling, sets, statistics
from tessella.sources import tables


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, 1 if i < 23 else 2) for i in range(60)], "sample long, grp int").cache()


def by(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r["sample"])
    return out


def test_neighbours_of_copies_far_from_the_origin(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) + 1e4
    x[60:90], x[90:] = x[:30], x[7]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 6)], "sample long, values array<double>")
    want = {}
    for i in range(len(x)):
        gap = np.sqrt(((x - x[i]) ** 2).sum(1))
        want[i] = [(int(j), gap[j]) for j in sorted(range(len(x)), key=lambda j: (gap[j], j)) if j != i][:5]  # noqa: B023
    for block in (9, 4096):
        got = {}
        for r in neighbours.knn(rows, 5, blocks=1, block=block).orderBy("sample", "rank").collect():
            got.setdefault(r["sample"], []).append((r["neighbor"], r["dist"]))
        assert {i: [n for n, _ in v] for i, v in got.items()} == {i: [n for n, _ in v] for i, v in want.items()}
        assert all(a == pytest.approx(b, abs=0 if b == 0 else 1e-9) for i in want for (_, a), (_, b) in zip(got[i], want[i], strict=True))


def test_folds_do_not_overlap_and_leave_the_remainder(people):
    found = by(resampling.k_fold(people, 7, 1).collect(), "fold", "role")
    valid = [set(v) for (f, role), v in found.items() if role == "valid"]
    assert len(valid) == 7 and all(len(v) == 60 // 7 for v in valid) and len(set().union(*valid)) == 7 * (60 // 7)
    assert all(set(found[f, "train"]) == set(range(60)) - set(found[f, "valid"]) for f in range(1, 8))


@pytest.mark.parametrize("n", [2, 49, 98, 103])
def test_leaving_one_out_tests_each_once(spark, n):
    rows = resampling.leave_one_out(spark.createDataFrame([(i, 1) for i in range(n)], "sample long, grp int"), 3).where("role = 'valid'").collect()
    assert sorted(r["sample"] for r in rows) == list(range(n))


def test_balanced_folds_have_equal_classes(people):
    for rows in (resampling.k_fold_balanced(people, 4, 2), resampling.monte_carlo_balanced(people, 4, 0.3, 2)):
        sizes = {}
        for (fold, role, grp), v in by(rows.collect(), "fold", "role", "grp").items():
            assert len(v) == len(set(v))
            sizes.setdefault((fold, role), set()).add(len(v))
        assert all(len(s) == 1 for s in sizes.values())
    even = people.where("sample < 46")  # groups of one size
    assert {len(v) for k, v in by(resampling.k_fold_balanced(even, 4, 2).where("role = 'valid'").collect(), "fold", "grp").items()} == {23 // 4}


def test_held_out_sets_never_overlap_and_leave_the_folds(people):
    held = resampling.holdouts(people, 0.2, 5)
    found = by(held.collect(), "pipeline_iter")
    assert set(found) == {(i,) for i in range(1, 6)}
    assert all(not set(a) & set(b) for a, b in itertools.combinations(found.values(), 2))
    folds = resampling.k_fold(people, 3, 1).withColumn("pipeline_iter", F.lit(2))
    left = resampling.without_holdout(folds, held).collect()
    assert not {r["sample"] for r in left} & set(found[2,])
    with pytest.raises(ValueError, match="whole"):
        resampling.holdouts(people, 0.3, 5)
    assert len(by(resampling.holdouts(people, 0.05, 5).collect(), "pipeline_iter")) == 20


def test_draws_with_replacement(people):
    rows = resampling.monte_carlo_with_replacement(people, 5, 0.3, 4).collect()
    found = by(rows, "fold", "role")
    for f in range(1, 6):
        assert len(found[f, "valid"]) == 18 and len(found[f, "train"]) == 42 and not set(found[f, "valid"]) & set(found[f, "train"])


def test_permuted_groups_complement_each_other(people):
    rows = resampling.permuted_labels(people, 6, 9).collect()
    for v in {r["replicate"] for r in rows}:
        own = [r for r in rows if r["replicate"] == v]
        assert len(own) == 60 and sum(r["pseudo"] == 1 for r in own) == 23
    assert len({tuple(sorted(r["sample"] for r in rows if r["replicate"] == v and r["pseudo"] == 1)) for v in range(1, 7)}) == 6


def test_draws_do_not_depend_on_partitions(people):
    a = sorted(resampling.k_fold_balanced(people.repartition(7, "grp"), 5, 3).collect())
    assert a == sorted(resampling.k_fold_balanced(people.orderBy(F.desc("sample")).coalesce(1), 5, 3).collect())


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "sample long") for v in ([1, 1, 2, 3], [1, 2, 2, 9]))
    values = lambda d: sorted(r[0] for r in d.collect())
    assert values(sets.intersect_all(a)) == [1, 2, 3] and values(sets.intersect_all(a, b)) == [1, 2]
    assert values(sets.difference(a, b)) == [3] and values(sets.bag_union(a, b)) == [1, 1, 1, 2, 2, 2, 3, 9]
    named = a.withColumn("name", F.lit("a")).unionByName(b.withColumn("name", F.lit("b")))
    assert values(sets.in_all(named)) == [1, 2]


def t_tail(t, df, n=400_000):
    """P(T > t) by adding up the density."""
    x = np.linspace(0, 1, n + 1)[1:]  # t to infinity as t / x
    u = t / x
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return float(np.sum(c * (1 + u * u / df) ** (-(df + 1) / 2) * t / (x * x)) / n)


@pytest.mark.parametrize(("t", "df"), [(0.5, 1), (2.0, 3), (3.0, 10), (6.0, 30), (0.1, 49)])
def test_t_tail_against_added_density(t, df):
    assert abs(math.exp(scalars.log_t_tail(np.array([t]), np.array([df]))[0]) - t_tail(t, df)) < 1e-4


def test_t_tail_known_values_and_far_tails():
    # Two-sided 5 % and 1 % points of Student's t.
    for df, t, p in ((1, 12.7062, 0.025), (5, 2.5706, 0.025), (10, 3.1693, 0.005), (30, 2.0423, 0.025)):
        assert abs(math.exp(scalars.log_t_tail(np.array([t]), np.array([df]))[0]) - p) < 1e-5
    far = scalars.log_t_tail(np.array([25.0, 80.0, -80.0]), np.array([48.0, 48.0, 48.0]))
    assert np.isfinite(far).all() and far[1] < far[0] < -50 and far[1] == far[2]


def test_signed_z_keeps_sign_and_order(spark):
    rows = spark.createDataFrame([(v, 49.0) for v in (-40.0, -3.0, 0.0, 1.0, 30.0, 4000.0)] + [(None, 3.0), (1.0, 0.0)], "t double, df double")
    z = [r[0] for r in rows.select(scalars.signed_z("t", "df")).collect()]
    assert z[:6] == sorted(z[:6]) and z[2] == 0 and z[0] < -10 and np.isfinite(z[5]) and z[6:] == [None, None]


def test_normal_tail_without_spread(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 0.0), (0.5, 1.0, 0.0), (1.96, 0.0, 1.0), (None, 0.0, 1.0)], "x double, m double, s double")
    found = [r[0] for r in rows.select(scalars.normal_upper_tail(F.col("x"), F.col("m"), F.col("s"))).collect()]
    assert found[:2] == [0.0, 1.0] and abs(found[2] - 0.025) < 1e-4 and found[3] is None


def test_area_against_counted_pairs(spark):
    rng = random.Random(1)
    rows = [("a" if i % 2 else "b", rng.randint(0, 1), float(rng.randint(0, 6))) for i in range(120)] + [("c", 1, 1.0)]
    found = {r["k"]: r["auc"] for r in ranking.auc(spark.createDataFrame(rows, "k string, truth int, score double"), "k").collect()}
    for k in "ab":
        pos, neg = ([s for g, t, s in rows if g == k and t == x] for x in (1, 0))
        assert abs(found[k] - np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])) < 1e-12
    assert found["c"] is None
    whole = {r["k"]: r["pauc"] for r in ranking.partial_auc(spark.createDataFrame(rows[:-1], "k string, truth int, score double"), 0.0, 1.0, "k").collect()}
    assert all(abs(whole[k] - found[k]) < 1e-9 for k in "ab")


def curve(spark, rows):
    return spark.createDataFrame(rows, "k int, n_features int, mean_auc double, neg_mean double, null_mean double, p_null double, p double")


def test_selection_rules(spark):
    good, bad = (0.9, 0.5, 0.5, 0.01, 0.01), (0.9, 0.5, 0.5, 0.2, 0.2)
    rows = [(1, n, *(good if n in (2, 3, 5) else bad)) for n in range(2, 7)] + [(2, n, *(bad if n == 2 else good)) for n in range(2, 7)] + [(3, n, *good) for n in range(2, 7)]
    c = curve(spark, rows)
    sizes = lambda d: {r["k"]: r["size"] for r in d.collect()}
    assert sizes(ranking.prefix_size(c, 0.05, True, "k")) == {1: 3, 2: 0, 3: 6}
    assert sizes(ranking.prefix_size(c, 0.05, False, "k")) == {1: 6, 2: 6, 3: 6}
    assert sizes(ranking.first_failure_size(c, 0.05, "k")) == {1: 3, 2: 1, 3: 6}
    assert sizes(ranking.difference_size(c, 0.05, "k")) == {1: 3, 2: 4, 3: 3}


def test_interleaved_ranks_take_both_ends_in_turn(spark):
    rows = spark.createDataFrame([(i, float(10 - i)) for i in range(7)], "feature int, score double")
    order = [r["feature"] for r in ranking.ranked(rows, "interleaved").orderBy("rank").collect()]
    assert order == [0, 6, 1, 5, 2, 4, 3]
    with pytest.raises(ValueError, match="no order"):
        ranking.ranked(rows, "other")


def points(spark, n=60, d=4, seed=2):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=d).round(2).tolist(), int(i % 3 == 0) + 1) for i in range(n)], "sample long, values array<double>, grp int").cache()


def test_neighbours_against_all_pairs(spark):
    rows = points(spark)
    x = {r["sample"]: np.array(r["values"]) for r in rows.collect()}
    for blocks in (1, 3, 8):
        found = {}
        for r in neighbours.knn(rows, 4, blocks=blocks).collect():
            found.setdefault(r["sample"], []).append((r["rank"], r["neighbor"]))
        for s, v in x.items():
            want = sorted((np.sqrt(((v - w) ** 2).sum()), n) for n, w in x.items() if n != s)[:4]
            assert [n for _, n in sorted(found[s])] == [n for _, n in want]


def test_synthetic_samples_lie_between_and_reach_parity(spark):
    rows = points(spark)
    x = {r["sample"]: np.array(r["values"]) for r in rows.collect()}
    made = neighbours.smote(rows, 2, 3, 1).collect()
    assert len(made) == 20
    for r in made:
        a, b, p = x[r["sample"]], x[r["neighbor"]], np.array(r["values"])
        u = (p - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= u <= 1 and np.allclose(a + u * (b - a), p) and r["neighbor"] % 3 == 0


def test_tomek_links_are_mutual(spark):
    rows = points(spark)
    near = {r["sample"]: r["neighbor"] for r in neighbours.knn(rows, 1).collect()}
    grp = {r["sample"]: r["grp"] for r in rows.collect()}
    want = {(a, b) for a, b in near.items() if grp[a] == 1 and grp[b] == 2}
    assert {tuple(r) for r in neighbours.tomek_links(rows, mutual=False).collect()} == want
    assert {tuple(r) for r in neighbours.tomek_links(rows).collect()} == {(a, b) for a, b in want if near[b] == a}
    left = neighbours.without_links(rows, 1).groupBy("grp").count().collect()
    assert len({r["count"] for r in left}) == 1


def test_coassociation_against_counting(spark):
    rng = random.Random(4)
    runs = [(r, s, rng.randint(0, 2)) for r in range(6) for s in range(12) if rng.random() < 0.8]
    found = {(r["row_sample"], r["col_sample"]): (r["n"], r["norm"]) for r in consensus.coassociation(spark.createDataFrame(runs, "run int, sample long, cluster int")).collect()}
    of = {}
    for r, s, c in runs:
        of.setdefault(s, {})[r] = c
    for a, b in itertools.product(of, of):
        n = sum(of[b].get(r) == c for r, c in of[a].items())
        assert found.get((a, b), (0, 0)) == (n, n / len(of[b])) or n == 0 and (a, b) not in found


def test_silhouettes_of_lone_samples_are_zero(spark):
    dist = spark.createDataFrame([(a, b, float(abs(a - b))) for a in (0, 1, 9) for b in (0, 1, 9) if a != b], "row_sample long, col_sample long, dist double")
    own = spark.createDataFrame([(0, 1), (1, 1), (9, 2)], "sample long, cluster int")
    found = {r["sample"]: r["silhouette"] for r in consensus.silhouettes(dist, own).collect()}
    assert found[9] == 0 and abs(found[0] - 8 / 9) < 1e-12 and abs(found[1] - 7 / 8) < 1e-12


def test_merging_passes_over_missing_cells(spark):
    cells = spark.createDataFrame([(1, 1, 2.0), (1, 1, None), (1, 2, None)], "row_sample long, col_sample long, v double")
    found = {(r["row_sample"], r["col_sample"]): (r["total"], r["mean"]) for r in consensus.merged_rows(cells).collect()}
    assert found == {(1, 1): (2.0, 2.0), (1, 2): (0.0, None)}


def test_classifiers_part_two_clouds():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(2.5, 1, (60, 3))])
    y = np.repeat([0.0, 1.0], 60)
    a, b = x[y == 0], x[y == 1]
    scatter = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / 118
    test, truth = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(2.5, 1, (40, 3))]), np.repeat([0, 1], 40)
    for score in (classify.lda_scores(scatter, a.mean(0), b.mean(0), 0.5, test), classify.logistic_scores(x, y, test), classify.forest_scores(x, y, test, 30)):
        assert ((score > 0.5) == truth).mean() > 0.93 and score.min() >= 0 and score.max() <= 1


def test_unknown_methods_are_refused(spark, people):
    with pytest.raises(NotImplementedError, match="xgboost"):
        classify.sweep(people, people, people, [2], "xgboost")


def test_enrichment_follows_the_targets(spark):
    scores = spark.createDataFrame([(1, f, float(f)) for f in range(20)], "sample long, feature int, value double")
    up = [(0, 100, t, 1.0, 1.0) for t in (17, 18, 19)]
    down = [(0, 200, t, 1.0, 0.5) for t in (0, 1, 2)] + [(0, 300, t, -1.0, 0.5) for t in (0, 1, 2)] + [(0, 400, 5, 1.0, 1.0)]
    network = spark.createDataFrame(up + down, "network_id int, regulator int, target int, tfmode double, likelihood double")
    found = {r["regulator"]: r["nes"] for r in enrichment.activity(scores, network, least=2).collect()}
    assert set(found) == {100, 200, 300} and found[100] > 1 and found[200] < -1 and abs(found[200] + found[300]) < 1e-9


def test_reading_text_matrices(spark, tmp_path):
    path = tmp_path / "matrix.tsv"
    path.write_text("id\tA-1\tB.2\ng1\t1.5\t2\ng2\t\t-3\n")
    rows = {(r["feature"], r["sample"]): r["value"] for r in tables.long_from_text(spark, str(path)).collect()}
    assert rows == {("g1", "A-1"): 1.5, ("g1", "B.2"): 2.0, ("g2", "A-1"): None, ("g2", "B.2"): -3.0}


def test_results_of_other_keys_stay(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda f, v: spark.createDataFrame([(1, f, 0, v)], "pipeline_iter int, fold int, cluster int, auc double")
    tables.write_results(make(1, 0.1), path)
    tables.write_results(make(2, 0.2), path)
    tables.write_results(make(1, 0.3), path)
    assert sorted((r["fold"], r["auc"]) for r in tables.read_results(spark, path).collect()) == [(1, 0.3), (2, 0.2)]


def test_normalised_counts(spark):
    rows = spark.createDataFrame([(s, f, float((f + 1) * (1 + s))) for s in range(3) for f in range(4)], "sample long, feature int, value double")
    found = {}
    for r in statistics.log_normalised(rows).collect():
        found.setdefault(r["feature"], set()).add(round(r["value"], 9))
    assert all(len(v) == 1 for v in found.values())  # samples that differ by a factor become alike


def test_medoids_against_all_choices(spark):
    rng = np.random.default_rng(5)
    for k in (1, 2, 3):
        x = rng.normal(size=(9, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        best = min(d[:, list(c)].min(1).sum() for c in itertools.combinations(range(9), k))
        rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "run int, sample long, values array<double>")
        assert sum(r["dist"] for r in medoids.medoid_runs(rows, {1: k}).collect()) <= best * 1.05 + 1e-9


def clouds(spark, n=45):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(i, (rng.normal(0, 0.3, 3) + 4 * (i % 3)).tolist()) for i in range(n)], "sample long, values array<double>").cache()


def agrees(rows, n=3):
    seen = {}
    for r in rows:
        seen.setdefault(r["sample"] % n, set()).add(r["cluster"])
    return all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == n


def test_clusterers_find_three_clouds(spark):
    rows = clouds(spark)
    assert agrees(medoids.best_of(rows, [2, 3, 4, 5]).collect())
    many = clouds(spark, 300)
    found, scores = clusters.mixture(many, 3)
    assert agrees(found.collect()) and max(scores.collect(), key=lambda r: r["bic"])["k"] == 3
    own = rows.select("sample", (F.col("sample") % 3 + 1).alias("cluster"))
    moved = clusters.transferred(rows.where("sample < 30"), own, rows.where("sample >= 30"), 20).collect()
    assert len(moved) == 15 and all(r["cluster"] == r["sample"] % 3 + 1 for r in moved)


def test_principal_components_against_svd(spark):
    rows = clouds(spark)
    x = np.array([r["values"] for r in rows.orderBy("sample").collect()])
    x = x - x.mean(0)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * s[:2] * [1 if vt[i][np.abs(vt[i]).argmax()] > 0 else -1 for i in range(2)]
    got = np.array([r["coord"] for r in clusters.principal_components(rows, 2).orderBy("sample").collect()])
    assert np.allclose(got, want, atol=1e-8)


def brute_runs(values, members, features, k, seed, iterations):
    """k-means of one run, as consensus_runs describes it."""
    x = {s: np.array([values[s][i] for i in features]) for s in members}
    order = sorted(members, key=lambda s: (hashlib.md5(f"{seed}centre|1|{s}".encode()).hexdigest(), s))
    centres = {p + 1: x[s] for p, s in enumerate(order[:k])}
    nearest = lambda v: min(centres, key=lambda p: (((v - centres[p]) ** 2).sum(), p))
    for _ in range(iterations):
        at = {s: nearest(v) for s, v in x.items()}
        centres = {p: np.mean([x[s] for s in x if at[s] == p], axis=0) for p in set(at.values())}
    return {s: nearest(v) for s, v in x.items()}


def test_consensus_runs_against_a_loop(spark):
    rng = random.Random(5)
    values = {i: [rng.gauss(3 * (i % 3) * (j < 4), 1) * (1 + j % 5) for j in range(12)] for i in range(60)}
    rows = spark.createDataFrame(list(values.items()), "sample long, values array<double>")
    members = spark.createDataFrame([(1, i) for i in range(60) if i % 7], "run int, sample long")
    got = {r["sample"]: r["cluster"] for r in clusters.consensus_runs(rows, 1, 1.0, 3, 9, (0.3, 0.3), 4, members).collect()}
    mine = [i for i in values if i % 7]
    spread = sorted(range(12), key=lambda j: (-np.var([values[i][j] for i in mine], ddof=1), j))
    assert got == brute_runs(values, mine, sorted(spread[:4]), 3, 9, 4)
    many = clusters.consensus_runs(rows, 4, 0.8, 3, 9).collect()
    assert {r["run"] for r in many} == {1, 2, 3, 4} and len(many) == 4 * 48 and {r["cluster"] for r in many} <= {1, 2, 3}


def test_enrichment_null_is_that_of_permuted_labels(spark):
    rng = random.Random(6)
    matrix = spark.createDataFrame([(s, f, rng.gauss(2 * (s < 12) * (f < 5), 1)) for s in range(24) for f in range(12)], "sample long, feature int, value double")
    members = spark.createDataFrame([(s, 1 if s < 12 else 2) for s in range(24)], "sample long, grp int")
    network = spark.createDataFrame([(0, 100, f, 1.0, 1.0) for f in range(5)] + [(0, 101, f, 1.0, 1.0) for f in range(7, 12)], "network_id int, regulator int, target int, tfmode double, likelihood double")
    got = {r["regulator"]: r for r in enrichment.activity_against_null(matrix, members, network, 40, 3).collect()}
    null = resampling.permuted_labels(members, 40, 3).select("replicate", "sample", F.col("pseudo").alias("grp"))
    by = {}
    for r in enrichment.activity(enrichment.group_signature(matrix, null, "replicate"), network).collect():
        by.setdefault(r["regulator"], []).append(r["nes"])
    for k, r in got.items():
        assert abs(r["null_mean"] - np.mean(by[k])) < 1e-9 and abs(r["z"] - (r["nes"] - np.mean(by[k])) / np.std(by[k], ddof=1)) < 1e-9
    assert got[100]["z"] > 1 > 0 > got[101]["z"]


def test_numbering_is_that_of_one_window(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(500)], "sample long, grp int")
    got = {r["sample"]: (r["rn"], r["n"]) for r in resampling.numbered(rows, 7).collect()}
    order = sorted(range(500), key=lambda s: (hashlib.md5(f"7|0|{s}".encode()).hexdigest(), s))
    assert got == {s: (i + 1, 500) for i, s in enumerate(order)}
    assert resampling.numbered(rows.limit(0), 7).count() == 0


def test_greedy_addition_keeps_what_lowers_errors(spark):
    rng = np.random.default_rng(4)
    rows, own = [], []
    for i in range(150):
        c = i % 3
        x = rng.normal(0, 1, 6)
        x[0] += 20 * (c == 0)
        x[2] += 20 * (c == 1)
        rows.append((i, x.tolist()))
        own.append((i, c))
    frames = spark.createDataFrame(rows, "sample long, values array<double>"), spark.createDataFrame(own, "sample long, cluster int")
    ranks = spark.createDataFrame([(c, f, r) for c, fs in enumerate([[0, 3], [1, 2], [4, 5]]) for r, f in enumerate(fs, 1)], "cluster int, feature int, rank int")
    found = clusters.greedy_addition(*frames, ranks, 5, 2, 10)
    # Cluster 0 has no error to lower; feature 2 parts the others, which lowers both their errors.
    assert {tuple(r) for r in found.collect()} == {(1, 0, 0), (1, 1, 1), (1, 2, 4), (2, 1, 2), (2, 2, 5)}
    assert clusters.greedy_addition(*frames, ranks.limit(0), 5, 2, 10).count() == 0
