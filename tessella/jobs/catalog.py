"""Named queries over the given tables, with equivalent SQL for DuckDB.

`embeddings` stands for the measurements (vec_id is the sample, the position the feature), its label for cohorts and
clusters: group 1 is label 0, group 2 label 1. Every query runs over its whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import classify, clusters, communities, consensus, dendrograms, enrichment, medoids, mixtures, neighbours, ranking, reduction, resampling, sets, statistics
from tessella.sources.tables import long_from_arrays, table, wide

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LONG = "l AS (SELECT vec_id AS sample, CAST(i - 1 AS INTEGER) AS feature, CAST(embedding[i] AS DOUBLE) AS value, label FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
MEMBERS = "m AS (SELECT vec_id AS sample, CAST(label + 1 AS INTEGER) AS grp FROM embeddings WHERE label < 2)"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def long(spark: SparkSession, sf: str) -> DataFrame:
    return long_from_arrays(table(spark, sf, "embeddings"), keep=("label",))


def arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("values"), "label")


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("label < 2").select(F.col("vec_id").alias("sample"), (F.col("label") + 1).cast("int").alias("grp"))


# Matrices and cohorts


@query(f"WITH {LONG} SELECT sample, feature, value FROM l")
def long_matrix(spark, sf):
    return long(spark, sf).select("sample", "feature", "value")


@query("SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id")
def wide_matrix_pivot(spark, sf):
    return rounded(wide(table(spark, sf, "events"), "user_id", "event_type", "value", EVENT_TYPES), *EVENT_TYPES)


@query("SELECT user_id AS sample FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def cohort_intersect_n(spark, sf):
    return sets.in_all(table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("sample")))


@query("SELECT o_custkey AS sample FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def cohort_setdiff(spark, sf):
    orders = table(spark, sf, "orders")
    return sets.difference(orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample")), orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT o_custkey AS sample FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def cohort_bag_union(spark, sf):
    return sets.bag_union(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample")), table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sample")))


@query("(SELECT o_custkey AS sample FROM orders WHERE o_orderstatus = 'F') INTERSECT (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') INTERSECT (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cohort_intersect_all(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return sets.intersect_all(*[orders.where(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("sample")) for s in "FO"], customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("sample")))


# Resampling

ORDERED = f"{MEMBERS}, o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '7', '0', sample)), sample) AS rn, count(*) OVER () AS n FROM m)"
BY_GROUP = f"{MEMBERS}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', '7', grp, sample)), sample) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM m), k AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM m GROUP BY grp))"
FOLDS = "CAST(f AS INTEGER) AS fold"


@query(f"WITH {ORDERED} SELECT {FOLDS}, CASE WHEN (rn - 1) // (n // 5) + 1 = f THEN 'valid' ELSE 'train' END AS role, grp, sample FROM o, generate_series(1, 5) AS t(f)")
def kfold_unbalanced(spark, sf):
    return resampling.k_fold(members(spark, sf), 5, 7)


@query(f"WITH {BY_GROUP} SELECT {FOLDS}, CASE WHEN (rn - 1) // (m // 5) + 1 = f THEN 'valid' ELSE 'train' END AS role, grp, sample FROM o, k, generate_series(1, 5) AS t(f) WHERE rn <= m")
def kfold_balanced(spark, sf):
    return resampling.k_fold_balanced(members(spark, sf), 5, 7)


@query(
    f"WITH {MEMBERS}, k AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM m GROUP BY grp)), o AS (SELECT *, row_number() OVER (PARTITION BY f, grp ORDER BY md5(concat_ws('|', '7', f, grp, sample)), sample) AS rn FROM m, generate_series(1, 10) AS t(f)) "
    f"SELECT {FOLDS}, CASE WHEN rn <= floor(k.m * CAST(0.3 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS role, grp, sample FROM o, k WHERE rn <= k.m"
)
def mc_balanced(spark, sf):
    return resampling.monte_carlo_balanced(members(spark, sf), 10, 0.3, 7)


@query(
    f"""WITH {ORDERED}, s AS (SELECT max(n) AS n, CAST(floor(max(n) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS size FROM o),
    v AS (SELECT f, c, CAST('0x' || substr(md5(concat_ws('|', '7v', f, c)), 1, 8) AS BIGINT) % n + 1 AS rn FROM (SELECT *, unnest(generate_series(1, size)) AS c FROM s, generate_series(1, 4) AS t(f))),
    r AS (SELECT f, rn, row_number() OVER (PARTITION BY f ORDER BY rn) AS place, count(*) OVER (PARTITION BY f) AS l FROM (SELECT f, rn FROM o, generate_series(1, 4) AS t(f) EXCEPT SELECT f, rn FROM v)),
    d AS (SELECT f, c, CAST('0x' || substr(md5(concat_ws('|', '7t', f, c)), 1, 8) AS BIGINT) % l + 1 AS place FROM (SELECT *, unnest(generate_series(1, n - size)) AS c FROM s, (SELECT DISTINCT f, l FROM r)))
    SELECT CAST(x.f AS INTEGER) AS fold, role, grp, sample, CAST(c AS INTEGER) AS copy_no FROM (SELECT f, 'valid' AS role, rn, c FROM v UNION ALL SELECT d.f, 'train', r.rn, c FROM d JOIN r ON d.f = r.f AND d.place = r.place) x JOIN o USING (rn)"""
)
def mc_with_replacement(spark, sf):
    return resampling.monte_carlo_with_replacement(members(spark, sf), 4, 0.3, 7)


@query(f"WITH {ORDERED} SELECT {FOLDS}, CASE WHEN rn = f THEN 'valid' ELSE 'train' END AS role, grp, sample FROM o, generate_series(1, 100000) AS t(f) WHERE f <= n")
def loocv(spark, sf):
    return resampling.leave_one_out(members(spark, sf), 7)


@query(
    f"WITH {MEMBERS}, e AS (SELECT *, CAST(sample % 2 AS INTEGER) AS sub FROM m), k AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM e GROUP BY grp, sub)), "
    f"o AS (SELECT *, row_number() OVER (PARTITION BY f, grp, sub ORDER BY md5(concat_ws('|', '7', f, grp, sub, sample)), sample) AS rn FROM e, generate_series(1, 5) AS t(f)) SELECT {FOLDS}, CASE WHEN rn > least THEN 'valid' ELSE 'train' END AS role, grp, sample, sub FROM o, k"
)
def substrata(spark, sf):
    return resampling.balanced_strata(members(spark, sf).withColumn("sub", (F.col("sample") % 2).cast("int")), 5, "sub", 7)


@query(f"WITH {BY_GROUP} SELECT CAST((rn - 1) // (n // 4) + 1 AS INTEGER) AS pipeline_iter, grp, sample FROM o WHERE (rn - 1) // (n // 4) + 1 <= 4")
def holdout_disjoint(spark, sf):
    return resampling.holdouts(members(spark, sf), 0.25, 7)


@query(
    f"WITH {MEMBERS}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', '7', grp, sample)), sample) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM m), "
    "r AS (SELECT CAST(f AS INTEGER) AS fold, grp, sample, CASE WHEN (rn - 1) // (n // 5) + 1 = f THEN 'valid' ELSE 'train' END AS role, CASE WHEN rn <= (f - 1) * (n // 5) THEN rn ELSE rn - n // 5 END AS place FROM o, generate_series(1, 5) AS t(f)), "
    "k AS (SELECT fold, grp, count(*) AS own FROM r WHERE role = 'train' GROUP BY 1, 2), x AS (SELECT fold, grp, own, unnest(generate_series(1, most - own)) AS c FROM (SELECT *, max(own) OVER (PARTITION BY fold) AS most FROM k)), "
    "e AS (SELECT fold, grp, c, CAST('0x' || substr(md5(concat_ws('|', '7o', fold, grp, c)), 1, 8) AS BIGINT) % own + 1 AS place FROM x) "
    "SELECT fold, role, grp, sample, CAST(0 AS INTEGER) AS copy_no FROM r UNION ALL SELECT e.fold, role, e.grp, sample, CAST(c AS INTEGER) FROM e JOIN r ON e.fold = r.fold AND e.grp = r.grp AND e.place = r.place AND role = 'train'"
)
def kfold_oversampled(spark, sf):
    return resampling.k_fold_oversampled(members(spark, sf), 5, 7)


@query(
    f"WITH {MEMBERS}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', '7', grp, sample)), sample) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM m) "
    "SELECT sample, grp, CASE WHEN rn <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'test' WHEN rn <= floor(n * CAST(0.2 AS DOUBLE)) + floor(n * CAST(0.25 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS role FROM o"
)
def three_way_split(spark, sf):
    return resampling.three_way(members(spark, sf), 0.2, 0.25, 7)


@query(
    f"WITH {MEMBERS}, o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY md5(concat_ws('|', '7', f, sample)), sample) AS rn, sum(CASE WHEN grp = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY f) AS n1 FROM m, generate_series(1, 10) AS t(f)) "
    "SELECT CAST(f AS INTEGER) AS replicate, sample, grp, CASE WHEN rn <= n1 THEN 1 ELSE 2 END AS pseudo FROM o"
)
def permute_labels(spark, sf):
    return resampling.permuted_labels(members(spark, sf), 10, 7)


@query(f"WITH {LONG} SELECT CAST(f AS INTEGER) AS replicate, feature, CAST(row_number() OVER (PARTITION BY f ORDER BY md5(concat_ws('|', '7', f, feature)), feature) AS INTEGER) AS rank FROM (SELECT DISTINCT feature FROM l), generate_series(1, 10) AS t(f)")
def neg_control_features(spark, sf):
    return resampling.random_features(long(spark, sf), 10, 7)


@query("WITH o AS (SELECT vec_id AS sample, f, row_number() OVER (PARTITION BY f ORDER BY md5(concat_ws('|', '7', f, vec_id)), vec_id) AS rn, count(*) OVER (PARTITION BY f) AS n FROM embeddings, generate_series(1, 10) AS t(f)) SELECT CAST(f AS INTEGER) AS run, sample FROM o WHERE rn <= round_even(n * CAST(0.8 AS DOUBLE), 0)")
def consensus_subsamples(spark, sf):
    return resampling.subsampled_runs(arrays(spark, sf), 10, 0.8, 7)


@query(
    "WITH o AS (SELECT vec_id AS sample, row_number() OVER (ORDER BY md5(concat_ws('|', '7', 0, vec_id)), vec_id) AS rn FROM embeddings), k AS (SELECT count(*) AS n FROM embeddings), "
    "d AS (SELECT f AS run, unnest(generate_series(1, CAST(round_even(n * CAST(0.8 AS DOUBLE), 0) AS BIGINT))) AS c, n FROM k, generate_series(1, 10) AS t(f)), "
    "e AS (SELECT run, c, CAST('0x' || substr(md5(concat_ws('|', '7r', run, c)), 1, 8) AS BIGINT) % n + 1 AS rn FROM d) SELECT CAST(run AS INTEGER) AS run, CAST(c AS INTEGER) AS copy_no, sample FROM e JOIN o USING (rn)"
)
def consensus_draws(spark, sf):
    return resampling.drawn_runs(arrays(spark, sf), 10, 0.8, 7)


# Statistics


@query(f"WITH {LONG} SELECT label, feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM l GROUP BY label, feature")
def row_mean_sd(spark, sf):
    return rounded(statistics.moments(long(spark, sf), "label", "feature"), "mean", "sd")


@query("WITH l AS (SELECT user_id AS sample, event_type AS feature, CASE WHEN event_type = 'view' THEN 1.0 ELSE value END AS value FROM events) SELECT feature, count(*) AS n FROM l WHERE feature IN (SELECT feature FROM l GROUP BY feature HAVING stddev_samp(value) > 0) GROUP BY feature")
def zero_variance_filter(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("feature"), F.when(F.col("event_type") == "view", 1.0).otherwise(F.col("value")).alias("value"))
    return statistics.varying(rows).groupBy("feature").agg(F.count("*").alias("n"))


@query(f"WITH {LONG}, v AS (SELECT feature, var_samp(value) AS variance FROM l GROUP BY feature) SELECT feature, round(variance, 6) AS variance, CAST(row_number() OVER (ORDER BY variance DESC, feature) AS INTEGER) AS rank FROM v QUALIFY rank <= 20")
def top_variance_features(spark, sf):
    return rounded(statistics.top_variance(long(spark, sf), 20), "variance")


REFERENCE = f"{LONG}, r AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM l WHERE label = 1 GROUP BY feature)"


@query(f"WITH {REFERENCE} SELECT sample, l.feature, round((value - mean) / (sd / sqrt(n)), 6) AS t, n - 1 AS df FROM l JOIN r USING (feature) WHERE label <> 1")
def t_signature(spark, sf):
    rows = long(spark, sf)
    return rounded(statistics.t_signature(rows.where("label <> 1"), rows.where("label = 1")), "t")


@query(f"WITH {REFERENCE} SELECT sample, l.feature, round((value - mean) / sd, 6) AS z FROM l JOIN r USING (feature) WHERE label <> 1")
def z_signature(spark, sf):
    rows = long(spark, sf)
    return rounded(statistics.z_signature(rows.where("label <> 1"), rows.where("label = 1")), "z")


@query()
def signed_z(spark, sf):
    rows = long(spark, sf)
    return statistics.signed_z_signature(rows.where("label <> 1"), rows.where("label = 1"))


WELCH = f"{LONG}, g AS (SELECT feature, count(*) FILTER (WHERE label = 0) AS n1, avg(value) FILTER (WHERE label = 0) AS m1, var_samp(value) FILTER (WHERE label = 0) AS v1, count(*) FILTER (WHERE label = 1) AS n2, avg(value) FILTER (WHERE label = 1) AS m2, var_samp(value) FILTER (WHERE label = 1) AS v2 FROM l WHERE label < 2 GROUP BY feature)"


@query(f"WITH {WELCH} SELECT feature, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS df FROM g")
def welch_moments(spark, sf):
    rows = long(spark, sf).where("label < 2").withColumn("grp", F.col("label") + 1)
    return rounded(statistics.welch(rows), "t", "df").drop("log_p")


@query()
def welch_log_p(spark, sf):
    return statistics.welch(long(spark, sf).where("label < 2").withColumn("grp", F.col("label") + 1))


def distance_sql(value: str) -> str:
    return f"WITH {LONG} SELECT x.sample AS a, y.sample AS b, round({value}, 6) AS dist FROM l x JOIN l y ON x.feature = y.feature AND x.sample < y.sample GROUP BY x.sample, y.sample"


@query(distance_sql("sqrt(sum((x.value - y.value) * (x.value - y.value)))"))
def euclid_distance(spark, sf):
    return rounded(statistics.distances(arrays(spark, sf), "euclid"), "dist")


@query(distance_sql("sum(abs(x.value - y.value))"))
def manhattan_distance(spark, sf):
    return rounded(statistics.distances(arrays(spark, sf), "manhattan"), "dist")


@query(distance_sql("1 - corr(x.value, y.value)"))
def pearson_distance(spark, sf):
    return rounded(statistics.distances(arrays(spark, sf), "pearson"), "dist")


# Ranking and selection

SCORES = f"{REFERENCE}, s AS (SELECT feature, sum((value - mean) / sd) AS score FROM l JOIN r USING (feature) WHERE label = 0 GROUP BY feature)"


def scores(spark, sf):
    rows = long(spark, sf)
    z = statistics.z_signature(rows.where("label = 0"), rows.where("label = 1")).withColumnRenamed("z", "nes")
    return statistics.stouffer(z).select("feature", F.col("total").alias("score"))


@query(f"WITH {REFERENCE} SELECT feature, round(sum((value - mean) / sd), 6) AS total, round(sum((value - mean) / sd) / sqrt(count(*)), 6) AS stouffer FROM l JOIN r USING (feature) WHERE label = 0 GROUP BY feature")
def stouffer(spark, sf):
    rows = long(spark, sf)
    z = statistics.z_signature(rows.where("label = 0"), rows.where("label = 1")).withColumnRenamed("z", "nes")
    return rounded(statistics.stouffer(z), "total", "stouffer")


@query(f"WITH {SCORES} SELECT feature, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM s")
def rank_signed(spark, sf):
    return ranking.ranked(scores(spark, sf), "signed").select("feature", "rank")


@query(f"WITH {SCORES} SELECT feature, CAST(row_number() OVER (ORDER BY abs(score) DESC, feature) AS INTEGER) AS rank FROM s")
def rank_abs(spark, sf):
    return ranking.ranked(scores(spark, sf), "abs").select("feature", "rank")


@query(f"WITH {SCORES}, q AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS t, count(*) OVER () AS n FROM s) SELECT feature, CAST(CASE WHEN t <= n - t + 1 THEN 2 * t - 1 ELSE 2 * (n - t + 1) END AS INTEGER) AS rank FROM q")
def rank_interleave(spark, sf):
    return ranking.ranked(scores(spark, sf), "interleaved").select("feature", "rank")


@query(
    f"WITH {LONG}, s AS (SELECT CAST(sample % 4 AS INTEGER) AS network, feature, avg(value) AS score FROM l GROUP BY 1, 2), q AS (SELECT *, rank() OVER (PARTITION BY network ORDER BY -score) + (count(*) OVER (PARTITION BY network, score) - 1) / 2.0 AS r FROM s), "
    "g AS (SELECT feature, count(*) AS n_networks, sum(r) AS rank_sum FROM q GROUP BY feature HAVING count(*) = 4) SELECT feature, n_networks, rank_sum, CAST(row_number() OVER (ORDER BY rank_sum, feature) AS INTEGER) AS rank FROM g"
)
def multi_network_rank_sum(spark, sf):
    parts = long(spark, sf).groupBy(F.pmod("sample", F.lit(4)).cast("int").alias("network"), "feature").agg(F.avg("value").alias("score"))
    return ranking.rank_sums(parts)


AUC = f"{LONG}, p AS (SELECT feature, label AS truth, value AS score FROM l WHERE label < 2), q AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0 AS r FROM p), a AS (SELECT feature, count(*) FILTER (WHERE truth = 1) AS n_pos, count(*) FILTER (WHERE truth = 0) AS n_neg, (sum(r) FILTER (WHERE truth = 1) - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auc FROM q GROUP BY feature)"


def predictions(spark, sf):
    return long(spark, sf).where("label < 2").select("feature", F.col("label").alias("truth"), F.col("value").alias("score"))


@query(f"WITH {AUC} SELECT feature, n_pos, n_neg, round(auc, 6) AS auc FROM a")
def auc_rank_sum(spark, sf):
    return rounded(ranking.auc(predictions(spark, sf), "feature"), "auc")


ROC = f"{LONG}, c AS (SELECT feature, value AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM l WHERE label < 2 GROUP BY 1, 2), roc AS (SELECT feature, threshold, sum(pos) OVER w / sum(pos) OVER v AS sensitivity, 1 - sum(neg) OVER w / sum(neg) OVER v AS specificity FROM c WINDOW w AS (PARTITION BY feature ORDER BY threshold DESC), v AS (PARTITION BY feature))"


@query(f"WITH {ROC} SELECT feature, threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM roc")
def roc_curve(spark, sf):
    return rounded(ranking.roc(predictions(spark, sf), "feature"), "sensitivity", "specificity")


@query(
    f"""WITH {ROC}, p AS (SELECT feature, specificity AS x, sensitivity AS y FROM roc UNION ALL SELECT DISTINCT feature, 1.0, 0.0 FROM roc),
    s AS (SELECT feature, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY feature ORDER BY x DESC, y)),
    t AS (SELECT *, least(x0, 1.0) AS a, greatest(x, 0.8) AS b FROM s WHERE x0 > x),
    u AS (SELECT feature, sum(CASE WHEN a > b THEN (a - b) * (2 * y0 + (y - y0) * (2 * x0 - a - b) / (x0 - x)) / 2 ELSE 0 END) AS area FROM t GROUP BY feature)
    SELECT feature, round((1 + (area - 0.02) / (0.2 - 0.02)) / 2, 6) AS pauc FROM u"""
)
def partial_auc(spark, sf):
    return rounded(ranking.partial_auc(predictions(spark, sf), 0.8, 1.0, "feature"), "pauc")


# A curve that needs no classifier: for n = 2.. the mean area of the first n features of the ranking, per replicate of samples.
CURVE = f"""{LONG}, p AS (SELECT CAST(sample % 3 AS INTEGER) AS replicate, feature, label AS truth, value AS score FROM l WHERE label < 2),
q AS (SELECT *, rank() OVER (PARTITION BY replicate, feature ORDER BY score) + (count(*) OVER (PARTITION BY replicate, feature, score) - 1) / 2.0 AS r FROM p),
a AS (SELECT replicate, feature, count(*) FILTER (WHERE truth = 1) AS n1, count(*) FILTER (WHERE truth = 0) AS n0, (sum(r) FILTER (WHERE truth = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS area FROM q GROUP BY 1, 2),
x AS (SELECT 'test' AS kind, feature + 2 AS n_features, replicate, abs(area - 0.5) + 0.5 AS auc FROM a UNION ALL SELECT 'neg', 65 - feature, replicate, area FROM a UNION ALL SELECT 'null', feature + 2, replicate, 1 - area FROM a)"""


def curve_aucs(spark, sf):
    rows = long(spark, sf).where("label < 2").select(F.pmod("sample", F.lit(3)).cast("int").alias("replicate"), "feature", F.col("label").alias("truth"), F.col("value").alias("score"))
    a = ranking.auc(rows, "replicate", "feature")
    part = lambda kind, n, v: a.select(F.lit(kind).alias("kind"), n.cast("int").alias("n_features"), "replicate", v.alias("auc"))
    f, v = F.col("feature"), F.col("auc")
    return part("test", f + 2, F.abs(v - 0.5) + 0.5).union(part("neg", 65 - f, v)).union(part("null", f + 2, 1 - v))


MEANS = f"{CURVE}, c AS (SELECT n_features, avg(auc) FILTER (WHERE kind = 'test') AS mean_auc, avg(auc) FILTER (WHERE kind = 'neg') AS neg_mean, stddev_samp(auc) FILTER (WHERE kind = 'neg') AS neg_sd, avg(auc) FILTER (WHERE kind = 'null') AS null_mean, stddev_samp(auc) FILTER (WHERE kind = 'null') AS null_sd FROM x GROUP BY n_features)"


@query(f"WITH {MEANS} SELECT n_features, round(mean_auc, 6) AS mean_auc, round(neg_mean, 6) AS neg_mean, round(neg_sd, 6) AS neg_sd, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd FROM c")
def auc_curve(spark, sf):
    columns = ["mean_auc", "neg_mean", "neg_sd", "null_mean", "null_sd"]
    return rounded(ranking.curves(curve_aucs(spark, sf)).select("n_features", *columns), *columns)


@query(f"WITH {MEANS}, g AS (SELECT n_features, min(CASE WHEN mean_auc >= neg_mean THEN 1 ELSE 0 END) OVER (ORDER BY n_features ROWS UNBOUNDED PRECEDING) AS good FROM c) SELECT CAST(coalesce(max(n_features) FILTER (WHERE good = 1), 0) AS INTEGER) AS size FROM g")
def prefix_rule(spark, sf):
    return ranking.prefix_size(ranking.curves(curve_aucs(spark, sf)), use_null=False)


@query()
def prefix_rule_with_null(spark, sf):
    return ranking.prefix_size(ranking.curves(curve_aucs(spark, sf)))


# Both rules below take p as given: here a number from the areas that stands for one.
WITH_P = f"{MEANS}, d AS (SELECT *, 1 - mean_auc AS p_null, 1 - mean_auc AS p FROM c)"


def with_p(spark, sf):
    return ranking.curves(curve_aucs(spark, sf)).withColumn("p_null", 1 - F.col("mean_auc")).withColumn("p", 1 - F.col("mean_auc"))


@query(f"WITH {WITH_P}, o AS (SELECT *, row_number() OVER (ORDER BY p_null, n_features) AS place FROM d) SELECT CAST(coalesce((SELECT n_features FROM o WHERE place >= 2 AND mean_auc >= neg_mean AND p_null < 0.4 ORDER BY place LIMIT 1), 0) AS INTEGER) AS size")
def max_diff_rule(spark, sf):
    return ranking.difference_size(with_p(spark, sf), 0.4)


@query(f"WITH {WITH_P} SELECT CAST(coalesce(min(n_features) FILTER (WHERE p > 0.3) - 1, max(n_features)) AS INTEGER) AS size FROM d")
def first_failure_rule(spark, sf):
    return ranking.first_failure_size(with_p(spark, sf), 0.3)


@query(f"WITH {CURVE}, y AS (SELECT CASE WHEN kind = 'test' THEN 'null' WHEN kind = 'null' THEN 'test' ELSE kind END AS kind, n_features, replicate, auc FROM x), f AS (SELECT avg(CASE WHEN m < 0.5 THEN 1.0 ELSE 0.0 END) > 0.3 AS inverted FROM (SELECT avg(auc) AS m FROM y WHERE kind = 'test' GROUP BY n_features)) SELECT kind, n_features, replicate, round(CASE WHEN inverted THEN 1 - auc ELSE auc END, 6) AS auc, inverted FROM y, f")
def auc_inversion_rule(spark, sf):
    kind = F.when(F.col("kind") == "test", "null").when(F.col("kind") == "null", "test").otherwise(F.col("kind"))
    rows = curve_aucs(spark, sf).withColumn("kind", kind).withColumn("unit", F.lit(1))
    return rounded(ranking.inverted(rows, 0.3, "unit").drop("unit"), "auc")


@query(f"WITH {MEANS} SELECT n_features, round(neg_mean, 6) AS mean, round(neg_sd, 6) AS sd, round(neg_mean - 2 * neg_sd, 6) AS lower, round(neg_mean + 2 * neg_sd, 6) AS upper FROM c WHERE neg_mean IS NOT NULL")
def error_band(spark, sf):
    curve = ranking.curves(curve_aucs(spark, sf)).where("neg_mean is not null").select("n_features", F.col("neg_mean").alias("mean"), F.col("neg_sd").alias("sd"))
    return rounded(statistics.banded(curve, 2.0), "mean", "sd", "lower", "upper")


# Folds, t statistics on the training members, ranks, the first ten, votes

TRAINED = f"""{LONG}, {MEMBERS}, o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '7', '0', sample)), sample) AS rn, count(*) OVER () AS n FROM m),
f AS (SELECT CAST(f AS INTEGER) AS fold, grp, sample FROM o, generate_series(1, 5) AS t(f) WHERE (rn - 1) // (n // 5) + 1 <> f),
g AS (SELECT fold, feature, count(*) FILTER (WHERE grp = 1) AS n1, avg(value) FILTER (WHERE grp = 1) AS m1, var_samp(value) FILTER (WHERE grp = 1) AS v1, count(*) FILTER (WHERE grp = 2) AS n2, avg(value) FILTER (WHERE grp = 2) AS m2, var_samp(value) FILTER (WHERE grp = 2) AS v2 FROM f JOIN l USING (sample) GROUP BY fold, feature),
k AS (SELECT fold, feature, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS nes FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY abs(nes) DESC, feature) AS rank FROM k),
w AS (SELECT feature, count(*) AS votes, avg(nes) AS mean_nes, sum(nes) AS sum_nes FROM r WHERE rank <= 10 GROUP BY feature)"""


def fold_rankings(spark, sf):
    train = resampling.k_fold(members(spark, sf), 5, 7).where("role = 'train'")
    rows = train.join(long(spark, sf).select("sample", "feature", "value"), "sample")
    of = lambda g, f: f(F.when(F.col("grp") == g, F.col("value")))
    m = rows.groupBy("fold", "feature").agg(*[of(g, f).alias(f"{name}{g}") for g in (1, 2) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    return ranking.ranked(m.select("fold", "feature", t.alias("score")), "abs", "fold").withColumnRenamed("score", "nes")


@query(f"WITH {TRAINED} SELECT feature, votes, round(mean_nes, 6) AS mean_nes, round(sum_nes, 6) AS sum_nes, CAST(row_number() OVER (ORDER BY votes DESC, mean_nes DESC, feature) AS INTEGER) AS rank FROM w")
def fold_votes(spark, sf):
    rankings = fold_rankings(spark, sf)
    sizes = rankings.select("fold").distinct().withColumn("size", F.lit(10))
    return rounded(ranking.votes(rankings, sizes, ["fold"]), "mean_nes", "sum_nes")


# Networks

NETWORK = f"{LONG}, net AS (SELECT CAST(x.sample % 2 AS INTEGER) AS network_id, x.feature AS regulator, y.feature AS target, corr(x.value, y.value) AS tfmode FROM l x JOIN l y ON x.sample = y.sample AND x.feature <> y.feature GROUP BY 1, 2, 3)"


@query(f"WITH {NETWORK} SELECT network_id, regulator, target, round(tfmode, 6) AS tfmode FROM (SELECT *, row_number() OVER (PARTITION BY network_id, regulator ORDER BY abs(tfmode) DESC, target) AS place FROM net) WHERE place <= 20")
def network_prune(spark, sf):
    return rounded(enrichment.pruned(enrichment.correlation_network(long(spark, sf), 2), 20).drop("likelihood"), "tfmode")


@query()
def enrichment_nes(spark, sf):
    network = enrichment.pruned(enrichment.correlation_network(long(spark, sf), 2), 20)
    return enrichment.activity(long(spark, sf).select("sample", "feature", "value"), network)


@query()
def enrichment_against_null(spark, sf):
    network = enrichment.pruned(enrichment.correlation_network(long(spark, sf), 2), 20)
    return enrichment.activity_against_null(long(spark, sf).select("sample", "feature", "value"), members(spark, sf), network, 100, 7)


# Consensus clustering: run r looks at four positions, and the largest names the cluster; four fifths of the samples are in a run.

RUNS = """runs AS (SELECT CAST(r AS INTEGER) AS run, vec_id AS sample, CAST(list_position(embedding[4 * r + 1 : 4 * r + 4], list_max(embedding[4 * r + 1 : 4 * r + 4])) AS INTEGER) AS cluster
FROM embeddings, generate_series(0, 7) AS t(r) WHERE CAST('0x' || substr(md5(concat_ws('|', '7', r, vec_id)), 1, 8) AS BIGINT) % 5 <> 0)"""


def runs(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(7))))
    four = F.expr("slice(embedding, 4 * run + 1, 4)")
    kept = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("7"), F.col("run").cast("string"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("long") % 5 != 0
    return rows.where(kept).select("run", F.col("vec_id").alias("sample"), F.array_position(four, F.array_max(four)).cast("int").alias("cluster"))


PAIRS = f"{RUNS}, own AS (SELECT sample, count(*) AS whole FROM runs GROUP BY sample), co AS (SELECT a.sample AS row_sample, b.sample AS col_sample, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.cluster = b.cluster GROUP BY 1, 2), ca AS (SELECT row_sample, col_sample, CAST(n AS DOUBLE) AS n, n / whole AS norm FROM co JOIN own ON col_sample = sample)"


@query(f"WITH {PAIRS} SELECT row_sample, col_sample, n, round(norm, 6) AS norm FROM ca")
def coassociation(spark, sf):
    return consensus.coassociation(runs(spark, sf), digits=6)


@query(f"WITH {RUNS}, co AS (SELECT a.sample AS row_sample, b.sample AS col_sample, sum(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS n, count(*) AS whole FROM runs a JOIN runs b ON a.run = b.run GROUP BY 1, 2) SELECT row_sample, col_sample, CAST(n AS DOUBLE) AS n, round(n / whole, 6) AS norm FROM co WHERE n > 0")
def coassociation_norm(spark, sf):
    return consensus.coassociation(runs(spark, sf), per_sampled=True, digits=6)


@query(f"WITH {RUNS}, co AS (SELECT a.run % 2 AS part, a.sample AS row_sample, b.sample AS col_sample, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.cluster = b.cluster GROUP BY 1, 2, 3) SELECT row_sample, col_sample, CAST(sum(n) AS DOUBLE) AS total, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd FROM co GROUP BY 1, 2")
def merge_adjacency(spark, sf):
    return rounded(consensus.merged_counts(runs(spark, sf), 2), "mean", "sd")


LOW = "low AS (SELECT vec_id AS sample FROM embeddings WHERE label = 3)"


def low(spark, sf):
    return table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("sample"))


@query(f"WITH {PAIRS}, {LOW} SELECT c.row_sample, c.col_sample, CASE WHEN low.sample IS NULL THEN c.n END AS n, round(CASE WHEN low.sample IS NULL THEN c.n / own.whole END, 6) AS norm FROM ca c LEFT JOIN low ON c.col_sample = low.sample LEFT JOIN own ON own.sample = c.col_sample")
def mask_low_confidence(spark, sf):
    return consensus.coassociation(runs(spark, sf), low=low(spark, sf), digits=6)


@query(f"WITH {PAIRS} SELECT row_sample AS src, col_sample AS dst, round(norm, 6) AS weight FROM ca WHERE row_sample <> col_sample")
def graph_edges(spark, sf):
    return consensus.edges(consensus.coassociation(runs(spark, sf), digits=6))


SILHOUETTE = f"""{LONG}, d AS (SELECT x.sample AS i, y.sample AS j, x.label AS li, y.label AS lj, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist FROM l x JOIN l y ON x.feature = y.feature AND x.sample <> y.sample GROUP BY 1, 2, 3, 4),
e AS (SELECT i, li, lj, avg(dist) AS m FROM d GROUP BY 1, 2, 3), h AS (SELECT i, li, max(m) FILTER (WHERE li = lj) AS a, min(m) FILTER (WHERE li <> lj) AS b FROM e GROUP BY 1, 2),
sil AS (SELECT i AS sample, li AS cluster, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM h)"""


def silhouette_scores(spark, sf):
    rows = arrays(spark, sf).select(F.lit(0).alias("run"), "sample", "values", F.col("label").alias("cluster"))
    return medoids.silhouettes(rows, least=8).drop("run")


@query(f"WITH {SILHOUETTE} SELECT sample, cluster, round(silhouette, 6) AS silhouette FROM sil")
def silhouette(spark, sf):
    return rounded(silhouette_scores(spark, sf), "silhouette")


@query(f"WITH {SILHOUETTE} SELECT cluster, silhouette >= 0.25 AS confident, count(*) AS n FROM sil GROUP BY 1, 2")
def silhouette_split(spark, sf):
    return consensus.confidence(silhouette_scores(spark, sf)).groupBy("cluster", "confident").agg(F.count("*").alias("n"))


MEDIANS = f"{LONG}, med AS (SELECT label, feature, quantile_cont(value, 0.5) AS m FROM l WHERE feature < 3 GROUP BY 1, 2), cd AS (SELECT x.label AS ci, y.label AS cj, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS dist FROM med x JOIN med y USING (feature) GROUP BY 1, 2)"


def centres(spark, sf):
    rows = long(spark, sf)
    return consensus.centre_distances(rows.select("sample", "feature", "value"), arrays(spark, sf).select("sample", F.col("label").alias("cluster")))


@query(f"WITH {MEDIANS} SELECT ci, cj, round(dist, 6) AS dist FROM cd")
def centre_distance(spark, sf):
    return rounded(centres(spark, sf), "dist")


@query(f"WITH {MEDIANS} SELECT ci, cj, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY ci ORDER BY dist DESC, cj) AS INTEGER) AS rank FROM cd WHERE ci <> cj QUALIFY rank <= 3")
def farthest_clusters(spark, sf):
    return rounded(consensus.farthest(centres(spark, sf), 3), "dist")


VERSUS = f"""{MEDIANS}, far AS (SELECT ci, cj, row_number() OVER (PARTITION BY ci ORDER BY dist DESC, cj) AS place FROM cd WHERE ci <> cj QUALIFY place <= 3),
mem AS (SELECT label AS cluster, sample, feature, value, 1 AS grp FROM l UNION ALL SELECT ci, sample, feature, value, 2 FROM far JOIN l ON label = cj),
tt AS (SELECT cluster, feature, (avg(value) FILTER (WHERE grp = 1) - avg(value) FILTER (WHERE grp = 2)) / sqrt(var_samp(value) FILTER (WHERE grp = 1) / count(*) FILTER (WHERE grp = 1) + var_samp(value) FILTER (WHERE grp = 2) / count(*) FILTER (WHERE grp = 2)) AS nes FROM mem GROUP BY 1, 2)"""


def versus_farthest(spark, sf):
    """(cluster, feature, nes): each cluster's Welch's t against the three clusters farthest from it."""
    from tessella.jobs import workflows

    rows = long(spark, sf)
    own = rows.select("sample", F.col("label").alias("cluster")).distinct()
    members = consensus.cluster_members(own, consensus.farthest(centres(spark, sf), 3))
    return workflows.signatures(rows.select("sample", "feature", "value"), members, "cluster")


@query(f"WITH {VERSUS} SELECT cluster, feature, round(nes, 6) AS nes, CAST(row_number() OVER (PARTITION BY cluster ORDER BY abs(nes) DESC, feature) AS INTEGER) AS rank FROM tt")
def cluster_versus_farthest(spark, sf):
    found = ranking.ranked(versus_farthest(spark, sf).withColumnRenamed("nes", "score"), "abs", "cluster")
    return rounded(found.withColumnRenamed("score", "nes"), "nes").select("cluster", "feature", "nes", "rank")


@query(f"WITH {VERSUS}, e AS (SELECT cluster % 3 AS network, feature, avg(nes) AS m FROM tt GROUP BY 1, 2) SELECT feature, count(*) AS n_networks, round(avg(m), 6) AS mean FROM e GROUP BY 1")
def mean_of_network_means(spark, sf):
    rows = versus_farthest(spark, sf).select((F.col("cluster") % 3).alias("network"), "feature", F.col("nes").alias("score"))
    return rounded(ranking.mean_of_means(rows), "mean")


@query(f"WITH {RUNS} SELECT label AS cluster_a, cluster AS cluster_b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM embeddings JOIN runs ON vec_id = sample AND run = 0 GROUP BY 1, 2")
def cluster_contingency(spark, sf):
    own = arrays(spark, sf).select("sample", F.col("label").alias("cluster"))
    return rounded(consensus.contingency(own, runs(spark, sf).where("run = 0")), "share")


# Neighbours

NEAR = f"{LONG}, d AS (SELECT x.sample, y.sample AS neighbor, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist FROM l x JOIN l y ON x.feature = y.feature AND x.sample <> y.sample GROUP BY 1, 2), nn AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY dist, neighbor) AS rank FROM d)"


@query(f"WITH {NEAR} SELECT sample, neighbor, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 5")
def knn(spark, sf):
    return rounded(neighbours.knn(arrays(spark, sf), 5), "dist")


@query(f"WITH {NEAR}, g AS (SELECT vec_id AS sample, CASE WHEN label < 5 THEN 1 ELSE 2 END AS grp FROM embeddings), f AS (SELECT sample, neighbor FROM nn WHERE rank = 1) SELECT f.sample, f.neighbor FROM f JOIN g a ON a.sample = f.sample AND a.grp = 1 JOIN g b ON b.sample = f.neighbor AND b.grp = 2")
def tomek_links(spark, sf):
    rows = arrays(spark, sf).withColumn("grp", F.when(F.col("label") < 5, 1).otherwise(2))
    return neighbours.tomek_links(rows, mutual=False)


@query(f"WITH {NEAR} SELECT a.sample AS src, b.sample AS dst, count(*) AS shared FROM nn a JOIN nn b ON a.neighbor = b.neighbor AND a.sample < b.sample WHERE a.rank <= 5 AND b.rank <= 5 GROUP BY 1, 2")
def shared_neighbours(spark, sf):
    return consensus.shared_neighbours(neighbours.knn(arrays(spark, sf), 5))


@query(
    f"""WITH {LONG}, few AS (SELECT vec_id AS sample FROM embeddings WHERE label = 0), s AS (SELECT count(*) FILTER (WHERE label = 0) AS few, count(*) FILTER (WHERE label IN (1, 2)) AS many FROM embeddings),
    o AS (SELECT sample, row_number() OVER (ORDER BY md5(concat_ws('|', '7', sample)), sample) AS rn FROM few),
    c AS (SELECT sample, CAST(u AS INTEGER) AS copy_no FROM o, s, generate_series(1, 1000) AS t(u) WHERE u <= (many - few) // few + CASE WHEN rn <= (many - few) % few THEN 1 ELSE 0 END),
    d AS (SELECT x.sample, y.sample AS neighbor, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist FROM l x JOIN l y ON x.feature = y.feature AND x.sample <> y.sample WHERE x.label = 0 AND y.label = 0 GROUP BY 1, 2),
    nn AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY dist, neighbor) AS rank FROM d)
    SELECT c.sample, copy_no, neighbor, round(sum(x.value + CAST('0x' || substr(md5(concat_ws('|', '7u', c.sample, copy_no)), 1, 8) AS BIGINT) / 4294967296.0 * (y.value - x.value)), 6) AS total
    FROM c JOIN nn ON nn.sample = c.sample AND rank = floor(CAST('0x' || substr(md5(concat_ws('|', '7n', c.sample, copy_no)), 1, 8) AS BIGINT) / 4294967296.0 * 5) + 1 JOIN l x ON x.sample = c.sample JOIN l y ON y.sample = neighbor AND y.feature = x.feature GROUP BY 1, 2, 3"""
)
def smote(spark, sf):
    rows = arrays(spark, sf).where("label < 3").withColumn("grp", F.when(F.col("label") == 0, 1).otherwise(2))
    made = neighbours.smote(rows, 1, 5, 7)
    return rounded(made.select("sample", "copy_no", "neighbor", F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total")), "total")


# Classifier sweeps

#: All prefix sizes up to 50, so that a rule that stops at the first failure sees each; and a few for the slower methods.
SIZES = list(range(2, 51))
FEW_SIZES = [2, 3, 5, 8, 13, 20]


def sweep_inputs(spark, sf):
    """Folds and rankings of the three kinds: true labels, permuted labels, random features."""
    true = resampling.k_fold(members(spark, sf), 5, 7)
    top = fold_rankings(spark, sf).select("fold", "feature", "rank")
    kind = lambda d, k: d.withColumn("kind", F.lit(k))
    one = F.lit(1).alias("replicate")
    fake = true.where("role = 'train'").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(5))))
    w = Window.partitionBy("fold", "replicate")
    first = F.sum(F.when(F.col("grp") == 1, 1).otherwise(0)).over(w)
    hashed = F.md5(F.concat_ws("|", F.lit("7p"), "fold", "replicate", "sample"))
    fake = fake.withColumn("grp", F.when(F.row_number().over(w.orderBy(hashed, "sample")) <= first, 1).otherwise(2))
    tested = true.where("role = 'valid'").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(5))))
    both = fake.select("fold", "replicate", "role", "grp", "sample").unionByName(tested.select("fold", "replicate", "role", "grp", "sample"))
    again = true.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(5))))
    names = ["fold", "kind", "replicate", "role", "grp", "sample"]
    folds = reduce(DataFrame.unionByName, [kind(true.select("*", one), "test").select(names), kind(both, "null").select(names), kind(again, "neg").select(names)])
    control = resampling.random_features(long(spark, sf), 5, 7).crossJoin(F.broadcast(true.select("fold").distinct()))
    more = top.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(5))))
    columns = ["fold", "kind", "replicate", "feature", "rank"]
    ranks = reduce(DataFrame.unionByName, [kind(top.select("*", one), "test").select(columns), kind(more, "null").select(columns), kind(control, "neg").select(columns)])
    return long(spark, sf).select("sample", "feature", "value"), folds, ranks


@query()
def sweep_controls(spark, sf):
    found = classify.sweep(*sweep_inputs(spark, sf), SIZES)
    return ranking.auc(found, "kind", "replicate", "n_features")


@query()
def sweep_selected_size(spark, sf):
    found = classify.sweep(*sweep_inputs(spark, sf), SIZES)
    return ranking.prefix_size(ranking.curves(ranking.auc(found, "kind", "replicate", "n_features")), 0.05)


def only_test(spark, sf, method):
    matrix, folds, ranks = sweep_inputs(spark, sf)
    found = classify.sweep(matrix, folds.where("kind = 'test'"), ranks.where("kind = 'test'"), SIZES if method == "lda" else FEW_SIZES, method)
    return ranking.auc(found, "kind", "n_features")


@query()
def sweep_lda(spark, sf):
    return only_test(spark, sf, "lda")


@query()
def sweep_logistic(spark, sf):
    return only_test(spark, sf, "logistic")


@query()
def sweep_forest(spark, sf):
    return only_test(spark, sf, "forest")


@query()
def held_out_test(spark, sf):
    """Areas on held-out samples of the features that the folds have voted for."""
    from tessella.jobs import workflows

    return workflows.select_features(long(spark, sf).select("sample", "feature", "value"), members(spark, sf))["final"]


# Clusters


def first_components(spark, sf, k=8):
    return clusters.principal_components(arrays(spark, sf), k).withColumnRenamed("coord", "values")


@query()
def pca(spark, sf):
    return first_components(spark, sf).select("sample", F.posexplode("values").alias("component", "value"))


@query()
def consensus_clusters(spark, sf):
    """Co-association of seeded runs of subsampling, choosing variable features, and clustering."""
    return consensus.coassociation(clusters.consensus_runs(arrays(spark, sf).select("sample", "values"), 20, 0.8, 10, 7))


@query()
def consensus_run_labels(spark, sf):
    return clusters.consensus_runs(arrays(spark, sf).select("sample", "values"), 20, 0.8, 10, 7)


@query(f"WITH {LONG} SELECT a.label AS run, a.feature AS i, b.feature AS j, round(coalesce(covar_samp(a.value, b.value), 0), 6) + 0.0 AS value FROM l a JOIN l b ON a.sample = b.sample GROUP BY 1, 2, 3")
def label_covariances(spark, sf):
    """The covariances of each label's rows."""
    found = reduction.covariances(reduction.with_mean(arrays(spark, sf).select(F.col("label").alias("run"), "sample", "values")))
    return found.select("run", "i", F.posexplode("cells").alias("j", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query()
def consensus_reduced_labels(spark, sf):
    """Labels of runs that each take 80 % of the samples, their most variable positions and two components of these, and
    cluster them by k-means with a k drawn from 10 to 12."""
    return reduction.consensus_reduced(arrays(spark, sf).select("sample", "values"), medoids.drawn_ks(20, 10, 12, 7), 0.8, 2, 7)


@query()
def consensus_reduced_medoids(spark, sf):
    """Co-association of such runs, by medoids."""
    found = reduction.consensus_reduced(arrays(spark, sf).select("sample", "values"), medoids.drawn_ks(10, 10, 12, 7), 0.8, 2, 7, clusterer="pam")
    return consensus.coassociation(found)


@query()
def pam(spark, sf):
    """The k from 2 to 12 whose medoids give the best mean silhouette."""
    return medoids.best_of(arrays(spark, sf).select("sample", "values"), list(range(2, 13))).select("sample", "cluster")


@query()
def medoid_consensus(spark, sf):
    """Co-clustered by co-sampled runs of 10 medoids by Pearson's distance, each over 75 % of the samples and of the features."""
    return consensus.coassociation(sampled_medoids(spark, sf), per_sampled=True)


def sampled_medoids(spark, sf):
    return medoids.consensus_medoids(arrays(spark, sf).select("sample", "values"), dict.fromkeys(range(1, 51), 10), 0.75, 0.75, 7)


@query()
def medoid_consensus_cut(spark, sf):
    """Ten clusters of average linkage over 1 less that share; pairs that no run has together in a cluster are 1 apart."""
    samples = arrays(spark, sf).select("sample")
    return dendrograms.cut(consensus.average_tree(sampled_medoids(spark, sf), samples), samples, 10)


@query()
def medoid_runs_drawn_k(spark, sf):
    """Labels of runs whose k is drawn from 10 to 12."""
    return medoids.consensus_medoids(arrays(spark, sf).select("sample", "values"), medoids.drawn_ks(20, 10, 12, 7), 0.8, 1.0, 7, "euclid").select("run", "sample", "cluster")


def neighbour_graph(spark, sf):
    return consensus.shared_neighbours(neighbours.knn(arrays(spark, sf), 5)).withColumnRenamed("shared", "weight")


@query()
def graph_communities(spark, sf):
    """Communities of the shared-neighbour graph by modularity."""
    return communities.communities(neighbour_graph(spark, sf))


@query(
    f"""WITH {NEAR}, e AS (SELECT a.sample AS src, b.sample AS dst, count(*) AS w FROM nn a JOIN nn b ON a.neighbor = b.neighbor AND a.sample <> b.sample WHERE a.rank <= 5 AND b.rank <= 5 GROUP BY 1, 2),
    p AS (SELECT x.label AS x, y.label AS y, w FROM e JOIN embeddings x ON x.vec_id = src JOIN embeddings y ON y.vec_id = dst),
    c AS (SELECT x, sum(w) AS total, sum(CASE WHEN x = y THEN w ELSE 0 END) AS within FROM p GROUP BY 1)
    SELECT count(*) AS communities, round(sum(within) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) AS modularity FROM c"""
)
def label_modularity(spark, sf):
    """The modularity of the labels on the shared-neighbour graph."""
    own = arrays(spark, sf).select("sample", F.col("label").alias("cluster"))
    return rounded(communities.modularity(neighbour_graph(spark, sf), own), "modularity")


@query()
def dendrogram_ward(spark, sf):
    return dendrograms.point_ward(arrays(spark, sf))


@query()
def dendrogram_single(spark, sf):
    return dendrograms.point_tree(arrays(spark, sf)).select("a", "b", "height")


@query()
def dendrogram_average_cut(spark, sf):
    """Ten clusters of average linkage."""
    rows = arrays(spark, sf)
    return dendrograms.cut(dendrograms.point_average(rows), rows, 10)


@query()
def gmm_bic(spark, sf):
    return clusters.mixture(first_components(spark, sf, 4), 6)[1]


@query()
def mixture_models(spark, sf):
    """BIC of six covariance models with 1 to 6 components over four principal components."""
    rows = first_components(spark, sf, 4)
    fits, n, _ = mixtures.fitted(rows, 6)
    return mixtures.scores(rows, fits, n)


@query()
def spectral(spark, sf):
    shared = consensus.shared_neighbours(neighbours.knn(arrays(spark, sf), 10)).withColumnRenamed("shared", "weight")
    return clusters.graph_clusters(shared, 10)


@query()
def cluster_transfer(spark, sf):
    rows = arrays(spark, sf)
    own = rows.select("sample", F.col("label").alias("cluster"))
    folds = resampling.k_fold(rows.select("sample", F.lit(1).alias("grp")), 5, 7).where("fold = 1")
    part = lambda role: rows.join(folds.where(F.col("role") == role).select("sample"), "sample", "left_semi")
    return clusters.transferred(part("train"), own, part("valid"), 50)


@query()
def greedy_feature_addition(spark, sf):
    """Features kept of each cluster's ranking against its farthest clusters, three cycles of forests of 20 trees."""
    rows = arrays(spark, sf)
    rankings = ranking.ranked(versus_farthest(spark, sf).withColumnRenamed("nes", "score"), "abs", "cluster")
    return clusters.greedy_addition(rows, rows.select("sample", F.col("label").alias("cluster")), rankings, 3, 2, 20)
