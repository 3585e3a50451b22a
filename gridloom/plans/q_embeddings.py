"""Embedding checks, comparisons, neighbours, probes and array operators (sections B33-B37, K)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import arrays as Ar, rules
from gridloom.operators import decisions as Dc, embeddings as E, metrics as M, neighbours as Ng, probing as Pr, splits as Sp
from gridloom.plans.fixtures import fx_patch, fx_pixel, fx_vec, table
from gridloom.plans.q_reports import rounded
from gridloom.plans.q_splits import h_sql
from gridloom.plans.registry import query
from gridloom.sources import tiles as Tl

VEC = """(SELECT patch_id, y, region, label, CAST(embedding AS DOUBLE[]) AS e, CAST(other AS DOUBLE[]) AS o, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x + 0.01) AS t FROM fx_vec)"""


def third(spark, d):
    """A third modality: every value squared, plus a constant."""
    x = F.transform("embedding", lambda v: v.cast("double") * v.cast("double") + 0.01)
    return fx_vec(spark, d).select("patch_id", x.alias("embedding"))


def second(spark, d):
    return fx_vec(spark, d).select("patch_id", F.col("other").alias("embedding"))


@query("cosine", f"SELECT patch_id, round(list_cosine_similarity(e, o), 6) AS cosine FROM {VEC}")
def _(spark, d):
    return rounded(E.row_cosine(E.pair_embeddings(fx_vec(spark, d), second(spark, d))))


def _cons(kind, value):
    stats = ", ".join(
        f"round({f}({c}), 6) AS {s}_{n}" for c, s in (("s", "snap"), ("r", "rtc"), ("d", "delta")) for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"), ("median", "median"))
    )
    quart = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {s}_{n}" for c, s in (("s", "snap"), ("r", "rtc"), ("d", "delta")) for q, n in ((0.25, "q25"), (0.75, "q75")))
    return f"""SELECT '{kind}' AS group_type, {value} AS group_value, count(*) AS n, CAST(count(*) FILTER (y = 1) AS BIGINT) AS positive_count, CAST(count(*) FILTER (y = 0) AS BIGINT) AS empty_count, {stats}, {quart},
      CAST(count(*) FILTER (d > 1e-8) AS BIGINT) AS rtc_wins, CAST(count(*) FILTER (d < -1e-8) AS BIGINT) AS snap_wins, CAST(count(*) FILTER (abs(d) <= 1e-8) AS BIGINT) AS ties,
      CASE WHEN avg(d) > 1e-8 AND count(*) FILTER (d > 1e-8) > count(*) FILTER (d < -1e-8) THEN 'RTC higher consistency' WHEN avg(d) < -1e-8 AND count(*) FILTER (d < -1e-8) > count(*) FILTER (d > 1e-8) THEN 'SNAP-GRD higher consistency'
        WHEN abs(avg(d)) <= 1e-8 THEN 'Near tie' WHEN avg(d) > 0 THEN 'RTC higher mean, mixed patches' ELSE 'SNAP-GRD higher mean, mixed patches' END AS decision FROM c GROUP BY ALL"""


@query(
    "consistency",
    f"WITH c AS (SELECT y, region, list_cosine_similarity(e, o) AS s, list_cosine_similarity(e, t) AS r, list_cosine_similarity(e, t) - list_cosine_similarity(e, o) AS d FROM {VEC}) "
    + " UNION ALL ".join((_cons("overall", "'all_patches'"), _cons("region", "region"), _cons("label_binary", "CAST(y AS VARCHAR)"))),
)
def _(spark, d):
    v = fx_vec(spark, d)
    snap = E.row_cosine(E.pair_embeddings(v, second(spark, d))).withColumnRenamed("cosine", "cos_snap")
    rtc = E.row_cosine(E.pair_embeddings(v, third(spark, d))).withColumnRenamed("cosine", "cos_rtc")
    rows = v.select("patch_id", F.col("y").alias("label_binary"), "region").join(snap, "patch_id").join(rtc, "patch_id")
    return rounded(E.consistency(rows, ["region", "label_binary"]))


@query(
    "check_embeddings",
    f"""WITH u AS (SELECT patch_id, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS k FROM {VEC}), n AS (SELECT patch_id, sqrt(sum(v * v)) AS l FROM u GROUP BY 1)
      SELECT 's2' AS modality, (SELECT count(*) FROM fx_vec) AS n_rows, CAST((SELECT max(len(e)) FROM {VEC}) AS INTEGER) AS embedding_dim, TRUE AS one_shape, TRUE AS all_finite, (SELECT count(*) FROM fx_vec WHERE y = 1) AS positive_count, (SELECT count(*) FROM fx_vec WHERE y = 0) AS empty_count,
      round((SELECT avg(v) FROM u), 6) AS global_mean, round((SELECT stddev_pop(v) FROM u), 6) AS global_std, round((SELECT avg(l) FROM n), 6) AS mean_l2_norm, round((SELECT min(l) FROM n), 6) AS min_l2_norm, round((SELECT max(l) FROM n), 6) AS max_l2_norm,
      CAST((SELECT count(*) FROM (SELECT k FROM u GROUP BY k HAVING stddev_pop(v) <= 1e-12)) AS INTEGER) AS zero_variance_dimensions, CAST(0 AS BIGINT) AS duplicate_ids, 'passed' AS status""",
)
def _(spark, d):
    emb = fx_vec(spark, d).select(F.lit("s2").alias("modality"), "patch_id", F.col("y").alias("label_binary"), "embedding")
    return rounded(E.check_embeddings(emb))


@query(
    "pairwise_check",
    f"""WITH u AS (SELECT patch_id, unnest(e) AS a, unnest(o) AS b FROM {VEC}) SELECT TRUE AS same_shape, round(max(abs(a - b)), 6) AS max_abs_diff, round(avg(abs(a - b)), 6) AS mean_abs_diff, (SELECT round(avg(list_cosine_similarity(e, o)), 6) FROM {VEC}) AS mean_cosine_similarity,
      bool_and(abs(a - b) <= 1e-8 + 1e-6 * abs(b)) AS allclose, 'passed' AS status FROM u""",
)
def _(spark, d):
    return rounded(E.pairwise_check(E.pair_embeddings(fx_vec(spark, d), second(spark, d))))


@query(
    "metadata_agreement",
    """WITH j AS (SELECT a.patch_id, b.patch_id AS other, a.y AS ya, CASE WHEN b.patch_id % 10 = 0 THEN 1 ELSE b.y END AS yb, a.region AS ra, b.region AS rb FROM fx_vec a FULL JOIN (SELECT * REPLACE (CASE WHEN label = 3 THEN -patch_id - 1 ELSE patch_id END AS patch_id) FROM fx_vec) b ON a.patch_id = b.patch_id)
      SELECT 'y' AS field, CAST(count(*) FILTER (patch_id IS NOT NULL AND other IS NOT NULL AND ya <> yb) AS BIGINT) AS mismatches FROM j UNION ALL SELECT 'region', CAST(count(*) FILTER (patch_id IS NOT NULL AND other IS NOT NULL AND ra <> rb) AS BIGINT) FROM j UNION ALL SELECT 'unpaired_keys', CAST(count(*) FILTER (patch_id IS NULL OR other IS NULL) AS BIGINT) FROM j""",
)
def _(spark, d):
    v = fx_vec(spark, d)
    b = v.withColumns({"y": F.when(F.col("patch_id") % 10 == 0, 1).otherwise(F.col("y")), "patch_id": F.when(F.col("label") == 3, -F.col("patch_id") - 1).otherwise(F.col("patch_id"))})
    return E.metadata_agreement(v, b, ["y", "region"])


@query(
    "standardize",
    f"""WITH u AS (SELECT patch_id, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS k FROM {VEC}), s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd FROM u GROUP BY k)
      SELECT patch_id, CAST(u.k AS INTEGER) AS k, round((v - m) / sd, 6) AS z FROM u JOIN s ON u.k = s.k""",
)
def _(spark, d):
    z = E.standardize(fx_vec(spark, d).select("patch_id", "embedding"))
    return rounded(z.select("patch_id", F.posexplode("embedding").alias("k", "z")).withColumn("k", F.col("k") + 1))


@query("pca_variance")
def _(spark, d):
    return E.pca(E.standardize(fx_vec(spark, d).select("patch_id", "embedding")))[1]


@query(
    "silhouette",
    f"""WITH p AS (SELECT a.patch_id, a.region AS own, b.region AS oth, list_distance(a.e, b.e) ** 2 AS dist FROM {VEC} a JOIN {VEC} b ON a.patch_id <> b.patch_id), m AS (SELECT patch_id, own, oth, avg(dist) AS m FROM p GROUP BY ALL),
      s AS (SELECT patch_id, max(m) FILTER (own = oth) AS a, min(m) FILTER (own <> oth) AS b FROM m GROUP BY 1) SELECT patch_id AS id, round((b - a) / greatest(a, b), 6) AS silhouette FROM s""",
)
def _(spark, d):
    return rounded(E.silhouette(fx_vec(spark, d), "region"))


SPLIT = f"""WITH r AS (SELECT patch_id, y, e, rep, row_number() OVER (PARTITION BY rep, y ORDER BY {h_sql("concat_ws(':', rep, patch_id)", salt="42")}, concat_ws(':', rep, patch_id)) AS rn, count(*) OVER (PARTITION BY rep, y) AS n FROM {VEC}, (SELECT unnest(range(1, 3)) AS rep)),
  s AS (SELECT *, rn <= ceil(n * 0.25) AS test FROM r), k AS (SELECT q.rep, q.patch_id, q.y, t.y AS ty, list_distance(q.e, t.e) AS dist, row_number() OVER (PARTITION BY q.rep, q.patch_id ORDER BY list_distance(q.e, t.e), t.patch_id) AS rk, t.patch_id AS tid FROM s q JOIN s t ON q.rep = t.rep AND q.test AND NOT t.test)"""


def neighbours(spark, d):
    rows = Sp.shuffle_splits(fx_vec(spark, d).select("patch_id", "embedding", "y"), "y", "patch_id", repeats=2)
    train = rows.where("role = 'train'").select(F.col("repeat").alias("run"), F.col("patch_id").alias("id"), "embedding", F.col("y").alias("label"))
    test = rows.where("role = 'test'").select(F.col("repeat").alias("run"), F.col("patch_id").alias("query"), "embedding", "y")
    return E.nearest_neighbours(train, test, k=15, pivots=16, chunk=200), test


@query("nearest_neighbours", SPLIT + " SELECT CAST(rep AS INTEGER) AS run, patch_id AS query, tid AS neighbour, round(dist, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 15")
def _(spark, d):
    return rounded(neighbours(spark, d)[0].select("run", "query", "neighbour", "distance", "rank"))


@query("knn_scores", SPLIT + " SELECT CAST(rep AS INTEGER) AS run, patch_id AS query, round(sum(CASE WHEN ty = 1 THEN 1 / dist ELSE 0 END) / sum(1 / dist), 6) AS score FROM k WHERE rk <= 15 GROUP BY ALL")
def _(spark, d):
    return rounded(E.knn_scores(neighbours(spark, d)[0]))


@query(
    "knn_separability",
    SPLIT
    + """, c AS (SELECT CAST(rep AS INTEGER) AS run, patch_id, y, round(sum(CASE WHEN ty = 1 THEN 1 / dist ELSE 0 END) / sum(1 / dist), 6) AS score FROM k WHERE rk <= 15 GROUP BY ALL),
      g AS (SELECT run, score, sum(y) AS p, sum(1 - y) AS q FROM c GROUP BY run, score),
      w AS (SELECT *, sum(p) OVER o AS tp, sum(q) OVER o AS fp FROM g WINDOW o AS (PARTITION BY run ORDER BY score DESC)),
      m AS (SELECT run, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, sum(p * tp / (tp + fp)) / sum(p) AS ap, sum((tp - p / 2.0) * q) / (CAST(sum(p) AS DOUBLE) * sum(q)) AS auc,
        CAST(coalesce(sum(p) FILTER (score >= 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(q) FILTER (score >= 0.5), 0) AS BIGINT) AS fp FROM w GROUP BY run)
      SELECT run, positives, negatives, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, tp, fp, positives - tp AS fn, negatives - fp AS tn, round(2.0 * tp / (tp + fp + positives), 6) AS f1,
      round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(tp / positives, 6) AS recall, round(0.5 * (tp / positives + (negatives - fp) / negatives), 6) AS balanced_accuracy,
      round((tp + negatives - fp) / (positives + negatives), 6) AS accuracy FROM m""",
)
def _(spark, d):
    near, test = neighbours(spark, d)
    scored = rounded(E.knn_scores(near)).join(test.select("run", "query", "y"), ["run", "query"])
    return rounded(M.ranking_metrics(scored, ["run"], "score", "y", 0.5))


@query("probe_logistic")
def _(spark, d):
    v = fx_vec(spark, d).withColumnRenamed("y", "label_binary")
    scored = E.train_probe(v.where("region <> 'region_0'"), v.where("region = 'region_0'"))
    return M.ranking_metrics(scored, ["region"], "score", "label_binary", 0.5)


@query("probe_svm")
def _(spark, d):
    v = fx_vec(spark, d).withColumnRenamed("y", "label_binary")
    scored = E.train_probe(v.where("region <> 'region_1'"), v.where("region = 'region_1'"), "linear_svm")
    return M.ranking_metrics(scored, ["region"], "score", "label_binary", 0.5)


SCORES = """s AS (SELECT l_linestatus AS modality, 'logistic_regression' AS probe, concat('fold', l_suppkey % 3) AS fold, CASE WHEN l_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS role,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST((l_partkey * 7 + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END) % 1000 AS DOUBLE) / 1000.0 AS score FROM lineitem)"""


def score_table(spark, d):
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("modality"), F.lit("logistic_regression").alias("probe"), F.concat(F.lit("fold"), (F.col("l_suppkey") % 3).cast("string")).alias("fold"),
        F.when(F.col("l_orderkey") % 4 == 0, "test").otherwise("train").alias("role"), y.alias("y"), (((F.col("l_partkey") * 7 + y * 300) % 1000).cast("double") / 1000.0).alias("score"),
    )


@query(
    "probe_results",
    f"""WITH {SCORES}, qs AS (SELECT modality, fold, unnest(quantile_cont(score, [0.02 + i * 0.96 / 100 FOR i IN range(101)])) AS t FROM s WHERE role = 'train' GROUP BY modality, fold),
      ts AS (SELECT DISTINCT modality, fold, round(t, 9) AS t FROM qs),
      f AS (SELECT s.modality, s.fold, t, 2.0 * count(*) FILTER (score >= t AND y = 1) / (count(*) FILTER (score >= t) + count(*) FILTER (y = 1)) AS f1 FROM s JOIN ts ON s.modality = ts.modality AND s.fold = ts.fold WHERE role = 'train' GROUP BY ALL),
      cut AS (SELECT modality, fold, t, f1 FROM f QUALIFY row_number() OVER (PARTITION BY modality, fold ORDER BY f1 DESC, t) = 1),
      c AS (SELECT s.modality, probe, s.fold, t, f1, count(*) FILTER (role = 'train') AS train_samples, count(*) FILTER (role = 'test') AS test_samples, count(*) FILTER (role = 'train' AND y = 1) AS train_positive,
          count(*) FILTER (role = 'train' AND y = 0) AS train_negative, count(*) FILTER (role = 'test' AND y = 1) AS test_positive, count(*) FILTER (role = 'test' AND y = 0) AS test_negative,
          count(*) FILTER (role = 'test' AND y = 1 AND score >= t) AS tp, count(*) FILTER (role = 'test' AND y = 0 AND score >= t) AS fp
        FROM s JOIN cut ON s.modality = cut.modality AND s.fold = cut.fold GROUP BY ALL),
      g AS (SELECT modality, fold, score, sum(y) AS p, sum(1 - y) AS q FROM s WHERE role = 'test' GROUP BY ALL),
      w AS (SELECT *, sum(p) OVER o AS a, sum(q) OVER o AS b FROM g WINDOW o AS (PARTITION BY modality, fold ORDER BY score DESC)),
      m AS (SELECT modality, fold, sum(p * a / (a + b)) / sum(p) AS ap, sum((a - p / 2.0) * q) / (CAST(sum(p) AS DOUBLE) * sum(q)) AS auc FROM w GROUP BY ALL)
      SELECT c.modality, probe, c.fold, train_samples, test_samples, train_positive, train_negative, test_positive, test_negative, round(t, 6) AS threshold, round(f1, 6) AS train_best_f1, round(ap, 6) AS average_precision,
        round(auc, 6) AS roc_auc, round(2.0 * tp / (tp + fp + test_positive), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / test_positive, 6) AS recall,
        round(0.5 * (tp / test_positive + (test_negative - fp) / test_negative), 6) AS balanced_accuracy, round((tp + test_negative - fp) / test_samples, 6) AS accuracy, tp, fp, test_positive - tp AS fn,
        test_negative - fp AS tn, round(100.0 * test_positive / test_samples, 6) AS test_positive_percent, round(100.0 * (tp + fp) / test_samples, 6) AS pred_positive_percent
      FROM c JOIN m ON c.modality = m.modality AND c.fold = m.fold""",
)
def _(spark, d):
    return rounded(Pr.probe_results(score_table(spark, d)))


@query("probe_evaluation")
def _(spark, d):
    """All folds of both linear probes on two modalities: the vectors, and their components in reverse with noise signs."""
    v = fx_vec(spark, d)
    both = v.select("region", "y", "embedding", F.lit("plain").alias("modality")).unionByName(v.select("region", "y", F.transform("other", lambda x: x * x).alias("embedding"), F.lit("squared").alias("modality")))
    return rounded(Pr.evaluate_probes(both, F.col("region"), F.col("y"), F.col("modality")))


@query("approximate_neighbours")
def _(spark, d):
    """All training rows of each repeat against its test rows, as `nearest_neighbours` takes them."""
    rows = Sp.shuffle_splits(fx_vec(spark, d).select("patch_id", "embedding", "y"), "y", "patch_id", 2)
    train = rows.where("role = 'train'").select(F.col("repeat").alias("run"), F.col("patch_id").alias("id"), "embedding", F.col("y").alias("label"))
    test = rows.where("role = 'test'").select(F.col("repeat").alias("run"), F.col("patch_id").alias("query"), "embedding")
    return Ng.approximate_neighbours(train, test, 15).drop("label")


def packed(spark, d):
    px = fx_pixel(spark, d)
    t = Tl.pixels_to_tiles(px, ["vv", "vh", "label"], F.col("is_valid"), 16)
    return t.select("raster_id", "tile_row", "tile_col", F.slice("bands", 1, 2).alias("bands"), F.col("bands")[2].alias("label"), "mask")


@query(
    "extract_features",
    "SELECT raster_id, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, 8 AS dim, round(min(vv), 2) AS vv_min, round(max(vv), 2) AS vv_max FROM fx_pixel GROUP BY ALL",
)
def _(spark, d):
    out = E.extract(packed(spark, d), E.band_statistics_model, ["raster_id", "tile_row", "tile_col"])
    e = F.col("embedding")
    return rounded(out.select("raster_id", "tile_row", "tile_col", F.size(e).alias("dim"), e[4].cast("double").alias("vv_min"), e[6].cast("double").alias("vv_max")), 2)


@query(
    "score_patches",
    """SELECT raster_id, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, CAST(count(*) FILTER (is_valid AND vv >= 25 AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (is_valid AND vv >= 25 AND label = 0) AS BIGINT) AS fp,
      CAST(count(*) FILTER (is_valid AND vv < 25 AND label = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (is_valid AND vv < 25 AND label = 0) AS BIGINT) AS tn FROM fx_pixel GROUP BY ALL""",
)
def _(spark, d):
    def logistic():
        return lambda x: 1.0 / (1.0 + np.exp(-(x[0].astype("float64") - 25.0) / 10.0))

    return E.score_patches(packed(spark, d), logistic, 0.5, ["raster_id", "tile_row", "tile_col"])


@query("select_bands", "SELECT vec_id, CAST([embedding[4], embedding[3], embedding[2], embedding[8]] AS FLOAT[]) AS bands FROM embeddings")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", Ar.select_bands(F.col("embedding"), Ar.S2_SETS["rgb_nir"], Ar.S2_BANDS).alias("bands"))


@query("tokens_to_chw", "SELECT vec_id, list_transform(range(64), lambda i: embedding[(i % 16) * 4 + i // 16 + 1]) AS chw, list_transform(range(60), lambda i: embedding[(i % 15) * 4 + i // 15 + 1]) AS hwc FROM embeddings")
def _(spark, d):
    v, e = table(spark, d, "embeddings"), F.col("embedding")
    return v.select("vec_id", Ar.tokens_to_chw(e, 16, 4)[0].alias("chw"), Ar.hwc_to_chw(e, 5, 3, 4).alias("hwc"))


@query(
    "array_roles",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'metadata_or_label' WHEN user_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'global_patch_embedding' ELSE 'two_dimensional_array' END WHEN user_id % 5 = 1 THEN 'dense_token_sequence_n_tokens_c'
      WHEN user_id % 5 = 2 THEN 'dense_token_sequence_n_c_tokens' WHEN user_id % 5 = 3 THEN 'dense_feature_map_n_c_h_w' ELSE 'dense_feature_map_n_h_w_c' END AS role, event_type <> 'click' AND user_id % 5 > 0 AS usable FROM events""",
)
def _(spark, d):
    u = F.col("user_id") % 5
    arr = lambda *v: F.array(*[F.lit(x) if isinstance(x, int) else x for x in v])
    c = F.when(F.col("event_id") % 2 == 0, 768).otherwise(700)
    shape = F.when(u == 0, arr(100, c)).when(u == 1, arr(100, 784, 768)).when(u == 2, arr(100, 768, 784)).when(u == 3, arr(100, 768, 28, 28)).otherwise(arr(100, 28, 28, 768))
    key = F.when(F.col("event_type") == "click", "patch_ids").otherwise("features")
    role = rules.array_role(key, shape, F.lit("float32"), 100, 768)
    return table(spark, d, "events").select("event_id", role.alias("role"), rules.dense_usable(role).alias("usable"))


ROLE_SQL = """CASE WHEN event_type = 'click' THEN 'metadata_or_label' WHEN user_id % 5 = 0 OR event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'global_patch_embedding' ELSE 'two_dimensional_array' END WHEN user_id % 5 = 1 THEN 'dense_token_sequence_n_tokens_c'
  WHEN user_id % 5 = 2 THEN 'dense_token_sequence_n_c_tokens' WHEN user_id % 5 = 3 THEN 'dense_feature_map_n_c_h_w' ELSE 'dense_feature_map_n_h_w_c' END"""


@query(
    "feature_decision",
    f"""WITH a AS (SELECT event_type AS m, user_id % 50 AS file, {ROLE_SQL} AS role FROM events),
      g AS (SELECT m, count(DISTINCT file) AS files, bool_or(role = 'global_patch_embedding') AS gl, bool_or(role LIKE 'dense_token%') AS tk, bool_or(role LIKE 'dense_feature_map%') AS mp FROM a GROUP BY 1),
      w AS (SELECT unnest(['purchase', 'view', 'click', 'absent']) AS m),
      j AS (SELECT w.m, coalesce(files, 0) AS files, coalesce(gl, FALSE) AS gl, coalesce(tk, FALSE) AS tk, coalesce(mp, FALSE) AS mp FROM w LEFT JOIN g ON g.m = w.m)
      SELECT m AS target_modality, files AS target_files, gl AS has_global_embedding, tk AS has_dense_tokens, mp AS has_dense_feature_map, tk OR mp AS has_usable_features, (SELECT bool_or(role LIKE 'dense_%') FROM a) AS any_file_has_usable_features,
        CASE WHEN files = 0 THEN 'target_modality_file_missing' WHEN tk OR mp THEN 'dense_features_available' WHEN gl THEN 'global_only_extract_dense_features_next' ELSE 'manual_inspection_needed' END AS recommendation, tk OR mp AS can_proceed FROM j""",
)
def _(spark, d):
    arr = lambda *v: F.array(*[F.lit(x) if isinstance(x, int) else x for x in v])
    u = F.when(F.col("event_type") == "view", 0).otherwise(F.col("user_id") % 5)
    shape = F.when(u == 0, arr(100, F.when(F.col("event_id") % 2 == 0, 768).otherwise(700))).when(u == 1, arr(100, 784, 768)).when(u == 2, arr(100, 768, 784)).when(u == 3, arr(100, 768, 28, 28)).otherwise(arr(100, 28, 28, 768))
    role = rules.array_role(F.when(F.col("event_type") == "click", "patch_ids").otherwise("features"), shape, F.lit("float32"), 100, 768)
    arrays = table(spark, d, "events").select(F.col("event_type").alias("modality"), (F.col("user_id") % 50).alias("file"), role.alias("role"))
    return Dc.feature_decision(arrays, ["purchase", "view", "click", "absent"])


GEOMETRY = {"none": ("r", "c"), "rot90": ("49 - c", "r"), "rot180": ("49 - r", "49 - c"), "rot270": ("c", "49 - r"), "hflip": ("r", "49 - c"), "vflip": ("49 - r", "c"), "hflip_rot90": ("c", "r"), "vflip_rot90": ("49 - c", "49 - r")}
GAIN = {None: "vv / 100", "gain_up": "least(vv / 100 * 1.1, 6)", "s1_gain_down": "least(vv / 100 * 0.9, 6)", "s2_gain_up": "least(vv / 100, 6)"}


@query(
    "augment",
    " UNION ALL ".join(
        f"SELECT '{n}' AS augmentation, raster_id, {GEOMETRY[Ar.AUGMENTATION_PARTS[n][0]][0]} AS r, {GEOMETRY[Ar.AUGMENTATION_PARTS[n][0]][1]} AS c, round({GAIN[Ar.AUGMENTATION_PARTS[n][1]]}, 7) AS vv FROM fx_pixel"
        for n in ("rot90", "rot270", "hflip", "vflip_rot90", "hflip_rot90", "rot180", "hflip_gain_up", "s1_gain_down", "s2_gain_up")
    ),
)
def _(spark, d):
    names = ("rot90", "rot270", "hflip", "vflip_rot90", "hflip_rot90", "rot180", "hflip_gain_up", "s1_gain_down", "s2_gain_up")
    px = fx_pixel(spark, d).withColumn("vv", F.col("vv") / 100)
    return Ar.augmented(px, names, 50, {"s1_vv": "vv"}).select("augmentation", "raster_id", "r", "c", F.round("vv", 7).alias("vv"))


@query("feature_index_join", "SELECT p.patch_id, v.vec_id AS dense_index, v.vec_id IS NULL AS missing FROM fx_patch p LEFT JOIN embeddings v ON p.patch_id = v.vec_id")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.col("vec_id").alias("dense_index"))
    j = fx_patch(spark, d).select("patch_id").join(v, "patch_id", "left")
    return j.withColumn("missing", F.col("dense_index").isNull())
