"""Segmentation metrics, threshold sweeps and ranking metrics (section L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import bins
from gridloom.functions.metrics import error_class
from gridloom.operators import metrics as M
from gridloom.plans.fixtures import fx_confusion, fx_metrics, fx_pixel, fx_score
from gridloom.plans.q_reports import rounded
from gridloom.plans.registry import query

TS = M.grid()


@query(
    "confusion",
    """SELECT raster_id, CAST(count(*) FILTER (is_valid AND vv >= 25 AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (is_valid AND vv >= 25 AND label = 0) AS BIGINT) AS fp,
      CAST(count(*) FILTER (is_valid AND vv < 25 AND label = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (is_valid AND vv < 25 AND label = 0) AS BIGINT) AS tn FROM fx_pixel GROUP BY raster_id""",
)
def _(spark, d):
    return M.confusion(fx_pixel(spark, d), ["raster_id"], F.col("vv"), F.col("label"), 25.0, F.col("is_valid"))


@query(
    "segmentation_metrics",
    """SELECT patch_id, round(tp / (tp + fp + fn + 1e-6), 6) AS iou_pos, round(2 * tn / (2 * tn + fp + fn + 1e-6), 6) AS dice_neg,
      round(0.5 * (tp / (tp + fp + 1e-6) + tn / (tn + fn + 1e-6)), 6) AS macro_precision,
      round(((tp + fn) * (tp / (tp + fp + fn + 1e-6)) + (tn + fp) * (tn / (tn + fp + fn + 1e-6))) / (tp + fp + fn + tn + 1e-6), 6) AS weighted_iou,
      round((tp + tn) / (tp + fp + fn + tn + 1e-6), 6) AS accuracy, round(0.5 * (tp / (tp + fn + 1e-6) + tn / (tn + fp + 1e-6)), 6) AS balanced_accuracy,
      round(tn / (tn + fp + 1e-6), 6) AS specificity, round(fp / (fp + tn + 1e-6), 6) AS fpr, round(fn / (fn + tp + 1e-6), 6) AS fnr,
      round(100 * (tp + fp) / (tp + fp + fn + tn), 6) AS pred_pos_pct FROM fx_confusion""",
)
def _(spark, d):
    keep = ["iou_pos", "dice_neg", "macro_precision", "weighted_iou", "accuracy", "balanced_accuracy", "specificity", "fpr", "fnr", "pred_pos_pct"]
    return rounded(M.with_metrics(fx_confusion(spark, d), 1e-6, keep).drop("tp", "fp", "fn", "tn"))


SWEEP = f"""WITH t AS (SELECT unnest({TS}) AS threshold), s AS (SELECT fold, threshold, CAST(count(*) FILTER (score >= threshold AND y = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (score >= threshold AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (score < threshold AND y = 1) AS BIGINT) AS fn,
  CAST(count(*) FILTER (score < threshold AND y = 0) AS BIGINT) AS tn FROM fx_score, t GROUP BY fold, threshold) """


def sweep(spark, d):
    return M.threshold_sweep(fx_score(spark, d), ["fold"], F.col("score"), F.col("y"), TS)


@query("threshold_sweep", SWEEP + "SELECT fold, CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn FROM s")
def _(spark, d):
    return sweep(spark, d)


@query(
    "best_threshold",
    SWEEP
    + """, m AS (SELECT *, tp / (tp + fp + fn + 1e-8) AS iou_pos, 2 * tp / (2 * tp + fp + fn + 1e-8) AS dice_pos, abs(fp - fn) AS gap FROM s)
      SELECT fold, CAST(threshold AS DOUBLE) AS threshold, tp, round(iou_pos, 6) AS iou_pos, round(dice_pos, 6) AS dice_pos FROM
      (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY iou_pos DESC, dice_pos DESC, gap, threshold) AS rn FROM m) WHERE rn = 1""",
)
def _(spark, d):
    scored = M.with_metrics(sweep(spark, d), keep=["iou_pos", "dice_pos", "pred_pos_pct", "gt_pos_pct"])
    return rounded(M.best_threshold(scored, ["fold"])).select("fold", "threshold", "tp", "iou_pos", "dice_pos")


MULTI = "(SELECT CAST(floor(vv / 21) AS INTEGER) % 5 AS t, CAST(floor(vh / 5) AS INTEGER) % 5 AS p FROM fx_pixel)"


@query(
    "multiclass_metrics",
    f"""WITH x AS {MULTI}, k AS (SELECT unnest(range(5)) AS c), n AS (SELECT CAST(c AS INTEGER) AS class_id, CAST(count(*) FILTER (t = c AND p = c) AS DOUBLE) AS tp,
      CAST(count(*) FILTER (t <> c AND p = c) AS DOUBLE) AS fp, CAST(count(*) FILTER (t = c AND p <> c) AS DOUBLE) AS fn, CAST(count(*) FILTER (t <> c AND p <> c) AS DOUBLE) AS tn FROM x, k GROUP BY c)
      SELECT *, round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-9), 6) AS dice, round(tp / (tp + fp + 1e-9), 6) AS precision,
      round(tp / (tp + fn + 1e-9), 6) AS recall, tp + fn AS support_pixels, tp + fp AS pred_pixels FROM n""",
)
def _(spark, d):
    target, pred = F.floor(F.col("vv") / 21).cast("int") % 5, F.floor(F.col("vh") / 5).cast("int") % 5
    return rounded(M.multiclass_metrics(M.multiclass_matrix(fx_pixel(spark, d), target, pred, 5), 5))


@query(
    "binary_by_bin",
    """SELECT CASE WHEN gt_pos_pct <= 0 THEN 0 WHEN gt_pos_pct <= 1 THEN 1 WHEN gt_pos_pct <= 5 THEN 2 WHEN gt_pos_pct <= 20 THEN 3 ELSE 4 END AS density_class, count(*) AS n_patches,
      sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn) + 1e-9), 6) AS iou,
      round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn) + 1e-9), 6) AS dice, round(sum(tp) / (sum(tp) + sum(fp) + 1e-9), 6) AS precision,
      round(sum(tp) / (sum(tp) + sum(fn) + 1e-9), 6) AS recall, round((sum(tp) + sum(tn)) / (sum(tp) + sum(fp) + sum(fn) + sum(tn) + 1e-9), 6) AS accuracy,
      round(100 * (sum(fp) - sum(fn)) / (sum(tp) + sum(fp) + sum(fn) + sum(tn)), 6) AS pred_minus_gt_pct FROM fx_metrics GROUP BY 1""",
)
def _(spark, d):
    rows = fx_metrics(spark, d).withColumn("density_class", bins.density_class(F.col("gt_pos_pct")))
    return rounded(M.binary_by_bin(rows, "density_class"))


@query(
    "error_map",
    """SELECT raster_id, r, c, CASE WHEN label > 0 AND vv >= 25 THEN 1 WHEN vv >= 25 THEN 2 WHEN label > 0 THEN 3 ELSE 0 END AS error_class FROM fx_pixel WHERE is_valid""",
)
def _(spark, d):
    px = fx_pixel(spark, d).where("is_valid")
    return px.select("raster_id", "r", "c", error_class(F.col("label"), F.col("vv") >= 25).alias("error_class"))


@query(
    "ranking_metrics",
    """WITH g AS (SELECT fold, score, sum(y) AS p, sum(1 - y) AS q FROM fx_score GROUP BY fold, score),
      r AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
      m AS (SELECT fold, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, sum(p * tp / (tp + fp)) / sum(p) AS ap,
        sum((tp - p / 2.0) * q) / (CAST(sum(p) AS DOUBLE) * sum(q)) AS auc, CAST(coalesce(sum(p) FILTER (score >= 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(q) FILTER (score >= 0.5), 0) AS BIGINT) AS fp FROM r GROUP BY fold)
      SELECT fold, positives, negatives, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, tp, fp, positives - tp AS fn, negatives - fp AS tn,
      round(2.0 * tp / (tp + fp + positives), 6) AS f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(tp / positives, 6) AS recall,
      round(0.5 * (tp / positives + (negatives - fp) / negatives), 6) AS balanced_accuracy, round((tp + negatives - fp) / (positives + negatives), 6) AS accuracy FROM m""",
)
def _(spark, d):
    return rounded(M.ranking_metrics(fx_score(spark, d), ["fold"], "score", "y", 0.5))


@query(
    "best_f1_threshold",
    """WITH qs AS (SELECT fold, unnest(quantile_cont(score, [0.02 + i * 0.96 / 100 FOR i IN range(101)])) AS t FROM fx_score GROUP BY fold),
      ts AS (SELECT DISTINCT fold, round(t, 9) AS t FROM qs), f AS (SELECT s.fold, t, 2.0 * count(*) FILTER (score >= t AND y = 1) / (count(*) FILTER (score >= t) + count(*) FILTER (y = 1)) AS f1
        FROM fx_score s JOIN ts ON s.fold = ts.fold GROUP BY s.fold, t)
      SELECT fold, round(t, 6) AS threshold, round(f1, 6) AS train_f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, t) AS rn FROM f) WHERE rn = 1""",
)
def _(spark, d):
    return rounded(M.best_f1_threshold(fx_score(spark, d), ["fold"], "score", "y"))
