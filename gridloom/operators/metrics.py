"""Confusion counts, threshold sweeps, ranking metrics and multiclass metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.metrics import class_metrics, segmentation_metrics
from gridloom.functions.scalars import safe_div
from gridloom.operators.ranking import ranked
from gridloom.operators.stats import value_bucket


def confusion(px: DataFrame, by: Sequence[str], score: Column, label: Column, threshold: float, valid: Column | None = None) -> DataFrame:
    """tp, fp, fn, tn of valid cells at one threshold."""
    ok = F.lit(True) if valid is None else valid
    pred, truth = score >= threshold, label >= 0.5
    cells = {"tp": pred & truth, "fp": pred & ~truth, "fn": ~pred & truth, "tn": ~pred & ~truth}
    return px.groupBy(*by).agg(*[F.count_if(ok & c).alias(k) for k, c in cells.items()])


def with_metrics(df: DataFrame, eps: float = 1e-8, keep: Sequence[str] | None = None) -> DataFrame:
    m = segmentation_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), eps)
    return df.select("*", *[v.alias(k) for k, v in m.items() if keep is None or k in keep])


def grid(start: float = 0.05, end: float = 0.95, step: float = 0.05) -> list[float]:
    n = int((end - start) / step + 1e-9)
    return [round(start + i * step, 6) for i in range(n + 1)]


def threshold_sweep(px: DataFrame, by: Sequence[str], score: Column, label: Column, thresholds: Sequence[float], valid: Column | None = None) -> DataFrame:
    """Confusion counts at every threshold from one pass.

    Each cell adds to the count of the highest threshold it reaches; counts at a threshold are sums over the thresholds
    at or above it, taken on one small array per group. No cell is repeated per threshold.
    """
    ts = sorted(thresholds)
    ok = F.lit(True) if valid is None else valid
    level = F.lit(0)
    for i, t in enumerate(ts, 1):
        level = F.when(score >= t, i).otherwise(level)
    truth = label >= 0.5
    counts = px.where(ok).groupBy(*by, level.alias("_level")).agg(F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_q"))
    steps = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ts, 1)])
    laid = counts.select(*by, "_level", "_p", "_q", F.inline(steps))
    hit = F.col("_level") >= F.col("_i")
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return laid.groupBy(*by, "threshold").agg(
        total("_p", hit).alias("tp"), total("_q", hit).alias("fp"), total("_p", ~hit).alias("fn"), total("_q", ~hit).alias("tn")
    )


def best_threshold(sweep: DataFrame, by: Sequence[str], metric: str = "iou_pos") -> DataFrame:
    """Best row per group: metric, then dice, then predicted share closest to the true share, then lowest threshold."""
    gap = F.abs(F.col("pred_pos_pct") - F.col("gt_pos_pct"))
    order = F.struct(-F.col(metric), -F.col("dice_pos"), gap, F.col("threshold"))
    cols = [c for c in sweep.columns if c not in by]
    picked = sweep.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_best"))
    return picked.select(*by, "_best.*")


def multiclass_matrix(px: DataFrame, target: Column, pred: Column, classes: int) -> DataFrame:
    return px.where((target >= 0) & (target < classes)).groupBy(target.alias("target"), pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(matrix: DataFrame, classes: int, eps: float = 1e-9) -> DataFrame:
    """Per-class metrics from a confusion matrix of at most classes * classes rows; classes never seen are kept."""
    ids = F.array(*[F.lit(i) for i in range(classes)])
    cells = matrix.select("target", "pred", "n", F.explode(ids).alias("class_id"))
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("double")
    is_t, is_p = F.col("target") == F.col("class_id"), F.col("pred") == F.col("class_id")
    counts = cells.groupBy("class_id").agg(
        hit(is_t & is_p).alias("tp"), hit(~is_t & is_p).alias("fp"), hit(is_t & ~is_p).alias("fn"), hit(~is_t & ~is_p).alias("tn")
    )
    m = class_metrics(F.col("tp"), F.col("fp"), F.col("fn"), eps)
    return counts.select(
        "*", *[v.alias(k) for k, v in m.items()], (F.col("tp") + F.col("fn")).alias("support_pixels"), (F.col("tp") + F.col("fp")).alias("pred_pixels")
    )


SCORE_UNIT = 1e6  # buckets are logarithmic above a score of 1e-9, so those of a rare class spread as well


def ranking_metrics(rows: DataFrame, by: Sequence[str], score: str, label: str, threshold: float | None = None) -> DataFrame:
    """Average precision, ROC AUC (ties share a rank) and threshold metrics, for scores in [0, 1].

    Rows are reduced to one per (group, score). Running sums then go down the score axis in buckets, so a group of any
    size is spread over many tasks.
    """
    pos = F.col(label) == 1
    per = rows.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_q"))
    bucket = -value_bucket(F.col("_s") * SCORE_UNIT)
    run = ranked(per, by, [F.col("_s").desc()], bucket, "_r", {"_p": "_tp", "_q": "_fp"})
    steps = run.select(*by, "_s", "_p", "_q", "_tp", "_fp")
    # AUC counts, for each score, the positives ranked above plus half of the tied ones, per negative.
    above = F.sum((F.col("_tp") - F.col("_p") / 2.0) * F.col("_q"))
    pairs = F.sum("_p").cast("double") * F.sum("_q")
    ap = F.sum(F.col("_p") * (F.col("_tp") / (F.col("_tp") + F.col("_fp"))))
    out = [
        F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"),
        F.when(F.sum("_p") > 0, ap / F.sum("_p")).alias("average_precision"),
        F.when(pairs > 0, above / pairs).alias("roc_auc"),
    ]
    if threshold is not None:
        hit = F.col("_s") >= threshold
        out += [F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_q")).otherwise(0)).alias("fp")]
    agg = steps.groupBy(*by).agg(*out)
    if threshold is None:
        return agg
    agg = agg.withColumn("fn", F.col("positives") - F.col("tp")).withColumn("tn", F.col("negatives") - F.col("fp"))
    m = segmentation_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), 0)
    return agg.select(
        "*", m["dice_pos"].alias("f1"), m["precision_pos"].alias("precision"), m["recall_pos"].alias("recall"),
        m["balanced_accuracy"].alias("balanced_accuracy"), m["accuracy"].alias("accuracy"),
    )


def best_f1_threshold(rows: DataFrame, by: Sequence[str], score: str, label: str, n: int = 101) -> DataFrame:
    """Score threshold with the best F1 among n exact quantiles from 2 % to 98 %; the lowest wins ties.

    Groups with at most two distinct scores try those scores themselves.
    """
    from gridloom.operators.stats import quantile_rows

    rows_q = quantile_rows(rows, by, score, [0.02 + i * 0.96 / (n - 1) for i in range(n)])
    tries = rows_q.groupBy(*by).agg(F.collect_set("quantile").alias("_tries"))  # at most n values
    per = rows.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q")
    )
    ends = per.groupBy(*by).agg(
        F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.sum("_p").alias("_pos"), (F.count(F.lit(1)) <= 2).alias("_few")
    )
    chosen = F.when(F.col("_few"), F.array("_lo", "_hi")).otherwise(F.col("_tries"))
    cuts = tries.join(ends, list(by)).select(*by, "_pos", F.array_sort(F.array_distinct(chosen)).alias("_cuts"))
    # Each score falls between two cuts; suffix sums over at most n + 1 steps give the counts at every cut.
    level = F.aggregate("_cuts", F.lit(0), lambda a, c: a + (F.col("_s") >= c).cast("int"))
    steps = per.join(cuts, list(by)).groupBy(*by, level.alias("_level")).agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    laid = cuts.select(*by, "_pos", F.posexplode("_cuts").alias("_i", "threshold"))
    reach = laid.join(steps, list(by)).where(F.col("_level") > F.col("_i"))
    scored = reach.groupBy(*by, "_i", "threshold", "_pos").agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_fp"))
    f1 = safe_div(2.0 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_pos"))
    return scored.withColumn("f1", f1).groupBy(*by).agg(
        F.min_by("threshold", F.struct(-F.col("f1"), F.col("_i"))).alias("threshold"), F.max("f1").alias("train_f1")
    )


def binary_by_bin(rows: DataFrame, bin_: str) -> DataFrame:
    """Collapsed binary metrics per density bin, micro-averaged over its patches."""
    sums = rows.groupBy(bin_).agg(F.count(F.lit(1)).alias("n_patches"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    m = segmentation_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), 1e-9)
    keep = {"iou_pos": "iou", "dice_pos": "dice", "precision_pos": "precision", "recall_pos": "recall", "accuracy": "accuracy"}
    return sums.select("*", *[m[k].alias(n) for k, n in keep.items()], m["pred_minus_gt_pct"].alias("pred_minus_gt_pct"))


