"""Named top-N patch lists and diagnostic panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.ranking import hash_order, top_k


def named_lists(df: DataFrame, rules: dict[str, tuple[Column | None, Sequence[Column]]], n: int, key: str = "patch_id", keep: Sequence[str] | None = None) -> DataFrame:
    """Top n rows of each rule (condition, ascending sort keys); the list name is a column.

    A row is laid out once per list it qualifies for, and the rank limit keeps n rows per list and task before the
    shuffle, so even a list over the whole table moves little.
    """
    width = max(len(order) for _, order in rules.values())
    items = []
    for name, (cond, order) in rules.items():
        keys = [*[o.cast("double") for o in order], *[F.lit(0.0)] * (width - len(order))]
        entry = F.struct(F.lit(name).alias("list_name"), *[k.alias(f"_s{i}") for i, k in enumerate(keys)])
        items.append(entry if cond is None else F.when(cond, entry))
    laid = df.select(*(keep or df.columns), F.inline(F.array_compact(F.array(*items))))
    out = top_k(laid, ["list_name"], [*[F.col(f"_s{i}") for i in range(width)], F.col(key)], n, "list_rank")
    return out.drop(*[f"_s{i}" for i in range(width)])


def patch_lists(df: DataFrame, n: int = 100) -> DataFrame:
    """The ten review lists of the error report."""
    c = {k: F.col(k) for k in ("gt_pos_pct", "pred_pos_pct", "iou_pos", "recall_pos", "pred_minus_gt_pct", "gt_minus_pred_pct")}
    gt, pred, iou = c["gt_pos_pct"], c["pred_pos_pct"], c["iou_pos"]
    rules = {
        "hard_false_positive": (F.col("is_hard_false_positive"), [-pred, gt]),
        "hard_false_negative": (F.col("is_hard_false_negative"), [-gt, c["recall_pos"]]),
        "severe_overprediction": (F.col("is_severe_overprediction"), [-c["pred_minus_gt_pct"]]),
        "severe_underprediction": (F.col("is_severe_underprediction"), [-c["gt_minus_pred_pct"]]),
        "tiny_fragment_missed": (F.col("is_tiny_fragment_missed"), [-gt]),
        "good_positive": (F.col("is_good_positive"), [-iou, -gt]),
        "worst_positive": (gt > 0, [iou, -gt]),
        "best_positive": (gt > 0, [-iou, -gt]),
        "largest_label": (None, [-gt]),
        "largest_prediction": (None, [-pred]),
    }
    return named_lists(df, rules, n, keep=["patch_id", "city", "region", *c])


def diagnostic_patches(df: DataFrame, n: int = 12, min_gt: float = 0.05, seed: str = "42") -> DataFrame:
    """n patches per panel category; a patch can be in several."""
    pos = F.col("gt_pos_pct") >= min_gt
    rules = {
        "random": (None, [hash_order(F.col("patch_id"), salt=seed)]),
        "best_iou": (pos, [-F.col("iou_pos")]),
        "worst_iou": (pos, [F.col("iou_pos")]),
        "high_false_negative": (pos, [-F.col("fn_pct")]),
        "underprediction": (pos, [-F.col("gt_minus_pred_pct")]),
        "high_false_positive": (None, [-F.col("fp_pct")]),
        "overprediction": (None, [-F.col("pred_minus_gt_pct")]),
    }
    return named_lists(df, rules, n, keep=["patch_id", "city", "region"]).withColumnRenamed("list_name", "category")


def city_extremes(df: DataFrame, by: Sequence[str], value: str, n: int = 5) -> DataFrame:
    """Highest and lowest n cities per group."""
    w = [("highest_city_mean", F.col(value).desc()), ("lowest_city_mean", F.col(value).asc())]
    parts = [top_k(df, by, [o, F.col("city")], n).withColumn("extreme_type", F.lit(name)) for name, o in w]
    return parts[0].unionByName(parts[1])


def sort_by_category(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Sorted report with an explicit category order; unknown categories come last."""
    position = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.orderBy(F.when(position > 0, position).otherwise(1 << 30), column, *then)
