"""Segmentation metrics from confusion counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridloom.functions.scalars import safe_div


def _ratio(n: Column, d: Column, eps: float) -> Column:
    return safe_div(n, d) if eps == 0 else n / (d + F.lit(eps))


def class_metrics(tp: Column, fp: Column, fn: Column, eps: float = 1e-8) -> dict[str, Column]:
    return {
        "iou": _ratio(tp, tp + fp + fn, eps),
        "dice": _ratio(2.0 * tp, 2.0 * tp + fp + fn, eps),
        "precision": _ratio(tp, tp + fp, eps),
        "recall": _ratio(tp, tp + fn, eps),
    }


def segmentation_metrics(tp: Column, fp: Column, fn: Column, tn: Column, eps: float = 1e-8) -> dict[str, Column]:
    """Both classes, macro and support-weighted means, rates and shares. `eps=0` means zero-safe division."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    pos = class_metrics(tp, fp, fn, eps)
    neg = class_metrics(tn, fn, fp, eps)
    total, gt, gt_neg = tp + fp + fn + tn, tp + fn, tn + fp
    out = {f"{k}_pos": v for k, v in pos.items()}
    out |= {f"{k}_neg": v for k, v in neg.items()}
    out |= {f"macro_{k}": 0.5 * (pos[k] + neg[k]) for k in pos}
    out |= {f"weighted_{k}": _ratio(gt * pos[k] + gt_neg * neg[k], total, eps) for k in pos}
    specificity = _ratio(tn, tn + fp, eps)
    out |= {
        "accuracy": _ratio(tp + tn, total, eps),
        "balanced_accuracy": 0.5 * (pos["recall"] + specificity),
        "specificity": specificity,
        "fpr": _ratio(fp, fp + tn, eps),
        "fnr": _ratio(fn, fn + tp, eps),
        "pred_pos_pct": safe_div(100.0 * (tp + fp), total),
        "gt_pos_pct": safe_div(100.0 * gt, total),
        "fp_pct": safe_div(100.0 * fp, total),
        "fn_pct": safe_div(100.0 * fn, total),
        "pred_minus_gt_pct": safe_div(100.0 * (fp - fn), total),
        "gt_minus_pred_pct": safe_div(100.0 * (fn - fp), total),
    }
    return out


def error_class(label: Column, predicted: Column) -> Column:
    """Per-pixel error map: 1 TP, 2 FP, 3 FN, 0 TN."""
    return (
        F.when((label > 0) & predicted, 1)
        .when(~(label > 0) & predicted, 2)
        .when((label > 0) & ~predicted, 3)
        .otherwise(0)
    )
