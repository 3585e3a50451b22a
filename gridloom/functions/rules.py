"""Classifiers and decision rules as ordered CASE expressions. Thresholds are keyword arguments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridloom.functions.scalars import safe_div, set_flags

# VV / VH mean and standard deviation (dB) published for Sentinel-1 GRD patches.
PUBLISHED_SAR_DB = {"VV": (-12.59, 5.26), "VH": (-20.26, 5.91)}

POSITIVE_SCALES = ("linear_sigma0_power", "positive_power_with_large_tail", "unknown_positive_large")

# Simplified error groups and the detailed modes each one covers.
ERROR_GROUPS = {
    "Correct / acceptable": ("good_empty_or_near_empty", "good_positive"),
    "Tiny-object problem": ("tiny_fragment_missed", "tiny_positive_other"),
    "Overprediction problem": ("severe_overprediction", "hard_false_positive"),
    "Underprediction problem": ("hard_false_negative", "severe_underprediction"),
    "Ambiguous / weak positive": ("mixed_or_average", "low_iou_positive_other"),
}

POOLS = (
    "hard_negative_strict",
    "hard_negative_moderate",
    "missed_large_positive",
    "severe_missed_large_positive",
    "good_large_positive",
    "medium_large_positive",
    "challenging_positive",
    "overexpanded_positive",
    "random_negative",
)


def first_true(cases: list[tuple[Column, str]], default: str) -> Column:
    """Name of the first case whose condition is true."""
    (cond, name), *rest = cases
    out = F.when(cond, name)
    for cond, name in rest:
        out = out.when(cond, name)
    return out.otherwise(default)


# --- value scales ----------------------------------------------------------------------------------------------------


def infer_scale(n: Column, p1: Column, p99: Column, median: Column, mean: Column, lo: Column, hi: Column) -> Column:
    return first_true(
        [
            (n == 0, "unknown_no_valid_values"),
            ((median < 0) & (p1 > -100) & (p99 < 50), "db"),
            ((lo >= 0) & (p99 <= 5) & (median < 1.5) & (mean < 1.5), "linear_sigma0_power"),
            ((lo >= 0) & (median < 1.5) & (p99 > 5), "positive_power_with_large_tail"),
            ((lo >= 0) & (hi > 5), "unknown_positive_large"),
        ],
        "unknown_assumed_db",
    )


def conversion_mode(
    product: Column, scale: Column, force_rtc: bool = False, force_positive: bool = False
) -> Column:
    return first_true(
        [
            (F.lit(force_rtc) & (product == "RTC"), "forced_rtc_10log10"),
            (F.lit(force_positive) & scale.isin(*POSITIVE_SCALES), "forced_positive_10log10"),
            (scale == "linear_sigma0_power", "auto_linear_sigma0_10log10"),
        ],
        "none_raw_values_used",
    )


def converts(mode: Column) -> Column:
    return mode != "none_raw_values_used"


def plausibility(
    mean: Column,
    std: Column,
    ref_mean: Column,
    comparable: Column,
    mean_tolerance: float = 10.0,
    std_min: float = 1.0,
    std_max: float = 12.0,
) -> Column:
    mean_ok = F.abs(mean - ref_mean) <= mean_tolerance
    std_ok = (std >= std_min) & (std <= std_max)
    return first_true(
        [
            (~comparable, "not_comparable_scale"),
            (mean_ok & std_ok, "broadly_plausible"),
            (std_ok, "mean_shift_check_needed"),
            (mean_ok, "std_range_check_needed"),
        ],
        "distribution_check_needed",
    )


def reflectance_mode(p98: Column, mode: str = "auto", threshold: float = 2.0) -> Column:
    """`divide_10000` or `keep`: forced, or by the pooled 98th percentile of the valid values."""
    if mode in ("divide_10000", "keep"):
        return F.lit(mode)
    return F.when(p98 > threshold, "divide_10000").otherwise("keep")


# --- grids -----------------------------------------------------------------------------------------------------------


def transforms_equal(a: Column, b: Column, tol: float = 0.0) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tol), lambda ok: ok)


def identity_like(transform: Column, tol: float = 1e-9) -> Column:
    unit = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)])
    return transforms_equal(transform, unit, tol)


def suspicious_transform(transform: Column, has_crs: Column) -> Column:
    unit_pixels = (F.abs(transform[0]) == 1) & (F.abs(transform[4]) == 1)
    return identity_like(transform) | (~has_crs & unit_pixels)


def georef_mode(transform: Column, crs: Column, gcp_count: Column, gcp_crs: Column) -> Column:
    has_crs = crs.isNotNull() & (crs != "")
    return first_true(
        [
            (has_crs & ~suspicious_transform(transform, has_crs), "normal_crs_transform"),
            ((gcp_count >= 4) & gcp_crs.isNotNull() & (gcp_crs != ""), "gcps"),
        ],
        "insufficient_georef",
    )


def city_grid_status(s1_exists: Column, s1_ok: Column, label_ok: Column) -> Column:
    return first_true(
        [
            (label_ok & s1_ok, "OK_S2_S1_LABEL"),
            (label_ok & ~s1_exists, "OK_S2_LABEL_S1_MISSING"),
            (label_ok, "LABEL_OK_S1_ALIGNMENT_PROBLEM"),
        ],
        "ALIGNMENT_PROBLEM",
    )


# --- repair actions --------------------------------------------------------------------------------------------------


def s2_repair_action(
    combined_pct: Column,
    border_share_pct: Column,
    internal_pct: Column,
    no_action: float = 0.01,
    internal_fill: float = 0.10,
    mostly_border: float = 95.0,
) -> Column:
    return first_true(
        [
            (combined_pct <= no_action, "no_action"),
            (internal_pct >= internal_fill, "crop_border_plus_internal_fill"),
            (border_share_pct >= mostly_border, "crop_border"),
        ],
        "crop_border_then_verify_tiny_internal",
    )


def crop_label_impact(removed: Column, removed_pct: Column, safe: float = 0.0, tiny: float = 0.1) -> Column:
    return first_true(
        [
            (removed == 0, "safe_no_positive_label_loss"),
            (removed_pct <= safe, "safe_within_threshold"),
            (removed_pct <= tiny, "review_tiny_label_loss"),
        ],
        "unsafe_label_loss_review_crop",
    )


def s1_action(
    nodata_pct: Column,
    label_overlap_pct: Column,
    tiny: float = 0.5,
    large: float = 5.0,
    tiny_overlap: float = 0.1,
    significant_overlap: float = 1.0,
) -> Column:
    small = nodata_pct <= tiny
    return first_true(
        [
            (nodata_pct == 0, "no_action"),
            ((nodata_pct >= large) | (label_overlap_pct >= significant_overlap), "major_s1_coverage_issue_do_not_fill"),
            (small & (label_overlap_pct <= tiny_overlap), "fill_tiny_s1_nodata_candidate"),
            (small, "review_tiny_s1_nodata_label_overlap"),
        ],
        "moderate_s1_nodata_review",
    )


def stack_status(
    aligned: Column,
    s2_bands: Column,
    s1_bands: Column,
    label_bands: Column,
    label_binary: Column,
    s2_nodata: Column,
    s1_nodata: Column,
    expected: tuple[int, int, int] = (12, 3, 1),
) -> Column:
    """Status of a cropped city stack: contract failures first, then which product still has holes."""
    return first_true(
        [
            (~aligned, "fail_alignment"),
            (s2_bands != expected[0], "fail_s2_band_count"),
            (s1_bands != expected[1], "fail_s1_band_count"),
            (label_bands != expected[2], "fail_label_band_count"),
            (~label_binary, "fail_label_not_binary"),
            (s2_nodata > 0, "pass_alignment_residual_s2_nodata"),
            (s1_nodata > 0, "pass_alignment_residual_s1_nodata"),
        ],
        "pass_clean",
    )


def filled_stack_status(
    aligned: Column,
    s2_bands: Column,
    s1_bands: Column,
    label_bands: Column,
    label_binary: Column,
    s2_nodata: Column,
    s1_nodata: Column,
    fill_level_status: Column,
    require_fill_qa: bool = False,
    expected: tuple[int, int, int] = (12, 3, 1),
) -> Column:
    """Status after the optical holes were filled: those must be gone, radar holes may remain."""
    return first_true(
        [
            (~aligned, "fail_alignment"),
            (s2_bands != expected[0], "fail_s2_band_count"),
            (s1_bands != expected[1], "fail_s1_band_count"),
            (label_bands != expected[2], "fail_label_band_count"),
            (~label_binary, "fail_label_not_binary"),
            (s2_nodata > 0, "fail_s2_filled_has_nodata"),
            (F.lit(require_fill_qa) & (fill_level_status != "ok"), "fail_fill_qa"),
            (s1_nodata > 0, "pass_s2_clean_residual_s1_nodata"),
        ],
        "pass_s2_clean_all_aligned",
    )


def ready_stack_status(
    s2_bands: Column,
    s1_bands: Column,
    label_bands: Column,
    s1_aligned: Column,
    label_aligned: Column,
    s2_nodata: Column,
    s1_nodata: Column,
    label_binary: Column,
    s2_qa_ok: Column,
    s1_qa_ok: Column,
    unresolved: Column,
    require_qa: bool = False,
    expected: tuple[int, int, int] = (12, 3, 1),
) -> Column:
    qa = F.lit(require_qa)
    return first_true(
        [
            (s2_bands != expected[0], "fail_s2_band_count"),
            (s1_bands != expected[1], "fail_s1_band_count"),
            (label_bands != expected[2], "fail_label_band_count"),
            (~s1_aligned, "fail_s1_alignment"),
            (~label_aligned, "fail_label_alignment"),
            (s2_nodata != 0, "fail_s2_has_nodata"),
            (s1_nodata != 0, "fail_s1_has_nodata"),
            (~label_binary, "fail_label_not_binary"),
            (qa & ~s2_qa_ok, "fail_s2_fill_level_qa"),
            (qa & ~s1_qa_ok, "fail_s1_fill_source_qa"),
            (qa & (unresolved > 0), "fail_s1_unresolved_fill_source"),
        ],
        "pass_final_ready_stack",
    )


# --- patch quality ---------------------------------------------------------------------------------------------------


def quality_flags(
    s2_nodata: Column,
    s1_nodata: Column,
    label_nodata: Column,
    cloud_pct: Column | None = None,
    max_nodata: float = 10.0,
    max_cloud: float = 20.0,
    strict: float = 5.0,
) -> dict[str, Column]:
    """A patch without a cloud mask passes the cloud test."""
    worst = F.greatest(s2_nodata, s1_nodata, label_nodata)
    nodata_ok = worst <= max_nodata
    cloud_ok = F.coalesce(cloud_pct <= max_cloud, F.lit(True)) if cloud_pct is not None else F.lit(True)
    basic = nodata_ok & cloud_ok
    all_strict = (worst <= strict) & (s2_nodata <= strict) & (s1_nodata <= strict) & (label_nodata <= strict)
    return {
        "max_nodata_percent": worst,
        "passes_nodata_filter": nodata_ok,
        "passes_cloud_filter": cloud_ok,
        "passes_basic_quality_filter": basic,
        "passes_strict_filter": basic & all_strict,
    }


def positive_flags(p: Column) -> dict[str, Column]:
    out = {f"positive_gt_{name}pct": p > edge for name, edge in {"0": 0.0, "0_5": 0.5, "1": 1.0, "2": 2.0}.items()}
    return out | {"recommended_sampling_group": F.when(p > 0, "positive").otherwise("negative")}


# --- error analysis --------------------------------------------------------------------------------------------------


def confusion_pct(gt: Column, pred: Column, fp: Column | None = None, fn: Column | None = None, iou: Column | None = None) -> dict[str, Column]:
    """tp/fp/fn/tn as percent of the patch: from fp and fn, else from IoU, else the largest possible overlap."""

    def clip(x: Column, hi: float = 100.0) -> Column:
        return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(hi))

    gt, pred = clip(gt), clip(pred)
    if fp is not None and fn is not None:
        fp, fn = clip(fp), clip(fn)
        tp = clip(gt - fn)
    else:
        if iou is not None:
            j = clip(iou, 1.0)
            tp = clip(j * (gt + pred) / (1.0 + j))
        else:
            tp = F.least(gt, pred)
        fp, fn = clip(pred - tp), clip(gt - tp)
    return {"tp_pct": tp, "fp_pct": fp, "fn_pct": fn, "tn_pct": clip(100.0 - tp - fp - fn)}


def pool_flags(gt: Column, pred: Column, iou: Column, recall: Column) -> dict[str, Column]:
    """Membership in the nine training pools; a patch may be in several."""
    diff, iou, recall = pred - gt, F.coalesce(iou, F.lit(0.0)), F.coalesce(recall, F.lit(0.0))
    tests = [
        (gt <= 1) & (pred >= 20),
        (gt <= 5) & (pred >= 10),
        (gt >= 10) & (recall < 0.40),
        (gt >= 20) & (diff <= -10),
        (gt >= 10) & (iou >= 0.50),
        gt >= 5,
        (gt >= 5) & (iou < 0.50),
        (gt >= 5) & (diff >= 10),
        (gt <= 0) & (pred <= 1),
    ]
    return dict(zip(POOLS, tests))


def pool_labels(flags: dict[str, Column]) -> Column:
    return set_flags(flags)


def error_flags(
    gt: Column,
    pred: Column,
    iou: Column,
    recall: Column,
    empty: float = 0.0,
    positive: float = 0.0,
    tiny: float = 1.0,
    fragment: float = 2.0,
    good_gt: float = 1.0,
    good_iou: float = 0.50,
    hard_fp_gt: float = 1.0,
    hard_fp_pred: float = 20.0,
    moderate_fp_gt: float = 5.0,
    moderate_fp_pred: float = 10.0,
    over: float = 20.0,
    hard_fn_gt: float = 20.0,
    hard_fn_recall: float = 0.20,
    under: float = 20.0,
    tiny_recall: float = 0.05,
) -> dict[str, Column]:
    is_tiny = (gt > empty) & (gt <= tiny)
    return {
        "is_empty_gt": gt <= empty,
        "is_tiny_positive": is_tiny,
        "is_positive_patch": gt > positive,
        "is_good_positive": (gt >= good_gt) & (iou >= good_iou),
        "is_hard_false_positive": (gt <= hard_fp_gt) & (pred >= hard_fp_pred),
        "is_moderate_false_positive": (gt <= moderate_fp_gt) & (pred >= moderate_fp_pred),
        "is_severe_overprediction": (pred - gt) >= over,
        "is_hard_false_negative": (gt >= hard_fn_gt) & (recall <= hard_fn_recall),
        "is_severe_underprediction": (gt - pred) >= under,
        "is_tiny_fragment_missed": is_tiny & (recall <= tiny_recall),
        "is_boundary_or_fragment_case": (gt > empty) & (gt <= fragment),
    }


def dominant_mode(f: dict[str, Column], gt: Column, pred: Column, iou: Column) -> Column:
    return first_true(
        [
            (f["is_good_positive"], "good_positive"),
            (f["is_hard_false_positive"], "hard_false_positive"),
            (f["is_hard_false_negative"], "hard_false_negative"),
            (f["is_severe_overprediction"], "severe_overprediction"),
            (f["is_severe_underprediction"], "severe_underprediction"),
            (f["is_tiny_fragment_missed"], "tiny_fragment_missed"),
            (f["is_empty_gt"] & (pred <= 1), "good_empty_or_near_empty"),
            (f["is_tiny_positive"], "tiny_positive_other"),
            ((iou < 0.1) & (gt >= 1), "low_iou_positive_other"),
        ],
        "mixed_or_average",
    )


def error_group_of_mode(mode: Column) -> Column:
    return first_true([(mode.isin(*modes), name) for name, modes in ERROR_GROUPS.items()], "Ambiguous / weak positive")


def infer_error_group(gt: Column, pred: Column, iou: Column, recall: Column) -> Column:
    """The same groups where only the percentages are known."""
    return first_true(
        [
            (((gt == 0) & (pred <= 1)) | ((gt > 0) & (iou >= 0.5)), "Correct / acceptable"),
            ((gt > 0) & (gt <= 1), "Tiny-object problem"),
            (((pred - gt) >= 10) | ((gt <= 5) & (pred >= 10)), "Overprediction problem"),
            (((gt - pred) >= 5) | ((gt >= 5) & (recall < 0.25)), "Underprediction problem"),
        ],
        "Ambiguous / weak positive",
    )


# --- variants and evidence -------------------------------------------------------------------------------------------


def winner_from_text(text: Column) -> Column:
    """Which radar variant a decision text favours; a text naming both counts only through a fixed phrase."""
    t = F.lower(text)
    snap, rtc = F.contains(t, F.lit("snap")), F.contains(t, F.lit("rtc"))
    says = lambda *words: [F.contains(t, F.lit(w)) for w in words]
    (stronger,) = says("stronger")
    prefer_snap, rtc_stronger, prefer_rtc = says("prefer snap", "rtc stronger", "prefer rtc")
    return first_true(
        [
            (snap & ~rtc, "SNAP-GRD"),
            (rtc & ~snap, "RTC"),
            ((snap & stronger) | prefer_snap, "SNAP-GRD"),
            (rtc_stronger | prefer_rtc, "RTC"),
        ],
        "Mixed",
    )


def direction(delta: Column, rtc_wins: Column, snap_wins: Column, min_delta: float = 1e-4) -> Column:
    up, down = delta > min_delta, delta < -min_delta
    return first_true(
        [
            (up & (rtc_wins > snap_wins), "RTC stronger"),
            (down & (snap_wins > rtc_wins), "SNAP-GRD stronger"),
            (up, "RTC higher mean, mixed folds"),
            (down, "SNAP-GRD higher mean, mixed folds"),
            (rtc_wins > snap_wins, "Mixed / near tie, RTC more fold wins"),
            (snap_wins > rtc_wins, "Mixed / near tie, SNAP-GRD more fold wins"),
        ],
        "Near tie",
    )


# --- array roles -----------------------------------------------------------------------------------------------------

# Parts of an array key that mark it as metadata.
METADATA_WORDS = (
    "patch_id", "city", "region", "label", "target", "positive", "path", "row", "col", "x", "y", "window", "split",
    "modality", "index", "filename", "file", "id",
)


def array_role(key: Column, shape: Column, dtype: Column, n: int, c: int) -> Column:
    """Role of a stored array from its key, dtype and shape: global embedding, token sequence, feature map, metadata."""
    nd, d = F.size(shape), lambda i: F.get(shape, F.lit(i))
    is_text = F.lower(dtype).rlike("str|unicode|object")
    named = F.exists(F.array(*[F.lit(w) for w in METADATA_WORDS]), lambda w: F.contains(F.lower(key), w))
    rows = d(0) == n
    return first_true(
        [
            (shape.isNull(), "unknown"),
            (nd == 0, "scalar_or_empty"),
            (named | is_text | (nd == 1), "metadata_or_label"),
            ((nd == 2) & rows & (d(1) == c), "global_patch_embedding"),
            (nd == 2, "two_dimensional_array"),
            ((nd == 3) & rows & (d(2) == c), "dense_token_sequence_n_tokens_c"),
            ((nd == 3) & rows & (d(1) == c), "dense_token_sequence_n_c_tokens"),
            (nd == 3, "three_dimensional_array"),
            ((nd == 4) & rows & (d(1) == c), "dense_feature_map_n_c_h_w"),
            ((nd == 4) & rows & (d(3) == c), "dense_feature_map_n_h_w_c"),
            (nd == 4, "four_dimensional_array"),
            (nd == 5, "possible_multilayer_dense_features"),
        ],
        "other_array",
    )


def dense_usable(role: Column) -> Column:
    return role.startswith("dense_")


def weighted_candidate_score(
    overlap: Column, full: Column, pols_ok: Column, mode_ok: Column, type_ok: Column, days: Column
) -> Column:
    """Selection score of a fallback product; a missing acquisition time counts as 999999 days away."""
    i = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    return (
        F.coalesce(overlap, F.lit(0.0)) * 1000.0
        + i(full) * 100.0
        + i(pols_ok) * 50.0
        + i(mode_ok) * 25.0
        + i(type_ok) * 25.0
        - F.coalesce(days, F.lit(999999.0)) * 0.01
    )


def share(n: Column, d: Column) -> Column:
    return safe_div(n.cast("double"), d.cast("double"))
