"""Group reports: patch, split, fold, distribution and error summaries.

Everything here is a partial + final aggregate: a hot city costs one partial row per task, whatever its size. Exact
`percentile` is used only where the domain of the value is bounded (whole pixel counts out of a fixed patch area);
other exact quantiles go through `stats.quantiles`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.metrics import segmentation_metrics
from gridloom.functions.rules import POOLS, share
from gridloom.functions.scalars import pct
from gridloom.operators.ranking import join_null_safe
from gridloom.operators.stats import grouped_quantiles


def n_rows() -> Column:
    return F.count(F.lit(1))


def names(c: str, sep: str = ",") -> Column:
    """Sorted distinct names of a group as one string. The set is of cities or regions, so it is small by nature."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def n_names(c: str) -> Column:
    """Number of distinct cities, regions or folds in a group. The set itself is small, so it travels as a partial
    aggregate; `count(distinct)` would expand every row and shuffle on the name."""
    return F.size(F.collect_set(c)).cast("bigint")


def quality_summary(patches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Patches, cities, positives, mean shares and quality share per group."""
    positive, ok = F.col("is_positive_patch"), F.col("passes_basic_quality_filter")
    return patches.groupBy(*by).agg(
        n_rows().alias("patch_count"),
        n_names("city").alias("city_count"),
        F.count_if(positive).alias("positive_patch_count"),
        F.avg("label_positive_percent").alias("mean_label_positive_percent"),
        F.max("label_positive_percent").alias("max_label_positive_percent"),
        F.avg("s2_nodata_percent").alias("mean_s2_nodata_percent"),
        F.avg("s1_nodata_percent").alias("mean_s1_nodata_percent"),
        F.avg("max_nodata_percent").alias("mean_max_nodata_percent"),
        F.count_if(ok).alias("quality_pass_count"),
        (100.0 * F.count_if(positive) / n_rows()).alias("positive_patch_percent"),
        (100.0 * F.count_if(ok) / n_rows()).alias("quality_pass_percent"),
    )


def city_summary(meta: DataFrame) -> DataFrame:
    """Per-city roll-up of 224-px metadata: extremes of the validity shares."""
    return meta.groupBy("city", "region").agg(
        n_rows().alias("patches"),
        F.count_if(F.col("label_positive_pixels") > 0).alias("positive_patches"),
        F.max("label_positive_percent").alias("max_label_positive_percent"),
        F.min(100.0 - F.col("s2_nodata_percent")).alias("min_s2_valid_percent"),
        F.min(100.0 - F.col("s1_nodata_percent")).alias("min_s1_valid_percent"),
    )


def label_distribution(patches: DataFrame, by: Sequence[str], patch_area: int) -> DataFrame:
    """Label distribution for the whole table and for each column in `by`, from one pass over the patches.

    Patches are first counted per (groups, positive pixels): a pixel count takes one of `patch_area + 1` values, so
    however many patches there are, that table is bounded. Grouping sets, moments and exact weighted quantiles then
    work on it.
    """
    qs = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    pos_qs = ("p25", "median", "p75", "p95")
    cells = patches.groupBy(*by, "label_positive_pixels", "label_positive_percent").agg(n_rows().alias("_n"))
    p, k = F.col("label_positive_percent"), F.col("_n")
    positive = F.col("label_positive_pixels") > 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def moments(rows: Column, prefix: str) -> list[Column]:
        v, w = F.when(rows, p), F.when(rows, k)
        n = F.sum(w)
        mean = F.sum(v * w) / n
        spread = F.when(n > 1, F.sqrt(F.greatest(F.sum(v * v * w) - n * mean * mean, F.lit(0.0)) / (n - 1)))
        return [x.alias(prefix + name) for x, name in ((mean, "mean"), (spread, "std"), (F.min(v), "min"), (F.max(v), "max"))]

    sets = [[F.col(c) for c in cols] for cols in [[]] + [[c] for c in by]]
    agg = cells.groupingSets(sets, *[F.col(c) for c in by]).agg(
        F.grouping_id().alias("_gid"), F.sum(k).alias("n_patches"), F.coalesce(F.sum(F.when(positive, k)), F.lit(0)).alias("n_positive_patches"),
        F.sum(F.col("label_positive_pixels") * k).alias("total_label_positive_pixels"), *moments(F.lit(True), ""), *moments(positive, "pos_"),
        F.percentile(p, F.array(*[F.lit(q) for q in qs.values()]), k).alias("_q"),
        F.percentile(F.when(positive, p), F.array(*[F.lit(qs[q]) for q in pos_qs]), k).alias("_pq"),
    )
    whole = (1 << len(by)) - 1
    kind, value = F.lit("overall"), F.lit("all_patches")
    for i, c in enumerate(by):
        here = F.col("_gid") == whole - (1 << (len(by) - 1 - i))
        kind, value = F.when(here, c).otherwise(kind), F.when(here, F.coalesce(F.col(c), F.lit("unknown"))).otherwise(value)
    pixels = F.col("n_patches") * F.lit(patch_area)
    return agg.select(
        kind.alias("group_type"), value.alias("group_value"), "n_patches", "n_positive_patches",
        (F.col("n_patches") - F.col("n_positive_patches")).alias("n_empty_patches"),
        pct(F.col("n_positive_patches"), F.col("n_patches")).alias("positive_patch_percent"),
        "total_label_positive_pixels", pixels.alias("total_patch_pixels"),
        pct(F.col("total_label_positive_pixels"), pixels).alias("pixel_positive_percent"),
        "mean", zero(F.col("std")).alias("std"), "min", "max",
        *[F.col("_q")[i].alias(k) for i, k in enumerate(qs)],
        *[zero(F.col(f"pos_{k}")).alias(f"pos_{k}") for k in ("mean", "std", "min", "max")],
        *[zero(F.get(F.col("_pq"), F.lit(i))).alias(f"pos_{k}") for i, k in enumerate(pos_qs)],
    )


def density_bin_rows(patches: DataFrame, bin_: Column, order: Column) -> DataFrame:
    p = F.col("label_positive_percent")
    rows = patches.groupBy(bin_.alias("density_bin")).agg(
        n_rows().alias("n_patches"),
        F.count_if(F.col("label_positive_pixels") > 0).alias("n_positive_patches"),
        F.sum("label_positive_pixels").alias("total_label_positive_pixels"),
        F.avg(p).alias("mean"), F.median(p).alias("median"), F.min(p).alias("min"), F.max(p).alias("max"),
    )
    return share_of(rows, "n_patches", [], "patch_percent").withColumn("bin_order", order)


def share_of(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Percent of the group (or table) total. Meant for aggregated tables: the whole-table form runs on one row per
    group, never on raw rows."""
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    return df.withColumn(name, pct(F.col(value), F.sum(value).over(whole)))


def area_distribution(
    patches: DataFrame, by: Sequence[str], patch_size: int = 224, pixel_m: float = 10.0, min_pixels: int = 1
) -> DataFrame:
    """Positive patches, positive area in hectares and shares of the dataset, per group."""
    area = patch_size * patch_size
    pos, own = F.col("label_positive_pixels"), 100.0 * F.col("label_positive_pixels") / float(area)
    ha = pixel_m * pixel_m / 10000.0
    total, k = F.sum(pos), F.count_if(pos >= min_pixels)
    rows = patches.groupBy(*by).agg(
        n_rows().alias("patch_count"), k.alias("positive_patch_count"), (n_rows() - k).alias("negative_patch_count"),
        (100.0 * k / n_rows()).alias("positive_patch_pct"), total.alias("positive_pixels"), (n_rows() * area).alias("total_pixels"),
        (100.0 * total / (n_rows() * area)).alias("positive_pixel_pct"), (total * ha).alias("positive_area_ha"),
        (n_rows() * area * ha).alias("total_area_ha"), F.avg(own).alias("mean_patch_pct"), F.median(own).alias("median_patch_pct"),
        F.stddev_pop(own).alias("std_patch_pct"), F.max(own).alias("max_patch_pct"),
    )
    rows = share_of(rows, "patch_count", [], "patch_share_of_dataset_pct")
    return share_of(rows, "positive_pixels", [], "pixel_share_of_dataset_pct")


def split_summary(rows: DataFrame, by: Sequence[str], bin_col: str = "label_density_bin") -> DataFrame:
    """Split or fold summary with bin counts and the names of its cities and regions."""
    positive = F.col("label_positive_pixels") > 0
    k = F.count_if(positive)
    bins = [F.count_if(F.col(bin_col) == b).alias(f"bin_{b}") for b in ("empty", "low", "medium", "high")]
    return rows.groupBy(*by).agg(
        n_rows().alias("patches"), k.alias("positive_patches"), (n_rows() - k).alias("empty_patches"),
        (100.0 * k / n_rows()).alias("positive_patch_percent"),
        F.sum("label_positive_pixels").alias("total_label_positive_pixels"),
        F.avg("label_positive_percent").alias("mean_label_positive_percent"),
        F.max("label_positive_percent").alias("max_label_positive_percent"),
        *bins, n_names("city").alias("n_cities"), names("city", ";").alias("cities"), names("region", ";").alias("regions"),
    )


def positive_pixel_pct(df: DataFrame, by: Sequence[str], pixels: str | None, total: str | None, fraction: str | None) -> DataFrame:
    """Share of positive pixels: from the counts where they exist, else the mean of a column that may hold fractions
    or percentages (a maximum of 1.5 or less means fractions)."""
    pixel_n = F.sum(pixels) if pixels else F.lit(None).cast("double")
    total_n = F.sum(total) if total else F.lit(None).cast("double")
    v = F.when(~F.isnan(F.col(fraction)), F.col(fraction)) if fraction else F.lit(None).cast("double")
    mean = F.avg(v) * F.when(F.max(v) <= 1.5, 100.0).otherwise(1.0)
    return df.groupBy(*by).agg(F.when(total_n > 0, 100.0 * pixel_n / total_n).otherwise(mean).alias("positive_pixel_pct"))


def pos_weight(train: DataFrame, patch_area: int, cap: float) -> DataFrame:
    """Class weight negatives/positives, capped; 1 where there are no positives."""
    pos = F.coalesce(F.sum("label_positive_pixels"), F.lit(0)).cast("double")
    raw = F.when(pos > 0, (n_rows() * patch_area - pos) / pos)
    return train.agg(
        n_rows().alias("train_rows"), raw.alias("raw_pos_weight"), F.coalesce(F.least(raw, F.lit(float(cap))), F.lit(1.0)).alias("pos_weight")
    )


def _sums(eps: float) -> list[Column]:
    m = segmentation_metrics(F.sum("tp"), F.sum("fp"), F.sum("fn"), F.sum("tn"), eps)
    keep = [f"{k}_{c}" for c in ("pos", "neg") for k in ("iou", "dice", "precision", "recall")]
    keep += ["macro_iou", "macro_dice", "macro_precision", "macro_recall", "accuracy", "pred_pos_pct", "gt_pos_pct"]
    return [m[k].alias(f"global_{k}") for k in keep]


def error_report(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Patch means and quantiles, shares of error modes, summed counts and the metrics of the sums, per group."""
    if not by:
        return error_report(rows.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    frac = lambda c: F.avg(F.col(c).cast("int")).alias(f"fraction_{c[3:]}")
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    base = rows.groupBy(*by).agg(
        n_rows().alias("n_patches"), n_names("city").alias("n_cities"), n_names("region").alias("n_regions"),
        *[mean(c) for c in ("iou_pos", "dice_pos", "precision_pos", "recall_pos", "iou_neg", "macro_iou")],
        *[mean(c) for c in ("gt_pos_pct", "pred_pos_pct", "pred_minus_gt_pct", "fp_pct", "fn_pct")],
        *[frac(c) for c in ("is_good_positive", "is_hard_false_positive", "is_hard_false_negative", "is_tiny_fragment_missed")],
        *[F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn", "tn")], *_sums(1e-8),
    )
    q = grouped_quantiles(rows, by, ["iou_pos"], [0.25, 0.5, 0.75])
    return base.join(q, list(by), "left")


def mode_counts(rows: DataFrame, by: Sequence[str], mode: str = "dominant_error_mode") -> DataFrame:
    counts = rows.groupBy(*by, mode).agg(n_rows().alias("n_patches"))
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    total = F.sum("n_patches").over(Window.partitionBy(*(by or ["_all"])))
    out = counts.withColumn("total_patches", total).withColumn("fraction", F.col("n_patches") / total)
    return out.drop("_all")


def pool_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and pool, empty pools included: every pool is a conditional aggregate of one pass, and the
    nine results are laid out as rows afterwards."""
    values = ("gt_pos_pct", "pred_pos_pct", "pred_minus_gt_pct", "iou_pos", "precision_pos", "recall_pos")
    aggs = [n_rows().alias("group_total_patches")]
    for p in POOLS:
        aggs.append(F.count_if(F.col(f"pool_{p}")).alias(f"n_{p}"))
        aggs += [F.avg(F.when(F.col(f"pool_{p}"), F.col(v))).alias(f"{v}_{p}") for v in values]
    wide = rows.groupBy(*by).agg(*aggs)
    one = lambda p: F.struct(
        F.lit(p).alias("pool"), F.col(f"n_{p}").alias("n_patches"), *[F.col(f"{v}_{p}").alias(f"mean_{v}") for v in values]
    )
    out = wide.select(*by, "group_total_patches", F.inline(F.array(*[one(p) for p in POOLS])))
    return out.withColumn("fraction_of_group", share(F.col("n_patches"), F.col("group_total_patches")))


# Nested subsets of patches by positive share.
SUBSETS = (("all", None), ("positive_gt0", 0.0), ("gt1", 1.0), ("gt5", 5.0), ("gt10", 10.0), ("gt20", 20.0), ("gt40", 40.0))


def upper_bound_tables(rows: DataFrame, levels: Sequence[Sequence[str]] = (("split",), ("split", "region"), ("split", "region", "city"))) -> DataFrame:
    """Summed metrics of the nested subsets at each grouping level.

    Rows are reduced once to (finest group, highest subset they reach); the subsets are nested, so each one is the sum
    over the steps at or above it, and the coarser levels are sums of the finest. No row is repeated per subset.
    """
    finest = list(levels[-1])
    step = F.lit(0)
    for i, (_, t) in enumerate(SUBSETS):
        if t is not None:
            step = F.when(F.col("gt_pos_pct") > t, i).otherwise(step)
    sums = ("tp_pct", "fp_pct", "fn_pct", "tn_pct", "gt_pos_pct", "pred_pos_pct", "iou_pos", "dice_pos")
    fine = rows.groupBy(*finest, step.alias("_step")).agg(n_rows().alias("_n"), *[F.sum(c).alias(c) for c in sums])
    subset = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(n).alias("subset"), F.lit(t).cast("double").alias("gt_threshold_pct")) for i, (n, t) in enumerate(SUBSETS)])
    laid = fine.select("*", F.inline(F.filter(subset, lambda s: s["_i"] <= F.col("_step"))))
    sets = [[F.col(c) for c in [*lv, "subset", "gt_threshold_pct"]] for lv in levels]
    m = segmentation_metrics(F.sum("tp_pct"), F.sum("fp_pct"), F.sum("fn_pct"), F.sum("tn_pct"), 0)
    n = F.sum("_n")
    return laid.groupingSets(sets, *[F.col(c) for c in [*finest, "subset", "gt_threshold_pct"]]).agg(
        n.alias("n_patches"), *[m[k].alias(f"global_{k}") for k in ("iou_pos", "dice_pos", "precision_pos", "recall_pos", "iou_neg", "accuracy")],
        *[(F.sum(c) / n).alias(f"mean_{c}") for c in ("gt_pos_pct", "pred_pos_pct", "iou_pos", "dice_pos")],
        F.sum("gt_pos_pct").alias("total_gt_pos_pct_sum"), F.sum("pred_pos_pct").alias("total_pred_pos_pct_sum"),
    )


def upper_bound_medians(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Medians of the nested subsets; these do not add up, so each row counts in every subset it belongs to."""
    labels = F.array(*[F.struct(F.lit(n).alias("subset"), F.lit(-1.0 if t is None else t).alias("t")) for n, t in SUBSETS])
    laid = rows.select("*", F.inline(F.filter(labels, lambda s: (F.col("gt_pos_pct") > s["t"]))))
    return grouped_quantiles(laid, [*by, "subset"], ["gt_pos_pct", "pred_pos_pct", "iou_pos", "dice_pos"], [0.5])


def aggregate_folds(results: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population std and median over folds; missing values are skipped. One value per fold bounds the buffer."""
    clean = [F.when(~F.isnan(F.col(m)), F.col(m)) for m in metrics]
    aggs = [f(c).alias(f"{m}_{n}") for m, c in zip(metrics, clean) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("median", F.median))]
    return results.groupBy(*by).agg(n_rows().alias("n_folds"), *aggs)


def pivot_counts(rows: DataFrame, by: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Wide counts, zero where a combination does not occur; the values are given, so no extra pass finds them."""
    return rows.groupBy(*by).pivot(column, list(values)).agg(n_rows()).fillna(0, list(values))


def distinct_values(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Every distinct value of each group as a row, with the group's number of values and whether all are 0 or 1."""
    seen = rows.select(*by, value).distinct()
    totals = seen.groupBy(*by).agg(F.count(value).alias("unique_count"), F.bool_and(F.col(value).isin(0, 1)).alias("binary_ok"))
    return join_null_safe(seen, totals, by)


def patch_threshold_counts(patches: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float] = (0, 1, 5, 25, 50)) -> DataFrame:
    """How many patches, and positive patches, reach each threshold."""
    positive = F.col("label_positive_pixels") > 0
    out = [n_rows().alias("patches"), F.count_if(positive).alias("positive_patches")]
    out += [F.count_if(F.col(value) > 0).alias("patches_any"), F.count_if((F.col(value) > 0) & positive).alias("positive_patches_any")]
    for t in thresholds:
        out += [F.count_if(F.col(value) >= t).alias(f"patches_ge_{t}pct"), F.count_if((F.col(value) >= t) & positive).alias(f"positive_patches_ge_{t}pct")]
    return patches.groupBy(*by).agg(*out)


def modality_summary(manifest: DataFrame) -> DataFrame:
    k = F.count_if(F.col("label_positive_pixels") > 0)
    return manifest.groupBy("modality", "uses_s2", "uses_sar", "sar_variant").agg(
        n_rows().alias("rows"), k.alias("positive_rows"), (n_rows() - k).alias("empty_rows"), (100.0 * k / n_rows()).alias("positive_percent")
    )
