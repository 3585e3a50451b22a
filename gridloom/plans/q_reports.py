"""Patch, split, fold and error reports (section D and the metric rules that feed them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import bins, rules
from gridloom.operators import aggregates as A, windows as Wn
from gridloom.operators.joins import expand_config
from gridloom.plans.fixtures import PATCH_AREA, fx_confusion, fx_metrics, fx_patch, fx_pixel, fx_quality, table
from gridloom.plans.q_scalars import INFER_SQL, METRICS, MODE_SQL, POOL_SQL, metric_args, with_modes
from gridloom.plans.registry import query


def rounded(df, digits=6):
    """Round every double column, so that both engines print the same value."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query(
    "quality_summary",
    """SELECT split, region, count(*) AS patch_count, count(DISTINCT city) AS city_count,
      CAST(sum(CASE WHEN is_positive_patch THEN 1 ELSE 0 END) AS BIGINT) AS positive_patch_count,
      round(avg(label_positive_percent), 6) AS mean_label_positive_percent, round(max(label_positive_percent), 6) AS max_label_positive_percent,
      round(avg(s2_nodata_percent), 6) AS mean_s2_nodata_percent, round(avg(s1_nodata_percent), 6) AS mean_s1_nodata_percent,
      round(avg(max_nodata_percent), 6) AS mean_max_nodata_percent,
      CAST(sum(CASE WHEN passes_basic_quality_filter THEN 1 ELSE 0 END) AS BIGINT) AS quality_pass_count,
      round(100.0 * sum(CASE WHEN is_positive_patch THEN 1 ELSE 0 END) / count(*), 6) AS positive_patch_percent,
      round(100.0 * sum(CASE WHEN passes_basic_quality_filter THEN 1 ELSE 0 END) / count(*), 6) AS quality_pass_percent
      FROM fx_quality GROUP BY split, region""",
)
def _(spark, d):
    return rounded(A.quality_summary(fx_quality(spark, d), ["split", "region"]))


@query(
    "city_summary",
    """SELECT city, region, count(*) AS patches, CAST(sum(CASE WHEN label_positive_pixels > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_patches,
      round(max(label_positive_percent), 6) AS max_label_positive_percent, min(100 - s2_nodata_percent) AS min_s2_valid_percent,
      min(100 - s1_nodata_percent) AS min_s1_valid_percent FROM fx_patch GROUP BY city, region""",
)
def _(spark, d):
    return rounded(A.city_summary(fx_patch(spark, d)))


DIST = """count(*) AS n_patches, CAST(count(*) FILTER (label_positive_pixels > 0) AS BIGINT) AS n_positive_patches,
  CAST(count(*) FILTER (label_positive_pixels <= 0) AS BIGINT) AS n_empty_patches,
  round(100.0 * count(*) FILTER (label_positive_pixels > 0) / count(*), 6) AS positive_patch_percent,
  CAST(sum(label_positive_pixels) AS BIGINT) AS total_label_positive_pixels, count(*) * 50176 AS total_patch_pixels,
  round(100.0 * sum(label_positive_pixels) / (count(*) * 50176), 6) AS pixel_positive_percent,
  round(avg(p), 6) AS mean, round(coalesce(stddev_samp(p), 0), 6) AS std, round(min(p), 6) AS min, round(max(p), 6) AS max, """ + ", ".join(
    f"round(quantile_cont(p, {q}), 6) AS {n}"
    for n, q in [("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
) + """, round(coalesce(avg(p) FILTER (p > 0), 0), 6) AS pos_mean, round(coalesce(stddev_samp(p) FILTER (p > 0), 0), 6) AS pos_std,
  round(coalesce(min(p) FILTER (p > 0), 0), 6) AS pos_min, round(coalesce(max(p) FILTER (p > 0), 0), 6) AS pos_max, """ + ", ".join(
    f"round(coalesce(quantile_cont(p, {q}) FILTER (p > 0), 0), 6) AS pos_{n}" for n, q in [("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)]
)
PATCH_BINNED = """(SELECT *, label_positive_percent AS p, CASE WHEN label_positive_percent <= 0 THEN 'empty' WHEN label_positive_percent < 1 THEN 'low'
  WHEN label_positive_percent < 10 THEN 'medium' ELSE 'high' END AS label_density_bin FROM fx_patch)"""


def binned(spark, d):
    return fx_patch(spark, d).withColumn("label_density_bin", bins.density4(F.col("label_positive_percent")))


@query(
    "label_distribution",
    "WITH b AS "
    + PATCH_BINNED
    + " SELECT 'overall' AS group_type, 'all_patches' AS group_value, "
    + DIST
    + " FROM b"
    + "".join(f" UNION ALL SELECT '{g}', {g}, {DIST} FROM b GROUP BY {g}" for g in ("region", "city", "split", "label_density_bin")),
)
def _(spark, d):
    return rounded(A.label_distribution(binned(spark, d), ["region", "city", "split", "label_density_bin"], PATCH_AREA))


@query(
    "density_bin_rows",
    """SELECT bin AS density_bin, CAST(min(o) AS INTEGER) AS bin_order, count(*) AS n_patches, CAST(count(*) FILTER (label_positive_pixels > 0) AS BIGINT) AS n_positive_patches,
      CAST(sum(label_positive_pixels) AS BIGINT) AS total_label_positive_pixels, round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(min(p), 6) AS min,
      round(max(p), 6) AS max, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS patch_percent FROM
      (SELECT *, label_positive_percent AS p, """
    + "CASE " + " ".join(f"WHEN label_positive_percent <= {e} THEN '{n}'" for e, n in bins.DENSITY8[:-1]) + " ELSE 'very_high_50_100' END AS bin, "
    + "CASE " + " ".join(f"WHEN label_positive_percent <= {e} THEN {i}" for i, (e, _) in enumerate(bins.DENSITY8[:-1])) + " ELSE 7 END AS o"
    + " FROM fx_patch) GROUP BY bin",
)
def _(spark, d):
    order = bins.scheme_order(F.col("density_bin"), bins.DENSITY8)
    return rounded(A.density_bin_rows(fx_patch(spark, d), bins.density8(F.col("label_positive_percent")), order))


@query(
    "area_distribution",
    """WITH p AS (SELECT *, 100.0 * label_positive_pixels / CAST(50176 AS DOUBLE) AS v FROM fx_patch)
      SELECT region, city, count(*) AS patch_count, CAST(count(*) FILTER (v > 0) AS BIGINT) AS positive_patch_count, CAST(count(*) FILTER (v <= 0) AS BIGINT) AS negative_patch_count,
      round(100.0 * count(*) FILTER (v > 0) / count(*), 6) AS positive_patch_pct, CAST(sum(label_positive_pixels) AS BIGINT) AS positive_pixels, count(*) * 50176 AS total_pixels,
      round(100.0 * sum(label_positive_pixels) / (count(*) * 50176), 6) AS positive_pixel_pct, round(CAST(sum(label_positive_pixels) AS DOUBLE) * 0.01, 6) AS positive_area_ha,
      round(count(*) * 50176 * CAST(0.01 AS DOUBLE), 6) AS total_area_ha, round(avg(v), 6) AS mean_patch_pct, round(median(v), 6) AS median_patch_pct,
      round(stddev_pop(v), 6) AS std_patch_pct, round(max(v), 6) AS max_patch_pct, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS patch_share_of_dataset_pct,
      round(100.0 * sum(label_positive_pixels) / sum(sum(label_positive_pixels)) OVER (), 6) AS pixel_share_of_dataset_pct FROM p GROUP BY region, city""",
)
def _(spark, d):
    return rounded(A.area_distribution(fx_patch(spark, d), ["region", "city"]))


@query(
    "split_summary",
    f"""SELECT split, count(*) AS patches, CAST(count(*) FILTER (p > 0) AS BIGINT) AS positive_patches, CAST(count(*) FILTER (p <= 0) AS BIGINT) AS empty_patches,
      round(100.0 * count(*) FILTER (p > 0) / count(*), 6) AS positive_patch_percent, CAST(sum(label_positive_pixels) AS BIGINT) AS total_label_positive_pixels,
      round(avg(p), 6) AS mean_label_positive_percent, round(max(p), 6) AS max_label_positive_percent,
      {", ".join(f"CAST(count(*) FILTER (label_density_bin = '{b}') AS BIGINT) AS bin_{b}" for b in ("empty", "low", "medium", "high"))},
      count(DISTINCT city) AS n_cities, string_agg(DISTINCT city, ';' ORDER BY city) AS cities, string_agg(DISTINCT region, ';' ORDER BY region) AS regions
      FROM {PATCH_BINNED} GROUP BY split""",
)
def _(spark, d):
    return rounded(A.split_summary(binned(spark, d), ["split"]))


@query(
    "positive_pixel_share",
    """SELECT region, round(100.0 * sum(label_positive_pixels) / sum(label_total_pixels), 6) AS by_pixels,
      round(avg(label_positive_percent), 6) AS by_percent, round(100 * avg(label_positive_percent / 100), 6) AS by_fraction FROM fx_patch GROUP BY region""",
)
def _(spark, d):
    p = fx_patch(spark, d).withColumn("fraction", F.col("label_positive_percent") / 100)
    one = lambda n, *a: A.positive_pixel_pct(p, ["region"], *a).withColumnRenamed("positive_pixel_pct", n)
    by_pixels = one("by_pixels", "label_positive_pixels", "label_total_pixels", None)
    by_percent = one("by_percent", None, None, "label_positive_percent")
    return rounded(by_pixels.join(by_percent, "region").join(one("by_fraction", None, None, "fraction"), "region"))


@query(
    "pos_weight",
    """SELECT count(*) AS train_rows, round((count(*) * 50176 - sum(label_positive_pixels)) / CAST(sum(label_positive_pixels) AS DOUBLE), 6) AS raw_pos_weight,
      round(least((count(*) * 50176 - sum(label_positive_pixels)) / CAST(sum(label_positive_pixels) AS DOUBLE), 2.5), 6) AS pos_weight FROM fx_patch WHERE split = 'train'""",
)
def _(spark, d):
    return rounded(A.pos_weight(fx_patch(spark, d).where("split = 'train'"), PATCH_AREA, 2.5))


def _global(prefix="global_", eps="1e-8", tp="sum(tp)", fp="sum(fp)", fn="sum(fn)", tn="sum(tn)"):
    def cls(c, a, b, x):
        return {
            f"iou_{c}": f"{a} / ({a} + {b} + {x} + {eps})", f"dice_{c}": f"2 * {a} / (2 * {a} + {b} + {x} + {eps})",
            f"precision_{c}": f"{a} / ({a} + {b} + {eps})", f"recall_{c}": f"{a} / ({a} + {x} + {eps})",
        }

    m = cls("pos", tp, fp, fn) | cls("neg", tn, fn, fp)
    m |= {f"macro_{k}": f"0.5 * ({m[k + '_pos']} + {m[k + '_neg']})" for k in ("iou", "dice", "precision", "recall")}
    m["accuracy"] = f"({tp} + {tn}) / ({tp} + {fp} + {fn} + {tn} + {eps})"
    m["pred_pos_pct"] = f"100 * ({tp} + {fp}) / ({tp} + {fp} + {fn} + {tn})"
    m["gt_pos_pct"] = f"100 * ({tp} + {fn}) / ({tp} + {fp} + {fn} + {tn})"
    return ", ".join(f"round({v}, 6) AS {prefix}{k}" for k, v in m.items())


ERR = f"""count(*) AS n_patches, count(DISTINCT city) AS n_cities, count(DISTINCT region) AS n_regions,
  {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in "iou_pos dice_pos precision_pos recall_pos iou_neg macro_iou gt_pos_pct pred_pos_pct pred_minus_gt_pct fp_pct fn_pct".split())},
  round(avg(CASE WHEN gt >= 1 AND iou_pos >= 0.5 THEN 1 ELSE 0 END), 6) AS fraction_good_positive,
  round(avg(CASE WHEN gt <= 1 AND pred >= 20 THEN 1 ELSE 0 END), 6) AS fraction_hard_false_positive,
  round(avg(CASE WHEN gt >= 20 AND recall_pos <= 0.2 THEN 1 ELSE 0 END), 6) AS fraction_hard_false_negative,
  round(avg(CASE WHEN gt > 0 AND gt <= 1 AND recall_pos <= 0.05 THEN 1 ELSE 0 END), 6) AS fraction_tiny_fragment_missed,
  {", ".join(f"sum({c}) AS total_{c}" for c in ("tp", "fp", "fn", "tn"))}, {_global()},
  {", ".join(f"round(quantile_cont(iou_pos, {q}), 6) AS iou_pos_p{int(q * 100)}" for q in (0.25, 0.5, 0.75))}"""


@query("error_report_region", f"SELECT region, {ERR} FROM {METRICS} GROUP BY region")
def _(spark, d):
    return rounded(A.error_report(with_modes(fx_metrics(spark, d)), ["region"]))


@query("error_report_all", f"SELECT {ERR} FROM {METRICS}")
def _(spark, d):
    return rounded(A.error_report(with_modes(fx_metrics(spark, d)), []))


@query(
    "mode_counts",
    f"""SELECT city, mode AS dominant_error_mode, count(*) AS n_patches, CAST(sum(count(*)) OVER (PARTITION BY city) AS BIGINT) AS total_patches,
      round(count(*) / sum(count(*)) OVER (PARTITION BY city), 6) AS fraction FROM (SELECT *, {MODE_SQL} AS mode FROM {METRICS}) GROUP BY city, mode""",
)
def _(spark, d):
    return rounded(A.mode_counts(with_modes(fx_metrics(spark, d)), ["city"]))


@query(
    "pool_summary",
    " UNION ALL ".join(
        f"""SELECT split, '{n}' AS pool, count(*) AS group_total_patches, CAST(count(*) FILTER ({c}) AS BIGINT) AS n_patches,
        {", ".join(f"round(avg({v}) FILTER ({c}), 6) AS mean_{v}" for v in "gt_pos_pct pred_pos_pct pred_minus_gt_pct iou_pos precision_pos recall_pos".split())},
        round(count(*) FILTER ({c}) / count(*), 6) AS fraction_of_group FROM {METRICS} GROUP BY split"""
        for n, c in zip(rules.POOLS, POOL_SQL)
    ),
)
def _(spark, d):
    flags = rules.pool_flags(*metric_args())
    rows = fx_metrics(spark, d).select("*", *[c.alias(f"pool_{n}") for n, c in flags.items()])
    return rounded(A.pool_summary(rows, ["split"]))


def _upper(level):
    keys = ["split", "region", "city"]
    cols = ", ".join(k if k in level else f"NULL AS {k}" for k in keys)
    return " UNION ALL ".join(
        f"""SELECT {cols}, '{n}' AS subset, CAST({"NULL" if t is None else t} AS DOUBLE) AS gt_threshold_pct, count(*) AS n_patches,
        {", ".join(f"round(CASE WHEN {den} <> 0 THEN {num} / {den} ELSE 0 END, 6) AS global_{k}" for k, num, den in [
            ("iou_pos", "sum(tp_pct)", "(sum(tp_pct) + sum(fp_pct) + sum(fn_pct))"), ("dice_pos", "2 * sum(tp_pct)", "(2 * sum(tp_pct) + sum(fp_pct) + sum(fn_pct))"),
            ("precision_pos", "sum(tp_pct)", "(sum(tp_pct) + sum(fp_pct))"), ("recall_pos", "sum(tp_pct)", "(sum(tp_pct) + sum(fn_pct))"),
            ("iou_neg", "sum(tn_pct)", "(sum(tn_pct) + sum(fp_pct) + sum(fn_pct))"),
            ("accuracy", "(sum(tp_pct) + sum(tn_pct))", "(sum(tp_pct) + sum(fp_pct) + sum(fn_pct) + sum(tn_pct))")])},
        {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("gt_pos_pct", "pred_pos_pct", "iou_pos", "dice_pos"))},
        round(sum(gt_pos_pct), 4) AS total_gt_pos_pct_sum, round(sum(pred_pos_pct), 4) AS total_pred_pos_pct_sum
        FROM c {"" if t is None else f"WHERE gt_pos_pct > {t}"} GROUP BY {", ".join(level)}"""
        for n, t in A.SUBSETS
    )


CONF = f"""WITH c AS (SELECT *, greatest(gt - fn_pct, 0) AS tp_pct, 100 - greatest(gt - fn_pct, 0) - fp_pct - fn_pct AS tn_pct FROM {METRICS}) """


def confused(spark, d):
    gt, pred, _, _ = metric_args()
    pcts = rules.confusion_pct(gt, pred, F.col("fp_pct"), F.col("fn_pct"))
    return fx_metrics(spark, d).withColumns(pcts)


@query("upper_bound_tables", CONF + " UNION ALL ".join(_upper(lv) for lv in (["split"], ["split", "region"], ["split", "region", "city"])))
def _(spark, d):
    out = A.upper_bound_tables(confused(spark, d))
    sums = ["total_gt_pos_pct_sum", "total_pred_pos_pct_sum"]
    return rounded(out.withColumns({c: F.round(c, 4) for c in sums}))


@query(
    "upper_bound_medians",
    "WITH c AS (SELECT * FROM fx_metrics) "
    + " UNION ALL ".join(
        f"SELECT split, '{n}' AS subset, "
        + ", ".join(f"round(median({c}), 6) AS {c}_p50" for c in ("gt_pos_pct", "pred_pos_pct", "iou_pos", "dice_pos"))
        + f" FROM c {'' if t is None else f'WHERE gt_pos_pct > {t}'} GROUP BY split"
        for n, t in A.SUBSETS
    ),
)
def _(spark, d):
    return rounded(A.upper_bound_medians(fx_metrics(spark, d), ["split"]))


@query(
    "aggregate_folds",
    """WITH r AS (SELECT s_nationkey % 5 AS probe, s_suppkey AS fold, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal / 10000.0 END AS m FROM supplier)
      SELECT probe, count(*) AS n_folds, round(avg(m), 6) AS m_mean, round(stddev_pop(m), 6) AS m_std, round(median(m), 6) AS m_median FROM r GROUP BY probe""",
)
def _(spark, d):
    m = F.when(F.col("s_suppkey") % 7 == 0, float("nan")).otherwise(F.col("s_acctbal") / 10000.0)
    runs = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("probe"), m.alias("m"))
    return rounded(A.aggregate_folds(runs, ["probe"], ["m"]))


@query(
    "pivot_counts",
    """SELECT city, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'val') AS BIGINT) AS val,
      CAST(count(*) FILTER (split = 'test') AS BIGINT) AS test FROM fx_patch GROUP BY city""",
)
def _(spark, d):
    return A.pivot_counts(fx_patch(spark, d), ["city"], "split", ["train", "val", "test"])


@query(
    "distinct_values",
    """SELECT c_nationkey, k, u AS unique_count, b AS binary_ok FROM (SELECT DISTINCT c_nationkey, c_custkey % (1 + c_nationkey % 5) AS k FROM customer)
      JOIN (SELECT c_nationkey, count(DISTINCT c_custkey % (1 + c_nationkey % 5)) AS u, bool_and(c_custkey % (1 + c_nationkey % 5) IN (0, 1)) AS b FROM customer GROUP BY 1) USING (c_nationkey)""",
)
def _(spark, d):
    k = (F.col("c_custkey") % (1 + F.col("c_nationkey") % 5)).alias("k")
    return A.distinct_values(table(spark, d, "customer").select("c_nationkey", k), ["c_nationkey"], "k")


@query(
    "patch_threshold_counts",
    "SELECT city, count(*) AS patches, CAST(count(*) FILTER (q > 0) AS BIGINT) AS positive_patches, CAST(count(*) FILTER (z > 0) AS BIGINT) AS patches_any, "
    "CAST(count(*) FILTER (z > 0 AND q > 0) AS BIGINT) AS positive_patches_any, "
    + ", ".join(
        f"CAST(count(*) FILTER (z >= {t}) AS BIGINT) AS patches_ge_{t}pct, CAST(count(*) FILTER (z >= {t} AND q > 0) AS BIGINT) AS positive_patches_ge_{t}pct"
        for t in (0, 1, 5, 25, 50)
    )
    + " FROM (SELECT city, s1_nodata_percent * 4 AS z, label_positive_pixels AS q FROM fx_patch) GROUP BY city",
)
def _(spark, d):
    p = fx_patch(spark, d).withColumn("zero_percent", F.col("s1_nodata_percent") * 4)
    return A.patch_threshold_counts(p, ["city"], "zero_percent")


# The five input modalities (bands are 1-based positions in their stacks).
MODALITIES = [
    {"modality": "s2", "uses_s2": True, "uses_sar": False, "sar_variant": "none", "optical_bands": list(range(1, 13)), "sar_bands": []},
    {"modality": "s1_snap_vv_vh", "uses_s2": False, "uses_sar": True, "sar_variant": "snap_grd", "optical_bands": [], "sar_bands": [1, 2]},
    {"modality": "s1_rtc_vv_vh", "uses_s2": False, "uses_sar": True, "sar_variant": "rtc", "optical_bands": [], "sar_bands": [1, 2]},
    {"modality": "s2_s1_snap_vv_vh", "uses_s2": True, "uses_sar": True, "sar_variant": "snap_grd", "optical_bands": list(range(1, 13)), "sar_bands": [1, 2]},
    {"modality": "s2_s1_rtc_vv_vh", "uses_s2": True, "uses_sar": True, "sar_variant": "rtc", "optical_bands": list(range(1, 13)), "sar_bands": [1, 2]},
]
EMBEDDING_KEYS = {m["modality"]: {(True, False): "optical_GAP", (False, True): "SAR_GAP"}.get((m["uses_s2"], m["uses_sar"]), "joint_GAP") for m in MODALITIES}


def modality_manifest(patches):
    """One row per patch and modality with its id, band positions and embedding key (A7 shape)."""
    rows = expand_config(patches, MODALITIES, list(MODALITIES[0]))
    key = F.create_map(*[F.lit(x) for kv in EMBEDDING_KEYS.items() for x in kv])
    return rows.withColumn("embedding_key", key[F.col("modality")]).withColumn(
        "manifest_row_id", F.concat_ws("__", F.col("modality"), F.col("patch_id").cast("string"))
    )


@query(
    "modality_manifest",
    """WITH m(modality, uses_s2, uses_sar, sar_variant, n_opt, n_sar, key) AS (VALUES ('s2', TRUE, FALSE, 'none', 12, 0, 'optical_GAP'), ('s1_snap_vv_vh', FALSE, TRUE, 'snap_grd', 0, 2, 'SAR_GAP'),
        ('s1_rtc_vv_vh', FALSE, TRUE, 'rtc', 0, 2, 'SAR_GAP'), ('s2_s1_snap_vv_vh', TRUE, TRUE, 'snap_grd', 12, 2, 'joint_GAP'), ('s2_s1_rtc_vv_vh', TRUE, TRUE, 'rtc', 12, 2, 'joint_GAP'))
      SELECT concat(modality, '__', patch_id) AS manifest_row_id, patch_id, modality, uses_s2, uses_sar, sar_variant, n_opt AS n_optical, n_sar, key AS embedding_key FROM fx_patch, m""",
)
def _(spark, d):
    m = modality_manifest(fx_patch(spark, d).select("patch_id"))
    return m.select(
        "manifest_row_id", "patch_id", "modality", "uses_s2", "uses_sar", "sar_variant", F.size("optical_bands").alias("n_optical"),
        F.size("sar_bands").alias("n_sar"), "embedding_key",
    )


@query(
    "modality_summary",
    """WITH m(modality, uses_s2, uses_sar, sar_variant) AS (VALUES ('s2', TRUE, FALSE, 'none'), ('s1_snap_vv_vh', FALSE, TRUE, 'snap_grd'), ('s1_rtc_vv_vh', FALSE, TRUE, 'rtc'),
        ('s2_s1_snap_vv_vh', TRUE, TRUE, 'snap_grd'), ('s2_s1_rtc_vv_vh', TRUE, TRUE, 'rtc'))
      SELECT modality, uses_s2, uses_sar, sar_variant, count(*) AS rows, CAST(count(*) FILTER (label_positive_pixels > 0) AS BIGINT) AS positive_rows,
      CAST(count(*) FILTER (label_positive_pixels = 0) AS BIGINT) AS empty_rows, round(100.0 * count(*) FILTER (label_positive_pixels > 0) / count(*), 6) AS positive_percent
      FROM fx_patch, m GROUP BY ALL""",
)
def _(spark, d):
    return rounded(A.modality_summary(modality_manifest(fx_patch(spark, d).select("patch_id", "label_positive_pixels"))))


@query(
    "simplified_error_metrics",
    CONF
    + f"""SELECT split, {INFER_SQL} AS error_group, count(*) AS n_patches, round(sum(tp_pct) / (sum(tp_pct) + sum(fp_pct) + sum(fn_pct)), 6) AS global_iou_pos,
      round(avg(gt_pos_pct), 6) AS mean_gt_pos_pct FROM c GROUP BY ALL HAVING sum(tp_pct) + sum(fp_pct) + sum(fn_pct) > 0""",
)
def _(spark, d):
    rows = confused(spark, d).withColumn("error_group", rules.infer_error_group(*metric_args()))
    den = F.sum("tp_pct") + F.sum("fp_pct") + F.sum("fn_pct")
    out = rows.groupBy("split", "error_group").agg(
        F.count(F.lit(1)).alias("n_patches"), den.alias("den"), (F.sum("tp_pct") / den).alias("global_iou_pos"), F.avg("gt_pos_pct").alias("mean_gt_pos_pct")
    )
    return rounded(out.where("den > 0").drop("den"))
