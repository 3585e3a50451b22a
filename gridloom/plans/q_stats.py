"""Band statistics, scales, normalisation and product comparison over pixels (sections B, D, N5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import masks, rules
from gridloom.functions.scalars import to_db
from gridloom.operators import decisions as D, scaling as Sc, stats as St
from gridloom.plans.fixtures import fx_pixel, table
from gridloom.plans.q_reports import rounded
from gridloom.plans.q_scalars import PX, holed_pixels
from gridloom.plans.registry import query

LONG = "(SELECT raster_id, r, c, is_valid, label, event_type, 'vv' AS band, vv AS value FROM fx_pixel UNION ALL SELECT raster_id, r, c, is_valid, label, event_type, 'vh', vh FROM fx_pixel)"


def long_px(spark, d):
    return St.long_bands(fx_pixel(spark, d), ["vv", "vh"], ["raster_id", "r", "c", "is_valid", "label", "event_type"])


def _stats(v, f="", std="stddev_pop", quant=()):
    q = ", ".join(f"round(quantile_cont({v}, {x}) {f}, 6) AS {n}" for n, x in quant)
    return f"""CAST(count({v}) {f} AS BIGINT) AS valid_count, round(min({v}) {f}, 6) AS min, round(max({v}) {f}, 6) AS max, round(avg({v}) {f}, 6) AS mean, round({std}({v}) {f}, 6) AS std{", " + q if q else ""}"""


@query(
    "band_stats",
    f"""SELECT raster_id, band, {_stats("value", "FILTER (is_valid)")}, CAST(count(*) FILTER (NOT is_valid) AS BIGINT) AS invalid_count, round(100.0 * count(*) FILTER (is_valid AND value = 0) / count(*) FILTER (is_valid), 6) AS zero_pct,
      round(100.0 * count(*) FILTER (is_valid AND value < 0) / count(*) FILTER (is_valid), 6) AS negative_pct, round(100.0 * count(*) FILTER (is_valid AND value > 1) / count(*) FILTER (is_valid), 6) AS gt1_pct FROM {LONG} GROUP BY ALL""",
)
def _(spark, d):
    return rounded(St.band_stats(long_px(spark, d), ["raster_id", "band"], valid=F.col("is_valid")))


@query("band_stats_sample_std", f"SELECT band, {_stats('value', std='stddev_samp')} FROM {LONG} GROUP BY ALL")
def _(spark, d):
    return rounded(St.band_stats(long_px(spark, d), ["band"], ddof=1).select("band", "valid_count", "min", "max", "mean", "std"))


QS = [(n, q) for n, q in Sc.QS.items()]


@query(
    "band_percentiles",
    f"SELECT raster_id, band, {', '.join(f'round(quantile_cont(value, {q}), 6) AS {n}' for n, q in QS)} FROM {LONG} WHERE is_valid GROUP BY ALL",
)
def _(spark, d):
    px = long_px(spark, d).where("is_valid")
    return rounded(St.quantiles(px, ["raster_id", "band"], "value", [q for _, q in QS], [n for n, _ in QS]))


@query("price_percentiles", f"SELECT {', '.join(f'round(quantile_cont(o_totalprice, {q}), 6) AS {n}' for n, q in QS)} FROM orders")
def _(spark, d):
    return rounded(St.quantiles(table(spark, d, "orders"), [], "o_totalprice", [q for _, q in QS], [n for n, _ in QS]))


@query(
    "outlier_counts",
    f"""SELECT band, count(value) AS n, {", ".join(f"CAST(count(*) FILTER (value > {t}) AS BIGINT) AS raw_gt_{t}" for t in (1, 10, 100, 1000))}, CAST(count(*) FILTER (value <= 0) AS BIGINT) AS raw_le_0,
      CAST(count(*) FILTER (db > 0) AS BIGINT) AS db_gt_0, CAST(count(*) FILTER (db > 10) AS BIGINT) AS db_gt_10, CAST(count(*) FILTER (db < -50) AS BIGINT) AS db_lt_minus_50
      FROM (SELECT *, CASE WHEN value > 0 THEN 10 * log10(value) END AS db FROM {LONG}) GROUP BY band""",
)
def _(spark, d):
    return St.outlier_counts(long_px(spark, d).withColumn("db", to_db(F.col("value"))), ["band"])


PRODUCT = f"""(SELECT CASE WHEN band = 'vv' THEN 'SNAP-GRD' ELSE 'RTC' END AS product, CASE WHEN label = 1 THEN 'VV' ELSE 'VH' END AS band, raster_id AS city, CASE WHEN band = 'vv' THEN value / 100 ELSE value - 30 END AS value FROM {LONG})"""


def product_px(spark, d):
    """Two products with two bands: one in linear power, one in decibel."""
    b, v = F.col("band"), F.col("value")
    return long_px(spark, d).select(
        F.when(b == "vv", "SNAP-GRD").otherwise("RTC").alias("product"), F.when(F.col("label") == 1, "VV").otherwise("VH").alias("band"),
        F.col("raster_id").alias("city"), F.when(b == "vv", v / 100).otherwise(v - 30).alias("value"),
    )


@query(
    "stats_two_level",
    f"""SELECT product, band, NULL AS city, CAST(1 AS TINYINT) AS is_global, count(*) AS valid_pixel_count, CAST(0 AS BIGINT) AS invalid_pixel_count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM {PRODUCT} GROUP BY product, band
      UNION ALL SELECT product, band, city, CAST(0 AS TINYINT), count(*), 0, round(avg(value), 6), round(coalesce(stddev_samp(value), 0), 6), round(min(value), 6), round(max(value), 6) FROM {PRODUCT} GROUP BY product, band, city""",
)
def _(spark, d):
    return rounded(Sc.stats_two_level(product_px(spark, d)))


SCALE = """CASE WHEN p50 < 0 AND p01 > -100 AND p99 < 50 THEN 'db' WHEN mn >= 0 AND p99 <= 5 AND p50 < 1.5 AND m < 1.5 THEN 'linear_sigma0_power' WHEN mn >= 0 AND p50 < 1.5 AND p99 > 5 THEN 'positive_power_with_large_tail'
  WHEN mn >= 0 AND mx > 5 THEN 'unknown_positive_large' ELSE 'unknown_assumed_db' END"""


@query(
    "detect_scales",
    f"""WITH g AS (SELECT product, band, count(*) AS n, avg(value) AS m, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM {PRODUCT} GROUP BY ALL),
      k AS (SELECT *, {SCALE} AS s FROM g), x AS (SELECT p.product, p.band, CASE WHEN s = 'linear_sigma0_power' THEN CASE WHEN value > 0 THEN 10 * log10(value) END ELSE value END AS v FROM {PRODUCT} p JOIN k ON p.product = k.product AND p.band = k.band)
      SELECT k.product, k.band, n AS valid_count, s AS inferred_input_scale, CASE WHEN s = 'linear_sigma0_power' THEN 'auto_linear_sigma0_10log10' ELSE 'none_raw_values_used' END AS conversion_mode, s = 'linear_sigma0_power' AS convert_to_db,
      (SELECT count(v) FROM x WHERE x.product = k.product AND x.band = k.band) AS converted_count, (SELECT round(avg(v), 6) FROM x WHERE x.product = k.product AND x.band = k.band) AS converted_mean FROM k""",
)
def _(spark, d):
    out = Sc.detect_scales(product_px(spark, d))
    return rounded(out.select("product", "band", "valid_count", "inferred_input_scale", "conversion_mode", "convert_to_db", "converted_count", "converted_mean"))


@query(
    "decibel_auto",
    f"""WITH q AS (SELECT raster_id, band, quantile_cont(value, 0.01) >= 0 AND quantile_cont(value, 0.99) > 1 AS lin FROM {LONG} GROUP BY ALL)
      SELECT l.raster_id, l.r, l.c, l.band, round(CASE WHEN lin THEN CASE WHEN value > 0 THEN 10 * log10(value) END ELSE value END, 6) AS db FROM {LONG} l JOIN q ON l.raster_id = q.raster_id AND l.band = q.band""",
)
def _(spark, d):
    return rounded(Sc.to_db_auto(long_px(spark, d)).select("raster_id", "r", "c", "band", "db"))


@query(
    "scale_reflectance",
    f"""WITH s AS (SELECT raster_id, r, c, band, CASE WHEN event_type = 'error' THEN -1 ELSE value / (1 + 99 * (raster_id % 2)) END AS v FROM {LONG}), q AS (SELECT raster_id, quantile_cont(v, 0.98) AS p98 FROM s WHERE v <> -1 GROUP BY 1)
      SELECT s.raster_id, r, c, band, CASE WHEN p98 > 2 THEN 'divide_10000' ELSE 'keep' END AS scale_mode_used, round(CASE WHEN v = -1 THEN CASE WHEN p98 > 2 THEN -9999 ELSE -1 END WHEN p98 > 2 THEN v * (1 / 10000.0) ELSE v END, 9) AS scaled FROM s JOIN q ON s.raster_id = q.raster_id""",
)
def _(spark, d):
    v = F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("value") / (1 + 99 * (F.col("raster_id") % 2)))
    out = Sc.scale_reflectance(long_px(spark, d).withColumn("value", v), nodata=-1.0)
    return rounded(out.select("raster_id", "r", "c", "band", "scale_mode_used", "scaled"), 9)


@query(
    "fill_with_mean",
    f"""WITH m AS (SELECT raster_id, band, avg(value) AS m FROM {LONG} WHERE is_valid GROUP BY ALL) SELECT l.raster_id, l.r, l.c, l.band, round(CASE WHEN is_valid THEN value ELSE m END, 6) AS filled FROM {LONG} l JOIN m ON l.raster_id = m.raster_id AND l.band = m.band""",
)
def _(spark, d):
    return rounded(Sc.fill_with_mean(long_px(spark, d), ["raster_id", "band"], F.col("is_valid")).select("raster_id", "r", "c", "band", "filled"))


@query(
    "normalize_bands",
    f"""WITH s AS (SELECT band, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.02) AS p2, quantile_cont(value, 0.98) AS p98 FROM {LONG} WHERE is_valid GROUP BY band)
      SELECT l.raster_id, l.r, l.c, l.band, round((least(greatest(value, p2), p98) - m) / sd, 6) AS normalized FROM {LONG} l JOIN s ON l.band = s.band""",
)
def _(spark, d):
    px = long_px(spark, d)
    stats = Sc.full_stats(px, ["band"], valid=F.col("is_valid"), qs={"p2": 0.02, "p98": 0.98})
    return rounded(Sc.normalize(px, stats, "clip_standard").select("raster_id", "r", "c", "band", "normalized"))


@query(
    "normalize_patch",
    f"""WITH s AS (SELECT raster_id, band, avg(value) AS m, stddev_pop(value) AS sd FROM {LONG} GROUP BY ALL) SELECT l.raster_id, l.r, l.c, l.band, round(least(greatest((value - (m - 2 * sd)) / greatest(4 * sd, 1e-6), 0), 1), 6) AS normalized
      FROM {LONG} l JOIN s ON l.raster_id = s.raster_id AND l.band = s.band""",
)
def _(spark, d):
    return rounded(Sc.normalize_patch(long_px(spark, d), ["raster_id", "band"]).select("raster_id", "r", "c", "band", "normalized"))


@query(
    "compare_products",
    """SELECT raster_id, count(*) AS n, round(avg(vv - vh), 6) AS mean_diff, round(avg(abs(vv - vh)), 6) AS mean_abs_diff, round(sqrt(avg((vv - vh) * (vv - vh))), 6) AS rmse, round(corr(vv, vh), 6) AS pearson_r, round(avg(vv), 6) AS mean_a, round(avg(vh), 6) AS mean_b,
      round(stddev_pop(vv), 6) AS std_a, round(stddev_pop(vh), 6) AS std_b, round(quantile_cont(vv - vh, 0.05), 6) AS diff_p05, round(quantile_cont(vv - vh, 0.5), 6) AS diff_p50, round(quantile_cont(vv - vh, 0.95), 6) AS diff_p95 FROM fx_pixel WHERE is_valid GROUP BY raster_id""",
)
def _(spark, d):
    return rounded(St.paired_stats(fx_pixel(spark, d).where("is_valid"), ["raster_id"], "vv", "vh"))


@query(
    "nodata_breakdown",
    f"""WITH x AS (SELECT raster_id, a = -9999 AS o, b IS NOT NULL AND abs(a) <= 1e-6 AND abs(b) <= 1e-6 AS z, b IS NULL AS nf FROM ({PX}))
      SELECT raster_id, count(*) AS total_pixels, {", ".join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}_pixels, round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS {n}_pct" for n, c in [("official_nodata", "o"), ("all_zero", "z"), ("non_finite", "nf"), ("combined_nodata", "o OR z OR nf")])} FROM x GROUP BY 1""",
)
def _(spark, d):
    ab = [F.col("a"), F.col("b")]
    out = St.nodata_breakdown(holed_pixels(spark, d), ["raster_id"], F.col("a") == -9999, masks.all_zero(ab, 1e-6), ~masks.all_finite(ab))
    return rounded(out)


@query(
    "border_zone",
    """SELECT raster_id, CAST(count(*) FILTER (NOT is_valid AND (r < 5 OR c < 5 OR r >= 45 OR c >= 45)) AS BIGINT) AS border_nodata, CAST(count(*) FILTER (NOT is_valid AND NOT (r < 5 OR c < 5 OR r >= 45 OR c >= 45)) AS BIGINT) AS interior_nodata FROM fx_pixel GROUP BY 1""",
)
def _(spark, d):
    zone = masks.border_zone(F.col("r"), F.col("c"), F.lit(50), F.lit(50), 5)
    bad = ~F.col("is_valid")
    return fx_pixel(spark, d).groupBy("raster_id").agg(F.count_if(bad & zone).alias("border_nodata"), F.count_if(bad & ~zone).alias("interior_nodata"))


@query(
    "rtc_city_stats",
    f"""WITH x AS (SELECT *, b IS NOT NULL AS fin, b IS NOT NULL AND abs(a) <= 1e-6 AND abs(b) <= 1e-6 AS z FROM ({PX}))
      SELECT raster_id, count(*) AS total, CAST(count(*) FILTER (fin) AS BIGINT) AS finite, CAST(count(*) FILTER (z) AS BIGINT) AS zero, round(100.0 * count(*) FILTER (z) / count(*), 6) AS zero_pct, CAST(count(*) FILTER (z AND lab > 0) AS BIGINT) AS label_on_zero,
      round(min(a) FILTER (fin AND NOT z), 6) AS a_min, round(max(b) FILTER (fin AND NOT z), 6) AS b_max, round(avg(a) FILTER (fin AND NOT z), 6) AS a_mean FROM x GROUP BY 1""",
)
def _(spark, d):
    from gridloom.operators.alignment import rtc_city_stats

    out = rtc_city_stats(holed_pixels(spark, d), ["raster_id"], "a", "b", F.col("lab"))
    return rounded(out.select("raster_id", "total", "finite", "zero", "zero_pct", "label_on_zero", "a_min", "b_max", "a_mean"))


@query(
    "mask_bbox",
    """SELECT raster_id, CAST(greatest(min(r) - 3, 0) AS BIGINT) AS row_start, CAST(least(max(r) + 4, 50) AS BIGINT) AS row_stop, CAST(greatest(min(c) - 3, 0) AS BIGINT) AS col_start, CAST(least(max(c) + 4, 50) AS BIGINT) AS col_stop FROM fx_pixel WHERE vv > 300 GROUP BY 1""",
)
def _(spark, d):
    return St.mask_bbox(fx_pixel(spark, d), ["raster_id"], F.col("vv") > 300, F.lit(50).cast("bigint"), F.lit(50).cast("bigint"), 3)


SARSTATS = f"""(SELECT product, band, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, 100.0 * count(*) FILTER (value > 10) / count(*) AS db_gt_10_pct,
  CASE band WHEN 'VV' THEN -12.59 ELSE -20.26 END AS ref_mean, CASE band WHEN 'VV' THEN 5.26 ELSE 5.91 END AS ref_std FROM {PRODUCT} GROUP BY product, band)"""


def sar_stats(spark, d):
    px = product_px(spark, d)
    s = Sc.full_stats(px, ["product", "band"], ddof=1, qs={"p25": 0.25, "p50": 0.5, "p75": 0.75})
    g = px.groupBy("product", "band").agg((100.0 * F.count_if(F.col("value") > 10) / F.count(F.lit(1))).alias("db_gt_10_pct"))
    ref = {b: F.when(F.col("band") == "VV", rules.PUBLISHED_SAR_DB["VV"][i]).otherwise(rules.PUBLISHED_SAR_DB["VH"][i]) for i, b in enumerate(("ref_mean", "ref_std"))}
    out = s.join(g, ["product", "band"]).withColumns(ref)
    return out.withColumn("plausibility_flag", rules.plausibility(F.col("mean"), F.col("std"), F.col("ref_mean"), F.lit(True)))


@query(
    "sar_main_table",
    f"""SELECT product, band, round(mean, 8) AS mean, round(p75 - p25, 8) AS iqr, round(mean - ref_mean, 8) AS mean_difference, round(std / ref_std, 8) AS std_ratio,
      CASE WHEN abs(mean - ref_mean) <= 10 AND std BETWEEN 1 AND 12 THEN 'Broadly plausible' WHEN product = 'RTC' THEN 'Shifted high-tail distribution; inspect before primary use' ELSE 'Distribution requires inspection' END AS interpretation FROM {SARSTATS}""",
)
def _(spark, d):
    main, _ = D.sar_tables(sar_stats(spark, d))
    return rounded(main.select("product", "band", "mean", "iqr", "mean_difference", "std_ratio", "interpretation"), 8)


@query(
    "sar_variant_table",
    f"""SELECT a.band, round(b.mean - a.mean, 8) AS mean_delta, round(b.p50 - a.p50, 8) AS median_delta, round(b.std / a.std, 8) AS std_ratio, round(b.db_gt_10_pct - a.db_gt_10_pct, 8) AS gt10_delta,
      CASE WHEN b.mean - a.mean > 5 OR b.db_gt_10_pct - a.db_gt_10_pct > 5 THEN 'RTC much brighter with a larger high tail' ELSE 'broadly similar' END AS interpretation FROM {SARSTATS} a JOIN {SARSTATS} b ON a.band = b.band AND a.product = 'SNAP-GRD' AND b.product = 'RTC'""",
)
def _(spark, d):
    _, variant = D.sar_tables(sar_stats(spark, d))
    return rounded(variant.select("band", "mean_delta", "median_delta", "std_ratio", "gt10_delta", "interpretation"), 8)
