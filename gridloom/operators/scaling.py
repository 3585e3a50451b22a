"""Value scales and normalisation: per-group statistics are aggregated once and joined back to the cells.

The statistics hold one row per (raster, band); Catalyst broadcasts them while they are small and sort-merges them
(with skew splitting) when they are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import rules as R
from gridloom.functions.masks import is_finite
from gridloom.functions.scalars import fill_invalid, looks_linear, nan_to_null, out_nodata, to_db
from gridloom.operators.ranking import join_null_safe
from gridloom.operators.stats import band_stats, quantiles


def to_db_auto(long: DataFrame, by: Sequence[str] = ("raster_id", "band"), mode: str = "auto") -> DataFrame:
    """Column `db` for a long (raster, band, value) table: converted where the band looks linear, kept otherwise."""
    if mode == "linear_to_db":
        return long.withColumn("db", to_db(F.col("value")))
    if mode == "already_db":
        return long.withColumn("db", F.col("value"))
    q = quantiles(long, by, "value", [0.01, 0.99], ["_p1", "_p99"])
    joined = join_null_safe(long, q, list(by), "left")
    db = F.when(looks_linear(F.col("_p1"), F.col("_p99")), to_db(F.col("value"))).otherwise(F.col("value"))
    return joined.withColumn("db", db).drop("_p1", "_p99")


def scale_reflectance(long: DataFrame, nodata: float | None = None, mode: str = "auto", threshold: float = 2.0, by: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Scaled values, mode used and output nodata per cell. The decision pools all bands of a raster."""
    v = F.col("value")
    valid = is_finite(v) if nodata is None else is_finite(v) & (v != nodata)
    p98 = quantiles(long.where(valid), by, "value", [0.98], ["p98"])
    joined = join_null_safe(long, p98, list(by), "left")
    used = R.reflectance_mode(F.col("p98"), mode, threshold)
    factor = F.when(used == "divide_10000", 1.0 / 10000.0).otherwise(1.0)
    declared = F.lit(nodata).cast("double")
    out_code = out_nodata(declared, used == "divide_10000")
    return joined.withColumns({"scale_mode_used": used, "output_nodata": out_code, "scaled": F.when(valid, v * factor).otherwise(F.coalesce(out_code, v))})


def fill_with_mean(long: DataFrame, by: Sequence[str], valid: Column) -> DataFrame:
    means = long.where(valid).groupBy(*by).agg(F.avg("value").alias("_mean"))
    joined = join_null_safe(long, means, list(by), "left")
    return joined.withColumn("filled", fill_invalid(F.col("value"), valid, F.coalesce("_mean", F.lit(0.0)))).drop("_mean")


def normalize(long: DataFrame, stats: DataFrame, mode: str, by: Sequence[str] = ("band",), eps: float = 1e-6) -> DataFrame:
    """`none`, `standard`, or `clip_standard` (to p2..p98 first); a tiny std counts as 1."""
    if mode == "none":
        return long.withColumn("normalized", F.col("value"))
    joined = join_null_safe(long, stats.select(*by, "mean", "std", *(["p2", "p98"] if mode == "clip_standard" else [])), list(by))
    v = F.col("value")
    if mode == "clip_standard":
        v = F.least(F.greatest(v, F.col("p2")), F.col("p98"))
    std = F.when(F.col("std") < eps, 1.0).otherwise(F.col("std"))
    return joined.withColumn("normalized", (v - F.col("mean")) / std).drop("mean", "std", "p2", "p98")


def normalize_patch(long: DataFrame, by: Sequence[str] = ("patch_id", "band"), eps: float = 1e-6) -> DataFrame:
    """Clip to mean +- 2 population std of the sample's channel and scale to 0..1; `by=("band",)` pools a batch."""
    m = long.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    joined = join_null_safe(long, m, list(by))
    lo = F.col("_m") - 2.0 * F.col("_s")
    x = (F.col("value") - lo) / F.greatest(4.0 * F.col("_s"), F.lit(eps))
    return joined.withColumn("normalized", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).drop("_m", "_s")


QS = {"p01": 0.01, "p02": 0.02, "p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p98": 0.98, "p99": 0.99}


def full_stats(long: DataFrame, by: Sequence[str], value: str = "value", valid: Column | None = None, ddof: int = 0, qs: dict[str, float] = QS) -> DataFrame:
    """Moments, extremes and exact quantiles per group."""
    rows = long if valid is None else long.where(valid)
    base = band_stats(long, by, value, valid, ddof)
    q = quantiles(rows, by, value, list(qs.values()), list(qs))
    return join_null_safe(base, q, list(by), "left")


def stats_two_level(long: DataFrame, value: str = "value", ddof: int = 1) -> DataFrame:
    """Statistics per (product, band) and per (product, band, city) in one pass over grouping sets."""
    std = F.stddev_samp if ddof else F.stddev_pop
    c = F.col
    sets = [[c("product"), c("band")], [c("product"), c("band"), c("city")]]
    v = F.when(is_finite(c(value)), c(value))
    return long.groupingSets(sets, c("product"), c("band"), c("city")).agg(
        F.grouping("city").alias("is_global"), F.count(v).alias("valid_pixel_count"), (F.count(F.lit(1)) - F.count(v)).alias("invalid_pixel_count"),
        F.avg(v).alias("mean"), F.coalesce(std(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def detect_scales(long: DataFrame, force_rtc: bool = False, force_positive: bool = False) -> DataFrame:
    """Inferred input scale, conversion and raw / converted statistics per (product, band)."""
    by = ["product", "band"]
    raw = full_stats(long, by, qs={"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    c = F.col
    scale = R.infer_scale(c("valid_count"), c("p01"), c("p99"), c("p50"), c("mean"), c("min"), c("max"))
    out = raw.withColumn("inferred_input_scale", scale)
    out = out.withColumn("conversion_mode", R.conversion_mode(c("product"), c("inferred_input_scale"), force_rtc, force_positive))
    out = out.withColumn("convert_to_db", R.converts(c("conversion_mode")))
    plan = out.select(*by, "convert_to_db")
    conv = convert(long, plan).groupBy(*by).agg(
        F.count("converted").alias("converted_count"), F.avg("converted").alias("converted_mean"), F.min("converted").alias("converted_min"), F.max("converted").alias("converted_max")
    )
    return join_null_safe(out, conv, by, "left")


def convert(long: DataFrame, plan: DataFrame) -> DataFrame:
    """Column `converted` by the plan of `detect_scales`."""
    joined = join_null_safe(long, plan.select("product", "band", "convert_to_db"), ["product", "band"])
    return joined.withColumn("converted", F.when(F.col("convert_to_db"), to_db(F.col("value"))).otherwise(nan_to_null(F.col("value"))))
