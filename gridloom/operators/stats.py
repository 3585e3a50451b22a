"""Band statistics, exact order statistics, counters and paired statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.masks import is_finite
from gridloom.operators.ranking import join_null_safe

BUCKETS_PER_E = 256


def long_bands(px: DataFrame, bands: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (pixel, band); a narrow generator, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands])
    return px.select(*keep, F.inline(pairs))


def band_stats(px: DataFrame, by: Sequence[str], value: str = "value", valid: Column | None = None, ddof: int = 0) -> DataFrame:
    """count, invalid, min, max, mean, std and shares of zero, negative and above-one values over valid cells."""
    ok = is_finite(F.col(value)) if valid is None else valid & is_finite(F.col(value))
    v = F.when(ok, F.col(value).cast("double"))
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    n = F.count(v)
    share = lambda cond: F.when(n > 0, 100.0 * F.count_if(cond) / n)
    return px.groupBy(*by).agg(
        n.alias("valid_count"),
        (F.count(F.lit(1)) - n).alias("invalid_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        std(v).alias("std"),
        share(v == 0).alias("zero_pct"),
        share(v < 0).alias("negative_pct"),
        share(v > 1).alias("gt1_pct"),
    )


def outlier_counts(px: DataFrame, by: Sequence[str], value: str = "value", db: str = "db") -> DataFrame:
    """Threshold counters on raw and decibel values."""
    raw, dec = F.col(value), F.col(db)
    out = [F.count_if(raw > t).alias(f"raw_gt_{t}") for t in (1, 10, 100, 1000)]
    out += [F.count_if(raw <= 0).alias("raw_le_0")]
    out += [F.count_if(dec > 0).alias("db_gt_0"), F.count_if(dec > 10).alias("db_gt_10")]
    out += [F.count_if(dec < -50).alias("db_lt_minus_50")]
    return px.groupBy(*by).agg(F.count(raw).alias("n"), *out)


def value_bucket(v: Column) -> Column:
    """Monotone bucket along the value axis: linear near zero, logarithmic away from it, about 180 buckets per factor
    of two. It needs no look at the data, so both sides of the plan below share one pre-aggregation."""
    return F.floor(F.asinh(v * 1000.0) * BUCKETS_PER_E).cast("int")


def quantile_rows(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], weight: Column | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles as rows (group, index in `qs`, value), for groups of any size.

    Built-in `percentile` keeps every distinct value of a group in one buffer; use it where the domain is bounded
    (counts out of a fixed patch area). Here rows are first reduced to (group, value, count). A histogram over value
    buckets tells which buckets hold a wanted rank; only those buckets are sorted, each in its own task. An integer
    `weight` counts a row that many times.
    """
    by = list(by)
    weight = F.lit(1) if weight is None else weight
    counts = (
        df.select(*by, F.col(value).cast("double").alias("_v"), weight.cast("bigint").alias("_w"))
        .where(is_finite(F.col("_v")) & (F.col("_w") > 0))
        .groupBy(*by, "_v")
        .agg(F.sum("_w").alias("_n"))
        .select(*by, value_bucket(F.col("_v")).alias("_b"), "_v", "_n")
    )
    group = Window.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn")).select(
        *by, "_b", "_bn", F.sum("_bn").over(group).alias("_total"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off")
    )
    last_rank = F.col("_total") - 1
    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])

    def reached(lo: Column, hi: Column):
        """Whether a probe's lower or upper rank falls into [lo, hi)."""
        return lambda p: (F.ceil(last_rank * p["q"]) >= lo) & (F.floor(last_rank * p["q"]) < hi)

    end = F.col("_off") + F.col("_bn")
    wanted = histogram.withColumn("_p", F.filter(probes, reached(F.col("_off"), end))).where(F.size("_p") > 0).drop("_bn")
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = join_null_safe(counts, wanted, [*by, "_b"]).withColumn("_to", F.col("_off") + F.sum("_n").over(inside))
    held = held.withColumn("_from", F.col("_to") - F.col("_n"))
    hits = held.select(*by, "_v", "_from", "_to", "_total", F.inline(F.filter("_p", reached(F.col("_from"), F.col("_to")))))
    position = last_rank * F.col("q")
    at = lambda r: F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v")))
    lo, hi = at(F.floor(position)), at(F.ceil(position))
    return hits.groupBy(*by, F.col("i").alias("_i")).agg((lo + (hi - lo) * F.max(position - F.floor(position))).alias("quantile"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str] | None = None, weight: Column | None = None) -> DataFrame:
    """`quantile_rows` as one row per group with a column per quantile."""
    names = list(names or [f"q{q:g}" for q in qs])
    if not by:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, names, weight).drop("_all")
    rows = quantile_rows(df, by, value, qs, weight)
    out = [F.max(F.when(F.col("_i") == i, F.col("quantile"))).alias(n) for i, n in enumerate(names)]
    return rows.groupBy(*by).agg(*out)


def grouped_quantiles(df: DataFrame, by: Sequence[str], values: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """`quantiles` for several value columns at once, as columns `<value>_p<q>`."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in values])
    stacked = df.select(*by, F.inline(pairs))
    tags = [f"p{round(q * 100):02d}" for q in qs]
    long = quantiles(stacked, [*by, "_c"], "_x", qs, tags)
    out = [F.max(F.when(F.col("_c") == c, F.col(t))).alias(f"{c}_{t}") for c in values for t in tags]
    return long.groupBy(*by).agg(*out)


def paired_stats(pairs: DataFrame, by: Sequence[str], a: str, b: str, qs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Agreement of two co-located series: differences, RMSE, correlation, difference quantiles."""
    d = (F.col(a) - F.col(b)).cast("double")
    both = pairs.withColumn("_d", d).where(is_finite(F.col("_d")))
    base = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_d").alias("mean_diff"),
        F.avg(F.abs("_d")).alias("mean_abs_diff"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        F.corr(a, b).alias("pearson_r"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.stddev_pop(a).alias("std_a"),
        F.stddev_pop(b).alias("std_b"),
    )
    q = quantiles(both, by, "_d", qs, [f"diff_p{round(x * 100):02d}" for x in qs])
    return base.join(q, list(by), "left")


def nodata_breakdown(px: DataFrame, by: Sequence[str], official: Column, all_zero: Column, non_finite: Column) -> DataFrame:
    """Counts and shares of each reason a cell has no data, and of their union."""
    n = F.count(F.lit(1))
    out = []
    for name, cond in {
        "official_nodata": official,
        "all_zero": all_zero,
        "non_finite": non_finite,
        "combined_nodata": official | all_zero | non_finite,
    }.items():
        k = F.count_if(cond)
        out += [k.alias(f"{name}_pixels"), (100.0 * k / n).alias(f"{name}_pct")]
    return px.groupBy(*by).agg(n.alias("total_pixels"), *out)


def mask_bbox(px: DataFrame, by: Sequence[str], mask: Column, height: Column, width: Column, buffer: int = 0) -> DataFrame:
    """Bounding window of a mask with a buffer, clamped to the raster. Groups without any set cell are left out."""
    r, c = F.when(mask, F.col("r")), F.when(mask, F.col("c"))
    box = px.groupBy(*by).agg(
        F.greatest(F.min(r) - buffer, F.lit(0)).alias("row_start"),
        F.least(F.max(r) + buffer + 1, F.max(height)).alias("row_stop"),
        F.greatest(F.min(c) - buffer, F.lit(0)).alias("col_start"),
        F.least(F.max(c) + buffer + 1, F.max(width)).alias("col_stop"),
        F.min(r).isNotNull().alias("_any"),
    )
    return box.where("_any").drop("_any")  # greatest() skips NULL, so the window itself does not tell
