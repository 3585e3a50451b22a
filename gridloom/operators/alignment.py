"""Grid checks between rasters and whole-raster radar statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import rules as R
from gridloom.functions.masks import ZERO_TOLERANCE_RTC, all_finite, all_zero, label_positive_224


def n_rows() -> Column:
    return F.count(F.lit(1))


def grid_struct() -> Column:
    return F.struct("crs", "transform", "width", "height")


def by_product(meta: DataFrame, products: Sequence[str]) -> DataFrame:
    """One row per city with the grid of each product (NULL where the product is missing), from one grouped pass."""
    pick = lambda p: F.max_by(grid_struct(), F.when(F.col("product") == p, F.col("raster_id")))
    return meta.groupBy("city").agg(*[pick(p).alias(p) for p in products])


def same_grid(a: Column, b: Column, tol: float = 0.0) -> dict[str, Column]:
    """CRS, transform, shape, resolution and all of them; false where a product is missing."""
    no = lambda c: F.coalesce(c, F.lit(False))
    near = lambda x, y: F.abs(F.abs(x) - F.abs(y)) <= tol
    t, u = a["transform"], b["transform"]
    out = {
        "same_crs": no(a["crs"] == b["crs"]),
        "same_transform": no(R.transforms_equal(t, u, tol)),
        "same_shape": no((a["width"] == b["width"]) & (a["height"] == b["height"])),
        "same_resolution": no(near(t[0], u[0]) & near(t[4], u[4])),
    }
    out["all_match"] = out["same_crs"] & out["same_transform"] & out["same_shape"] & out["same_resolution"]
    return out


def alignment_qc(meta: DataFrame, reference: str = "s2", others: Sequence[str] = ("s1", "label"), tol: float = 0.0) -> DataFrame:
    """Grid equality of each product with the reference, per city, with the city status."""
    wide = by_product(meta, [reference, *others])
    cols = {}
    for o in others:
        cols |= {f"{o}_{k}": v for k, v in same_grid(F.col(reference), F.col(o), tol).items()}
        cols[f"{o}_exists"] = F.col(o).isNotNull()
    out = wide.withColumns(cols).drop(reference, *others)
    if {"s1", "label"} <= set(others):
        out = out.withColumn("city_status", R.city_grid_status(F.col("s1_exists"), F.col("s1_all_match"), F.col("label_all_match")))
    return out


def pair_check(meta: DataFrame, key: str = "city") -> DataFrame:
    """Whether the two polarisation files of a city can be used together."""
    mode = R.georef_mode(F.col("transform"), F.col("crs"), F.col("gcp_count"), F.col("gcp_crs"))
    m = meta.withColumn("mode", mode)
    row = F.struct("width", "height", "crs", "transform", "gcp_crs", "gcp_count", "mode")
    pick = lambda p: F.max_by(row, F.when(F.col("product") == p, F.col("raster_id")))
    g = m.groupBy(key).agg(pick("vv").alias("a"), pick("vh").alias("b"))
    a, b = F.col("a"), F.col("b")
    same = lambda f: a[f].eqNullSafe(b[f])
    shape = same("width") & same("height")
    can = lambda x: F.coalesce(x["mode"] != "insufficient_georef", F.lit(False))
    return g.select(
        key, shape.alias("same_shape"), same("crs").alias("same_crs"), same("transform").alias("same_transform"), same("gcp_crs").alias("same_gcp_crs"),
        same("gcp_count").alias("same_gcp_count"), (can(a) & can(b) & shape).alias("pair_ok"),
    )


def rtc_city_stats(px: DataFrame, by: Sequence[str], vv: str, vh: str, label: Column, eps: float = ZERO_TOLERANCE_RTC) -> DataFrame:
    """Finite and all-zero cells, labels on zero cells, and extremes and means of the cells with a signal."""
    bands = [F.col(vv), F.col(vh)]
    finite, zero, pos = all_finite(bands), all_zero(bands, eps), label_positive_224(label)
    ok = finite & ~zero
    aggs = [
        n_rows().alias("total"), F.count_if(finite).alias("finite"), F.count_if(zero).alias("zero"), (100.0 * F.count_if(zero) / n_rows()).alias("zero_pct"),
        F.count_if(pos).alias("label_positive"), F.count_if(pos & zero).alias("label_on_zero"),
    ]
    for b in (vv, vh):
        v = F.when(ok, F.col(b))
        aggs += [F.min(v).alias(f"{b}_min"), F.max(v).alias(f"{b}_max"), F.avg(v).alias(f"{b}_mean")]
    return px.groupBy(*by).agg(*aggs)
