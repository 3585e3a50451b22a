"""Projections and scalar rules as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRUE_WORDS = ("true", "1", "yes", "y")


def norm_city(c: Column) -> Column:
    """City key of a product folder: lower, trim, version suffixes removed however often they repeat."""
    key = F.regexp_replace(F.trim(F.lower(c)), r"(_ocm_v1|_v[1-7])+$", "")
    return F.regexp_replace(key, r"^_+|_+$", "")


def city_key(c: Column) -> Column:
    """City key of a path or a free-text name: its last part, with anything but letters and digits as one `_`."""
    last = F.element_at(F.split(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "/"), -1)
    return slug(last)


def slug(c: Column) -> Column:
    """File-safe name: runs of anything but letters and digits become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def safe_int(c: Column, default: int | None = 0) -> Column:
    """Text to integer through a double (so "3.0" reads as 3); the default where it does not parse."""
    value = c.try_cast("double")
    out = F.when(value.isNotNull() & ~F.isnan(value), value.cast("bigint"))
    return F.coalesce(out, F.lit(default).cast("bigint"))


def safe_float(c: Column, default: float | None = 0.0) -> Column:
    value = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(default).cast("double"))


def safe_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def pct(n: Column, d: Column, on_zero: float | None = 0.0) -> Column:
    """100*n/d; `on_zero` is the value for an empty denominator (0 for 224-px tables, None for 512-px ones)."""
    return F.when(d > 0, F.lit(100.0) * n / d).otherwise(F.lit(on_zero).cast("double"))


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_db(x: Column, floor: float | None = None) -> Column:
    """Linear power to decibel for positive values, NULL otherwise; `floor` lifts small positives first."""
    v = F.greatest(x, F.lit(floor)) if floor is not None else x
    return F.when(x > 0, F.lit(10.0) * F.log10(v))


def looks_linear(p1: Column, p99: Column) -> Column:
    """A band is linear power when its 1st percentile is not negative and its 99th exceeds 1."""
    return (p1 >= 0) & (p99 > 1)


def band_difference(a: Column, b: Column, valid: Column) -> Column:
    return F.when(valid, a - b)


def out_nodata(nodata: Column, scaled: Column) -> Column:
    """Declared nodata of the output: none and NaN stay, 0 stays 0, a scaled product uses -9999."""
    return (
        F.when(nodata.isNull() | F.isnan(nodata) | (nodata == 0), nodata)
        .when(scaled, F.lit(-9999.0))
        .otherwise(nodata)
    )


def fill_invalid(x: Column, valid: Column, value: Column | float) -> Column:
    return F.when(valid, x).otherwise(value if isinstance(value, Column) else F.lit(float(value)))


def area_ha(pixels: Column, pixel_size_m: float = 10.0) -> Column:
    return pixels * F.lit(pixel_size_m * pixel_size_m / 10000.0)


def pixel_area(transform: Column) -> Column:
    """Area of one cell from a six-number affine (a, b, c, d, e, f)."""
    return F.abs(transform[0] * transform[4] - transform[1] * transform[3])


def patch_id_224(city: Column, row_start: Column, col_start: Column, size: Column, stride: Column) -> Column:
    ints = [x.cast("int") for x in (row_start, col_start, size, stride)]
    return F.format_string("%s__r%06d__c%06d__ps%d__st%d", city, *ints)


def patch_id_512(
    strategy: Column, fold: Column, city: Column, row_start: Column, col_start: Column, height: Column, width: Column
) -> Column:
    ints = [x.cast("int") for x in (row_start, col_start, height, width)]
    fold = F.translate(fold, " -", "__")
    return F.format_string("%s__%s__%s__r%06d_c%06d__h%04d_w%04d", strategy, fold, city, *ints)


def semicolon_ints(c: Column) -> Column:
    """"1;2" to array<int>; blanks and unparsable parts are dropped."""
    parts = F.transform(F.split(c, ";"), lambda s: F.trim(s).try_cast("int"))
    return F.filter(parts, lambda i: i.isNotNull())


def json_field(c: Column, path: str, type_: str = "string") -> Column:
    return F.get_json_object(c, path).cast(type_)


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def winner_from_delta(delta: Column, a: str, b: str, tol: float = 1e-4) -> Column:
    """`delta` is value(a) - value(b); NULL means no comparison."""
    return (
        F.when(delta.isNull() | F.isnan(delta), F.lit("unknown"))
        .when(delta > tol, F.lit(a))
        .when(delta < -tol, F.lit(b))
        .otherwise(F.lit("tie"))
    )


def set_flags(flags: dict[str, Column]) -> Column:
    """Names of the boolean columns that are set, joined by `;`, or `none`."""
    picked = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
    return F.when(F.size(picked) > 0, F.array_join(picked, ";")).otherwise("none")
