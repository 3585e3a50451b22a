"""Radar product names, catalogue item fields and candidate filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gridloom.functions.scalars import first_non_empty

# Fixed value: layout of a Sentinel-1 product name (public naming convention).
PRODUCT_PATTERN = (
    r"^(S1[A-Z])_([A-Z0-9]+)_([A-Z0-9]+)_([A-Z0-9])([A-Z0-9])([A-Z0-9])([A-Z0-9]+)_"
    r"(\d{8}T\d{6})_(\d{8}T\d{6})_(\d+)_([A-Fa-f0-9]+)(?:_([A-Fa-f0-9]+))?(?:_(COG))?(?:\.SAFE)?(?:\.zip)?$"
)
PRODUCT_HEAD = r"^S1[A-Z]_[A-Z0-9]+_[A-Z0-9]+_[A-Z0-9]+_\d{8}T\d{6}_\d{8}T\d{6}_\d+_[A-Fa-f0-9]+(_|\.|$)"


def parse_product(c: Column) -> dict[str, Column]:
    """Fields of a product name; NULL where the name does not have the layout.

    The layout is tested once and the fields are cut at the underscores, so the pattern does not run per field.
    """
    fits = c.rlike(PRODUCT_PATTERN)
    parts = F.split(c, "_")
    part = lambda i: F.when(fits, F.get(parts, F.lit(i)))
    stamp = lambda i: F.try_to_timestamp(part(i), F.lit("yyyyMMdd'T'HHmmss"))
    return {
        "platform": part(0),
        "acquisition_mode": part(1),
        "product_type": part(2),
        "product_class": F.substring(part(3), 3, 1),
        "polarization_code": F.substring(part(3), 4, 8),
        "absolute_orbit": part(6),
        "datatake": F.substring_index(part(7), ".", 1),
        "acquisition_start": stamp(4),
        "acquisition_stop": stamp(5),
    }


def product_prefix(c: Column) -> Column:
    """The name up to the datatake: the same for a product and its re-packed copies."""
    bare = F.regexp_replace(c, r"(\.SAFE)?(\.zip)?$", "")
    return F.when(c.rlike(PRODUCT_HEAD), F.substring_index(F.substring_index(c, "_", 8), ".", 1)).otherwise(bare)


def product_inside(c: Column) -> Column:
    """The first product name up to the datatake that stands anywhere in a longer name; NULL if there is none."""
    found = F.regexp_extract(c, PRODUCT_HEAD.removeprefix("^").removesuffix(r"(_|\.|$)"), 0)
    return F.when(found != "", found)


def polarisations(c: Column) -> Column:
    """"VV,VH", "VV/VH" or "vv vh" to a set of upper-case names."""
    return F.array_distinct(F.filter(F.split(F.upper(c), r"[,/ ]+"), lambda p: p != ""))


def has_polarisations(c: Column, required: Sequence[str] = ("VV", "VH")) -> Column:
    need = F.array(*[F.lit(p) for p in required])
    return F.size(F.array_except(need, c)) == 0


def passes_filters(
    item_id: Column,
    pols: Column,
    mode: Column,
    product_type: Column,
    orbit: Column,
    required: Sequence[str] = ("VV", "VH"),
    want_mode: str = "IW",
    want_orbit: str = "ANY",
) -> Column:
    """Polarisations present, mode as wanted (or named in the id), a ground-range product, orbit as wanted."""
    known = lambda x: x.isNotNull() & (x != "")
    ok = has_polarisations(pols, required) if required else F.lit(True)
    if want_mode != "ANY":
        named = F.contains(F.upper(item_id), F.lit(f"_{want_mode}_"))
        ok = ok & F.when(known(mode), F.upper(mode) == want_mode).otherwise(named)
    ok = ok & F.when(known(product_type), F.contains(F.upper(product_type), F.lit("GRD"))).otherwise(True)
    if want_orbit != "ANY":
        ok = ok & F.when(known(orbit), F.upper(orbit) == want_orbit).otherwise(True)
    return ok


def days_from(acquired: Column, reference: Column) -> Column:
    """Absolute distance in days; NULL without an acquisition time."""
    micros = F.unix_micros(acquired.cast("timestamp")) - F.unix_micros(reference.cast("timestamp"))
    return F.abs(micros) / F.lit(86400.0 * 1e6)


def item_property(props: Column, *keys: str) -> Column:
    """First non-empty of several keys of a JSON object column."""
    return first_non_empty(*[F.get_json_object(props, f"$['{k}']") for k in keys])
