"""Validity, zero and label masks; every function takes band columns (or a band array) and returns a boolean column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

ZERO_TOLERANCE_512 = 1e-12
ZERO_TOLERANCE_RTC = 1e-6


def is_finite(x: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def all_finite(bands: Sequence[Column]) -> Column:
    return reduce(and_, [is_finite(b) for b in bands])


def all_zero(bands: Sequence[Column], eps: float = ZERO_TOLERANCE_512) -> Column:
    """All bands within `eps` of zero; a NULL or NaN band makes it false."""
    return reduce(and_, [is_finite(b) & F.coalesce(F.abs(b) <= eps, F.lit(False)) for b in bands])


def valid_mask(
    bands: Sequence[Column],
    nodata: float | None = None,
    zero_is_nodata: bool = False,
    nonfinite_is_nodata: bool = True,
    eps: float = 0.0,
) -> Column:
    """Finite in all bands, equal to the nodata value in none; all-zero pixels are nodata on request."""
    tests = [all_finite(bands) if nonfinite_is_nodata else reduce(and_, [b.isNotNull() for b in bands])]
    if nodata is not None and nodata == nodata:
        tests.append(reduce(and_, [F.coalesce(b != nodata, F.lit(False)) for b in bands]))
    if zero_is_nodata:
        tests.append(~all_zero(bands, eps))
    return reduce(and_, tests)


def valid_mask_array(bands: Column, nodata: float | None = None) -> Column:
    """The same test on an `array<float>` pixel vector."""
    return F.forall(bands, lambda b: is_finite(b) & (F.lit(True) if nodata is None else b != nodata))


def candidate_valid(bands: Sequence[Column], fill_value: float | None = None, eps: float = ZERO_TOLERANCE_RTC) -> Column:
    """A fallback pixel may be used when it is finite, not the fill value and not all zero."""
    return valid_mask(bands, nodata=fill_value, zero_is_nodata=True, eps=eps)


def label_valid_512(label: Column) -> Column:
    """Classes 0 and 1 are both valid; 0 is background, never nodata."""
    return is_finite(label) & label.isin(0, 1)


def label_positive_512(label: Column) -> Column:
    return label_valid_512(label) & (label == 1)


def label_positive_224(label: Column) -> Column:
    return is_finite(label) & (label > 0)


def label_non_binary(label: Column) -> Column:
    return is_finite(label) & ~label.isin(0, 1)


def nodata_class(valid: Column, border_connected: Column) -> Column:
    """0 valid, 1 border-connected nodata, 2 internal nodata."""
    return F.when(valid, 0).when(border_connected, 1).otherwise(2)


def border_zone(r: Column, c: Column, height: Column, width: Column, margin: int) -> Column:
    """Within `margin` cells of any raster edge (distance, not connectivity)."""
    return (r < margin) | (c < margin) | (r >= height - margin) | (c >= width - margin)
