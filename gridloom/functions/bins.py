"""Label and prediction density schemes.

Each scheme is a list of (upper edge, name); the last name has no upper edge. The edges and names below are fixed
values that results must match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 4 bins: empty at <= 0, then open on the right.
DENSITY4 = [(0.0, "empty"), (1.0, "low"), (10.0, "medium"), (None, "high")]

# 8 bins, closed on the right.
DENSITY8 = [
    (0.0, "empty_0"),
    (0.1, "tiny_0_0p1"),
    (1.0, "very_low_0p1_1"),
    (5.0, "low_1_5"),
    (10.0, "moderate_5_10"),
    (25.0, "medium_10_25"),
    (50.0, "high_25_50"),
    (None, "very_high_50_100"),
]

# 9 bins, closed on the right; the first name differs between labels and predictions.
DENSITY9 = [
    (0.0, "00_empty_gt_0"),
    (0.5, "01_tiny_0_0p5"),
    (1.0, "02_tiny_0p5_1"),
    (5.0, "03_low_1_5"),
    (10.0, "04_moderate_5_10"),
    (20.0, "05_medium_10_20"),
    (40.0, "06_high_20_40"),
    (60.0, "07_very_high_40_60"),
    (None, "08_extreme_gt_60"),
]
DENSITY9_PREDICTED = [(0.0, "00_empty_pred_0"), *DENSITY9[1:]]

# 5 bins, closed on the right.
DENSITY5 = [
    (0.0, "Empty (0%)"),
    (1.0, "Tiny (0-1%)"),
    (5.0, "Small (1-5%)"),
    (20.0, "Medium (5-20%)"),
    (None, "Large (>20%)"),
]
DENSITY5_PREDICTED = [
    (0.0, "No prediction (0%)"),
    (1.0, "Tiny prediction (0-1%)"),
    (5.0, "Small prediction (1-5%)"),
    (20.0, "Medium prediction (5-20%)"),
    (None, "Large prediction (>20%)"),
]


def closed_right(p: Column, scheme: list[tuple[float | None, str]]) -> Column:
    """Name of the first bin whose upper edge is not below `p`."""
    out = None
    for edge, name in scheme[:-1]:
        out = F.when(p <= edge, name) if out is None else out.when(p <= edge, name)
    return out.otherwise(scheme[-1][1])


def scheme_order(name: Column, scheme: list[tuple[float | None, str]]) -> Column:
    """Position of a bin name in its scheme, 999 for an unknown name."""
    position = F.array_position(F.array(*[F.lit(n) for _, n in scheme]), name)
    return F.when(position > 0, position - 1).otherwise(999).cast("int")


def density4(p: Column) -> Column:
    (_, empty), (low_edge, low), (medium_edge, medium), (_, high) = DENSITY4
    return F.when(p <= 0, empty).when(p < low_edge, low).when(p < medium_edge, medium).otherwise(high)


def density8(p: Column) -> Column:
    return closed_right(p, DENSITY8)


def density9(p: Column, predicted: bool = False) -> Column:
    return closed_right(p, DENSITY9_PREDICTED if predicted else DENSITY9)


def density5(p: Column, predicted: bool = False) -> Column:
    return closed_right(p, DENSITY5_PREDICTED if predicted else DENSITY5)


def density_class(p: Column) -> Column:
    """0..4 on the edges of the 5-bin scheme."""
    out = None
    for cls, (edge, _) in enumerate(DENSITY5[:-1]):
        out = F.when(p <= edge, cls) if out is None else out.when(p <= edge, cls)
    return out.otherwise(len(DENSITY5) - 1)
