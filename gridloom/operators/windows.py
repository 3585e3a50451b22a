"""Window idioms over keys whose groups are bounded (a raster column, a duplicate set, a probe's modalities)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def duplicate_conflicts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and whether their copies disagree in any of the columns."""
    differs = F.lit(False)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
        differs = differs | (F.col(f"_lo_{c}") != F.col(f"_hi_{c}"))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *aggs).where("copies > 1")
    return groups.select(*keys, "copies", differs.alias("conflict"))


def best_and_runner_up(df: DataFrame, by: Sequence[str], name: str, metric: str) -> DataFrame:
    """Best and second row per group with the margin; a single row is its own runner-up."""
    from gridloom.operators.ranking import top_k

    two = top_k(df, by, [F.col(metric).desc_nulls_last(), F.col(name)], 2, "_rn")
    pick = lambda c, i: F.max(F.when(F.col("_rn") == i, F.col(c)))
    best, second = pick(metric, 1), pick(metric, 2)
    return two.groupBy(*by).agg(
        pick(name, 1).alias("best"), best.alias("best_value"),
        F.coalesce(pick(name, 2), pick(name, 1)).alias("second"), F.coalesce(second, best).alias("second_value"),
        (best - F.coalesce(second, best)).alias("margin"),
    )


def group_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Each row with the mean and population std of its group. The moments are aggregated map-side and joined back;
    a window would move every row of a group to one task."""
    m = df.groupBy(*by).agg(F.avg(value).alias("group_mean"), F.stddev_pop(value).alias("group_std"))
    return df.join(m, list(by))


def column_runs(px: DataFrame, mask: Column, height: str = "run") -> DataFrame:
    """Length of the run of true cells ending at each cell, going down its raster column."""
    column = Window.partitionBy("raster_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    last_false = F.last(F.when(~mask, F.col("r")), ignorenulls=True).over(column)
    first_row = F.min("r").over(column)
    return px.withColumn(height, F.col("r") - F.coalesce(last_false, first_row - 1))


def nearest_valid_in_column(px: DataFrame, valid: Column) -> DataFrame:
    """Row of the last valid cell at or above, and the first at or below, in each raster column."""
    down = Window.partitionBy("raster_id", "c").orderBy("r")
    v = F.when(valid, F.col("r"))
    return px.withColumns(
        {
            "valid_above": F.last(v, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)),
            "valid_below": F.first(v, ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
