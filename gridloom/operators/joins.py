"""Keyed joins with the checks and defaults the reports need. Catalyst and AQE pick the physical join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def with_region(df: DataFrame, cities: DataFrame, key: str = "city", default: str = "UNKNOWN") -> DataFrame:
    """Region of each row's city; `default` where the city table has no entry."""
    looked_up = df.drop("region").join(cities.select(key, "region"), key, "left")
    return looked_up.withColumn("region", F.coalesce("region", F.lit(default)))


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str = "duplicate_key") -> DataFrame:
    """Many-to-one left join. A key that is not unique on the right keeps one deterministic row and is flagged, so the
    join can never multiply rows."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(
        F.min(F.struct(*rest)).alias("_row"), (F.count(F.lit(1)) > 1).alias(flag)
    )
    out = left.join(one, list(keys), "left")
    return out.select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in rest], F.coalesce(flag, F.lit(False)).alias(flag))


def expand_config(df: DataFrame, configs: Sequence[dict], keys: Sequence[str]) -> DataFrame:
    """Each row once per configuration, by an inline generator over literals: no join and no shuffle."""
    structs = [F.struct(*[_lit(c[k]).alias(k) for k in keys]) for c in configs]
    return df.select("*", F.inline(F.array(*structs)))


def _lit(v) -> Column:
    if isinstance(v, (list, tuple)):
        return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")
    return F.lit(v)


def keep_requested(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def missing_requested(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def rows_by_index(manifest: DataFrame, base: DataFrame, index: str) -> DataFrame:
    """Original rows of a manifest of row indexes; an index that occurs twice gives two rows."""
    return manifest.join(base, index, "inner")


def chain_left(base: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    for t in tables:
        base = base.join(t, key, "left")
    return base


def qc_summary(inventory: DataFrame, s2: DataFrame, s1: DataFrame, labels: DataFrame, alignment: DataFrame) -> DataFrame:
    """Per-city QC row from four reports, with the final status."""
    out = chain_left(inventory, [s2, s1, labels, alignment], "city")
    status = (
        F.when(F.col("city_status") == "OK_S2_S1_LABEL", "complete_s1_s2_label")
        .when(F.col("city_status") == "OK_S2_LABEL_S1_MISSING", "s2_label_only_s1_missing")
        .otherwise("check_required")
    )
    return out.withColumn("final_city_status", status)


def pair_variants(results: DataFrame, by: Sequence[str], variant: str, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Values of two variants of the same run side by side (`<value>_a`, `<value>_b`), runs with both only.

    One grouped pass instead of a self-join, so the results are read and shuffled once.
    """
    pick = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c)))
    out = results.where(F.col(variant).isin(a, b)).groupBy(*by).agg(
        F.count_distinct(variant).alias("_n"),
        *[pick(v, c).alias(f"{c}_{s}") for c in values for v, s in ((a, "a"), (b, "b"))],
    )
    return out.where(F.col("_n") == 2).drop("_n")
