"""Set operations between tables, splits and expected values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def role_overlap(splits: DataFrame, key: str = "patch_id", role: str = "split", by: Sequence[str] = ()) -> DataFrame:
    """Keys shared by each pair of roles, zero rows included. One pass: the roles of a key are a set of at most three,
    so no pairwise join of the splits is needed."""
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    roles = splits.groupBy(*by, key).agg(F.collect_set(role).alias("_r"))
    both = lambda a, b: F.count_if(F.array_contains("_r", a) & F.array_contains("_r", b))
    wide = roles.groupBy(*by).agg(*[both(a, b).alias(f"{a}_{b}") for a, b in pairs])
    laid = F.array(*[F.struct(F.lit(a).alias("role_a"), F.lit(b).alias("role_b"), F.col(f"{a}_{b}").alias("overlap")) for a, b in pairs])
    return wide.select(*by, F.inline(laid))


def missing_values(df: DataFrame, expected: Sequence[str], column: str) -> DataFrame:
    """Expected values that do not occur."""
    want = df.sparkSession.createDataFrame([(v,) for v in expected], f"{column} string")
    return want.join(df.select(column), column, "left_anti")


def distinct_on(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
