"""Ranks, running sums, samples and top-k lists that stay exact when one group holds a large share of all rows.

A plain `row_number() over (partition by city)` sends a hot city to one task. Here the group is cut along the sort
order into buckets first: counts per (group, bucket) are pre-aggregated map-side, their running total gives each bucket
its offset, and the window runs per (group, bucket). Where only the first row or a fixed k is wanted, `min_by` and the
rank-limit rule of Catalyst do the pruning before the shuffle, so no bucketing is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BUCKET = 1_000_000  # about as many rows of one group meet in a task


def hash_order(*keys: Column, salt: str = "") -> Column:
    """32-bit position of a row in the seeded sample order (md5, so that any SQL engine can reproduce it)."""
    text = F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(h: Column, n: Column) -> Column:
    """Bucket of a row along the sample order, for a group of n rows: as many buckets as keep each near ROWS_PER_BUCKET."""
    buckets = F.ceil(n / F.lit(ROWS_PER_BUCKET))
    return F.floor(h * buckets / F.lit(1 << 32)).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a NULL group key matches itself, so that unnamed groups are not lost."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    rank: str = "rank",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Exact `row_number` (and inclusive running sums) within `by`.

    `bucket` must not decrease along `order`. `sums` maps a value column to the name of its running sum.
    """
    sums = sums or {}
    keys = [*by, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_sum_{v}") for v in sums]
    )
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = join_null_safe(rows, offsets, keys)
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.row_number().over(inside) + F.col("_off")).cast("bigint").alias(rank),
        *[(F.sum(v).over(running) + F.col(f"_off_{v}")).alias(name) for v, name in sums.items()],
    )


def sample_rank(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], salt: str = "", rank: str = "sample_rank"
) -> DataFrame:
    """Position of each row of its group in the seeded sample order; ties broken by the keys."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    h = join_null_safe(df.withColumn("_h", hash_order(*[F.col(k) for k in keys], salt=salt)), sizes, by)
    out = ranked(h, by, [F.col("_h"), *[F.col(k) for k in keys]], hash_bucket(F.col("_h"), F.col("_size")), rank)
    return out.drop("_h", "_size")


def take_sample(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], quota: Column, salt: str = ""
) -> DataFrame:
    """The first `quota` rows of each group in the seeded order. `quota` may use any column constant in the group."""
    return sample_rank(df, by, keys, salt, "_rank").where(F.col("_rank") <= quota).drop("_rank")


def spread(df: DataFrame, by: Sequence[str | Column], n: int) -> DataFrame:
    """The n rows dealt by key into as many partitions as keep each near ROWS_PER_BUCKET, where the session's number of
    shuffle partitions would not; an aggregate by that key needs no other shuffle."""
    parts = -(-n // ROWS_PER_BUCKET)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The filter on the rank lets Catalyst keep at most k rows per group and task before
    the shuffle, so a hot group costs k rows per task, not its whole size."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_k_overall(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of the whole table: `limit` becomes a per-task heap; only k rows are ranked afterwards."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def best_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order, as a mergeable aggregate.

    `order` must hold ascending, non-null sort expressions (negate numbers for descending).
    """
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return picked.select(*by, "_best.*")


def row_ids(df: DataFrame, key: str, width: int, name: str = "row_id") -> DataFrame:
    """Dense ids 1..n in the order of an integer key. Each bucket covers `width` key values, so its size is bounded by
    the key's multiplicity and no task sorts the whole table; the offsets are one row per bucket."""
    whole = df.withColumn("_all", F.lit(0))
    return ranked(whole, ["_all"], [F.col(key)], F.floor(F.col(key) / width), name).drop("_all")
