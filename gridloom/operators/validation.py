"""Rule tables: named checks with observed and expected values, and the rows that break them.

All row rules of a table are counted in one pass. Failing rows are listed per check through a rank limit, which is the
report's own cap; the counts are always whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import bins, rules as R
from gridloom.functions.scalars import pct, safe_bool, safe_float, safe_int
from gridloom.operators.ranking import top_k
from gridloom.operators.sets import role_overlap


def n_rows() -> Column:
    return F.count(F.lit(1))


def _rows(checks: Sequence[tuple[str, Column, Column]]) -> Column:
    """Check rows from aggregated columns: (name, observed, expected)."""
    text = lambda c: c.cast("string")
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("check_name"), F.when(obs.eqNullSafe(exp), "passed").otherwise("failed").alias("status"),
                    text(obs).alias("observed"), text(exp).alias("expected"),
                )
                for name, obs, exp in checks
            ]
        )
    )


def run_checks(df: DataFrame, bad: Mapping[str, Column], key: str, context: Sequence[str] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(checks, errors) of row rules; `bad` maps a check to the condition of a failing row (NULL does not fail).

    All failing rows are errors; with a `limit` only that many per check, the smallest keys first, numbered as error_rank.
    """
    agg = df.agg(*[F.count_if(cond).alias(f"_{i}") for i, cond in enumerate(bad.values())])
    checks = agg.select(_rows([(name, F.col(f"_{i}"), F.lit(0).cast("bigint")) for i, name in enumerate(bad)]))
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in bad.items()]))
    failing = df.select(key, *context, F.explode(names).alias("check_name"))
    return checks, failing if limit is None else top_k(failing, ["check_name"], [F.col(key)], limit, "error_rank")


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Presence of required columns, from the schema alone."""
    rows = [(c, "passed" if c in df.columns else "failed") for c in required]
    return df.sparkSession.createDataFrame(rows, "check_name string, status string")


def check_counts(df: DataFrame, expected: Mapping[str, int], positive: Column) -> DataFrame:
    """Whole-table counts against their contract."""
    observed = {
        "total_patches": n_rows(), "city_count": F.size(F.collect_set("city")).cast("bigint"),
        "positive_patches": F.count_if(positive), "empty_patches": F.count_if(~positive),
    }
    agg = df.agg(*[observed[k].alias(k) for k in expected])
    return agg.select(_rows([(k, F.col(k), F.lit(v).cast("bigint")) for k, v in expected.items()]))


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "unique_keys") -> DataFrame:
    dup = df.groupBy(*keys).agg(n_rows().alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("_d"))
    return dup.select(_rows([(name, F.col("_d"), F.lit(0).cast("bigint"))]))


def contract_rules(contract: Mapping[str, int]) -> dict[str, Column]:
    """Band counts, or any column that must hold one value."""
    return {f"{c}_contract": F.coalesce(safe_int(F.col(c).cast("string")) != v, F.lit(True)) for c, v in contract.items()}


def availability_rules(flags: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_all_true": ~safe_bool(F.col(c)) for c in flags}


def percent_rules(full: Sequence[str], zero: Sequence[str] = (), tol: float = 1e-6) -> dict[str, Column]:
    out = {f"{c}_all_100": safe_float(F.col(c).cast("string")) < 100.0 - tol for c in full}
    return out | {f"{c}_all_0": safe_float(F.col(c).cast("string")) > tol for c in zero}


def label_rules() -> dict[str, Column]:
    """Label columns recomputed from pixels and percent."""
    pixels, binary = F.col("label_positive_pixels"), F.col("patch_label_binary")
    return {
        "labels_binary": safe_bool(F.col("label_non_binary")),
        "patch_label_binary_consistency": binary != (pixels > 0).cast("int"),
        "label_density_bin_consistency": F.col("label_density_bin") != bins.density4(F.col("label_positive_percent")),
    }


def window_rules(size: int, stride: int) -> dict[str, Column]:
    c = F.col
    inside = (
        (c("height") == size) & (c("width") == size) & (c("patch_size") == size) & (c("stride") == stride) & (c("row_start") >= 0)
        & (c("col_start") >= 0) & (c("row_start") + c("height") <= c("city_height")) & (c("col_start") + c("width") <= c("city_width"))
    )
    return {"patch_windows_inside_city_bounds": ~F.coalesce(inside, F.lit(False))}


def check_city_paths(df: DataFrame, path_columns: Sequence[str]) -> DataFrame:
    """Every city reads each product from one path, or has none for any of its patches."""
    g = df.groupBy("city").agg(*[(F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(F.lit(0), n_rows())).alias(c) for c in path_columns])
    bad = g.agg(*[F.count_if(~F.col(c)).alias(c) for c in path_columns])
    return bad.select(_rows([(f"one_{c}_per_city", F.col(c), F.lit(0).cast("bigint")) for c in path_columns]))


def check_splits(splits: DataFrame, by: Sequence[str] = ("fold_id",), min_positive: int = 5, key: str = "patch_id") -> DataFrame:
    """Leakage, roles and coverage of each fold, as (fold, check, observed, status).

    Two aggregates: one by patch for leakage, one by role for the city and region sets, which are small.
    """
    by, roles = list(by), ("train", "val", "test")
    leak = role_overlap(splits, key, "split", by)
    leaks = leak.select(*by, F.concat(F.lit("patch_leakage_"), "role_a", F.lit("_"), "role_b").alias("check_name"), F.col("overlap").alias("observed"))
    at = lambda role, v: F.when(F.col("split") == role, v)
    sets = splits.groupBy(*by).agg(
        F.max("heldout_region").alias("_held"),
        *[F.collect_set(at(r, F.col("city"))).alias(f"_c_{r}") for r in roles], *[F.collect_set(at(r, F.col("region"))).alias(f"_g_{r}") for r in roles],
        *[F.count_if((F.col("split") == r) & (F.col("label_positive_pixels") > 0)).alias(f"_k_{r}") for r in roles],
    )
    size = lambda c: F.size(c).cast("bigint")
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    found = {f"city_leakage_{a}_{b}": size(F.array_intersect(f"_c_{a}", f"_c_{b}")) for a, b in pairs}
    found |= {f"missing_role_{r}": (F.size(f"_c_{r}") == 0).cast("bigint") for r in roles}
    held = F.col("_held")
    found["test_outside_heldout"] = F.when(held.isNotNull() & (held != ""), size(F.array_except("_g_test", F.array(held)))).otherwise(0).cast("bigint")
    found["heldout_outside_test"] = F.array_contains(F.array_union("_g_train", "_g_val"), held).cast("bigint")
    found |= {f"too_few_positives_{r}": (F.col(f"_k_{r}") < min_positive).cast("bigint") for r in roles}
    laid = F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(v, F.lit(0)).alias("observed")) for n, v in found.items()])
    out = leaks.unionByName(sets.select(*by, F.inline(laid)))
    return out.withColumn("status", F.when(F.col("observed") == 0, "passed").otherwise("failed"))


def check_city_split(splits: DataFrame, cities: int, by: Sequence[str] = ("split_strategy", "fold_id")) -> DataFrame:
    """City-level split: row count, duplicates and roles present, per fold."""
    g = splits.groupBy(*by).agg(n_rows().alias("rows"), F.count_distinct("city").alias("distinct_cities"), F.count_distinct("split").alias("roles"))
    ok = (F.col("rows") == cities) & (F.col("distinct_cities") == F.col("rows"))
    return g.withColumn("status", F.when(ok & (F.col("roles") == 3), "passed").when(ok, "missing_roles").otherwise("failed"))


def check_index(df: DataFrame, other: DataFrame, index: str, key: str) -> DataFrame:
    """A feature index is 0..n-1 without gap or repeat, and both tables hold the same keys."""
    n = df.agg(n_rows().alias("_n"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.lit(1).alias("_one"))
    dup = df.groupBy(index).agg(n_rows().alias("_c")).agg(F.count_if(F.col("_c") > 1).alias("_dup"), F.lit(1).alias("_one"))
    sides = df.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(other.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = sides.groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    keys = per.agg(
        F.count_if((F.col("_a") > 0) != (F.col("_b") > 0)).alias("_diff"), F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("_dk"), F.lit(1).alias("_one")
    )
    row = n.join(dup, "_one").join(keys, "_one")
    zero = F.lit(0).cast("bigint")
    return row.select(
        _rows([
            ("index_starts_at_zero", F.col("_lo").cast("bigint"), zero), ("index_ends_at_last", F.col("_hi").cast("bigint"), F.col("_n") - 1),
            ("index_without_repeats", F.col("_dup"), zero), ("keys_unique", F.col("_dk"), zero), ("keys_equal", F.col("_diff"), zero),
        ])
    )


def check_cities(cities: DataFrame, n: int, regions: Sequence[str]) -> DataFrame:
    """City table: size, no unknown region, unique cities, all regions present."""
    zero = F.lit(0).cast("bigint")
    size = lambda c: F.size(c).cast("bigint")
    unknown = F.count_if(F.coalesce(F.col("region"), F.lit("UNKNOWN")) == "UNKNOWN")
    agg = cities.agg(n_rows().alias("n"), unknown.alias("u"), F.collect_set("city").alias("c"), F.collect_set("region").alias("r"))
    want = F.array(*[F.lit(x) for x in regions])
    return agg.select(
        _rows([
            ("city_count", F.col("n"), F.lit(n).cast("bigint")), ("unknown_regions", F.col("u"), zero),
            ("duplicate_cities", F.col("n") - size("c"), zero), ("missing_regions", size(F.array_except(want, F.col("r"))), zero),
        ])
    )


def check_manifest(manifest: DataFrame, modalities: Sequence[str], rows: int) -> DataFrame:
    """Rows per modality, and band lists that fit the modality."""
    g = manifest.where(F.col("modality").isin(*modalities)).groupBy("modality").agg(
        n_rows().alias("rows"), F.count_if((F.size("optical_bands") > 0) != F.col("uses_s2")).alias("bad_optical"),
        F.count_if((F.size("sar_bands") > 0) != F.col("uses_sar")).alias("bad_sar"),
    )
    ok = (F.col("rows") == rows) & (F.col("bad_optical") == 0) & (F.col("bad_sar") == 0)
    return g.withColumn("status", F.when(ok, "passed").otherwise("failed"))


def check_ready_stack(px: DataFrame, meta: DataFrame, s2_bad: Column, s1_bad: Column, label: Column, fill: Column, require_qa: bool = True) -> DataFrame:
    """Final status per city from its pixels (holes, label values, fill codes) and its raster table (bands, grids)."""
    g = px.groupBy("city").agg(
        n_rows().alias("total_pixels"), F.count_if(s2_bad).alias("s2_nodata"), F.count_if(s1_bad).alias("s1_nodata"),
        F.bool_and(label.isin(0, 1)).alias("label_binary"), F.bool_and(fill.isin(0, 1, 2, 9)).alias("fill_ok"), F.count_if(fill == 9).alias("unresolved"),
    )
    j = g.join(meta, "city")
    c = F.col
    status = R.ready_stack_status(
        c("s2_band_count"), c("s1_band_count"), c("label_band_count"), c("s1_aligned"), c("label_aligned"), c("s2_nodata"), c("s1_nodata"),
        c("label_binary"), F.lit(True), c("fill_ok"), c("unresolved"), require_qa,
    )
    return j.withColumn("status", status)


def check_filled_stack(
    px: DataFrame, meta: DataFrame, s2_bad: Column, s1_bad: Column, label: Column, fill: Column, height: Column, width: Column, fill_code: int = 3, require_fill_qa: bool = True, margin: int = 128, tile: int = 256
) -> DataFrame:
    """Final check of rasters whose optical holes were filled: no hole may be left, radar holes may.

    `meta` holds raster_id, band counts, `s1_aligned`, `label_aligned` and `fill_aligned` (NULL: there is no fill-level
    raster). Holes are told apart by components that touch the margin; fill levels may only be 0 and the code.
    """
    from gridloom.operators.repair import nodata_plan

    def holes(prefix: str, bad: Column) -> DataFrame:
        plan = nodata_plan(px, bad, height, width, margin, tile)
        kept = ("missing_pixels", "border_pixels", "internal_pixels", "missing_percent", "border_percent", "internal_percent", "border_share_percent")
        return plan.select("raster_id", *[F.col(c).alias(f"{prefix}_{c}") for c in kept])

    levels = px.groupBy("raster_id", fill.cast("string").alias("_v")).agg(n_rows().alias("_n"), F.min(label.isin(0, 1)).alias("_b"))
    values = F.array_join(F.array_sort(F.collect_list("_v")), ",")  # as text, so that a raster of wild values stays short in the report
    g = levels.groupBy("raster_id").agg(
        F.sum("_n").alias("total_pixels"), F.min("_b").alias("label_binary"), F.substring(values, 1, 4000).alias("_values"),
        F.sum(F.when(F.col("_v") == str(fill_code), F.col("_n")).otherwise(0)).alias("_filled"), F.bool_and(F.col("_v").isin("0", str(fill_code))).alias("_ok"),
    )
    j = g.join(holes("s2", s2_bad), "raster_id").join(holes("s1", s1_bad), "raster_id").join(meta, "raster_id")
    c = F.col
    there = c("fill_aligned").isNotNull()
    fill_status = R.first_true(
        [(~there, "missing_required" if require_fill_qa else "missing_optional"), (~c("fill_aligned"), "bad_alignment"), (~F.coalesce("_ok", F.lit(False)), "unexpected_values")], "ok"
    )
    j = j.withColumns(
        {
            "fill_level_status": fill_status, "fill_level_values": F.when(there, c("_values")), "fill_level_filled_pixels": F.when(there, c("_filled")),
            "fill_level_filled_percent": F.when(there, pct(c("_filled"), c("total_pixels"))),
        }
    )
    status = R.filled_stack_status(
        c("s1_aligned") & c("label_aligned"), c("s2_band_count"), c("s1_band_count"), c("label_band_count"), c("label_binary"), c("s2_missing_pixels"), c("s1_missing_pixels"), c("fill_level_status"), require_fill_qa
    )
    return j.withColumn("status", status).drop("_values", "_filled", "_ok")


def check_stack(meta: DataFrame, reference: str = "s2", others: Sequence[str] = ("s1", "label"), tol: float = 0.0) -> DataFrame:
    """Stack alignment as check rows: for every other product, how many cities lack it or differ from the reference in its grid."""
    from gridloom.operators.alignment import alignment_qc

    q = alignment_qc(meta, reference, others, tol)
    kinds = ("same_crs", "same_transform", "same_shape", "same_resolution", "all_match")
    counts = {f"{o}_missing": F.count_if(~F.col(f"{o}_exists")) for o in others}
    counts |= {f"{o}_not_{k}": F.count_if(F.col(f"{o}_exists") & ~F.col(f"{o}_{k}")) for o in others for k in kinds}
    agg = q.agg(*[v.alias(k) for k, v in counts.items()])
    return agg.select(_rows([(k, F.col(k), F.lit(0).cast("bigint")) for k in counts]))
