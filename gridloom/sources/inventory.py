"""Inventories from file listings and catalogue items. Only paths and metadata are read, never file contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.products import parse_product, product_prefix
from gridloom.functions.scalars import city_key, first_non_empty, norm_city, safe_float, safe_int
from gridloom.operators.candidates import match_cities, safe_status
from gridloom.operators.ranking import best_per_key, top_k_overall


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modification time of all files under a folder; the content column is not selected and so not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_path(rank: Column) -> Column:
    """Path with the lowest rank, then in path order; NULL ranks do not take part."""
    return F.min_by("path", F.when(rank.isNotNull(), F.struct(rank, "path")))


def city_inventory(files: DataFrame) -> DataFrame:
    """Inputs per city from a listing with columns kind (s2 / s1), folder, rel (path inside the folder) and path.

    The optical composite is the named file, else any hole-filled one, else any composite that is no mask; a city
    without one is left out. Folders whose names differ only by version are one city and the last folder wins.
    """
    name, low = _name(F.col("rel")), F.lower(_name(F.col("rel")))
    tif = F.endswith(low, F.lit(".tif"))
    has = lambda *words: [F.contains(low, F.lit(w)) for w in words]
    filled, composite, cloud, observation, small = has("smallholes_filled", "composite", "cloudmask", "observation", "small_holes_mask")
    s2, s1 = F.col("kind") == "s2", F.col("kind") == "s1"
    rank = (
        F.when(~s2 | ~tif, None).when(F.col("rel") == "city_composite_2022_smallholes_filled.tif", 0).when(F.col("rel") == "city_composite_2022.tif", 1)
        .when(filled, 2).when(composite & ~cloud & ~observation & ~small, 3).when(composite, 4)
    )
    band = lambda b: (
        F.when(~s1 | ~F.endswith(name, F.lit(".tif")), None).when(name == f"{b}.tif", 0).when(F.contains(name, F.lit(b)), 1).when(F.contains(name, F.lit(b.lower())), 2)
    )
    diag = F.when(s2 & F.contains(low, F.lit("diagnostics")) & F.endswith(low, F.lit(".json")), 0)
    mine = files.withColumn("city", norm_city(F.col("folder")))
    optical = mine.where(s2).groupBy("city", "folder").agg(
        first_path(rank).alias("s2_path"), first_path(F.when(tif & cloud, 0)).alias("s2_cloudmask_path"), first_path(diag).alias("s2_diagnostics_path")
    )
    last = optical.where("s2_path IS NOT NULL").groupBy("city").agg(F.max_by(F.struct("folder", "s2_path", "s2_cloudmask_path", "s2_diagnostics_path"), "folder").alias("_x"))
    radar = mine.where(s1).groupBy("city").agg(first_path(band("VV")).alias("s1_vv_path"), first_path(band("VH")).alias("s1_vh_path"))
    out = last.select("city", "_x.*").join(radar, "city", "left")
    return out.withColumn("has_s1", F.col("s1_vv_path").isNotNull() & F.col("s1_vh_path").isNotNull())


def product_table(files: DataFrame) -> DataFrame:
    """One row per product folder from the paths inside it (columns product_path and path): completeness and name parts."""
    low = F.lower("path")
    tif = F.contains(low, F.lit("/measurement/")) & low.rlike(r"\.tiff?$")
    leaf = _name(low)
    g = files.groupBy("product_path").agg(
        F.bool_or(F.endswith(low, F.lit("/manifest.safe"))).alias("has_manifest"), F.count_if(tif).alias("measurement_count"),
        F.bool_or(tif & F.contains(leaf, F.lit("vv"))).alias("has_vv"), F.bool_or(tif & F.contains(leaf, F.lit("vh"))).alias("has_vh"),
    )
    product = F.regexp_replace(_name(F.col("product_path")), r"(?i)\.safe(\.zip)?$|\.zip$", "")
    g = g.withColumn("product_id", product)
    return g.withColumns(parse_product(F.col("product_id"))).withColumns(
        {"is_valid": F.col("has_manifest") & (F.col("measurement_count") > 0), "unpacked": ~F.endswith(F.lower("product_path"), F.lit(".zip"))}
    )


def product_inventory(files: DataFrame, cities: DataFrame, selected: DataFrame) -> DataFrame:
    """Best product per city. `cities` holds city, has_raw_vv, has_raw_vh; `selected` holds city, item_id.

    A product's own points (files, validity, packing) do not depend on the city. Points for a match come from equi
    joins on path parts and on the product prefix, so only matching pairs are formed; a city without a match falls
    back to the product with most points of its own.
    """
    c = F.col
    pts = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    files_pts = F.when(c("has_vv") & c("has_vh"), 20).when(F.contains("polarization_code", F.lit("DV")), 15).otherwise(0)
    p = product_table(files)
    p = p.withColumn("own", files_pts + pts(c("is_valid"), 20) + pts(c("unpacked"), 5))
    parts = p.select("product_path", F.explode(F.array_distinct(F.transform(F.split("product_path", "/"), norm_city))).alias("city"), F.lit(50).alias("pts"))
    by_path = parts.join(cities.select("city").distinct(), "city", "left_semi").select("product_path", "city", "pts")
    keyed = p.select("product_path", "product_id", product_prefix(c("product_id")).alias("prefix"))
    wanted = selected.select("city", "item_id", product_prefix(c("item_id")).alias("prefix")).distinct()
    by_id = keyed.join(wanted, "prefix").select("product_path", "city", (F.lit(80) + pts(c("product_id") == c("item_id"), 100)).alias("pts"))
    match = by_path.unionByName(by_id.groupBy("product_path", "city").agg(F.max("pts").alias("pts"))).groupBy("product_path", "city").agg(F.sum("pts").alias("pts"))
    both = (c("has_vv") & c("has_vh")).cast("int")
    order = lambda extra: [-(c("own") + extra), -c("is_valid").cast("int"), -both, -c("unpacked").cast("int"), c("product_path")]
    best_match = best_per_key(match.join(p, "product_path").withColumn("score", c("own") + c("pts")), ["city"], order(c("pts")))
    top = top_k_overall(p.where(c("own") > 0).withColumn("score", c("own")), order(F.lit(0)), 1).withColumn("_one", F.lit(1))
    keep = ["product_path", "product_id", "score", "is_valid"]
    j = cities.join(best_match.select("city", *[c(k).alias(f"_m_{k}") for k in keep]), "city", "left").withColumn("_one", F.lit(1))
    j = j.join(top.select("_one", *[c(k).alias(f"_t_{k}") for k in keep]), "_one", "left")
    use_match = c("_m_score").isNotNull() & (c("_t_score").isNull() | (c("_m_score") >= c("_t_score")))
    out = j.select("city", "has_raw_vv", "has_raw_vh", *[F.when(use_match, c(f"_m_{k}")).otherwise(c(f"_t_{k}")).alias(k) for k in keep])
    found = c("product_path").isNotNull()
    raw = c("has_raw_vv") & c("has_raw_vh")
    return out.withColumn("status", safe_status(F.coalesce(c("is_valid"), F.lit(False)), found, raw))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items, one JSON document per file, as text with its path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("item"), F.col("_metadata.file_path").alias("item_path"))


def manifest_from_items(items: DataFrame) -> DataFrame:
    """Download manifest rows from item JSON (column `item`): first non-empty of several places per field, asset links."""
    at = lambda *paths: first_non_empty(*[F.get_json_object("item", p) for p in paths])
    href = lambda *names: at(*[f"$.assets['{n}'].href" for n in names])
    product = at("$.id", "$.item_id", "$.properties['s1:product_identifier']")
    return items.select(
        product.alias("item_id"), at("$.properties.datetime", "$.datetime", "$.properties.start_datetime").alias("acquired_at"),
        F.upper(at("$.properties['sar:instrument_mode']", "$.properties.instrument_mode")).alias("instrument_mode"),
        F.upper(at("$.properties['sar:product_type']", "$.properties['s1:product_type']", "$.properties.product_type")).alias("product_type"),
        F.upper(at("$.properties['sat:orbit_state']", "$.properties.orbit_state")).alias("orbit_state"),
        href("vv", "VV").alias("vv_href"), href("vh", "VH").alias("vh_href"), href("manifest", "safe-manifest", "manifest.safe").alias("manifest_href"),
        *[c for c in items.columns if c != "item"],
    )


# Parts of a path that mark a derived raster, and those that mark a terrain-corrected one.
DERIVED_WORDS = ("vvdiff", "vv_diff", "vvminusvh", "vv_minus_vh", "vv_vh_diff", "difference", "ratio")
CORRECTED_WORDS = ("rtc", "terrain", "gamma0", "sigma0", "orthorectified", "corrected")
ROLE_ORDER = {"stacked_vv_vh": 0, "stacked_candidate": 1, "vv": 0, "vh": 0, "vv_vh_name_ambiguous": 2, "unknown": 5, "derived_ignore": 9}


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9_/.]+", "_"), "_+", "_")


def raster_role(path: Column, bands: Column) -> Column:
    """Polarisation role of a raster from its path and number of bands: of the roles whose evidence is complete, the most specific."""
    text = normal_path(path)
    stem = F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\.[^.]*$", "")
    has = {b: text.rlike(rf"(^|[_./]){b}($|[_./])") | F.contains(stem, F.lit(b)) for b in ("vv", "vh")}
    several = F.coalesce(bands >= 2, F.lit(False))
    both, one = has["vv"] & has["vh"], has["vv"] != has["vh"]
    evidence = {  # by falling rank
        "derived_ignore": text.rlike("|".join(DERIVED_WORDS)),
        "stacked_vv_vh": both & several,
        "stacked_candidate": several & text.rlike("rtc|terrain"),
        "vv_vh_name_ambiguous": both,
        "vv": one & has["vv"],
        "vh": one & has["vh"],
    }
    return F.element_at(F.array_compact(F.array(*[F.when(found, role) for role, found in evidence.items()], F.lit("unknown"))), 1)


def raster_inventory(meta: DataFrame, cities: Sequence[str]) -> DataFrame:
    """Best raster per city and role, from `path` and `band_count`."""
    rows = match_cities(meta.withColumn("role", raster_role(F.col("path"), F.col("band_count"))), cities)
    text = normal_path(F.col("path"))
    order = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])[F.col("role")]
    order = order + F.when(text.rlike("|".join(CORRECTED_WORDS)), -1).otherwise(0)
    return best_per_key(rows, ["city", "role"], [order, F.length(text), text])


def raster_catalogue(manifest: DataFrame, path: str = "path") -> DataFrame:
    """Distinct rasters of a manifest with the number of manifest rows of each."""
    return manifest.groupBy("product", "city", path).agg(F.count(F.lit(1)).alias("rows"))


def patch_manifest(meta: DataFrame) -> DataFrame:
    """Typed manifest rows from patch metadata read as text."""
    ints = ["row_start", "col_start", "height", "width", "patch_size", "stride", "label_positive_pixels"]
    return meta.select(
        "patch_id", city_key(F.col("city")).alias("city"), F.coalesce("region", F.lit("")).alias("region"), *[safe_int(F.col(c).cast("string")).alias(c) for c in ints],
        safe_int(F.col("patch_label_binary").cast("string")).alias("label_binary"), safe_float(F.col("label_positive_percent").cast("string")).alias("label_positive_percent"), "label_density_bin",
    )
