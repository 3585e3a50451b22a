"""Inventories, manifests and resume over listings derived from the tables (section A)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.operators.candidates import first_candidates
from gridloom.operators.ranking import spread
from gridloom.plans.fixtures import fx_candidate, fx_patch, fx_pixel, table
from gridloom.plans.q_checks import metadata
from gridloom.plans.registry import query
from gridloom.session import shared_folder, stored
from gridloom.sources import inventory as I, tables as Tb, tiles as Tl

NAMES = [
    "city_composite_2022.tif", "sub/a_smallholes_filled_b.tif", "z_composite_x.tif", "composite_cloudmask.tif", "run_diagnostics.json", "S1_x/VV.tif", "S1_x/aVHb.tif", "S1_y/vv_low.tif", "city_composite_2022_smallholes_filled.tif",
    "composite_observation.tif",
]
FILES = f"""(SELECT concat('city', c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '_v2' ELSE '' END) AS folder, concat('city', c_nationkey) AS city, {NAMES}[c_custkey % 10 + 1] AS rel, CASE WHEN c_custkey % 10 IN (5, 6, 7) THEN 's1' ELSE 's2' END AS kind,
  concat('/raw/city', c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '_v2' ELSE '' END, '/', {NAMES}[c_custkey % 10 + 1]) AS path FROM customer)"""


def listing(spark, d):
    k = F.col("c_custkey")
    folder = F.concat(F.lit("city"), F.col("c_nationkey").cast("string"), F.when(k % 3 == 0, "_v2").otherwise(""))
    rel = F.get(F.array(*[F.lit(n) for n in NAMES]), (k % 10).cast("int"))
    f = table(spark, d, "customer").select(folder.alias("folder"), rel.alias("rel"), F.when((k % 10).isin(5, 6, 7), "s1").otherwise("s2").alias("kind"))
    return f.withColumn("path", F.concat(F.lit("/raw/"), "folder", F.lit("/"), "rel"))


@query(
    "city_inventory",
    f"""WITH f AS {FILES}, x AS (SELECT *, CASE WHEN kind = 's1' OR rel LIKE '%.json' THEN NULL WHEN rel = 'city_composite_2022_smallholes_filled.tif' THEN 0 WHEN rel = 'city_composite_2022.tif' THEN 1 WHEN rel LIKE '%smallholes_filled%' THEN 2
        WHEN rel LIKE '%composite%' AND rel NOT LIKE '%cloudmask%' AND rel NOT LIKE '%observation%' THEN 3 WHEN rel LIKE '%composite%' THEN 4 END AS rk FROM f),
      o AS (SELECT city, folder, arg_min(path, rk * 1000 + 0) FILTER (rk IS NOT NULL) AS s2_path, min(path) FILTER (rel LIKE '%cloudmask%') AS s2_cloudmask_path, min(path) FILTER (rel LIKE '%diagnostics%') AS s2_diagnostics_path FROM x WHERE kind = 's2' GROUP BY city, folder),
      l AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY folder DESC) AS rn FROM o WHERE s2_path IS NOT NULL),
      r AS (SELECT city, coalesce(min(path) FILTER (rel = 'S1_x/VV.tif'), min(path) FILTER (rel = 'S1_y/vv_low.tif')) AS vv, min(path) FILTER (rel = 'S1_x/aVHb.tif') AS vh FROM f WHERE kind = 's1' GROUP BY city)
      SELECT l.city, folder, s2_path, s2_cloudmask_path, s2_diagnostics_path, vv AS s1_vv_path, vh AS s1_vh_path, vv IS NOT NULL AND vh IS NOT NULL AS has_s1 FROM l LEFT JOIN r ON l.city = r.city WHERE rn = 1""",
)
def _(spark, d):
    return I.city_inventory(listing(spark, d))


def product_files(spark, d):
    """A product folder per supplier with its files, named after the lines it ships."""
    k = F.col("s_suppkey")
    pid = F.format_string("S1A_IW_GRDH_1SDV_20220413T082249_20220413T082318_%06d_051A1B", k.cast("int"))
    root = F.concat(F.lit("/safe/city"), F.col("s_nationkey").cast("string"), F.lit("/"), pid, F.when(k % 4 == 3, ".zip").otherwise(".SAFE"))
    names = F.array_compact(F.array(F.when(k % 5 != 0, "manifest.safe"), F.when(k % 3 != 0, "measurement/s1a-vv.tiff"), F.when(k % 2 == 0, "measurement/s1a-vh.tiff"), F.lit("preview/icon.png")))
    s = table(spark, d, "supplier").select(k, "s_nationkey", pid.alias("pid"), root.alias("product_path"), F.explode(names).alias("name"))
    return s.withColumn("path", F.concat("product_path", F.lit("/"), "name"))


@query(
    "product_inventory",
    """WITH p AS (SELECT s_suppkey AS k, concat('city', s_nationkey) AS pc, printf('S1A_IW_GRDH_1SDV_20220413T082249_20220413T082318_%06d_051A1B', s_suppkey) AS pid, s_suppkey % 5 <> 0 AND (s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0) AS valid, s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 AS two, s_suppkey % 4 <> 3 AS dir, s_nationkey FROM supplier),
        q AS (SELECT *, concat('/safe/', pc, '/', pid, CASE WHEN dir THEN '.SAFE' ELSE '.zip' END) AS path, CASE WHEN two THEN 20 ELSE 0 END + CASE WHEN valid THEN 20 ELSE 0 END + CASE WHEN dir THEN 5 ELSE 0 END AS own FROM p),
        c AS (SELECT DISTINCT concat('city', c_nationkey) AS city, c_nationkey % 2 = 0 AS raw FROM customer), sel AS (SELECT concat('city', (s_nationkey + 1) % 25) AS city, pid FROM p WHERE k % 10 = 4),
        m AS (SELECT c.city, q.*, own + CASE WHEN pc = c.city THEN 50 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM sel WHERE sel.city = c.city AND sel.pid = q.pid) THEN 180 ELSE 0 END AS score FROM c, q),
        b AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY score DESC, valid DESC, two DESC, dir DESC, path) AS rn FROM m WHERE score > 0)
      SELECT c.city, b.pid AS product_id, CAST(b.score AS BIGINT) AS score, CASE WHEN b.valid AND c.raw THEN 'SAFE_READY' WHEN b.valid THEN 'SAFE_FOUND_RAW_INCOMPLETE' WHEN b.pid IS NOT NULL THEN 'SAFE_FOUND_BUT_INCOMPLETE' WHEN c.raw THEN 'RAW_VV_VH_ONLY_NO_SAFE' ELSE 'MISSING_SAFE_AND_RAW_INCOMPLETE' END AS status FROM c LEFT JOIN b ON b.city = c.city AND rn = 1""",
)
def _(spark, d):
    files = product_files(spark, d)
    n = F.col("c_nationkey")
    cities = table(spark, d, "customer").select(F.concat(F.lit("city"), n.cast("string")).alias("city"), (n % 2 == 0).alias("has_raw_vv"), F.lit(True).alias("has_raw_vh")).distinct()
    chosen = files.where(F.col("s_suppkey") % 10 == 4).select(F.concat(F.lit("city"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("city"), F.col("pid").alias("item_id")).distinct()
    out = I.product_inventory(files.select("product_path", "path"), cities, chosen)
    return out.select("city", "product_id", "score", "status")


@query(
    "item_manifest",
    """SELECT concat('item_', event_id) AS item_id, CASE WHEN event_id % 2 = 0 THEN '2022-01-01' ELSE '2022-02-02' END AS acquired_at, CASE WHEN event_type = 'view' THEN 'IW' END AS instrument_mode, 'GRD' AS product_type, concat('/a/', event_id, '/vv.tif') AS vv_href, CAST(NULL AS VARCHAR) AS vh_href FROM events""",
)
def _(spark, d):
    e, k = F.col("event_type"), F.col("event_id")
    props = F.struct(
        F.when(k % 2 == 0, "2022-01-01").alias("datetime"), F.when(k % 2 == 1, "2022-02-02").alias("start_datetime"), F.when(e == "view", "iw").alias("sar:instrument_mode"), F.lit("grd").alias("product_type")
    )
    assets = F.struct(F.struct(F.concat(F.lit("/a/"), k.cast("string"), F.lit("/vv.tif")).alias("href")).alias("VV"))
    item = F.to_json(F.struct(F.concat(F.lit("item_"), k.cast("string")).alias("id"), props.alias("properties"), assets.alias("assets")))
    return I.manifest_from_items(table(spark, d, "events").select(item.alias("item"))).select("item_id", "acquired_at", "instrument_mode", "product_type", "vv_href", "vh_href")


ROLE_PATHS = ["a_VV.tif", "a_VH.tif", "a_vv_vh.tif", "rtc_stack.tif", "vv_vh_ratio.tif", "other.tif", "sigma0_VV_long.tif"]
ROLES = ["vv", "vh", "stacked_vv_vh", "stacked_candidate", "derived_ignore", "unknown", "vv"]
ORD = [0, 0, 0, 0, 9, 5, -1]


@query(
    "raster_inventory",
    f"""WITH f AS (SELECT concat('/raw/', CASE c_nationkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'Beta Town' ELSE 'gamma' END, '/', c_custkey, '/', {ROLE_PATHS}[c_custkey % 7 + 1]) AS path, {ROLES}[c_custkey % 7 + 1] AS role, {ORD}[c_custkey % 7 + 1] AS o,
        CASE c_nationkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta_town' END AS city FROM customer)
      SELECT city, role, path FROM (SELECT *, row_number() OVER (PARTITION BY city, role ORDER BY o, length(path), regexp_replace(lower(path), '[^a-z0-9_/.]+', '_', 'g')) AS rn FROM f WHERE city IS NOT NULL) WHERE rn = 1""",
)
def _(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    city = F.when(n == 0, "alpha").when(n == 1, "Beta Town").otherwise("gamma")
    name = F.get(F.array(*[F.lit(p) for p in ROLE_PATHS]), (k % 7).cast("int"))
    m = table(spark, d, "customer").select(F.concat(F.lit("/raw/"), city, F.lit("/"), k.cast("string"), F.lit("/"), name).alias("path"), F.when((k % 7).isin(2, 3), 2).otherwise(1).alias("band_count"))
    return I.raster_inventory(m, ["alpha", "beta_town"]).select("city", "role", "path")


@query("raster_catalogue", "SELECT l_returnflag AS product, l_suppkey AS city, l_linestatus AS path, count(*) AS rows FROM lineitem GROUP BY ALL")
def _(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("product"), F.col("l_suppkey").alias("city"), F.col("l_linestatus").alias("path"))
    return I.raster_catalogue(m)


@query(
    "patch_manifest",
    """SELECT patch_id, lower(city) AS city, region, (patch_id % 100) * 112 AS row_start, label_positive_pixels, CAST(CASE WHEN patch_id % 61 = 1 THEN 0 WHEN label_positive_pixels > 0 THEN 1 ELSE 0 END AS BIGINT) AS label_binary, round(label_positive_percent, 6) AS label_positive_percent FROM fx_patch""",
)
def _(spark, d):
    text = metadata(spark, d)
    text = text.select(*[F.col(c).cast("string").alias(c) if c != "patch_id" else F.col(c) for c in text.columns])
    m = I.patch_manifest(text)
    return m.select("patch_id", "city", "region", "row_start", "label_positive_pixels", "label_binary", F.round("label_positive_percent", 6).alias("label_positive_percent"))


@query("only_missing", "SELECT patch_id FROM fx_patch WHERE patch_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("patch_id"))
    return Tb.only_missing(fx_patch(spark, d).select("patch_id"), done, ["patch_id"])


@query(
    "resolve_columns",
    "SELECT patch_id, city, label_positive_pixels, round(label_positive_percent, 6) AS label_positive_percent FROM fx_patch",
)
def _(spark, d):
    odd = fx_patch(spark, d).select(F.col("patch_id").alias("Sample-ID"), F.col("city").alias("City Name"), F.col("label_positive_pixels").alias("N_Positive.Pixels"), F.round("label_positive_percent", 6).alias("GT pos PCT"))
    return Tb.resolve(odd, Tb.PATCH_ALIASES, ["patch_id", "city"])


@query("filter_modality", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    f = F.col("l_returnflag")
    name = F.when(f == "R", "S2 + S1 SNAP (vv/vh)").when(f == "A", "s2").otherwise("s1_rtc_vv_vh")
    return Tb.filter_modality(table(spark, d, "lineitem").withColumn("modality", name), "s2_s1_snap").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "positive_columns",
    """SELECT 'flag' AS kind, o_orderkey, o_orderkey % 3 = 1 AS is_positive FROM orders UNION ALL SELECT 'words', o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') FROM orders
      UNION ALL SELECT 'pixels', o_orderkey, o_orderkey % 7 > 2 FROM orders UNION ALL SELECT 'share', o_orderkey, o_orderkey % 5 > 2 FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    key, none = F.col("o_orderkey"), F.lit(None).cast("double")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    shapes = {
        "flag": o.select(key, F.when(key % 3 == 1, 1.0).when(key % 3 == 2, 0.0).otherwise(none).alias("Is Positive"), F.lit(9).alias("positive_pixels")),
        "words": o.select(key, F.when(urgent, " Positive").otherwise("none").alias("has_positive")),
        "pixels": o.select(key, (key % 7).cast("string").alias("positive_pixel_count"), F.lit(0).alias("gt_pos_pct")),
        "share": o.select(key, F.when(key % 5 > 0, key % 5).alias("gt_pos_pct")),
    }
    parts = [Tb.with_positive(df, 2.0 if kind in ("pixels", "share") else 0.0).select(F.lit(kind).alias("kind"), "o_orderkey", "is_positive") for kind, df in shapes.items()]
    return reduce(DataFrame.unionByName, parts)


# --- stored tables: each query writes the whole table to the shared folder and reads it back -------------------------


def fresh(spark, name):
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


@query(
    "stored_csv",
    """SELECT o_orderkey AS patch_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS city, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS label_positive_pixels, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice, 6) END AS label_positive_percent,
      o_orderkey % 2 = 0 AS complete FROM orders""",
)
def _(spark, d):
    """CSV with other column names and odd spellings of missing values, read with aliases into a schema."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    odd = o.select(
        k.alias("Sample-ID"), F.when(k % 7 == 0, " ").otherwise(F.col("o_orderstatus")).alias("City Name"), F.when(k % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("n_positive.pixels"),
        F.when(k % 11 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("GT pos PCT"), F.when(k % 2 == 0, "yes").otherwise("0").alias("complete"),
    )
    path = fresh(spark, "orders-csv")
    Tb.write_table(odd, path, format="csv")
    schema = T.StructType([
        T.StructField("patch_id", T.LongType()), T.StructField("city", T.StringType()), T.StructField("label_positive_pixels", T.LongType()), T.StructField("label_positive_percent", T.DoubleType()), T.StructField("complete", T.BooleanType()),
    ])
    return Tb.read_table(spark, path, schema, Tb.PATCH_ALIASES, required=["patch_id", "city"]).withColumn("label_positive_percent", F.round("label_positive_percent", 6))


@query("stored_splits", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 5 = 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS note FROM orders")
def _(spark, d):
    """One file per split, of which one has a column more."""
    o, k = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey") % 5
    paths = {}
    for split, rows in {"test": o.where(k == 0).withColumnRenamed("o_orderstatus", "note"), "val": o.where(k == 1).drop("o_orderstatus"), "train": o.where(k > 1).drop("o_orderstatus")}.items():
        paths[split] = fresh(spark, f"split-{split}")
        Tb.write_table(rows, paths[split])
    return Tb.read_splits(spark, paths, "parquet").select("o_orderkey", "o_custkey", "split", "note")


@query("stored_json", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, l_returnflag FROM lineitem")
def _(spark, d):
    path = fresh(spark, "lines-json")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    Tb.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path).withColumn("l_quantity", F.round("l_quantity", 6))


@query("stored_embeddings", "SELECT vec_id, 'label_3' AS modality, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE label = 3")
def _(spark, d):
    """All vectors stored by modality; one modality reads its own folder only."""
    path = fresh(spark, "embeddings")
    Tb.write_partitioned(table(spark, d, "embeddings").withColumn("modality", F.concat(F.lit("label_"), F.col("label").cast("string"))), path, "modality")
    got = Tb.read_embeddings(spark, path, "label_3")
    return got.select("vec_id", "modality", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("stored_candidates", "SELECT * REPLACE (round(overlap_percent, 6) AS overlap_percent) FROM (SELECT city, item_id, max(overlap_percent) AS overlap_percent FROM fx_candidate GROUP BY 1, 2)")
def _(spark, d):
    """Several candidate files under one glob, with repeated items of lower overlap."""
    c = fx_candidate(spark, d).select("city", "item_id", "overlap_percent")
    base = fresh(spark, "candidates")
    worse = c.withColumn("overlap_percent", F.col("overlap_percent") - 1)
    for name, rows in {"a": c.where("item_id % 2 = 0").unionByName(worse), "b": c.where("item_id % 2 = 1").withColumnRenamed("item_id", "product_id")}.items():
        Tb.write_table(rows, f"{base}/{name}", format="csv")
    read = [Tb.read_candidates(spark, f"{base}/{name}/*.csv") for name in ("a", "b")]
    both = stored(read[0].unionByName(read[1]).drop("candidate_path"), "candidates")
    return first_candidates(spread(both, ["city", "item_id"], both.count())).select("city", "item_id", F.round("overlap_percent", 6).alias("overlap_percent"))


@query("stored_tiles", "SELECT raster_id, r, c, round(CAST(CAST(vh AS FLOAT) AS DOUBLE), 6) AS vh, is_valid FROM fx_pixel WHERE raster_id % 2 = 0")
def _(spark, d):
    """All rasters stored as tiles by raster group; half of the rasters and one band are read back as cells."""
    path = fresh(spark, "tiles")
    t = Tl.pixels_to_tiles(fx_pixel(spark, d), ["vv", "vh"], F.col("is_valid"), 16)
    Tb.write_partitioned(t.withColumn("half", F.col("raster_id") % 2), path, "half")
    got = Tl.read_tiles(spark, path, [2]).where("half = 0")
    return Tl.tiles_to_pixels(got, ["vh"]).select("raster_id", "r", "c", F.round(F.col("vh").cast("double"), 6).alias("vh"), "is_valid")


@query(
    "stored_resume",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 1 THEN 'third run' WHEN o_orderkey % 4 < 2 THEN 'first run' ELSE 'second run' END AS written FROM orders""",
)
def _(spark, d):
    """Three runs of one job: the first writes two partitions and stops, the second adds what is missing, the third replaces one."""
    path = fresh(spark, "resume")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 4).cast("int").alias("part"))
    Tb.write_missing(o.where("part < 2").withColumn("written", F.lit("first run")), path, ["part"])
    Tb.write_missing(o.withColumn("written", F.lit("second run")), path, ["part"])
    Tb.replace_partitions(o.where("part = 1").withColumn("written", F.lit("third run")), path, ["part"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "written")
