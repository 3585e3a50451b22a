"""Tiles, patch windows and patch statistics (sections A8, C8, C9, D4, D10, H1, H13, H14, I4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import masks
from gridloom.operators import tiling as Ti
from gridloom.plans.fixtures import fx_pixel, table
from gridloom.plans.q_reports import rounded
from gridloom.plans.q_scalars import PX, holed_pixels
from gridloom.plans.q_stats import LONG, long_px
from gridloom.plans.registry import query
from gridloom.sources import tiles as Tl

SIZE, STRIDE = 16, 6


def raster_meta(px):
    return px.groupBy("raster_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def patch_index(spark, d, size=SIZE, stride=STRIDE, edge="cover"):
    meta = raster_meta(fx_pixel(spark, d)).withColumn("city", F.concat(F.lit("city"), F.col("raster_id").cast("string")))
    return Ti.tile_patches(meta, size, stride, edge)


SIZES = "(SELECT c_custkey, 200 + c_custkey % 300 AS h, 224 + c_nationkey * 9 AS w FROM customer)"


def sized(spark, d):
    c = table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    t = F.array(*[x.cast("double") for x in (F.lit(10), F.lit(0), 500000 + k * 10, F.lit(0), F.lit(-10), 7000000 - n * 10)])
    return c.select(k, (200 + k % 300).alias("height"), (224 + n * 9).alias("width"), F.concat(F.lit("c"), k.cast("string")).alias("city"), t.alias("transform"))


def _starts(n, edge):
    if edge == "partial":
        return f"range(0, CAST({n} AS BIGINT), 112)"
    base = f"range(0, CAST({n} AS BIGINT) - 224 + 1, 112)"
    if edge == "drop":
        return base
    return f"list_distinct(list_concat({base}, CASE WHEN {n} >= 224 THEN [CAST({n} AS BIGINT) - 224] ELSE [] END))"


for _edge in ("cover", "drop", "partial"):

    def _fn(spark, d, edge=_edge):
        p = Ti.tile_patches(sized(spark, d), 224, 112, edge)
        return p.select("patch_id", "row_start", "col_start", "height", "width", "is_edge_patch")

    query(
        f"tile_patches_{_edge}",
        f"""WITH a AS (SELECT c_custkey, h, w, unnest({_starts("h", _edge)}) AS r FROM {SIZES}), b AS (SELECT *, unnest({_starts("w", _edge)}) AS c FROM a)
          SELECT concat('c', c_custkey, '__r', lpad(CAST(r AS VARCHAR), 6, '0'), '__c', lpad(CAST(c AS VARCHAR), 6, '0'), '__ps224__st112') AS patch_id, r AS row_start, c AS col_start, least(224, h - r) AS height, least(224, w - c) AS width,
          r = 0 OR c = 0 OR least(r + 224, h) = h OR least(c + 224, w) = w AS is_edge_patch FROM b""",
    )(_fn)


@query(
    "window_bounds",
    f"""WITH a AS (SELECT c_custkey, 500000 + c_custkey * 10 AS x0, 7000000 - (w - 224) // 9 * 10 AS y0, h, w, unnest({_starts("h", "drop")}) AS r FROM {SIZES}), b AS (SELECT *, unnest({_starts("w", "drop")}) AS c FROM a)
      SELECT c_custkey, r AS row_start, c AS col_start, CAST(x0 + c * 10 AS DOUBLE) AS minx, CAST(x0 + (c + 224) * 10 AS DOUBLE) AS maxx, CAST(y0 - (r + 224) * 10 AS DOUBLE) AS miny, CAST(y0 - r * 10 AS DOUBLE) AS maxy,
      CAST(x0 + (c + 112) * 10 AS DOUBLE) AS centroid_x, CAST(y0 - (r + 112) * 10 AS DOUBLE) AS centroid_y FROM b""",
)
def _(spark, d):
    g = Ti.window_geo(Ti.tile_patches(sized(spark, d), 224, 112, "drop"))
    return g.select("c_custkey", "row_start", "col_start", "minx", "maxx", "miny", "maxy", "centroid_x", "centroid_y")


@query(
    "tile_round_trip",
    "SELECT raster_id, r, c, round(CAST(CAST(vv AS FLOAT) AS DOUBLE), 6) AS vv, round(CAST(CAST(vh AS FLOAT) AS DOUBLE), 6) AS vh, is_valid FROM fx_pixel",
)
def _(spark, d):
    t = Tl.pixels_to_tiles(fx_pixel(spark, d), ["vv", "vh"], F.col("is_valid"), 16)
    px = Tl.tiles_to_pixels(t, ["vv", "vh"])
    return rounded(px.withColumns({"vv": F.col("vv").cast("double"), "vh": F.col("vh").cast("double")}))


@query(
    "tile_table",
    "SELECT raster_id, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, count(*) AS cells, CAST(count(*) FILTER (is_valid) AS BIGINT) AS valid FROM fx_pixel GROUP BY ALL",
)
def _(spark, d):
    t = Tl.pixels_to_tiles(fx_pixel(spark, d), ["vv"], F.col("is_valid"), 16)
    return t.select("raster_id", "tile_row", "tile_col", F.size("mask").cast("bigint").alias("cells"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("valid"))


@query(
    "join_tiles",
    "SELECT raster_id, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, CAST(count(*) FILTER (is_valid AND label = 1) AS BIGINT) AS both_valid FROM fx_pixel GROUP BY ALL",
)
def _(spark, d):
    px = fx_pixel(spark, d)
    a, b = Tl.pixels_to_tiles(px, ["vv"], F.col("is_valid"), 16), Tl.pixels_to_tiles(px, ["vh"], F.col("label") == 1, 16)
    both = F.zip_with("mask", "other_mask", lambda x, y: x & y)
    return Tl.join_tiles(a, b).select("raster_id", "tile_row", "tile_col", F.size(F.filter(both, lambda m: m)).cast("bigint").alias("both_valid"))


@query(
    "preview",
    "SELECT raster_id, r // 4 AS pr, c // 4 AS pc, vv FROM fx_pixel WHERE r % 4 = 0 AND c % 4 = 0",
)
def _(spark, d):
    return Tl.downsample(fx_pixel(spark, d), F.lit(50), F.lit(50), 15).select("raster_id", "pr", "pc", "vv")


def _pstarts(n):
    return f"list_distinct(list_concat(range(0, {n} - {SIZE} + 1, {STRIDE}), [CAST({n} - {SIZE} AS BIGINT)]))"


PATCHES = f"""dims AS (SELECT raster_id, max(r) + 1 AS h, max(c) + 1 AS w FROM fx_pixel GROUP BY 1), pr AS (SELECT *, unnest({_pstarts("h")}) AS r0 FROM dims), pt AS (SELECT raster_id, r0, unnest({_pstarts("w")}) AS c0 FROM pr),
  pid AS (SELECT *, concat('city', raster_id, '__r', lpad(CAST(r0 AS VARCHAR), 6, '0'), '__c', lpad(CAST(c0 AS VARCHAR), 6, '0'), '__ps{SIZE}__st{STRIDE}') AS patch_id FROM pt)"""
COVER = f"x.raster_id = p.raster_id AND x.r >= p.r0 AND x.r < p.r0 + {SIZE} AND x.c >= p.c0 AND x.c < p.c0 + {SIZE}"


@query(
    "patch_metadata",
    f"""WITH {PATCHES}, x AS ({PX}) SELECT p.patch_id, count(*) AS total_pixels, CAST(count(*) FILTER (lab = 1) AS BIGINT) AS label_positive, CAST(count(*) FILTER (lab NOT IN (0, 1)) AS BIGINT) AS label_bad, CAST(count(*) FILTER (b IS NOT NULL AND a <> -9999 AND b <> -9999) AS BIGINT) AS s1_valid,
      CAST(count(*) FILTER (b IS NOT NULL AND abs(a) <= 1e-6 AND abs(b) <= 1e-6) AS BIGINT) AS s1_zero, round(min(vv) FILTER (is_valid), 6) AS vv_min, round(max(vv) FILTER (is_valid), 6) AS vv_max, round(avg(vv) FILTER (is_valid), 5) AS vv_mean, round(stddev_pop(vv) FILTER (is_valid), 5) AS vv_std,
      round(100.0 * count(*) FILTER (lab = 1) / count(*), 5) AS label_positive_percent FROM pid p JOIN x ON {COVER} GROUP BY 1""",
)
def _(spark, d):
    px = holed_pixels(spark, d)
    ab, lab = [F.col("a"), F.col("b")], F.col("lab")
    counts = {"label_positive": masks.label_positive_512(lab), "label_bad": masks.label_non_binary(lab), "s1_valid": masks.valid_mask(ab, -9999.0), "s1_zero": masks.all_zero(ab, 1e-6)}
    out = Ti.patch_stats(px, raster_meta(px), patch_index(spark, d), SIZE, STRIDE, counts, {"vv": (F.col("vv"), F.col("is_valid"))})
    return rounded(out.withColumn("label_positive_percent", 100.0 * F.col("label_positive") / F.col("total_pixels")), 5)


@query(
    "patch_pixels",
    f"""WITH {PATCHES} SELECT p.patch_id, count(*) AS cells, CAST(count(*) FILTER (is_valid) AS BIGINT) AS valid, CAST(sum((x.r - r0) * 100 + x.c - c0) AS BIGINT) AS place, CAST(max(x.r - r0) AS BIGINT) AS last_row FROM pid p JOIN fx_pixel x ON {COVER} GROUP BY 1""",
)
def _(spark, d):
    t = Tl.pixels_to_tiles(fx_pixel(spark, d), ["vv"], F.col("is_valid"), 16)
    px = Ti.patch_pixels(patch_index(spark, d), t, ["vv"], 16)
    return px.groupBy("patch_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("is_valid").alias("valid"), F.sum(F.col("pr") * 100 + F.col("pc")).cast("bigint").alias("place"), F.max("pr").cast("bigint").alias("last_row")
    )


NQ = {"p1": 0.01, "p2": 0.02, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p98": 0.98, "p99": 0.99}


@query(
    "normalization_stats",
    f"""WITH {PATCHES}, x AS {LONG}, j AS (SELECT x.* FROM pid p JOIN x ON {COVER})
      SELECT band, CAST(count(*) FILTER (is_valid) AS BIGINT) AS valid_count, CAST(count(*) FILTER (NOT is_valid) AS BIGINT) AS invalid_count, min(value) FILTER (is_valid) AS min, max(value) FILTER (is_valid) AS max, round(avg(value) FILTER (is_valid), 5) AS mean, round(stddev_pop(value) FILTER (is_valid), 5) AS std,
      {", ".join(f"round(quantile_cont(value, {q}) FILTER (is_valid), 5) AS {n}" for n, q in NQ.items())} FROM j GROUP BY band""",
)
def _(spark, d):
    train = patch_index(spark, d)
    return rounded(Ti.normalization_stats(long_px(spark, d), raster_meta(fx_pixel(spark, d)), train, SIZE, STRIDE, NQ), 5)


@query(
    "pad_or_crop",
    """WITH g AS (SELECT raster_id, unnest(range(52)) AS pr FROM (SELECT DISTINCT raster_id FROM fx_pixel)), h AS (SELECT *, unnest(range(52)) AS pc FROM g)
      SELECT h.raster_id AS patch_id, CAST(h.pr AS INTEGER) AS pr, CAST(h.pc AS INTEGER) AS pc, coalesce(x.vv, 0) AS vv FROM h LEFT JOIN fx_pixel x ON x.raster_id = h.raster_id AND x.r = h.pr AND x.c = h.pc""",
)
def _(spark, d):
    px = fx_pixel(spark, d).select(F.col("raster_id").alias("patch_id"), F.col("r").alias("pr"), F.col("c").alias("pc"), "vv")
    return Tl.pad_or_crop(px, px.select("patch_id").distinct(), 52, ["vv"])
