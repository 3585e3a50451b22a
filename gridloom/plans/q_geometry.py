"""Polygons, grids, resampling, overlap and map coordinates (section I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import alignment as Al, geometry as G, validation as Va
from gridloom.plans.fixtures import fx_pixel, table
from gridloom.plans.q_reports import rounded
from gridloom.plans.q_tiles import raster_meta
from gridloom.plans.registry import query

# Triangles drawn on the 50 x 50 fixture rasters, three per customer-sized table row: one polygon per supplier.
TRI = """(SELECT s_suppkey AS geom_id, s_suppkey % (SELECT max(raster_id) + 1 FROM fx_pixel) AS raster_id, [s_suppkey * 7 % 50, s_suppkey * 13 % 50 + 0.25, s_suppkey * 29 % 50 + 0.5] AS xs, [s_suppkey * 11 % 50 + 0.5, s_suppkey * 17 % 50, s_suppkey * 23 % 50 + 0.75] AS ys FROM supplier)"""
EDGES = f"(SELECT geom_id, raster_id, CAST(xs[i] AS DOUBLE) AS x0, CAST(ys[i] AS DOUBLE) AS y0, CAST(xs[i % 3 + 1] AS DOUBLE) AS x1, CAST(ys[i % 3 + 1] AS DOUBLE) AS y1 FROM {TRI}, (SELECT unnest([1, 2, 3]) AS i))"
HITS = f"""hits AS (SELECT e.raster_id, e.geom_id, x.r, x.c FROM {EDGES} e JOIN fx_pixel x ON x.raster_id = e.raster_id AND x.r + 0.5 >= least(y0, y1) AND x.r + 0.5 < greatest(y0, y1)
  AND x.c + 0.5 >= x0 + (x.r + 0.5 - y0) / (y1 - y0) * (x1 - x0) GROUP BY ALL HAVING count(*) % 2 = 1)"""


def grids(spark, d):
    unit = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)])
    return raster_meta(fx_pixel(spark, d)).select("raster_id", unit.alias("transform"), "width", "height")


def triangles(spark, d):
    n = grids(spark, d).agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    k = F.col("s_suppkey")
    corner = lambda i, a, x, b, y: F.struct(F.lit(i).alias("seq"), (k * a % 50 + x).cast("double").alias("x"), (k * b % 50 + y).cast("double").alias("y"))
    corners = F.array(corner(0, 7, 0, 11, 0.5), corner(1, 13, 0.25, 17, 0), corner(2, 29, 0.5, 23, 0.75))
    s = table(spark, d, "supplier").withColumn("_one", F.lit(1)).join(n, "_one")
    return s.select(k.alias("geom_id"), (k % F.col("_n")).alias("raster_id"), F.lit(0).alias("ring"), F.inline(corners))


@query("rasterize", f"WITH {HITS} SELECT DISTINCT raster_id, r, c FROM hits")
def _(spark, d):
    return G.rasterize(triangles(spark, d), grids(spark, d))


@query("rasterize_runs", f"WITH {HITS} SELECT geom_id, r, count(*) AS cells, min(c) AS c_first, max(c) AS c_last FROM hits GROUP BY ALL")
def _(spark, d):
    runs = G.rasterize_runs(triangles(spark, d), grids(spark, d))
    return runs.select("geom_id", "r", (F.col("c_last") - F.col("c_first") + 1).alias("cells"), "c_first", "c_last")


@query("polygon_area", f"SELECT geom_id, round(abs(sum(x0 * y1 - x1 * y0)) / 2, 6) AS area FROM {EDGES} GROUP BY 1")
def _(spark, d):
    return rounded(G.polygon_area(triangles(spark, d)))


@query(
    "cell_overlap",
    f"""WITH {HITS}, a AS (SELECT raster_id, r, c, CAST(1 + r * 0.01 AS DOUBLE) AS w FROM fx_pixel WHERE NOT is_valid), t AS (SELECT raster_id, sum(w) AS total FROM a GROUP BY 1)
      SELECT h.raster_id, h.geom_id AS item_id, round(sum(w), 6) AS overlap_area, round(max(total), 6) AS aoi_area, round(100 * sum(w) / max(total), 6) AS overlap_percent FROM hits h JOIN a ON h.raster_id = a.raster_id AND h.r = a.r AND h.c = a.c JOIN t ON t.raster_id = h.raster_id GROUP BY ALL""",
)
def _(spark, d):
    aoi = fx_pixel(spark, d).where("NOT is_valid")
    return rounded(G.cell_overlap(aoi, triangles(spark, d), grids(spark, d), 1 + F.col("r") * 0.01))


@query(
    "bbox_overlap",
    """WITH b AS (SELECT o_orderkey, o_custkey % 100 AS x, o_orderkey % 70 AS y FROM orders), i AS (SELECT *, greatest(least(x + 20, 60) - greatest(x, 40), 0) * greatest(least(y + 30, 50) - greatest(y, 10), 0) AS inter FROM b)
      SELECT o_orderkey, CAST(inter AS DOUBLE) AS inter, round(100.0 * inter / 600, 6) AS of_a, round(100.0 * inter / 800, 6) AS of_b FROM i""",
)
def _(spark, d):
    x, y = (F.col("o_custkey") % 100).cast("double"), (F.col("o_orderkey") % 70).cast("double")
    inter, a, b = G.bbox_overlap((x, y, x + 20, y + 30), tuple(F.lit(float(v)) for v in (40, 10, 60, 50)))
    return rounded(table(spark, d, "orders").select("o_orderkey", inter.alias("inter"), a.alias("of_a"), b.alias("of_b")))


def dst_grid(spark, d):
    """40 x 40 cells of 1.25 source cells, shifted by a third of a cell."""
    t = F.array(*[F.lit(float(v)) for v in (1.25, 0, 0.25, 0, 1.25, -0.75)])
    return grids(spark, d).select("raster_id", t.alias("transform"), F.least(F.lit(40), "width").alias("width"), F.least(F.lit(40), "height").alias("height"))


TARGET = """t AS (SELECT raster_id, r, c, 1.25 * (c + 0.5) + 0.25 AS fc, 1.25 * (r + 0.5) - 0.75 AS fr FROM fx_pixel WHERE r < 40 AND c < 40)"""


@query(
    "resample_nearest",
    f"WITH {TARGET} SELECT t.raster_id, t.r, t.c, s.vv FROM t LEFT JOIN fx_pixel s ON s.raster_id = t.raster_id AND s.is_valid AND s.r = floor(fr) AND s.c = floor(fc)",
)
def _(spark, d):
    return G.resample(fx_pixel(spark, d), grids(spark, d), dst_grid(spark, d), ["vv"], F.col("is_valid"), "nearest")


@query(
    "resample_bilinear",
    f"""WITH {TARGET}, n AS (SELECT t.*, floor(fr - 0.5) + dr AS sr, floor(fc - 0.5) + dc AS sc, (CASE dr WHEN 1 THEN fr - 0.5 - floor(fr - 0.5) ELSE 1 - (fr - 0.5 - floor(fr - 0.5)) END) * (CASE dc WHEN 1 THEN fc - 0.5 - floor(fc - 0.5) ELSE 1 - (fc - 0.5 - floor(fc - 0.5)) END) AS w
        FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc))
      SELECT n.raster_id, n.r, n.c, round(sum(w * s.vv) / nullif(sum(CASE WHEN s.vv IS NOT NULL THEN w ELSE 0 END), 0), 9) AS vv FROM n LEFT JOIN fx_pixel s ON s.raster_id = n.raster_id AND s.is_valid AND s.r = sr AND s.c = sc GROUP BY ALL""",
)
def _(spark, d):
    return rounded(G.resample(fx_pixel(spark, d), grids(spark, d), dst_grid(spark, d), ["vv"], F.col("is_valid")), 9)


META = """(SELECT c_custkey, concat('city', c_custkey // 3) AS city, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'archived' WHEN c_custkey % 3 = 0 THEN 's2' WHEN c_custkey % 3 = 1 THEN 's1' ELSE 'label' END AS product, CASE WHEN c_custkey % 31 = 0 THEN 'EPSG:32722' ELSE 'EPSG:32723' END AS crs,
  CASE WHEN c_custkey % 17 = 0 THEN 20.0 ELSE 10.0 END AS res, 1000 + CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS width FROM customer)"""


def grid_table(spark, d):
    k = F.col("c_custkey")
    res = F.when(k % 17 == 0, 20.0).otherwise(10.0)
    t = F.array(res, F.lit(0.0), F.lit(500000.0), F.lit(0.0), -res, F.lit(7000000.0))
    return table(spark, d, "customer").select(
        F.concat(F.lit("r"), k.cast("string")).alias("raster_id"), F.concat(F.lit("city"), F.floor(k / 3).cast("string")).alias("city"), k.alias("k"),
        F.when((k % 3 == 1) & (k % 5 == 0), "archived").when(k % 3 == 0, "s2").when(k % 3 == 1, "s1").otherwise("label").alias("product"), F.when(k % 31 == 0, "EPSG:32722").otherwise("EPSG:32723").alias("crs"),
        t.alias("transform"), (1000 + F.when(k % 23 == 0, 1).otherwise(0)).alias("width"), F.lit(900).alias("height"),
    )


@query(
    "alignment_qc",
    f"""WITH m AS {META}, j AS (SELECT c.city, a.crs = b.crs AND a.res = b.res AND a.width = b.width AS s1m, a.res = b.res AS s1t, b.city IS NOT NULL AS s1e, a.crs = l.crs AND a.res = l.res AND a.width = l.width AS lm, a.width = l.width AS lsh FROM (SELECT DISTINCT city FROM m) c
        LEFT JOIN m a ON a.city = c.city AND a.product = 's2' LEFT JOIN m b ON b.city = c.city AND b.product = 's1' LEFT JOIN m l ON l.city = c.city AND l.product = 'label')
      SELECT city, coalesce(s1m, FALSE) AS s1_all_match, coalesce(s1t, FALSE) AS s1_same_transform, s1e AS s1_exists, coalesce(lm, FALSE) AS label_all_match, coalesce(lsh, FALSE) AS label_same_shape,
      CASE WHEN lm AND s1m THEN 'OK_S2_S1_LABEL' WHEN lm AND NOT s1e THEN 'OK_S2_LABEL_S1_MISSING' WHEN lm THEN 'LABEL_OK_S1_ALIGNMENT_PROBLEM' ELSE 'ALIGNMENT_PROBLEM' END AS city_status FROM j""",
)
def _(spark, d):
    q = Al.alignment_qc(grid_table(spark, d))
    return q.select("city", "s1_all_match", "s1_same_transform", "s1_exists", "label_all_match", "label_same_shape", "city_status")


STACK_PARTS = {"same_crs": "a.crs = o.crs", "same_transform": "a.res = o.res", "same_shape": "a.width = o.width", "same_resolution": "a.res = o.res", "all_match": "a.crs = o.crs AND a.res = o.res AND a.width = o.width"}


@query(
    "stack_checks",
    f"WITH m AS {META}, c AS (SELECT DISTINCT city FROM m), f AS ("
    + " UNION ALL ".join(
        f"SELECT '{p}_missing' AS check_name, count(*) FILTER (o.city IS NULL) AS n FROM c LEFT JOIN m o ON o.city = c.city AND o.product = '{p}' UNION ALL "
        + " UNION ALL ".join(
            f"SELECT '{p}_not_{k}', count(*) FILTER (o.city IS NOT NULL AND NOT coalesce({test}, FALSE)) FROM c LEFT JOIN m o ON o.city = c.city AND o.product = '{p}' LEFT JOIN m a ON a.city = c.city AND a.product = 's2'" for k, test in STACK_PARTS.items()
        )
        for p in ("s1", "label")
    )
    + ") SELECT check_name, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM f",
)
def _(spark, d):
    return Va.check_stack(grid_table(spark, d))


@query(
    "pair_check",
    """WITH m AS (SELECT c_custkey // 2 AS city, c_custkey % 2 = 0 AS vv, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'EPSG:32723' END AS crs, CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 2 END AS gcps, c_custkey % 23 = 0 AS wide FROM customer),
        j AS (SELECT a.city, a.wide = b.wide AS sh, a.crs = b.crs AS sc, a.gcps = b.gcps AS sg, a.crs <> '' OR a.gcps >= 4 AS ca, b.crs <> '' OR b.gcps >= 4 AS cb FROM m a JOIN m b ON a.city = b.city AND a.vv AND NOT b.vv)
      SELECT city, sh AS same_shape, sc AS same_crs, sg AS same_gcp_count, ca AND cb AND sh AS pair_ok FROM j""",
)
def _(spark, d):
    k = F.col("c_custkey")
    t = F.array(*[F.lit(float(v)) for v in (10, 0, 500000, 0, -10, 7000000)])
    m = table(spark, d, "customer").select(
        k.alias("raster_id"), F.floor(k / 2).alias("city"), F.when(k % 2 == 0, "vv").otherwise("vh").alias("product"), F.when(k % 7 == 0, "").otherwise("EPSG:32723").alias("crs"), t.alias("transform"),
        (1000 + F.when(k % 23 == 0, 1).otherwise(0)).alias("width"), F.lit(900).alias("height"), F.when(k % 5 == 0, 10).otherwise(2).alias("gcp_count"), F.lit("EPSG:4326").alias("gcp_crs"),
    )
    return Al.pair_check(m).select("city", "same_shape", "same_crs", "same_gcp_count", "pair_ok")


# The inverse transverse Mercator series on WGS84, step by step; e2, q1 and p2 are the ellipsoid's constants.
LONLAT_SQL = """WITH k AS (SELECT f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS p2, f / (2 - f) AS q1, 6378137.0::DOUBLE AS a FROM (SELECT 1 / 298.257223563::DOUBLE AS f)),
  o AS (SELECT o_orderkey, 300000.0::DOUBLE + o_custkey * 10 AS x, 7400000.0::DOUBLE + o_orderkey % 1000 * 10 AS y, 22 + o_orderkey % 3 AS zone FROM orders),
  u AS (SELECT *, (y - 10000000) / 0.9996::DOUBLE / (a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256)) AS mu FROM o, k),
  p AS (SELECT *, mu + (3 * q1 / 2 - 27 * q1 ** 3 / 32) * sin(2 * mu) + (21 * q1 ** 2 / 16 - 55 * q1 ** 4 / 32) * sin(4 * mu) + 151 * q1 ** 3 / 96 * sin(6 * mu) + 1097 * q1 ** 4 / 512 * sin(8 * mu) AS phi FROM u),
  w AS (SELECT *, tan(phi) ** 2 AS t, p2 * cos(phi) ** 2 AS c, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, a * (1 - e2) / (1 - e2 * sin(phi) ** 2) ** 1.5 AS r FROM p),
  d AS (SELECT *, (x - 500000) / (n * 0.9996::DOUBLE) AS d FROM w)
  SELECT o_orderkey, round(zone * 6 - 183 + degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * p2 + 24 * t ** 2) * d ** 5 / 120) / cos(phi)), 9) AS lon,
  round(degrees(phi - n * tan(phi) / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * p2) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * p2 - 3 * c ** 2) * d ** 6 / 720)), 9) AS lat FROM d"""


@query("patch_lonlat", LONLAT_SQL)
def _(spark, d):
    o = table(spark, d, "orders")
    x, y = 300000.0 + F.col("o_custkey") * 10, 7400000.0 + F.col("o_orderkey") % 1000 * 10
    epsg = F.lit(32700) + 22 + F.col("o_orderkey") % 3
    rows = o.select("o_orderkey", x.alias("x"), y.alias("y"), epsg.alias("epsg"))
    return rounded(G.with_lonlat(rows, "x", "y", "epsg").select("o_orderkey", "lon", "lat"), 9)
