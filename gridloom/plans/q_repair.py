"""Nodata components, regions, crops, fills and merges (sections H and I6, I7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.masks import nodata_class
from gridloom.operators import components as C, repair as Rp
from gridloom.plans.fixtures import fx_pixel
from gridloom.plans.q_reports import rounded
from gridloom.plans.q_tiles import raster_meta
from gridloom.plans.registry import query

OFF = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)"
TILE = 16
HOLES = "h AS (SELECT raster_id, r, c FROM fx_pixel WHERE NOT is_valid)"
BORDER = f"""WITH RECURSIVE {HOLES}, b(raster_id, r, c) AS (SELECT * FROM h WHERE r < 1 OR c < 1 OR r >= 49 OR c >= 49 UNION
  SELECT h.raster_id, h.r, h.c FROM b, {OFF} JOIN h ON h.raster_id = b.raster_id AND h.r = b.r + o.dr AND h.c = b.c + o.dc)"""
COMP = f"""WITH RECURSIVE {HOLES}, reach(raster_id, r0, c0, r, c) AS (SELECT raster_id, r, c, r, c FROM h UNION
  SELECT h.raster_id, b.r0, b.c0, h.r, h.c FROM reach b, {OFF} JOIN h ON h.raster_id = b.raster_id AND h.r = b.r + o.dr AND h.c = b.c + o.dc),
  comp AS (SELECT raster_id, r0 AS r, c0 AS c, min(r * 2147483648 + c) AS component FROM reach GROUP BY ALL)"""


def side():
    """Height and width of the fixture rasters."""
    return F.lit(50), F.lit(50)


def holes(spark, d):
    return fx_pixel(spark, d).where("NOT is_valid")


@query("border_components", BORDER + " SELECT h.raster_id, h.r, h.c, b.raster_id IS NOT NULL AS border_connected FROM h LEFT JOIN b ON h.raster_id = b.raster_id AND h.r = b.r AND h.c = b.c")
def _(spark, d):
    return C.border_components(holes(spark, d), *side(), 1, TILE).select("raster_id", "r", "c", "border_connected")


@query(
    "nodata_class",
    BORDER + " SELECT p.raster_id, p.r, p.c, CASE WHEN p.is_valid THEN 0 WHEN b.raster_id IS NOT NULL THEN 1 ELSE 2 END AS nodata_class FROM fx_pixel p LEFT JOIN b ON p.raster_id = b.raster_id AND p.r = b.r AND p.c = b.c",
)
def _(spark, d):
    b = C.border_components(holes(spark, d), *side(), 1, TILE).select("raster_id", "r", "c", "border_connected")
    j = fx_pixel(spark, d).join(b, ["raster_id", "r", "c"], "left")
    return j.select("raster_id", "r", "c", nodata_class(F.col("is_valid"), F.coalesce("border_connected", F.lit(False))).alias("nodata_class"))


@query("components", COMP + " SELECT raster_id, r, c, CAST(component AS BIGINT) AS component FROM comp")
def _(spark, d):
    return C.components(holes(spark, d), TILE)


@query(
    "mask_regions",
    COMP
    + " SELECT raster_id, CAST(component AS BIGINT) AS component, count(*) AS pixels, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c, round(count(*) * 0.01, 6) AS area_ha FROM comp GROUP BY ALL HAVING count(*) >= 3",
)
def _(spark, d):
    return rounded(C.mask_regions(holes(spark, d), 3, tile=TILE))


@query(
    "row_runs",
    "SELECT raster_id, r, min(c) AS c_first, max(c) AS c_last FROM (SELECT raster_id, r, c, c - row_number() OVER (PARTITION BY raster_id, r ORDER BY c) AS g FROM fx_pixel WHERE NOT is_valid) GROUP BY raster_id, r, g",
)
def _(spark, d):
    return C.row_runs(holes(spark, d).select("raster_id", "r", "c"))


@query(
    "region_outline",
    f"WITH {HOLES} SELECT raster_id, r, c FROM h WHERE (SELECT count(*) FROM h n WHERE n.raster_id = h.raster_id AND abs(n.r - h.r) + abs(n.c - h.c) = 1) < 4",
)
def _(spark, d):
    return C.outline(holes(spark, d))


@query(
    "dilate",
    "SELECT DISTINCT p.raster_id, p.r, p.c FROM fx_pixel p JOIN fx_pixel m ON m.raster_id = p.raster_id AND m.vv > 150 AND (m.r - p.r) * (m.r - p.r) + (m.c - p.c) * (m.c - p.c) <= 9",
)
def _(spark, d):
    px = fx_pixel(spark, d)
    wide = C.dilate(px.where("vv > 150").select("raster_id", "r", "c"), 3, *side())
    return wide.join(px, ["raster_id", "r", "c"], "left_semi")


RECT = """WITH hts AS (SELECT raster_id, r, c, r - coalesce(max(CASE WHEN NOT ok THEN r END) OVER (PARTITION BY raster_id, c ORDER BY r), -1) AS run FROM (SELECT *, {ok} AS ok FROM fx_pixel)),
  w AS (SELECT a.raster_id, a.r, a.c AS l, b.c AS rt, (SELECT min(run) FROM hts m WHERE m.raster_id = a.raster_id AND m.r = a.r AND m.c BETWEEN a.c AND b.c) AS hh FROM hts a JOIN hts b ON a.raster_id = b.raster_id AND a.r = b.r AND b.c >= a.c),
  best AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY hh * (rt - l + 1) DESC, r, rt, hh DESC) AS rn FROM w)"""


@query(
    "largest_rectangle",
    RECT.format(ok="event_type <> 'error'") + " SELECT raster_id, r - hh + 1 AS row_start, r + 1 AS row_stop, l AS col_start, rt + 1 AS col_stop, hh * (rt - l + 1) AS area FROM best WHERE rn = 1",
)
def _(spark, d):
    return Rp.largest_rectangle(fx_pixel(spark, d), F.col("event_type") != "error")


@query(
    "trim_window",
    """WITH RECURSIVE bad AS (SELECT raster_id, r, c FROM fx_pixel WHERE c < 3 OR r >= 47 OR (event_type = 'error' AND c > 45)),
      win(raster_id, t, b, l, rt, done) AS (
        SELECT raster_id, 0::BIGINT, max(r) + 1, 0::BIGINT, max(c) + 1, FALSE FROM fx_pixel GROUP BY 1
        UNION ALL
        SELECT raster_id, CASE WHEN e THEN 0 ELSE nt END, CASE WHEN e THEN 0 ELSE nb END, CASE WHEN e THEN 0 ELSE nl END, CASE WHEN e THEN 0 ELSE nr END, done FROM (
          SELECT *, nt >= nb OR nl >= nr AS e FROM (
            SELECT raster_id, n = 0 AS done, CASE WHEN n = 0 OR m = 0 AND p > 1 OR m > 0 AND (top < m) THEN t WHEN m > 0 THEN t + 1 ELSE r1 + 1 END AS nt,
              CASE WHEN n = 0 OR m = 0 AND p <> 2 OR m > 0 AND (top = m OR bot < m) THEN b WHEN m > 0 THEN b - 1 ELSE r0 END AS nb,
              CASE WHEN n = 0 OR m = 0 AND p <> 3 OR m > 0 AND (top = m OR bot = m OR lef < m) THEN l WHEN m > 0 THEN l + 1 ELSE c1 + 1 END AS nl,
              CASE WHEN n = 0 OR m = 0 AND p <> 4 OR m > 0 AND (top = m OR bot = m OR lef = m) THEN rt WHEN m > 0 THEN rt - 1 ELSE c0 END AS nr
            FROM (SELECT *, greatest(top, bot, lef, rig) AS m, list_position(a, list_max(a)) AS p FROM (
              SELECT w.raster_id, t, b, l, rt, count(x.r) AS n, count(*) FILTER (x.r = t) AS top, count(*) FILTER (x.r = b - 1) AS bot, count(*) FILTER (x.c = l) AS lef, count(*) FILTER (x.c = rt - 1) AS rig,
                min(x.r) AS r0, max(x.r) AS r1, min(x.c) AS c0, max(x.c) AS c1,
                [greatest(b - max(x.r) - 1, 0) * (rt - l), greatest(min(x.r) - t, 0) * (rt - l), greatest(rt - max(x.c) - 1, 0) * (b - t), greatest(min(x.c) - l, 0) * (b - t)] AS a
              FROM win w LEFT JOIN bad x ON x.raster_id = w.raster_id AND x.r >= t AND x.r < b AND x.c >= l AND x.c < rt WHERE NOT w.done GROUP BY w.raster_id, t, b, l, rt)))))
      SELECT raster_id, t AS row_start, b AS row_stop, l AS col_start, rt AS col_stop, (b - t) * (rt - l) AS area FROM win WHERE done""",
)
def _(spark, d):
    px = fx_pixel(spark, d)
    return Rp.trim_window(px.where("c < 3 OR r >= 47 OR (event_type = 'error' AND c > 45)"), raster_meta(px))


@query(
    "crop",
    "SELECT raster_id, r - 5 AS r, c - 3 AS c, vv, label FROM fx_pixel WHERE r >= 5 AND r < 50 - raster_id % 4 AND c >= 3 AND c < 47",
)
def _(spark, d):
    px = fx_pixel(spark, d)
    w = px.select("raster_id").distinct().select("raster_id", F.lit(5).alias("row_start"), (50 - F.col("raster_id") % 4).alias("row_stop"), F.lit(3).alias("col_start"), F.lit(47).alias("col_stop"))
    return Rp.crop(px, w).select("raster_id", "r", "c", "vv", "label")


@query(
    "crop_impact",
    """WITH g AS (SELECT raster_id, count(*) AS pixels_before, CAST(count(*) FILTER (c >= raster_id % 3) AS BIGINT) AS crop_pixels, CAST(count(*) FILTER (label = 1) AS BIGINT) AS positive_before, CAST(count(*) FILTER (label = 1 AND c >= raster_id % 3) AS BIGINT) AS positive_inside FROM fx_pixel GROUP BY 1)
      SELECT *, positive_before - positive_inside AS positive_removed, round(100.0 * (positive_before - positive_inside) / positive_before, 6) AS positive_removed_percent, CASE WHEN positive_before = positive_inside THEN 'safe_no_positive_label_loss' WHEN 100.0 * (positive_before - positive_inside) / positive_before <= 3 THEN 'review_tiny_label_loss' ELSE 'unsafe_label_loss_review_crop' END AS status FROM g""",
)
def _(spark, d):
    px = fx_pixel(spark, d)
    w = px.select("raster_id").distinct().select("raster_id", F.lit(0).alias("row_start"), F.lit(50).alias("row_stop"), (F.col("raster_id") % 3).alias("col_start"), F.lit(50).alias("col_stop"))
    return rounded(Rp.crop_impact(px, w, F.col("label") == 1, tiny=3.0))


NEAR = """near AS (SELECT h.raster_id, h.r, h.c, v.r AS src_r, v.c AS src_c, v.vv, v.vh, row_number() OVER (PARTITION BY h.raster_id, h.r, h.c ORDER BY (v.r - h.r) * (v.r - h.r) + (v.c - h.c) * (v.c - h.c), v.r, v.c) AS rn
  FROM fx_pixel h JOIN fx_pixel v ON h.raster_id = v.raster_id AND NOT h.is_valid AND v.is_valid)"""


@query(
    "nearest_fill",
    f"WITH {NEAR} SELECT p.raster_id, p.r, p.c, coalesce(n.vv, p.vv) AS vv, coalesce(n.vh, p.vh) AS vh, CASE WHEN n.vv IS NULL THEN 0 ELSE 3 END AS fill_level, n.vv IS NOT NULL AS is_filled FROM fx_pixel p LEFT JOIN near n ON rn = 1 AND p.raster_id = n.raster_id AND p.r = n.r AND p.c = n.c",
)
def _(spark, d):
    out = Rp.nearest_fill(fx_pixel(spark, d), F.col("is_valid"), ["vv", "vh"], tile=TILE)
    return out.select("raster_id", "r", "c", "vv", "vh", "fill_level", "is_filled")


OFFSETS8 = "(VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1), (4, -1, -1), (5, -1, 1), (6, 1, -1), (7, 1, 1)) o(i, dr, dc)"
GROWN = """grown(raster_id, r, c, k, vv, vh) USING KEY (raster_id, r, c) AS (
    SELECT raster_id, r, c, 0, vv, vh FROM src WHERE NOT hole AND vv IS NOT NULL AND vh IS NOT NULL
    UNION
    SELECT h.raster_id, h.r, h.c, g.k + 1, arg_min(g.vv, o.i), arg_min(g.vh, o.i) FROM grown g, {off} JOIN src h ON h.hole AND h.raster_id = g.raster_id AND h.r + o.dr = g.r AND h.c + o.dc = g.c
      WHERE NOT EXISTS (SELECT 1 FROM recurring.grown x WHERE x.raster_id = h.raster_id AND x.r = h.r AND x.c = h.c) GROUP BY h.raster_id, h.r, h.c, g.k)""".format(off=OFFSETS8)


@query(
    "propagate_fill",
    "WITH RECURSIVE src AS (SELECT *, NOT is_valid AS hole FROM fx_pixel), "
    + GROWN
    + """, bad AS (SELECT DISTINCT raster_id FROM src s WHERE hole AND NOT EXISTS (SELECT 1 FROM grown g WHERE g.raster_id = s.raster_id AND g.r = s.r AND g.c = s.c))
      SELECT s.raster_id, s.r, s.c, CASE WHEN g.k > 0 THEN g.vv ELSE s.vv END AS vv, CASE WHEN g.k > 0 THEN g.vh ELSE s.vh END AS vh, coalesce(g.k > 0, FALSE) AS is_filled
      FROM src s LEFT JOIN grown g ON g.raster_id = s.raster_id AND g.r = s.r AND g.c = s.c AND s.raster_id NOT IN (SELECT raster_id FROM bad)""",
)
def _(spark, d):
    out, _ = Rp.propagate_fill(fx_pixel(spark, d).select("raster_id", "r", "c", "vv", "vh", "is_valid"), ~F.col("is_valid"), ["vv", "vh"], tile=TILE)
    return out.select("raster_id", "r", "c", "vv", "vh", "is_filled")


@query(
    "propagate_report",
    # raster 1 of every four has deep holes, raster 2 too many, raster 3 none; every eighth raster has no finite cell
    """WITH RECURSIVE src AS (SELECT raster_id, r, c, CASE WHEN raster_id % 8 = 4 AND is_valid THEN NULL ELSE vv END AS vv, vh,
        CASE raster_id % 4 WHEN 1 THEN c >= 10 AND c < 30 AND r < 40 WHEN 2 THEN c >= 10 WHEN 3 THEN FALSE ELSE NOT is_valid END AS hole FROM fx_pixel), """
    + GROWN
    + """, g AS (SELECT s.raster_id, count(*) AS total_pixels, count(*) FILTER (s.hole) AS holes, count(*) FILTER (s.hole AND g.k > 0) AS reached, coalesce(max(g.k), 0) AS deepest
          FROM src s LEFT JOIN grown g ON g.raster_id = s.raster_id AND g.r = s.r AND g.c = s.c GROUP BY 1),
      st AS (SELECT *, 100.0 * holes / total_pixels > 60 AS many FROM g)
      SELECT raster_id, total_pixels, holes, CASE WHEN NOT many AND reached = holes AND deepest <= 8 THEN holes ELSE 0 END AS filled, CASE WHEN many THEN 0 ELSE deepest END AS rings,
        CASE WHEN holes = 0 THEN 'clean' WHEN many THEN 'too_many_holes' WHEN reached < holes THEN 'stalled' WHEN deepest > 8 THEN 'iteration_cap' ELSE 'filled' END AS status FROM st""",
)
def _(spark, d):
    px, k, c = fx_pixel(spark, d), F.col("raster_id") % 4, F.col("c")
    hole = F.when(k == 1, (c >= 10) & (c < 30) & (F.col("r") < 40)).when(k == 2, c >= 10).when(k == 3, False).otherwise(~F.col("is_valid"))
    px = px.withColumn("vv", F.when((F.col("raster_id") % 8 == 4) & F.col("is_valid"), None).otherwise(F.col("vv")))
    _, report = Rp.propagate_fill(px.select("raster_id", "r", "c", "vv", "vh", hole.alias("hole")), F.col("hole"), ["vv", "vh"], max_iter=8, max_share=60.0, tile=TILE)
    return report


FB = "(SELECT raster_id, r, c, vv + 1000 AS vv, vh + 500 AS vh, event_type <> 'click' AND NOT (event_type = 'error' AND event_id % 40 < raster_id % 3 * 2) AS is_valid FROM fx_pixel)"


def fallback(spark, d):
    e, k = F.col("event_type"), F.col("event_id") % 40 < F.col("raster_id") % 3 * 2
    return fx_pixel(spark, d).select("raster_id", "r", "c", (F.col("vv") + 1000).alias("vv"), (F.col("vh") + 500).alias("vh"), ((e != "click") & ~((e == "error") & k)).alias("is_valid"))


MERGE = f"""SELECT o.raster_id, o.r, o.c, CASE WHEN o.is_valid THEN o.vv WHEN f.is_valid THEN f.vv ELSE 0 END AS vv, CASE WHEN o.is_valid THEN o.vh WHEN f.is_valid THEN f.vh ELSE 0 END AS vh, CASE WHEN o.is_valid THEN 0 WHEN f.is_valid THEN 1 ELSE 9 END AS fill_source, o.is_valid
  FROM fx_pixel o JOIN {FB} f ON o.raster_id = f.raster_id AND o.r = f.r AND o.c = f.c"""


def merged(spark, d, tiny):
    return Rp.merge_fallback(fx_pixel(spark, d).select("raster_id", "r", "c", "vv", "vh", "is_valid"), fallback(spark, d), fill_tiny=tiny, tiny_percent=6.0, tile=TILE)


@query("merge_fallback", f"SELECT raster_id, r, c, vv, vh, fill_source, round(vv - vh, 6) AS vv_minus_vh, fill_source <> 9 AS valid_after FROM ({MERGE})")
def _(spark, d):
    return rounded(merged(spark, d, False).select("raster_id", "r", "c", "vv", "vh", "fill_source", "vv_minus_vh", "valid_after"))


@query(
    "merge_report",
    f"""WITH g AS (SELECT raster_id, count(*) AS total_pixels, CAST(count(*) FILTER (NOT is_valid) AS BIGINT) AS original_missing, CAST(count(*) FILTER (fill_source = 1) AS BIGINT) AS fallback_filled, CAST(count(*) FILTER (fill_source = 9) AS BIGINT) AS m FROM ({MERGE}) GROUP BY 1)
      SELECT raster_id, total_pixels, original_missing, fallback_filled, CASE WHEN 100.0 * m / total_pixels <= 6 THEN m ELSE 0 END AS nearest_filled, CASE WHEN 100.0 * m / total_pixels <= 6 THEN 0 ELSE m END AS final_missing,
      CASE WHEN m > 0 AND 100.0 * m / total_pixels > 6 THEN 's1_ready_warning_residual_nodata' WHEN fallback_filled > 0 THEN 's1_ready_fallback_merged_zero_nodata' WHEN m > 0 THEN 's1_ready_tiny_nearest_filled_zero_nodata' ELSE 's1_ready_clean_copied_zero_nodata' END AS status FROM g""",
)
def _(spark, d):
    return Rp.merge_report(merged(spark, d, True))


ZERO = "(SELECT *, CASE WHEN event_type = 'click' THEN 0 ELSE vv END AS a, CASE WHEN event_type = 'click' THEN 1e-7 ELSE vh END AS b FROM fx_pixel)"
USABLE = "event_id % 7 <> 0 AND vv > 5"


def zeroed(spark, d):
    z = F.col("event_type") == "click"
    return fx_pixel(spark, d).select("raster_id", "r", "c", "label", F.when(z, 0.0).otherwise(F.col("vv")).alias("vv"), F.when(z, 1e-7).otherwise(F.col("vh")).alias("vh"))


def candidate(spark, d):
    ok = (F.col("event_id") % 7 != 0) & (F.col("vv") > 5)
    return fx_pixel(spark, d).select("raster_id", "r", "c", F.when(ok, F.col("vv") + 1).otherwise(-9999.0).alias("vv"), F.when(ok, F.col("vh") + 1).otherwise(-9999.0).alias("vh"))


@query(
    "merge_zero_report",
    f"""WITH x AS (SELECT *, abs(a) <= 1e-6 AND abs(b) <= 1e-6 AS z, {USABLE} AS u FROM {ZERO}) SELECT raster_id, count(*) AS total_pixels, CAST(count(*) FILTER (z) AS BIGINT) AS zero_before_pixels, CAST(count(*) FILTER (z AND label = 1) AS BIGINT) AS label_zero_before,
      CAST(count(*) FILTER (z AND u) AS BIGINT) AS repaired, CAST(count(*) FILTER (z AND u AND label = 1) AS BIGINT) AS repaired_label, CAST(count(*) FILTER (z AND NOT u) AS BIGINT) AS zero_after_pixels, CAST(count(*) FILTER (z AND NOT u AND label = 1) AS BIGINT) AS label_zero_after FROM x GROUP BY 1""",
)
def _(spark, d):
    return Rp.merge_zero_report(Rp.merge_zero_pixels(zeroed(spark, d), candidate(spark, d), tile=TILE), F.col("label"))


@query("merge_zero_pixels", f"SELECT raster_id, r, c, CASE WHEN abs(a) <= 1e-6 AND {USABLE} THEN vv + 1 ELSE a END AS vv, abs(a) <= 1e-6 AND abs(b) <= 1e-6 AND {USABLE} AS merged FROM {ZERO}")
def _(spark, d):
    return Rp.merge_zero_pixels(zeroed(spark, d), candidate(spark, d), tile=TILE).select("raster_id", "r", "c", "vv", "merged")


@query(
    "fillability",
    f"""WITH x AS (SELECT *, abs(a) <= 1e-6 AND abs(b) <= 1e-6 AS z, {USABLE} AS first, event_id % 3 = 0 AND c < 40 AS second FROM {ZERO}),
      y AS (SELECT raster_id, label, z, 'first' AS candidate_id, first AS u FROM x UNION ALL SELECT raster_id, label, z, 'second', second FROM x WHERE c < 45)
      SELECT raster_id, candidate_id, CAST(count(*) FILTER (u) AS BIGINT) AS valid_pixels, CAST(count(*) FILTER (z) AS BIGINT) AS zero_pixels, CAST(count(*) FILTER (z AND label > 0) AS BIGINT) AS label_zero_pixels,
      CAST(count(*) FILTER (z AND u) AS BIGINT) AS fillable_zero, CAST(count(*) FILTER (z AND u AND label > 0) AS BIGINT) AS fillable_label_zero, round(100.0 * count(*) FILTER (z AND u) / count(*) FILTER (z), 6) AS fillable_zero_percent,
      coalesce(round(100.0 * count(*) FILTER (z AND u AND label > 0) / nullif(count(*) FILTER (z AND label > 0), 0), 6), 0) AS fillable_label_zero_percent, CAST(count(*) FILTER (z AND NOT u) AS BIGINT) AS remaining_zero, CAST(count(*) FILTER (z AND NOT u AND label > 0) AS BIGINT) AS remaining_label_zero FROM y GROUP BY 1, 2""",
)
def _(spark, d):
    e, px = F.col("event_id"), fx_pixel(spark, d)
    ok = (e % 3 == 0) & (F.col("c") < 40)  # the second product ends at column 45
    second = px.where("c < 45").select("raster_id", "r", "c", F.when(ok, 7.0).otherwise(-9999.0).alias("vv"), F.when(ok, 7.0).otherwise(-9999.0).alias("vh"))
    both = candidate(spark, d).withColumn("candidate_id", F.lit("first")).unionByName(second.withColumn("candidate_id", F.lit("second")))
    return rounded(Rp.fillability(zeroed(spark, d), both, F.col("label"), tile=TILE))


PLAN = (
    BORDER
    + """, g AS (SELECT p.raster_id, count(*) AS n, count(*) FILTER (NOT is_valid) AS m, count(*) FILTER (label = 1) AS l, count(*) FILTER (label = 1 AND NOT is_valid) AS lm, (SELECT count(*) FROM b WHERE b.raster_id = p.raster_id) AS bp FROM fx_pixel p GROUP BY 1),
  q AS (SELECT *, 100.0 * m / n AS mp, 100.0 * bp / m AS sh, 100.0 * (m - bp) / n AS ip, 100.0 * lm / l AS ov FROM g)"""
)


@query(
    "repair_plan",
    PLAN
    + """ SELECT raster_id, n AS total_pixels, m AS missing_pixels, bp AS border_pixels, m - bp AS internal_pixels, round(mp, 6) AS missing_percent, round(sh, 6) AS border_share_percent, round(ip, 6) AS internal_percent,
      CASE WHEN mp <= 0.01 THEN 'no_action' WHEN ip >= 0.1 THEN 'crop_border_plus_internal_fill' WHEN sh >= 95 THEN 'crop_border' ELSE 'crop_border_then_verify_tiny_internal' END AS recommended_action FROM q""",
)
def _(spark, d):
    p = Rp.repair_plan(fx_pixel(spark, d), ~F.col("is_valid"), *side(), 1, TILE)
    return rounded(p.select("raster_id", "total_pixels", "missing_pixels", "border_pixels", "internal_pixels", "missing_percent", "border_share_percent", "internal_percent", "recommended_action"))


@query(
    "s1_plan",
    PLAN
    + """ SELECT raster_id, round(mp, 6) AS missing_percent, round(ov, 6) AS label_overlap_percent, CASE WHEN mp = 0 THEN 'no_action' WHEN mp >= 5 OR ov >= 1 THEN 'major_s1_coverage_issue_do_not_fill' WHEN mp <= 0.5 AND ov <= 0.1 THEN 'fill_tiny_s1_nodata_candidate'
      WHEN mp <= 0.5 THEN 'review_tiny_s1_nodata_label_overlap' ELSE 'moderate_s1_nodata_review' END AS recommended_action FROM q""",
)
def _(spark, d):
    p = Rp.plan_s1(fx_pixel(spark, d), ~F.col("is_valid"), F.col("label"), *side(), 1, TILE)
    return rounded(p.select("raster_id", "missing_percent", "label_overlap_percent", "recommended_action"))


@query(
    "crop_plan",
    BORDER
    + ", "
    + RECT.format(ok="NOT EXISTS (SELECT 1 FROM b WHERE b.raster_id = fx_pixel.raster_id AND b.r = fx_pixel.r AND b.c = fx_pixel.c)").removeprefix("WITH ")
    + """, win AS (SELECT raster_id, r - hh + 1 AS row_start, r + 1 AS row_stop, l AS col_start, rt + 1 AS col_stop, hh * (rt - l + 1) AS area FROM best WHERE rn = 1),
      g AS (SELECT p.raster_id, count(*) AS total_pixels, count(*) FILTER (NOT p.is_valid AND inside) AS post_missing, count(*) FILTER (inside AND bb.r IS NOT NULL) AS post_border
        FROM (SELECT p.*, p.r >= w.row_start AND p.r < w.row_stop AND p.c >= w.col_start AND p.c < w.col_stop AS inside FROM fx_pixel p JOIN win w ON w.raster_id = p.raster_id) p
        LEFT JOIN b bb ON bb.raster_id = p.raster_id AND bb.r = p.r AND bb.c = p.c GROUP BY 1)
      SELECT raster_id, total_pixels, row_start, row_stop, col_start, col_stop, area, post_missing, post_border, round(100.0 * area / total_pixels, 6) AS retained_percent,
        CASE WHEN area <= 0 THEN 'failed_no_valid_window' WHEN post_border > 0 THEN 'warning_original_border_nodata_remaining' WHEN 100.0 * area / total_pixels < 50 THEN 'warning_large_crop_loss'
             WHEN post_missing > 0 THEN 'ok_border_removed_residual_internal_or_crop_edge_nodata' ELSE 'ok_no_s2_nodata_after_crop' END AS crop_status FROM g JOIN win USING (raster_id)""",
)
def _(spark, d):
    return rounded(Rp.crop_plan(fx_pixel(spark, d), ~F.col("is_valid"), *side(), 1, TILE))
