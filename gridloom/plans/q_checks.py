"""Rule tables and decision roll-ups (sections M and N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import decisions as D, validation as V
from gridloom.operators.splits import apply_roles, assign_split, loro_patches
from gridloom.plans.fixtures import fx_patch, fx_pixel, fx_vec, table
from gridloom.plans.q_reports import binned, modality_manifest, rounded
from gridloom.plans.registry import query

META = """(SELECT *, label_positive_percent AS p, CASE WHEN patch_id % 50 = 0 THEN 11 ELSE 12 END AS s2_band_count, patch_id % 97 <> 0 AS s2_exists, 100 - CASE WHEN patch_id % 31 = 0 THEN 0.5 ELSE 0 END AS s2_valid_percent,
  CASE WHEN patch_id % 41 = 0 THEN 0.25 ELSE 0 END AS s1_zero_percent, CASE WHEN patch_id % 61 = 1 THEN 0 ELSE CASE WHEN label_positive_pixels > 0 THEN 1 ELSE 0 END END AS patch_label_binary, patch_id % 71 = 0 AS label_non_binary,
  CASE WHEN patch_id % 83 = 0 THEN 'high' WHEN label_positive_percent <= 0 THEN 'empty' WHEN label_positive_percent < 1 THEN 'low' WHEN label_positive_percent < 10 THEN 'medium' ELSE 'high' END AS label_density_bin,
  (patch_id % 100) * 112 AS row_start, 11000 + patch_id % 400 AS city_height FROM fx_patch)"""
RULES = {
    "s2_band_count_contract": "s2_band_count <> 12", "s2_exists_all_true": "NOT s2_exists", "s2_valid_percent_all_100": "s2_valid_percent < 100 - 1e-6",
    "s1_zero_percent_all_0": "s1_zero_percent > 1e-6", "labels_binary": "label_non_binary",
    "patch_label_binary_consistency": "patch_label_binary <> CASE WHEN label_positive_pixels > 0 THEN 1 ELSE 0 END",
    "label_density_bin_consistency": "label_density_bin <> CASE WHEN p <= 0 THEN 'empty' WHEN p < 1 THEN 'low' WHEN p < 10 THEN 'medium' ELSE 'high' END",
    "patch_windows_inside_city_bounds": "row_start + 224 > city_height",
}


def metadata(spark, d):
    """Patch metadata with a known share of broken rows."""
    k, pos = F.col("patch_id"), F.col("label_positive_pixels") > 0
    return binned(spark, d).withColumns({
        "s2_band_count": F.when(k % 50 == 0, 11).otherwise(12), "s2_exists": k % 97 != 0, "s2_valid_percent": 100.0 - F.when(k % 31 == 0, 0.5).otherwise(0.0),
        "s1_zero_percent": F.when(k % 41 == 0, 0.25).otherwise(0.0), "patch_label_binary": F.when(k % 61 == 1, 0).otherwise(pos.cast("int")),
        "label_non_binary": k % 71 == 0, "label_density_bin": F.when(k % 83 == 0, "high").otherwise(F.col("label_density_bin")),
        "row_start": (k % 100) * 112, "col_start": F.lit(0), "height": F.lit(224), "width": F.lit(224), "patch_size": F.lit(224), "stride": F.lit(112),
        "city_height": 11000 + k % 400, "city_width": F.lit(224),
    })


def all_rules():
    return (
        V.contract_rules({"s2_band_count": 12}) | V.availability_rules(["s2_exists"]) | V.percent_rules(["s2_valid_percent"], ["s1_zero_percent"])
        | V.label_rules() | V.window_rules(224, 112)
    )


@query(
    "metadata_checks",
    " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(count(*) AS VARCHAR) AS observed, '0' AS expected FROM {META} WHERE {c}" for n, c in RULES.items()
    ),
)
def _(spark, d):
    return V.run_checks(metadata(spark, d), all_rules(), "patch_id")[0]


@query(
    "metadata_errors",
    " UNION ALL ".join(f"SELECT '{n}' AS check_name, patch_id, city FROM {META} WHERE {c}" for n, c in RULES.items()),
)
def _(spark, d):
    return V.run_checks(metadata(spark, d), all_rules(), "patch_id", ["city"])[1]


@query(
    "global_counts",
    """WITH o AS (SELECT 'total_patches' AS n, count(*) AS o, 15000 AS e FROM fx_patch UNION ALL SELECT 'city_count', count(DISTINCT city), 26 FROM fx_patch UNION ALL
        SELECT 'positive_patches', count(*) FILTER (label_positive_pixels > 0), 6382 FROM fx_patch UNION ALL SELECT 'empty_patches', count(*) FILTER (label_positive_pixels = 0), 6317 FROM fx_patch)
      SELECT n AS check_name, CASE WHEN o = e THEN 'passed' ELSE 'failed' END AS status, CAST(o AS VARCHAR) AS observed, CAST(e AS VARCHAR) AS expected FROM o""",
)
def _(spark, d):
    want = {"total_patches": 15000, "city_count": 26, "positive_patches": 6382, "empty_patches": 6317}
    return V.check_counts(fx_patch(spark, d), want, F.col("label_positive_pixels") > 0)


@query(
    "unique_keys",
    """SELECT 'patch_ids' AS check_name, CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(count(*) AS VARCHAR) AS observed, '0' AS expected FROM (SELECT patch_id FROM fx_patch GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'lines', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END, CAST(count(*) AS VARCHAR), '0' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _(spark, d):
    a = V.check_unique(fx_patch(spark, d), ["patch_id"], "patch_ids")
    return a.unionByName(V.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lines"))


@query(
    "city_paths",
    """SELECT 'one_p1_per_city' AS check_name, 'passed' AS status, '0' AS observed, '0' AS expected UNION ALL
      SELECT 'one_p2_per_city', 'failed', CAST(count(*) AS VARCHAR), '0' FROM (SELECT city FROM fx_patch GROUP BY city HAVING count(DISTINCT CASE WHEN patch_id % 1000 = 7 THEN 'other' ELSE city END) > 1)""",
)
def _(spark, d):
    p = fx_patch(spark, d).withColumns({"p1": F.col("city"), "p2": F.when(F.col("patch_id") % 1000 == 7, "other").otherwise(F.col("city"))})
    return V.check_city_paths(p, ["p1", "p2"])


LEAK = """WITH x AS (SELECT l_orderkey AS patch_id, l_linestatus AS fold_id, CASE l_returnflag WHEN 'R' THEN 'test' WHEN 'A' THEN 'val' ELSE 'train' END AS split FROM lineitem),
  k AS (SELECT fold_id, patch_id, bool_or(split = 'train') AS t, bool_or(split = 'val') AS v, bool_or(split = 'test') AS e FROM x GROUP BY ALL)"""


@query(
    "split_leakage",
    LEAK
    + """ SELECT fold_id, 'train' AS role_a, 'val' AS role_b, CAST(count(*) FILTER (t AND v) AS BIGINT) AS overlap FROM k GROUP BY fold_id UNION ALL
      SELECT fold_id, 'train', 'test', CAST(count(*) FILTER (t AND e) AS BIGINT) FROM k GROUP BY fold_id UNION ALL SELECT fold_id, 'val', 'test', CAST(count(*) FILTER (v AND e) AS BIGINT) FROM k GROUP BY fold_id""",
)
def _(spark, d):
    from gridloom.operators.sets import role_overlap

    li = table(spark, d, "lineitem")
    f = F.col("l_returnflag")
    x = li.select(F.col("l_orderkey").alias("patch_id"), F.col("l_linestatus").alias("fold_id"), F.when(f == "R", "test").when(f == "A", "val").otherwise("train").alias("split"))
    return role_overlap(x, by=["fold_id"])


CHECK_NAMES = (
    [f"patch_leakage_{a}_{b}" for a, b in (("train", "val"), ("train", "test"), ("val", "test"))] + [f"city_leakage_{a}_{b}" for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    + [f"missing_role_{r}" for r in ("train", "val", "test")] + ["test_outside_heldout", "heldout_outside_test"] + [f"too_few_positives_{r}" for r in ("train", "val", "test")]
)


#: Four folds: one in order, one with patches and cities in two roles, one without validation and with thin roles, one whose held-out region is elsewhere as well.
SPLITS = """x AS (SELECT 'clean' AS fold_id, patch_id, city, region, split, label_positive_pixels, NULL AS heldout_region FROM fx_patch
  UNION ALL SELECT 'leaky', patch_id, city, region, split, label_positive_pixels, '' FROM fx_patch UNION ALL SELECT 'leaky', patch_id, city, region, 'train', label_positive_pixels, '' FROM fx_patch WHERE patch_id % 89 = 1
  UNION ALL SELECT 'thin', patch_id, city, region, CASE split WHEN 'val' THEN 'train' ELSE split END, CASE WHEN split = 'test' AND patch_id % 1000 <> 1 THEN 0 ELSE label_positive_pixels END, NULL FROM fx_patch
  UNION ALL SELECT 'held', patch_id, city, region, CASE WHEN region = 'ASIA' THEN 'test' ELSE split END, label_positive_pixels, 'ASIA' FROM fx_patch)"""


def split_table(spark, d):
    p = fx_patch(spark, d)
    k, split, pos = F.col("patch_id"), F.col("split"), F.col("label_positive_pixels")

    def fold(rows, name, role=split, positive=pos, held=None):
        return rows.select(F.lit(name).alias("fold_id"), "patch_id", "city", "region", role.alias("split"), positive.alias("label_positive_pixels"), F.lit(held).cast("string").alias("heldout_region"))

    thin = fold(p, "thin", F.when(split == "val", "train").otherwise(split), F.when((split == "test") & (k % 1000 != 1), 0).otherwise(pos))
    leaky = fold(p, "leaky", held="").unionByName(fold(p.where(k % 89 == 1), "leaky", F.lit("train"), held=""))
    return fold(p, "clean").unionByName(leaky).unionByName(thin).unionByName(fold(p, "held", F.when(F.col("region") == "ASIA", "test").otherwise(split), held="ASIA"))


ROLE_PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


@query(
    "split_checks",
    f"""WITH {SPLITS}, g AS (SELECT fold_id, max(heldout_region) AS held, list(DISTINCT region) FILTER (split = 'test') AS gt, list(DISTINCT region) FILTER (split <> 'test') AS gr FROM x GROUP BY 1), """
    + ", ".join(f"{n} AS (SELECT fold_id, {key}, list(DISTINCT split) AS s FROM x GROUP BY ALL)" for n, key in (("kp", "patch_id"), ("kc", "city")))
    + ", f AS ("
    + " UNION ALL ".join(
        f"SELECT fold_id, '{name}_leakage_{a}_{b}' AS check_name, count(*) FILTER (list_contains(s, '{a}') AND list_contains(s, '{b}')) AS observed FROM {t} GROUP BY 1" for t, name in (("kp", "patch"), ("kc", "city")) for a, b in ROLE_PAIRS
    )
    + "".join(
        f" UNION ALL SELECT fold_id, 'missing_role_{r}', CASE WHEN count(*) FILTER (split = '{r}') = 0 THEN 1 ELSE 0 END FROM x GROUP BY 1 UNION ALL SELECT fold_id, 'too_few_positives_{r}', CASE WHEN count(*) FILTER (split = '{r}' AND label_positive_pixels > 0) < 5 THEN 1 ELSE 0 END FROM x GROUP BY 1"
        for r in ("train", "val", "test")
    )
    + """ UNION ALL SELECT fold_id, 'test_outside_heldout', CASE WHEN held <> '' THEN len(list_filter(gt, lambda r: r <> held)) ELSE 0 END FROM g
      UNION ALL SELECT fold_id, 'heldout_outside_test', CASE WHEN list_contains(gr, held) THEN 1 ELSE 0 END FROM g)
      SELECT fold_id, check_name, CAST(coalesce(observed, 0) AS BIGINT) AS observed, CASE WHEN coalesce(observed, 0) = 0 THEN 'passed' ELSE 'failed' END AS status FROM f""",
)
def _(spark, d):
    return V.check_splits(split_table(spark, d))


@query("loro_split_checks", f"""SELECT concat('fold_test_', replace(lower(r.region), ' ', '_')) AS fold_id, c AS check_name, CAST(0 AS BIGINT) AS observed, 'passed' AS status
      FROM (SELECT DISTINCT region FROM fx_patch) r, (SELECT unnest({CHECK_NAMES}) AS c)""")
def _(spark, d):
    """The folds the library makes break no rule."""
    p = fx_patch(spark, d)
    return V.check_splits(apply_roles(p, loro_patches(p)))


CITY_FOLDS = """y AS (SELECT 'a' AS split_strategy, 'full' AS fold_id, city, split FROM (SELECT DISTINCT city, split FROM fx_patch) UNION ALL SELECT 'a', 'no_val', city, CASE split WHEN 'val' THEN 'train' ELSE split END FROM (SELECT DISTINCT city, split FROM fx_patch)
  UNION ALL SELECT 'b', 'twice', city, split FROM (SELECT DISTINCT city, split FROM fx_patch) UNION ALL SELECT 'b', 'twice', city, 'train' FROM (SELECT DISTINCT city, split FROM fx_patch) WHERE split = 'test')"""


@query(
    "city_split_checks",
    f"""WITH {CITY_FOLDS} SELECT split_strategy, fold_id, count(*) AS rows, count(DISTINCT city) AS distinct_cities, count(DISTINCT split) AS roles,
      CASE WHEN count(*) <> 25 OR count(DISTINCT city) <> count(*) THEN 'failed' WHEN count(DISTINCT split) = 3 THEN 'passed' ELSE 'missing_roles' END AS status FROM y GROUP BY 1, 2""",
)
def _(spark, d):
    c = fx_patch(spark, d).select("city", "split").distinct()
    fold = lambda s, f, rows: rows.select(F.lit(s).alias("split_strategy"), F.lit(f).alias("fold_id"), "city", "split")
    no_val = c.withColumn("split", F.when(F.col("split") == "val", "train").otherwise(F.col("split")))
    again = c.where("split = 'test'").withColumn("split", F.lit("train"))
    y = fold("a", "full", c).unionByName(fold("a", "no_val", no_val)).unionByName(fold("b", "twice", c.unionByName(again)))
    return V.check_city_split(y, 25)


@query("assigned_city_split", "SELECT 'custom' AS split_strategy, 'main' AS fold_id, count(DISTINCT city) AS rows, count(DISTINCT city) AS distinct_cities, 2 AS roles, 'missing_roles' AS status FROM fx_patch")
def _(spark, d):
    return V.check_city_split(assign_split(fx_patch(spark, d).select("city", "region").distinct(), ["NATION_0"]), 25)


@query(
    "feature_index",
    """WITH x AS (SELECT 'index_starts_at_zero' AS n, min(vec_id) AS o, 0 AS e FROM embeddings UNION ALL SELECT 'index_ends_at_last', max(vec_id), count(*) - 1 FROM embeddings UNION ALL
        SELECT 'index_without_repeats', 0, 0 UNION ALL SELECT 'keys_unique', 0, 0 UNION ALL SELECT 'keys_equal', (SELECT count(*) FROM fx_patch WHERE patch_id NOT IN (SELECT vec_id FROM embeddings)) + (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT patch_id FROM fx_patch)), 0)
      SELECT n AS check_name, CASE WHEN o = e THEN 'passed' ELSE 'failed' END AS status, CAST(o AS VARCHAR) AS observed, CAST(e AS VARCHAR) AS expected FROM x""",
)
def _(spark, d):
    v = fx_vec(spark, d).select(F.col("patch_id").alias("dense_index"), "patch_id")
    return V.check_index(v, fx_patch(spark, d), "dense_index", "patch_id")


@query(
    "city_table_checks",
    """SELECT 'city_count' AS check_name, 'failed' AS status, CAST(count(DISTINCT city) AS VARCHAR) AS observed, '26' AS expected FROM fx_patch UNION ALL SELECT 'unknown_regions', 'passed', '0', '0' UNION ALL
      SELECT 'duplicate_cities', 'passed', '0', '0' UNION ALL SELECT 'missing_regions', 'failed', CAST(6 - count(DISTINCT region) AS VARCHAR), '0' FROM fx_patch""",
)
def _(spark, d):
    return V.check_cities(fx_patch(spark, d).select("city", "region").distinct(), 26, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "OCEANIA"])


@query(
    "manifest_checks",
    "SELECT m AS modality, (SELECT count(*) FROM fx_patch) AS rows, CAST(0 AS BIGINT) AS bad_optical, CAST(0 AS BIGINT) AS bad_sar, CASE WHEN (SELECT count(*) FROM fx_patch) = 15000 THEN 'passed' ELSE 'failed' END AS status FROM (VALUES ('s2'), ('s1_rtc_vv_vh'), ('s2_s1_rtc_vv_vh')) v(m)",
)
def _(spark, d):
    m = modality_manifest(fx_patch(spark, d).select("patch_id"))
    return V.check_manifest(m, ["s2", "s1_rtc_vv_vh", "s2_s1_rtc_vv_vh"], 15000)


@query(
    "ready_stack",
    """WITH g AS (SELECT raster_id AS city, count(*) AS total_pixels, CAST(count(*) FILTER (raster_id % 3 = 0 AND event_type = 'error') AS BIGINT) AS s2_nodata, CAST(count(*) FILTER (raster_id % 3 = 1 AND NOT is_valid) AS BIGINT) AS s1_nodata,
        bool_and(label IN (0, 1)) AS label_binary, CAST(count(*) FILTER (event_type = 'click' AND raster_id % 5 = 2) AS BIGINT) AS unresolved FROM fx_pixel GROUP BY 1)
      SELECT city, total_pixels, s2_nodata, s1_nodata, unresolved, CASE WHEN city % 7 = 6 THEN 'fail_label_alignment' WHEN s2_nodata <> 0 THEN 'fail_s2_has_nodata' WHEN s1_nodata <> 0 THEN 'fail_s1_has_nodata' WHEN NOT label_binary THEN 'fail_label_not_binary'
        WHEN unresolved > 0 THEN 'fail_s1_unresolved_fill_source' ELSE 'pass_final_ready_stack' END AS status FROM g""",
)
def _(spark, d):
    px = fx_pixel(spark, d).withColumnRenamed("raster_id", "city")
    k, e = F.col("city"), F.col("event_type")
    meta = px.select("city").distinct().select(
        "city", F.lit(12).alias("s2_band_count"), F.lit(3).alias("s1_band_count"), F.lit(1).alias("label_band_count"), F.lit(True).alias("s1_aligned"), (k % 7 != 6).alias("label_aligned")
    )
    fill = F.when((e == "click") & (k % 5 == 2), 9).otherwise(0)
    out = V.check_ready_stack(px, meta, (k % 3 == 0) & (e == "error"), (k % 3 == 1) & ~F.col("is_valid"), F.col("label"), fill)
    return out.select("city", "total_pixels", "s2_nodata", "s1_nodata", "unresolved", "status")


FILLED = """WITH RECURSIVE z AS (SELECT raster_id, r, c, label, raster_id % 3 = 0 AND event_type = 'error' AS s2, raster_id % 2 = 1 AND NOT is_valid AS s1,
    CASE WHEN event_type = 'click' THEN CASE WHEN raster_id % 4 = 2 THEN 7 ELSE 3 END ELSE 0 END AS fill FROM fx_pixel),
  h AS (SELECT 's2' AS p, raster_id, r, c FROM z WHERE s2 UNION ALL SELECT 's1', raster_id, r, c FROM z WHERE s1),
  b(p, raster_id, r, c) AS (SELECT * FROM h WHERE r < 1 OR c < 1 OR r >= 49 OR c >= 49 UNION SELECT h.p, h.raster_id, h.r, h.c FROM b, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc) JOIN h ON h.p = b.p AND h.raster_id = b.raster_id AND h.r = b.r + o.dr AND h.c = b.c + o.dc),
  n AS (SELECT raster_id, count(*) FILTER (p = 's2') AS s2_border_pixels, count(*) FILTER (p = 's1') AS s1_border_pixels FROM b GROUP BY 1),
  g AS (SELECT raster_id, count(*) AS total_pixels, count(*) FILTER (s2) AS s2_missing_pixels, count(*) FILTER (s1) AS s1_missing_pixels, bool_and(label IN (0, 1)) AS label_binary, array_to_string(list_sort(list(DISTINCT fill)), ',') AS v,
      count(*) FILTER (fill = 3) AS f FROM z GROUP BY 1),
  q AS (SELECT g.*, coalesce(s2_border_pixels, 0) AS s2_border_pixels, coalesce(s1_border_pixels, 0) AS s1_border_pixels,
      CASE WHEN raster_id % 5 = 3 THEN 'missing_required' WHEN raster_id % 5 = 1 THEN 'bad_alignment' WHEN v LIKE '%7%' THEN 'unexpected_values' ELSE 'ok' END AS fill_level_status FROM g LEFT JOIN n USING (raster_id))"""


@query(
    "filled_stack",
    FILLED
    + """ SELECT raster_id, total_pixels, s2_missing_pixels, s2_border_pixels, s2_missing_pixels - s2_border_pixels AS s2_internal_pixels, s1_missing_pixels, s1_border_pixels, s1_missing_pixels - s1_border_pixels AS s1_internal_pixels, label_binary,
      CASE WHEN raster_id % 5 = 3 THEN NULL ELSE v END AS fill_level_values, CASE WHEN raster_id % 5 = 3 THEN NULL ELSE f END AS fill_level_filled_pixels, round(CASE WHEN raster_id % 5 <> 3 THEN 100.0 * f / total_pixels END, 6) AS fill_level_filled_percent, fill_level_status,
      CASE WHEN raster_id % 7 = 6 THEN 'fail_alignment' WHEN s2_missing_pixels > 0 THEN 'fail_s2_filled_has_nodata' WHEN fill_level_status <> 'ok' THEN 'fail_fill_qa' WHEN s1_missing_pixels > 0 THEN 'pass_s2_clean_residual_s1_nodata' ELSE 'pass_s2_clean_all_aligned' END AS status FROM q""",
)
def _(spark, d):
    px = fx_pixel(spark, d)
    k, e = F.col("raster_id"), F.col("event_type")
    meta = px.select("raster_id").distinct().select(
        "raster_id", F.lit(12).alias("s2_band_count"), F.lit(3).alias("s1_band_count"), F.lit(1).alias("label_band_count"), F.lit(True).alias("s1_aligned"), (k % 7 != 6).alias("label_aligned"),
        F.when(k % 5 == 3, None).otherwise(k % 5 != 1).alias("fill_aligned"),
    )
    fill = F.when(e == "click", F.when(k % 4 == 2, 7).otherwise(3)).otherwise(0)
    size = F.lit(50)
    out = V.check_filled_stack(px, meta, (k % 3 == 0) & (e == "error"), (k % 2 == 1) & ~F.col("is_valid"), F.col("label"), fill, size, size, margin=1, tile=16)
    names = [f"{p}_{n}_pixels" for p in ("s2", "s1") for n in ("missing", "border", "internal")]
    return rounded(out.select("raster_id", "total_pixels", *names, "label_binary", "fill_level_values", "fill_level_filled_pixels", "fill_level_filled_percent", "fill_level_status", "status"))


RUNS = """(SELECT * REPLACE (CASE WHEN fold % 9 = 0 THEN NULL ELSE f1 END AS f1) FROM (SELECT l_suppkey AS fold, CASE WHEN l_partkey % 2 = 0 THEN 'leave_one_region' ELSE 'leave_one_city' END AS fold_mode, l_linestatus AS probe,
  CASE l_linenumber WHEN 1 THEN 's1_snap_vv_vh' WHEN 2 THEN 's1_rtc_vv_vh' WHEN 3 THEN 's2_s1_snap_vv_vh' WHEN 4 THEN 's2_s1_rtc_vv_vh' ELSE 's2' END AS modality, max(l_discount) AS ap, min(l_tax) AS f1 FROM lineitem GROUP BY ALL))"""
COMPARISONS = {"sar_only_rtc_vs_snap": ("s1_snap_vv_vh", "s1_rtc_vv_vh"), "joint_rtc_vs_snap": ("s2_s1_snap_vv_vh", "s2_s1_rtc_vv_vh")}
CMP = f"""WITH r AS {RUNS}, p AS ({" UNION ALL ".join(f"SELECT '{n}' AS comparison, a.fold_mode, a.probe, '{m}' AS metric, a.{m} AS x, b.{m} AS y FROM r a JOIN r b ON a.fold = b.fold AND a.fold_mode = b.fold_mode AND a.probe = b.probe AND a.modality = '{rtc}' AND b.modality = '{snap}' WHERE a.{m} IS NOT NULL AND b.{m} IS NOT NULL" for n, (snap, rtc) in COMPARISONS.items() for m in ("ap", "f1"))}),
  c AS (SELECT comparison, fold_mode, probe, metric, count(*) AS n_matched_folds, avg(x) AS rtc_mean, avg(y) AS snap_mean, avg(x) - avg(y) AS delta, CAST(count(*) FILTER (x - y > 1e-12) AS BIGINT) AS rtc_wins, CAST(count(*) FILTER (x - y < -1e-12) AS BIGINT) AS snap_wins,
    CAST(count(*) FILTER (abs(x - y) <= 1e-12) AS BIGINT) AS ties FROM p GROUP BY ALL),
  d AS (SELECT comparison, count(*) AS n_summaries, CAST(count(*) FILTER (delta > 1.5e-4) AS BIGINT) AS rtc_higher, CAST(count(*) FILTER (delta < -1.5e-4) AS BIGINT) AS snap_higher, CAST(sum(rtc_wins) AS BIGINT) AS rtc_wins, CAST(sum(snap_wins) AS BIGINT) AS snap_wins, avg(delta) AS mean_delta FROM c WHERE metric = 'ap' GROUP BY comparison),
  dd AS (SELECT *, CASE WHEN comparison = 'joint_rtc_vs_snap' THEN CASE WHEN snap_higher > rtc_higher AND snap_wins > rtc_wins THEN 'Prefer SNAP-GRD' WHEN rtc_higher > snap_higher AND rtc_wins > snap_wins THEN 'Prefer RTC' ELSE 'Mixed / inconclusive' END
    ELSE CASE WHEN snap_higher > rtc_higher AND snap_wins > rtc_wins THEN 'SNAP-GRD stronger overall' WHEN rtc_higher > snap_higher AND rtc_wins > snap_wins THEN 'RTC stronger overall' ELSE 'Very close / mixed' END END AS decision FROM d)"""


def runs(spark, d):
    line, k = F.col("l_linenumber"), F.col("l_suppkey")
    m = F.when(line == 1, "s1_snap_vv_vh").when(line == 2, "s1_rtc_vv_vh").when(line == 3, "s2_s1_snap_vv_vh").when(line == 4, "s2_s1_rtc_vv_vh").otherwise("s2")
    g = table(spark, d, "lineitem").groupBy(
        k.alias("fold"), F.when(F.col("l_partkey") % 2 == 0, "leave_one_region").otherwise("leave_one_city").alias("fold_mode"), F.col("l_linestatus").alias("probe"), m.alias("modality")
    ).agg(F.max("l_discount").alias("ap"), F.min("l_tax").alias("f1"))
    return g.withColumn("f1", F.when(F.col("fold") % 9 == 0, float("nan")).otherwise(F.col("f1")))


def comparison(spark, d):
    return D.compare_variants(runs(spark, d), COMPARISONS, ["ap", "f1"], min_delta=1.5e-4)


@query(
    "compare_variants",
    CMP
    + """ SELECT comparison, fold_mode, probe, metric, n_matched_folds, round(rtc_mean, 5) AS rtc_mean, round(snap_mean, 5) AS snap_mean, rtc_wins, snap_wins, ties,
      CASE WHEN delta > 1.5e-4 AND rtc_wins > snap_wins THEN 'RTC stronger' WHEN delta < -1.5e-4 AND snap_wins > rtc_wins THEN 'SNAP-GRD stronger' WHEN abs(delta) <= 1.5e-4 THEN CASE WHEN rtc_wins > snap_wins THEN 'Mixed / near tie, RTC more fold wins'
        WHEN snap_wins > rtc_wins THEN 'Mixed / near tie, SNAP-GRD more fold wins' ELSE 'Near tie' END WHEN delta > 0 THEN 'RTC higher mean, mixed folds' ELSE 'SNAP-GRD higher mean, mixed folds' END AS direction FROM c""",
)
def _(spark, d):
    return rounded(comparison(spark, d).drop("delta"), 5)


@query("decide", CMP + " SELECT comparison, n_summaries, rtc_higher, snap_higher, n_summaries - rtc_higher - snap_higher AS near_ties, rtc_wins, snap_wins, decision FROM dd")
def _(spark, d):
    return D.decide(comparison(spark, d).where("metric = 'ap'"), 1.5e-4).drop("mean_delta", "ties")


CONS = "(SELECT 'overall' AS group_type, 'all_patches' AS group_value, avg(l_tax) AS snap_mean, avg(l_discount) AS rtc_mean FROM lineitem UNION ALL SELECT 'region', l_returnflag, avg(l_tax), avg(l_discount) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'city', l_linestatus, avg(l_tax), avg(l_discount) FROM lineitem GROUP BY l_linestatus)"
SEP = "(SELECT CASE l_linestatus WHEN 'O' THEN 'sar_only_rtc_vs_snap' ELSE 'joint_rtc_vs_snap' END AS comparison, max(l_tax) AS snap_knn, max(l_discount) AS rtc_knn, min(l_tax) AS snap_sil, min(l_discount) AS rtc_sil FROM lineitem GROUP BY 1)"
W = "CASE WHEN {d} > 1.5e-4 THEN 'RTC' WHEN {d} < -1.5e-4 THEN 'SNAP-GRD' ELSE 'Mixed' END"
PRETTY_SQL = "CASE comparison WHEN 'sar_only_rtc_vs_snap' THEN 'SAR-only RTC vs SNAP-GRD' ELSE 'Joint S2+S1 RTC vs SNAP-GRD' END"
EV = (
    CMP
    + f""", ev AS (SELECT 1 AS criterion_rank, {PRETTY_SQL} AS comparison, 'overall_decision' AS evidence_type, CASE WHEN decision LIKE '%SNAP%' THEN 'SNAP-GRD' WHEN decision LIKE '%RTC%' THEN 'RTC' ELSE 'Mixed' END AS winner FROM dd
  UNION ALL SELECT 1, {PRETTY_SQL}, concat('average_precision_', fold_mode, '_', probe), {W.format(d="delta")} FROM c WHERE metric = 'ap'
  UNION ALL SELECT 2, 'Optical-radar consistency', concat(group_type, '_', group_value), {W.format(d="(rtc_mean - snap_mean)")} FROM {CONS} WHERE group_type <> 'city'
  UNION ALL SELECT 3, {PRETTY_SQL}, 'kNN_average_precision_mean', {W.format(d="(rtc_knn - snap_knn)")} FROM {SEP} UNION ALL SELECT 3, {PRETTY_SQL}, 'label_silhouette', {W.format(d="(rtc_sil - snap_sil)")} FROM {SEP})"""
)


def evidence_rows(spark, d):
    li = table(spark, d, "lineitem")
    a = [F.avg("l_tax").alias("snap_mean"), F.avg("l_discount").alias("rtc_mean")]
    part = lambda t, v, g: g.agg(*a).select(F.lit(t).alias("group_type"), v.alias("group_value"), "snap_mean", "rtc_mean")
    cons = part("overall", F.lit("all_patches"), li.groupBy()).unionByName(part("region", F.col("l_returnflag"), li.groupBy("l_returnflag")))
    cons = cons.unionByName(part("city", F.col("l_linestatus"), li.groupBy("l_linestatus"))).withColumn("delta_mean", F.col("rtc_mean") - F.col("snap_mean"))
    name = F.when(F.col("l_linestatus") == "O", "sar_only_rtc_vs_snap").otherwise("joint_rtc_vs_snap")
    sep = li.groupBy(name.alias("comparison")).agg(F.max("l_tax").alias("snap_knn"), F.max("l_discount").alias("rtc_knn"), F.min("l_tax").alias("snap_sil"), F.min("l_discount").alias("rtc_sil"))
    sep = sep.withColumns({"delta_knn": F.col("rtc_knn") - F.col("snap_knn"), "delta_sil": F.col("rtc_sil") - F.col("snap_sil")})
    cmp_ = comparison(spark, d).where("metric = 'ap'")
    return D.evidence(D.decide(cmp_, 1.5e-4), cmp_, cons, sep, 1.5e-4)


@query(
    "separability_decisions",
    """WITH g AS (SELECT l_suppkey, avg(l_tax) AS a, avg(l_discount) AS b, min(l_quantity) AS x, min(l_linenumber) AS y FROM lineitem GROUP BY l_suppkey),
      m AS (SELECT l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE b - a END AS k, y - x AS s FROM g)
      SELECT l_suppkey, CASE WHEN k > 0.0050005 THEN 'RTC stronger separability' WHEN k < -0.0050005 THEN 'SNAP-GRD stronger separability' WHEN s > 0.0050005 THEN 'Near tie by kNN, RTC higher label silhouette'
      WHEN s < -0.0050005 THEN 'Near tie by kNN, SNAP-GRD higher label silhouette' ELSE 'Near tie / mixed' END AS decision FROM m""",
)
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"), F.min("l_quantity").alias("x"), F.min("l_linenumber").alias("y"))
    knn = F.when(F.col("l_suppkey") % 4 == 0, 0.0).otherwise(F.col("b") - F.col("a"))
    return g.select("l_suppkey", D.separability_decision(knn, F.col("y") - F.col("x"), 0.0050005).alias("decision"))


@query("evidence", EV + " SELECT criterion_rank, comparison, evidence_type, winner FROM ev")
def _(spark, d):
    return evidence_rows(spark, d).select("criterion_rank", "comparison", "evidence_type", "winner")


REC = EV + """, g AS (SELECT comparison, coalesce(max(winner) FILTER (criterion_rank = 1 AND evidence_type = 'overall_decision'), 'Mixed') AS c1, coalesce(max(winner) FILTER (evidence_type = 'kNN_average_precision_mean'), 'Mixed') AS c3,
    count(*) FILTER (winner = 'SNAP-GRD') AS s, count(*) FILTER (winner = 'RTC') AS r, count(*) FILTER (winner = 'Mixed') AS m FROM ev WHERE criterion_rank <> 2 GROUP BY comparison),
  rc AS (SELECT *, CASE WHEN c1 <> 'Mixed' THEN concat('Prefer ', c1) WHEN c3 <> 'Mixed' THEN concat('Lean ', c3) WHEN s > r THEN 'Lean SNAP-GRD' WHEN r > s THEN 'Lean RTC' ELSE 'Inconclusive' END AS recommendation FROM g)"""  # fmt: skip


@query(
    "recommend",
    REC
    + """ SELECT comparison, c1 AS criterion1_winner, c3 AS criterion3_winner, CAST(s AS BIGINT) AS snap_votes, CAST(r AS BIGINT) AS rtc_votes, CAST(m AS BIGINT) AS mixed_votes, recommendation,
      CASE WHEN recommendation LIKE 'Prefer%' AND c1 = c3 THEN 'high' WHEN recommendation LIKE 'Prefer%' THEN 'medium' WHEN recommendation LIKE 'Lean%' THEN 'low-to-medium' ELSE 'low' END AS confidence FROM rc""",
)
def _(spark, d):
    return D.recommend(evidence_rows(spark, d))


@query(
    "recommend_overall",
    REC
    + """, j AS (SELECT max(recommendation) FILTER (comparison LIKE 'Joint%') AS joint, max(recommendation) FILTER (comparison LIKE 'SAR%') AS sar, (SELECT count(*) FROM ev WHERE winner = 'SNAP-GRD') AS s, (SELECT count(*) FROM ev WHERE winner = 'RTC') AS r,
        (SELECT max(winner) FROM ev WHERE evidence_type = 'overall_all_patches') AS c2 FROM rc),
      f AS (SELECT *, CASE WHEN joint LIKE 'Prefer%' THEN substr(joint, 8) WHEN sar LIKE 'Prefer%' THEN substr(sar, 8) WHEN s > r THEN 'SNAP-GRD' WHEN r > s THEN 'RTC' ELSE 'Inconclusive' END AS fin FROM j)
      SELECT fin AS final_recommendation, CASE WHEN fin = 'SNAP-GRD' AND joint = 'Prefer SNAP-GRD' AND sar LIKE '%SNAP-GRD%' AND c2 = 'SNAP-GRD' THEN 'high' WHEN fin = 'SNAP-GRD' THEN 'medium-to-high' WHEN fin = 'RTC' THEN 'medium' ELSE 'low' END AS confidence FROM f""",
)
def _(spark, d):
    ev = evidence_rows(spark, d)
    return D.recommend_overall(D.recommend(ev), ev)
