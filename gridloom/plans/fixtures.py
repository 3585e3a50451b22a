"""Views over the given tables that have the shapes the operators read (cities, patches, pixels, scores, products).

Each view exists twice: as a DataFrame for the queries and as SQL for their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators.ranking import spread

PATCH_AREA = 50176  # 224 x 224


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FIXTURE_SQL = {
    "fx_city": """SELECT n.n_nationkey AS city_id, n.n_name AS city, r.r_name AS region, r.r_regionkey AS region_order
      FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_patch": """SELECT o.o_orderkey AS patch_id, f.city, f.region, f.region_order,
      CASE WHEN o.o_orderkey % 2 = 0 THEN 0 ELSE CAST(floor(o.o_totalprice) AS BIGINT) % 50176 END AS label_positive_pixels,
      CAST(50176 AS BIGINT) AS label_total_pixels, CAST(o.o_custkey % 13 AS DOUBLE) AS s2_nodata_percent,
      CAST(o.o_orderkey % 17 AS DOUBLE) AS s1_nodata_percent, CAST(0 AS DOUBLE) AS label_nodata_percent,
      CASE WHEN f.city_id < 5 THEN 'test' WHEN f.city_id < 10 THEN 'val' ELSE 'train' END AS split,
      CAST(100 AS DOUBLE) * (CASE WHEN o.o_orderkey % 2 = 0 THEN 0 ELSE CAST(floor(o.o_totalprice) AS BIGINT) % 50176 END)
        / CAST(50176 AS DOUBLE) AS label_positive_percent
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN fx_city f ON c.c_nationkey = f.city_id""",
    "fx_pixel": """SELECT CAST(floor(event_id / 2500.0) AS BIGINT) AS raster_id,
      CAST(floor((event_id % 2500) / 50.0) AS BIGINT) AS r, event_id % 50 AS c, value AS vv, value * 0.25 AS vh,
      event_type <> 'error' AND event_id % 50 >= 3 AS is_valid, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
      event_type, event_id FROM events""",
    "fx_confusion": """SELECT l_orderkey AS patch_id,
      sum(CASE WHEN l_returnflag = 'R'  AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS tp,
      sum(CASE WHEN l_returnflag = 'R'  AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS fp,
      sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS fn,
      sum(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS tn
      FROM lineitem GROUP BY l_orderkey""",
    "fx_metrics": """SELECT p.patch_id, p.city, p.region, p.split, c.tp, c.fp, c.fn, c.tn,
      c.tp / (c.tp + c.fp + c.fn + 1e-8) AS iou_pos, 2 * c.tp / (2 * c.tp + c.fp + c.fn + 1e-8) AS dice_pos,
      c.tp / (c.tp + c.fp + 1e-8) AS precision_pos, c.tp / (c.tp + c.fn + 1e-8) AS recall_pos,
      c.tn / (c.tn + c.fp + c.fn + 1e-8) AS iou_neg,
      0.5 * (c.tp / (c.tp + c.fp + c.fn + 1e-8) + c.tn / (c.tn + c.fp + c.fn + 1e-8)) AS macro_iou,
      100.0 * (c.tp + c.fp) / (c.tp + c.fp + c.fn + c.tn) AS pred_pos_pct,
      100.0 * (c.tp + c.fn) / (c.tp + c.fp + c.fn + c.tn) AS gt_pos_pct,
      100.0 * c.fp / (c.tp + c.fp + c.fn + c.tn) AS fp_pct, 100.0 * c.fn / (c.tp + c.fp + c.fn + c.tn) AS fn_pct,
      100.0 * (c.fp - c.fn) / (c.tp + c.fp + c.fn + c.tn) AS pred_minus_gt_pct,
      100.0 * (c.fn - c.fp) / (c.tp + c.fp + c.fn + c.tn) AS gt_minus_pred_pct
      FROM fx_confusion c JOIN fx_patch p ON c.patch_id = p.patch_id""",
    "fx_score": """SELECT CAST(l_partkey % 1000 AS DOUBLE) / 1000.0 AS score,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus AS fold FROM lineitem""",
    "fx_candidate": """SELECT f.city, CAST(l.l_orderkey AS VARCHAR) AS item_id,
      max(l.l_quantity) * 2 AS overlap_percent, min(l.l_shipdate) AS acquired_at
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN fx_city f ON s.s_nationkey = f.city_id
      GROUP BY f.city, CAST(l.l_orderkey AS VARCHAR)""",
    "fx_quality": """SELECT p.*, greatest(s2_nodata_percent, s1_nodata_percent, label_nodata_percent) AS max_nodata_percent,
      greatest(s2_nodata_percent, s1_nodata_percent, label_nodata_percent) <= 10 AS passes_basic_quality_filter,
      label_positive_pixels > 0 AS is_positive_patch FROM fx_patch p""",
    "fx_vec": """SELECT vec_id AS patch_id, embedding, list_reverse(embedding) AS other, label, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
      concat('region_', label % 5) AS region FROM embeddings""",
}


def fx_city(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("city_id"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        F.col("r_regionkey").alias("region_order"),
    )


def fx_patch(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(fx_city(spark, d), F.col("c_nationkey") == F.col("city_id"))
    pixels = F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.floor("o_totalprice") % PATCH_AREA).cast("bigint")
    return joined.select(
        F.col("o_orderkey").alias("patch_id"),
        "city",
        "region",
        "region_order",
        pixels.alias("label_positive_pixels"),
        F.lit(PATCH_AREA).cast("bigint").alias("label_total_pixels"),
        (F.col("o_custkey") % 13).cast("double").alias("s2_nodata_percent"),
        (F.col("o_orderkey") % 17).cast("double").alias("s1_nodata_percent"),
        F.lit(0.0).alias("label_nodata_percent"),
        F.when(F.col("city_id") < 5, "test").when(F.col("city_id") < 10, "val").otherwise("train").alias("split"),
        (100.0 * pixels / float(PATCH_AREA)).alias("label_positive_percent"),
    )


def fx_pixel(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.floor(F.col("event_id") / 2500).cast("bigint").alias("raster_id"),
        F.floor((F.col("event_id") % 2500) / 50).cast("bigint").alias("r"),
        (F.col("event_id") % 50).alias("c"),
        F.col("value").alias("vv"),
        (F.col("value") * 0.25).alias("vh"),
        ((F.col("event_type") != "error") & (F.col("event_id") % 50 >= 3)).alias("is_valid"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        "event_type",
        "event_id",
    )


def fx_confusion(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    pred, right = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    q = lambda cond: F.sum(F.when(cond, F.col("l_quantity")).otherwise(0.0))
    return li.groupBy(F.col("l_orderkey").alias("patch_id")).agg(
        q(right & pred).alias("tp"), q(right & ~pred).alias("fp"), q(~right & pred).alias("fn"), q(~right & ~pred).alias("tn")
    )


def fx_metrics(spark, d) -> DataFrame:
    from gridloom.functions.metrics import segmentation_metrics

    m = segmentation_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    keep = [
        "iou_pos", "dice_pos", "precision_pos", "recall_pos", "iou_neg", "macro_iou", "pred_pos_pct", "gt_pos_pct",
        "fp_pct", "fn_pct", "pred_minus_gt_pct", "gt_minus_pred_pct",
    ]
    rows = fx_confusion(spark, d).join(fx_patch(spark, d).select("patch_id", "city", "region", "split"), "patch_id")
    return rows.select("patch_id", "city", "region", "split", "tp", "fp", "fn", "tn", *[m[k].alias(k) for k in keep])


def fx_score(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        ((F.col("l_partkey") % 1000).cast("double") / 1000.0).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.col("l_linestatus").alias("fold"),
    )


def fx_candidate(spark, d) -> DataFrame:
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(fx_city(spark, d), F.col("s_nationkey") == F.col("city_id"))
    rows = joined.select("city", F.col("l_orderkey").cast("string").alias("item_id"), "l_quantity", "l_shipdate")
    return spread(rows, ["city", "item_id"], li.count()).groupBy("city", "item_id").agg(
        (F.max("l_quantity") * 2).alias("overlap_percent"), F.min("l_shipdate").alias("acquired_at")
    )


def fx_quality(spark, d) -> DataFrame:
    worst = F.greatest("s2_nodata_percent", "s1_nodata_percent", "label_nodata_percent")
    return (
        fx_patch(spark, d)
        .withColumn("max_nodata_percent", worst)
        .withColumn("passes_basic_quality_filter", worst <= 10)
        .withColumn("is_positive_patch", F.col("label_positive_pixels") > 0)
    )


def fx_vec(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("patch_id"),
        "embedding",
        F.reverse("embedding").alias("other"),
        "label",
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
        F.concat(F.lit("region_"), (F.col("label") % 5).cast("string")).alias("region"),
    )
