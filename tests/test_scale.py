"""Exactness of the skew-safe operators, and plan shape where it matters."""

import numpy as np
from pyspark.sql import Window, functions as F

from gridloom.operators import embeddings as E, ranking as R, sampling as Sm, splits as Sp, stats as St, tiling as Ti


def skewed(spark, n=20_000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None).cast("string")).otherwise((F.col("id") % 7).cast("string"))
    return spark.range(n).select("id", key.alias("g"), ((F.col("id") * 7919) % 1009 / 10.0 - 30).alias("v"))


def test_ranked_equals_window(spark):
    df = skewed(spark)
    got = R.sample_rank(df, ["g"], ["id"], "s")
    h = R.hash_order(F.col("id"), salt="s")
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(h, "id")))
    assert got.count() == df.count()
    assert got.join(want.select("id", "want"), "id").where("sample_rank <> want").count() == 0


def test_row_ids(spark):
    df = skewed(spark).select((F.col("id") * 3).alias("k"))
    rows = R.row_ids(df, "k", 500).orderBy("k").collect()
    assert [r["row_id"] for r in rows] == list(range(1, len(rows) + 1))


def test_quantiles_equal_numpy(spark):
    df = skewed(spark)
    qs = [0.0, 0.01, 0.37, 0.5, 0.98, 1.0]
    got = {r["g"]: r for r in St.quantiles(df, ["g"], "v", qs).collect()}
    local = df.toPandas()
    assert set(got) == set(local["g"].where(local["g"].notna(), None))
    for g, part in local.groupby(local["g"].fillna("_null")):
        row = got[None if g == "_null" else g]
        assert np.allclose([row[f"q{q:g}"] for q in qs], np.quantile(part["v"], qs), atol=1e-9)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 0), (5.0, 2), (9.0, 1)], "v double, w int")
    got = St.quantiles(df, [], "v", [0.5, 0.9], ["a", "b"], F.col("w")).first()
    assert np.allclose([got["a"], got["b"]], np.quantile([1, 1, 1, 5, 5, 9], [0.5, 0.9]))


def test_stratified_quota(spark):
    rows = [(n, k) for n in (2, 3, 10, 101, 1000) for k in range(0, n + 1, max(1, n // 7))]
    p, q = Sp.stratified_quota(F.col("n"), F.col("k"), 0.2, 5, 150)
    for r in spark.createDataFrame(rows, "n bigint, k bigint").select("n", "k", p.alias("p"), q.alias("q")).collect():
        want = max(1, min(max(round(0.2 * r["n"]), 5), 150, r["n"] - 1))
        assert r["p"] + r["q"] == want and r["p"] <= r["k"] and r["q"] <= r["n"] - r["k"]
        assert r["p"] >= 1 or r["k"] == 0


def patches(spark, n=3000):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("patch_id"), F.concat(F.lit("c"), (k % 9).cast("string")).alias("city"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("region"),
        F.when(k % 4 == 0, k % 900 + 1).otherwise(0).alias("label_positive_pixels"), F.when(k % 4 == 0, 3.0).otherwise(0.0).alias("label_positive_percent"),
        F.when(k % 9 < 6, "train").when(k % 9 < 8, "val").otherwise("test").alias("split"), F.lit(1.0).alias("max_nodata_percent"), F.lit(1.0).alias("s2_nodata_percent"),
        F.lit(1.0).alias("s1_nodata_percent"), F.lit(0.0).alias("label_nodata_percent"), (k % 10 != 0).alias("passes_basic_quality_filter"),
        F.lit("s").alias("split_strategy"), F.lit("main").alias("fold_id"),
    )


def test_filter_sets(spark):
    m = Sm.filter_sets(patches(spark))
    n = {(r["filter_set_id"], r["filter_inclusion_group"]): r["count"] for r in m.groupBy("filter_set_id", "filter_inclusion_group").count().collect()}
    for spec in Sm.FILTER_SPECS[3:]:
        pos, neg = n[spec.name, "train_positive"], n[spec.name, "train_negative_sampled"]
        have = patches(spark).where(f"split = 'train' AND passes_basic_quality_filter AND label_positive_percent <= {spec.threshold}").count()
        assert neg == min(have, round(spec.ratio * pos))
    assert m.groupBy("filter_set_id", "patch_id").count().where("count > 1").count() == 0


def test_curriculum_with_and_without_replacement(spark):
    train = patches(spark).withColumns({"pool_a": F.col("patch_id") < 40, "pool_b": F.col("patch_id") >= 100, "pool_c": F.lit(False)})
    rows = Sm.curriculum(train, {"a": 0.5, "b": 0.3, "c": 0.2}, 200).collect()
    by = {p: [r for r in rows if r["sample_pool"] == p] for p in "abc"}
    assert (len(by["a"]), len(by["b"]), len(by["c"])) == (100, 60, 0)
    assert all(r["sampled_with_replacement"] and r["patch_id"] < 40 for r in by["a"])
    assert len({r["patch_id"] for r in by["b"]}) == 60 and not any(r["sampled_with_replacement"] for r in by["b"])
    assert sorted(r["curriculum_row_id"] for r in rows) == [f"curriculum_{i:06d}" for i in range(160)]


def test_mixed_selection_tops_up(spark):
    p = patches(spark, 100)  # 25 positive, 75 empty
    for n, pos in ((20, 10), (60, 25), (200, 25)):
        rows = Sm.select_n(p, "mixed", n).collect()
        assert len(rows) == min(n, 100) and sum(r["label_positive_pixels"] > 0 for r in rows) == pos


def test_blocks_cover_every_cell_as_often_as_patches_do(spark):
    for size, stride, edge in ((16, 6, "cover"), (16, 8, "cover"), (10, 10, "drop"), (7, 5, "partial")):
        meta = spark.createDataFrame([("a", 50, 41), ("b", 23, 37)], "raster_id string, height int, width int").withColumn("city", F.col("raster_id"))
        px = meta.select("raster_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"), "width").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        index = Ti.tile_patches(meta, size, stride, edge)
        got = Ti.patch_stats(px, meta, index, size, stride, {"odd": (F.col("r") + F.col("c")) % 2 == 1})
        inside = (F.col("r") >= F.col("row_start")) & (F.col("r") < F.col("row_end")) & (F.col("c") >= F.col("col_start")) & (F.col("c") < F.col("col_end"))
        want = index.select("raster_id", "patch_id", "row_start", "row_end", "col_start", "col_end").join(px, "raster_id").where(inside)
        want = want.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("r") + F.col("c")) % 2 == 1).alias("k"))
        j = got.join(want, "patch_id", "full").where("total_pixels IS DISTINCT FROM n OR odd IS DISTINCT FROM k")
        assert j.count() == 0, (size, stride, edge)
        if edge == "cover":
            assert index.join(px, "raster_id").where(inside).select("raster_id", "r", "c").distinct().count() == px.count()


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.normal(5, 0.1, size=(300, 6)), np.zeros((5, 6))])  # a dense hot cell and ties
    train = spark.createDataFrame([(1, i, v.tolist(), i % 2) for i, v in enumerate(x)], "run int, id int, embedding array<double>, label int")
    q = np.concatenate([rng.normal(size=(20, 6)), x[200:205], np.zeros((1, 6))])
    queries = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(q)], "run int, query int, embedding array<double>")
    got = {}
    for r in E.nearest_neighbours(train, queries, k=7, pivots=8, chunk=64).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = np.lexsort((np.arange(len(d)), d.round(12)))[:7]
        assert np.allclose([got[i][k + 1][1] for k in range(7)], d[order], atol=1e-6)


def test_pca_variance_matches_numpy(spark):
    x = np.random.default_rng(5).normal(size=(200, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "patch_id int, embedding array<double>")
    got = [r["explained_variance_ratio"] for r in E.pca(emb, 3)[1].orderBy("component").collect()]
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(got, (w / w.sum())[:3])


def test_probe_and_extract(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) + 2 * (i % 2)).tolist(), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "patch_id int, embedding array<double>, label_binary int")
    scored = E.train_probe(df.where("patch_id < 150"), df.where("patch_id >= 150")).collect()
    assert np.mean([(r["score"] > 0.5) == r["label_binary"] for r in scored]) > 0.9
    tiles = spark.createDataFrame([(1, [[1.0, 3.0], [2.0, 2.0]])], "patch_id int, bands array<array<float>>")
    assert E.extract(tiles, E.band_statistics_model).first()["embedding"] == [2.0, 2.0, 1.0, 0.0, 1.0, 2.0, 3.0, 2.0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    for name in ("match_products", "filter_sets", "patch_metadata", "normalization_stats", "cell_overlap", "threshold_sweep", "modality_manifest", "product_inventory"):
        assert "CartesianProduct" not in plan(q[name](spark, "/root/testdata/sf0.001")), name
    text = plan(q["quality_summary"](spark, "/root/testdata/sf0.001"))
    assert "o_totalprice" in text and "o_orderpriority" not in text  # only the needed columns are read
    assert "WindowGroupLimit" in plan(q["patch_lists"](spark, "/root/testdata/sf0.001"))
