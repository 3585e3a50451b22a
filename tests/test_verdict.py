"""Cases that the fixtures of the queries do not hold: many values, hot groups, cancelling squares, missing paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import embeddings, metrics, ranking, repair, splits, tiling, validation
from gridloom.sources import tables


def test_modality_among_very_many_names(spark):
    df = spark.range(12_000).select(F.concat(F.lit("name "), "id").alias("modality")).unionByName(spark.createDataFrame([("S1-RTC",), ("s1 rtc v2",)], "modality string"))
    assert [r[0] for r in tables.filter_modality(df, "s1_rtc").collect()] == ["S1-RTC"]
    assert [r[0] for r in tables.filter_modality(df, "rtc_v2").collect()] == ["s1 rtc v2"]
    with pytest.raises(ValueError):
        tables.filter_modality(df, "optical")


def test_fill_takes_finite_sources_only(spark):
    values = [float("nan"), 1.0, None, float("inf"), 5.0]
    px = spark.createDataFrame([(1, 0, c, v, False) for c, v in enumerate(values)] + [(1, 1, c, None, True) for c in range(5)], "raster_id int, r int, c int, v double, hole boolean")
    out, _ = repair.propagate_fill(px, F.col("hole"), ["v"])
    got = [r.v for r in out.where("r = 1").orderBy("c").collect()]
    assert got == [1.0, 1.0, 1.0, 5.0, 5.0]


def test_patch_std_of_large_values(spark):
    rng = np.random.default_rng(0)
    v = 1e8 + rng.normal(0, 0.25, (8, 8))
    px = spark.createDataFrame([(1, r, c, float(v[r, c])) for r in range(8) for c in range(8)], "raster_id int, r int, c int, v double")
    meta = spark.createDataFrame([(1, 8, 8, "a")], "raster_id int, height int, width int, city string")
    patches = tiling.tile_patches(meta, 4, 2, "cover")
    out = tiling.patch_stats(px, meta, patches, 4, 2, {}, {"v": (F.col("v"), F.lit(True))}).join(patches, "patch_id").collect()
    assert len(out) == 9
    for r in out:
        own = v[r.row_start : r.row_start + 4, r.col_start : r.col_start + 4]
        assert abs(r.v_std - own.std()) < 1e-6 and abs(r.v_mean - own.mean()) < 1e-6


def test_city_with_some_missing_paths(spark):
    rows = [("a", "p"), ("a", None), ("b", "p"), ("c", None)]
    got = validation.check_city_paths(spark.createDataFrame(rows, "city string, path string"), ["path"]).first()
    assert (got.status, got.observed) == ("failed", "1")


def test_all_errors_by_default(spark):
    df = spark.range(500)
    checks, errors = validation.run_checks(df, {"even": F.col("id") % 2 == 1}, "id")
    assert errors.count() == 250 and checks.first().observed == "250"
    assert validation.run_checks(df, {"even": F.col("id") % 2 == 1}, "id", limit=7)[1].count() == 7


def test_silhouette_scores_every_row(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(6000, 4)) + 1e4, rng.integers(0, 3, 6000)
    x[c == 1, 0] += 3
    df = spark.createDataFrame([(i, v.tolist(), str(k)) for i, (v, k) in enumerate(zip(x, c))], "patch_id long, embedding array<double>, region string")
    got = np.array([r.silhouette for r in embeddings.silhouette(df, "region").orderBy("id").collect()])
    assert len(got) == 6000
    for i in range(0, 6000, 997):
        d = ((x - x[i]) ** 2).sum(1)
        a = d[c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[c == k].mean() for k in range(3) if k != c[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-6


def test_sample_buckets_follow_the_group(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 100)
    df = spark.range(5500).select("id", F.when(F.col("id") < 5000, "hot").otherwise("small").alias("g"))
    out = ranking.sample_rank(df, ["g"], ["id"]).toPandas()
    for g, n in (("hot", 5000), ("small", 500)):
        assert sorted(out[out.g == g].sample_rank) == list(range(1, n + 1))
    h = ranking.hash_order(F.col("id"))
    per = df.where("g = 'hot'").groupBy(ranking.hash_bucket(h, F.lit(5000)).alias("b")).count().toPandas()
    assert per["count"].max() < 200


def test_scores_of_a_rare_class(spark):
    rng = np.random.default_rng(2)
    s = rng.random(3000) ** 4 * 1e-3
    y = (rng.random(3000) < 0.1).astype(int)
    df = spark.createDataFrame([("x", float(a), int(b)) for a, b in zip(s, y)], "g string, s double, y int")
    got = metrics.ranking_metrics(df, ["g"], "s", "y").first()
    order = np.argsort(-s)
    hits = np.cumsum(y[order])
    assert abs(got.average_precision - (hits / np.arange(1, 3001))[y[order] == 1].mean()) < 1e-9
    per = df.groupBy(metrics.value_bucket(F.col("s") * metrics.SCORE_UNIT).alias("b")).count().toPandas()
    assert per["count"].max() < 300


def test_greedy_roles_cover_every_fold(spark):
    rows = [(r, f"{r}{i}", p) for r, n in (("a", 3), ("b", 2), ("c", 1)) for i in range(n) for p in [0, 1] * (50 + i)]
    out = splits.loro_greedy(spark.createDataFrame(rows, "region string, city string, label_positive_pixels int"), 0.3, 10, 1).toPandas()
    assert len(out) == 18 and (out[out.heldout_region == out.region].split == "test").all()
    rest = out[out.heldout_region != out.region]
    assert (rest.groupby(["heldout_region", "region"]).split.apply(lambda s: (s == "train").any())).all() and (rest.split == "val").any()


def test_required_columns(spark):
    got = validation.check_columns(spark.range(1), ["id", "city"]).collect()
    assert [(r.check_name, r.status) for r in got] == [("id", "passed"), ("city", "failed")]


def test_no_positive_column(spark):
    with pytest.raises(ValueError):
        tables.with_positive(spark.range(1))
