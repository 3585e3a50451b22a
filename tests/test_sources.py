"""Sources and sinks on files."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.sources import inventory as I, tables as Tb, tiles as Tl


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5, [1, 2]), ("b", None, None, [])], "patch_id string, row_start int, label_positive_percent double, bands array<int>")
    path = str(tmp_path / "t")
    Tb.write_table(df, path, format="csv")
    with pytest.raises(Exception, match="already exists"):
        Tb.write_table(df, path, format="csv")
    Tb.write_table(df, path, overwrite=True, format="csv")
    schema = T.StructType([T.StructField("patch_id", T.StringType()), T.StructField("row_start", T.IntegerType()), T.StructField("label_positive_percent", T.DoubleType()), T.StructField("absent", T.LongType())])
    rows = sorted(Tb.read_table(spark, path, schema, Tb.PATCH_ALIASES).collect())
    assert [tuple(r) for r in rows] == [("a", 1, 2.5, None), ("b", None, None, None)]


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Patch ID` int, `s1_snap_grd_valid_percent` int, other int")
    assert Tb.resolve(df, Tb.PATCH_ALIASES).columns == ["patch_id", "s1_snap_valid_percent", "other"]
    with pytest.raises(ValueError):
        Tb.resolve(df, Tb.PATCH_ALIASES, ["city"])


def test_candidates_and_splits(spark, tmp_path):
    for i, rows in enumerate(["c,i1,50,3\nc,i2,,1\n", "c,i1,70,9\n"]):
        (tmp_path / f"candidates{i}.csv").write_text("city,item_id,overlap_percent_of_missing_aoi,rank\n" + rows)
    got = {r["item_id"]: r for r in Tb.read_candidates(spark, str(tmp_path / "candidates*.csv")).collect()}
    assert got["i1"]["overlap_percent"] == 70 and got["i1"]["candidate_path"].endswith("candidates1.csv") and got["i2"]["overlap_percent"] is None
    (tmp_path / "tr.csv").write_text("patch_id,iou\na,0.5\n")
    (tmp_path / "te.csv").write_text("patch_id,iou,extra\nb,0.1,x\n")
    df = Tb.read_splits(spark, {"train": str(tmp_path / "tr.csv"), "test": str(tmp_path / "te.csv")})
    assert {(r["patch_id"], r["split"], r["extra"]) for r in df.collect()} == {("a", "train", None), ("b", "test", "x")}


def test_partitions_json_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("a", "f2")], "patch_id string, filter_set_id string")
    Tb.write_partitioned(df, str(tmp_path / "p"), "filter_set_id")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.where("filter_set_id = 'f2'").count() == 2
    Tb.write_json(df.groupBy("filter_set_id").count(), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    left = Tb.only_missing(spark.createDataFrame([("a",), ("z",)], "patch_id string"), back, ["patch_id"])
    assert [r[0] for r in left.collect()] == ["z"]


def test_tiles_round_trip(spark, tmp_path):
    px = spark.range(7 * 5).select(F.lit("x").alias("raster_id"), F.floor(F.col("id") / 5).alias("r"), (F.col("id") % 5).alias("c"), F.col("id").cast("float").alias("a"), (F.col("id") % 2 == 0).alias("ok"))
    tiles = Tl.pixels_to_tiles(px.withColumn("b", -F.col("a")), ["a", "b"], F.col("ok"), 4)
    Tb.write_table(tiles, str(tmp_path / "t"))
    back = Tl.tiles_to_pixels(Tl.read_tiles(spark, str(tmp_path / "t"), [2]), ["b"])
    assert {(r["r"], r["c"], r["b"], r["is_valid"]) for r in back.collect()} == {(i // 5, i % 5, -float(i), i % 2 == 0) for i in range(35)}


def test_embeddings_partition(spark, tmp_path):
    df = spark.createDataFrame([("s2", "a", [1.0]), ("rtc", "a", [2.0])], "modality string, patch_id string, embedding array<float>")
    Tb.write_table(df, str(tmp_path / "e"), partition_by=["modality"])
    assert Tb.read_embeddings(spark, str(tmp_path / "e"), "rtc").first()["embedding"] == [2.0]


def test_items_and_listing(spark, tmp_path):
    doc = {"id": "x1", "properties": {"datetime": "", "start_datetime": "2022-01-01", "sar:instrument_mode": "iw"}, "assets": {"vh": {"href": "h"}}}
    (tmp_path / "i.json").write_text(json.dumps(doc, indent=1))
    row = I.manifest_from_items(I.read_items(spark, str(tmp_path / "*.json"))).first()
    assert (row["item_id"], row["acquired_at"], row["instrument_mode"], row["vv_href"], row["vh_href"]) == ("x1", "2022-01-01", "IW", None, "h")
    files = I.list_files(spark, str(tmp_path))
    assert files.columns == ["path", "length", "modificationTime"] and files.count() == 1
