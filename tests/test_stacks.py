"""Plans over tiles, stored tables, and repairs of many lines."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry, repair as Rp
from gridloom.session import shared_folder
from gridloom.sources import tables as Tb, tiles as Tl

BANDS = "raster_id string, r bigint, c bigint, vv double, vh double, is_valid boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed_by_cell(df):
    """Exchanges whose keys are single cells."""
    return [x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan(df)) if re.search(r"\br#", x) and re.search(r"\bc#", x)]


def pixels(spark, seed, name="a", size=20, drop=0.0):
    rng = np.random.default_rng(seed)
    rows = [(name, r, c, float(rng.normal()), float(rng.normal()), bool(rng.random() < 0.7)) for r in range(size) for c in range(size) if rng.random() >= drop]
    return spark.createDataFrame(rows, BANDS), {(r[1], r[2]): r[3:] for r in rows}


def test_merge_meets_tile_by_tile(spark):
    orig, a = pixels(spark, 1)
    fallback, b = pixels(spark, 2, drop=0.2)  # the fallback lacks cells
    out = Rp.merge_fallback(orig, fallback, fill_tiny=False, tile=8)
    assert not keyed_by_cell(out) and "tile_row" in plan(out)
    rows = out.collect()
    assert len(rows) == 400
    for r in rows:
        own, other = a[r["r"], r["c"]], b.get((r["r"], r["c"]))
        code = 0 if own[2] else 1 if other and other[2] else 9
        want = own if code == 0 else other if code == 1 else (0.0, 0.0)
        assert (r["fill_source"], r["vv"], r["vh"]) == (code, want[0], want[1])
    near = Rp.merge_fallback(orig, fallback, tiny_percent=100.0, tile=8)
    assert near.where("fill_source = 9").count() == 0
    assert not keyed_by_cell(Rp.nearest_fill(orig, F.col("is_valid"), ["vv", "vh"], tile=8))


def test_merge_takes_tile_tables(spark):
    orig, _ = pixels(spark, 3)
    fallback, _ = pixels(spark, 4)
    cells = [Tl.tile_cells(Tl.pixels_to_tiles(x, ["vv", "vh"], F.col("is_valid"), 8), ["vv", "vh"], 8) for x in (orig, fallback)]
    stored = Rp.merge_fallback(*cells, fill_tiny=False).select("r", "c", F.round("vv", 4).alias("vv"), "fill_source")
    direct = Rp.merge_fallback(orig, fallback, fill_tiny=False, tile=8).select("r", "c", F.round("vv", 4).alias("vv"), "fill_source")
    assert sorted(map(tuple, stored.select("r", "c", "fill_source").collect())) == sorted(map(tuple, direct.select("r", "c", "fill_source").collect()))
    got = {(r.r, r.c): r.vv for r in stored.collect()}
    assert all(abs(got[r.r, r.c] - r.vv) < 2e-4 for r in direct.collect())


def test_two_candidates_by_tile(spark):
    cur, a = pixels(spark, 5)
    cur = cur.withColumns({"vv": F.when(F.col("is_valid"), F.col("vv")).otherwise(0.0), "vh": F.when(F.col("is_valid"), F.col("vh")).otherwise(0.0), "label": F.lit(1)})
    one, b = pixels(spark, 6)
    two, c = pixels(spark, 7, drop=0.3)
    bad = lambda df, name: df.select(F.lit(name).alias("candidate_id"), "raster_id", "r", "c", F.when(F.col("is_valid"), F.col("vv")).otherwise(-9999.0).alias("vv"), "vh")
    out = Rp.fillability(cur, bad(one, "one").unionByName(bad(two, "two")), F.col("label"), tile=8)
    assert not keyed_by_cell(out)
    zero = {k for k, v in a.items() if not v[2]}
    for r in out.collect():
        cells = b if r["candidate_id"] == "one" else c
        good = {k for k, v in cells.items() if v[2]}
        assert (r["valid_pixels"], r["zero_pixels"], r["fillable_zero"]) == (len(good), len(zero & set(cells)), len(zero & good))


def test_merge_zero_keeps_other_columns(spark):
    cur, a = pixels(spark, 8)
    cur = cur.withColumns({"vv": F.when(F.col("is_valid"), F.col("vv")).otherwise(0.0), "vh": F.when(F.col("is_valid"), F.col("vh")).otherwise(0.0), "label": F.col("r") % 2})
    cand, _ = pixels(spark, 9, drop=0.5)
    out = Rp.merge_zero_pixels(cur, cand.select("raster_id", "r", "c", "vv", "vh"), tile=8)
    assert out.count() == 400 and out.where("merged AND NOT zero_before").count() == 0 and out.where("label <> r % 2").count() == 0


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_resample_by_target_tiles(spark, method):
    rng = np.random.default_rng(10)
    rows = [("a", r, c, float(r * 100 + c), bool(rng.random() < 0.9)) for r in range(25) for c in range(30)]
    src = spark.createDataFrame(rows, "raster_id string, r bigint, c bigint, v double, ok boolean")
    s, t = [10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0], [7.0, 1.0, 1013.0, -0.5, -6.0, 4991.0]  # the target is turned a little
    grid = lambda g, w, h: spark.createDataFrame([("a", g, w, h)], "raster_id string, transform array<double>, width int, height int")
    out = geometry.resample(src, grid(s, 30, 25), grid(t, 47, 41), ["v"], F.col("ok"), method, tile=8)
    assert not keyed_by_cell(out)
    got = {(r["r"], r["c"]): r["v"] for r in out.collect()}
    assert len(got) == 47 * 41
    have = {(r[1], r[2]): r[3] for r in rows if r[4]}
    for (r, c), v in got.items():
        x, y = t[0] * (c + 0.5) + t[1] * (r + 0.5) + t[2], t[3] * (c + 0.5) + t[4] * (r + 0.5) + t[5]
        fc, fr = (x - s[2]) / s[0], (y - s[5]) / s[4]
        if method == "nearest":
            assert v == have.get((int(np.floor(fr)), int(np.floor(fc)))) or min(abs(fr - round(fr)), abs(fc - round(fc))) < 1e-9
            continue
        r0, c0 = int(np.floor(fr - 0.5)), int(np.floor(fc - 0.5))
        wr, wc = fr - 0.5 - r0, fc - 0.5 - c0
        parts = [((wr if i else 1 - wr) * (wc if j else 1 - wc), have[r0 + i, c0 + j]) for i in (0, 1) for j in (0, 1) if (r0 + i, c0 + j) in have]
        if parts and sum(w for w, _ in parts) > 1e-9:
            assert abs(v - sum(w * x for w, x in parts) / sum(w for w, _ in parts)) < 1e-6
        elif not parts:
            assert v is None


def test_trim_many_lines_in_one_pass(spark):
    """Five thousand lines on each side: no job per line."""
    n = 5000
    sizes = spark.createDataFrame([("a", 12_000, 12_000), ("clean", 4, 4)], "raster_id string, height int, width int")
    lines = spark.range(n).select(F.lit("a").alias("raster_id"), F.col("id").alias("r"), F.explode(F.array(*[F.lit(c) for c in (3, 77, 11_000)])).alias("c"))
    started = time.time()
    got = {r["raster_id"]: (r["row_start"], r["row_stop"], r["col_start"], r["col_stop"]) for r in Rp.trim_window(lines, sizes).collect()}
    assert got == {"a": (n, 12_000, 0, 12_000), "clean": (0, 4, 0, 4)} and time.time() - started < 60


def test_lines_count_spans():
    rng = np.random.default_rng(11)
    mask = rng.random((12, 40)) < 0.4
    runs = [(r, int(a), int(b)) for r in range(12) for a, b in zip(*[np.flatnonzero(np.diff(np.concatenate([[0], mask[r].astype(int), [0]])) == s) for s in (1, -1)])]
    lines = Rp.Lines(*(np.array(v) for v in zip(*runs)))
    for _ in range(300):
        r, a, b = int(rng.integers(0, 14)), *sorted(rng.integers(0, 41, 2).tolist())
        assert lines.count(r, a, b) == (int(mask[r, a:b].sum()) if r < 12 else 0)


def test_partitions_are_pruned_replaced_and_resumed(spark):
    path = f"{shared_folder(spark)}/test-partitions-{time.time_ns()}"
    rows = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("part"), F.lit("one").alias("run"))
    Tb.write_missing(rows.where("part < 2"), path, ["part"])
    Tb.write_missing(rows.withColumn("run", F.lit("two")), path, ["part"])
    Tb.replace_partitions(rows.where("part = 3").withColumn("run", F.lit("three")), path, ["part"])
    table = spark.read.parquet(path)
    got = {r["part"]: (r["run"], r["n"]) for r in table.groupBy("part", "run").agg(F.count("*").alias("n")).collect()}
    assert got == {0: ("one", 20), 1: ("one", 20), 2: ("two", 20), 3: ("three", 20), 4: ("two", 20)}
    one = table.where("part = 3")
    assert "PartitionFilters: [isnotnull(part" in plan(one)
    assert all("part=3" in f for f in {r[0] for r in one.select(F.input_file_name()).distinct().collect()})
    emb = f"{path}-emb"
    Tb.write_partitioned(spark.range(10).select("id", F.when(F.col("id") < 4, "s1").otherwise("s2").alias("modality")), emb, "modality")
    picked = Tb.read_embeddings(spark, emb, "s1")
    assert picked.count() == 4 and "PartitionFilters: [isnotnull(modality" in plan(picked)
