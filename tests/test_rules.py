"""Edges and ties of the scalar rules on literal frames."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays, bins, masks, products, rules, scalars
from gridloom.operators.metrics import grid
from gridloom.operators.sampling import RECIPES, allocate
from gridloom.operators.splits import greedy_validation
from gridloom.operators.tiling import axis_starts, stride_of

EDGES = [0, 0.05, 0.1, 0.5, 1, 5, 10, 20, 25, 40, 50, 60, 100]


def values(spark, xs, kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"x {kind}")


def test_density_edges(spark):
    x = F.col("x")
    rows = values(spark, [float(e) for e in EDGES]).select(
        "x", bins.density4(x).alias("d4"), bins.density8(x).alias("d8"), bins.density9(x).alias("d9"), bins.density5(x).alias("d5"), bins.density_class(x).alias("k")
    ).collect()
    at = {r["x"]: r for r in rows}
    assert (at[1]["d4"], at[0.5]["d4"], at[10]["d4"]) == ("medium", "low", "high")
    assert (at[0.1]["d8"], at[25]["d8"], at[50]["d8"], at[60]["d8"]) == ("tiny_0_0p1", "medium_10_25", "high_25_50", "very_high_50_100")
    assert (at[0.5]["d9"], at[40]["d9"], at[60]["d9"], at[100]["d9"]) == ("01_tiny_0_0p5", "06_high_20_40", "07_very_high_40_60", "08_extreme_gt_60")
    assert (at[0]["d5"], at[20]["d5"], at[25]["d5"]) == ("Empty (0%)", "Medium (5-20%)", "Large (>20%)")
    assert [at[e]["k"] for e in (0, 1, 5, 20, 100)] == [0, 1, 2, 3, 4]


def test_masks(spark):
    xs = [None, math.nan, math.inf, -9999.0, 0.0, -0.0, 1e-13, 1.0]
    x = F.col("x")
    rows = values(spark, xs).select(
        masks.valid_mask([x], -9999.0).alias("v"), masks.all_zero([x]).alias("z"), masks.valid_mask([x], None, True, eps=1e-12).alias("nz"), masks.label_valid_512(x).alias("l")
    ).collect()
    assert [r["v"] for r in rows] == [False, False, False, False, True, True, True, True]
    assert [r["z"] for r in rows] == [False, False, False, False, True, True, True, False]
    assert [r["nz"] for r in rows] == [False, False, False, True, False, False, False, True]
    assert [r["l"] for r in rows] == [False, False, False, False, True, True, False, True]


def test_safe_casts(spark):
    t = values(spark, ["3.0", " 4 ", "x", "", None, "nan"], "string")
    rows = t.select(scalars.safe_int(F.col("x")).alias("i"), scalars.safe_float(F.col("x"), None).alias("f")).collect()
    assert [r["i"] for r in rows] == [3, 4, 0, 0, 0, 0]
    assert [r["f"] for r in rows] == [3.0, 4.0, None, None, None, None]


def test_city_names(spark):
    t = values(spark, ["Rio_ocm_v1_v2", " sao_paulo_V7_", "belem"], "string")
    assert [r[0] for r in t.select(scalars.norm_city(F.col("x"))).collect()] == ["rio", "sao_paulo_v7", "belem"]
    p = values(spark, ["a/b/Porto Alegre", "x\\y\\Belo--Horizonte "], "string")
    assert [r[0] for r in p.select(scalars.city_key(F.col("x"))).collect()] == ["porto_alegre", "belo_horizonte"]


def test_product_name(spark):
    name = "S1A_IW_GRDH_1SDV_20220413T082249_20220413T082318_042752_051A1B_1234"
    f = {k: v.alias(k) for k, v in products.parse_product(F.col("x")).items()}
    row = values(spark, [name + ".SAFE"], "string").select(*f.values(), products.product_prefix(F.col("x")).alias("prefix")).first()
    assert (row["platform"], row["acquisition_mode"], row["product_type"], row["product_class"]) == ("S1A", "IW", "GRDH", "D")
    assert (row["absolute_orbit"], row["datatake"], row["prefix"]) == ("042752", "051A1B", name[:-5])
    assert str(row["acquisition_start"]) == "2022-04-13 08:22:49"
    assert values(spark, ["nonsense"], "string").select(products.parse_product(F.col("x"))["platform"].alias("p")).first()["p"] is None


@pytest.mark.parametrize("length,edge,want", [
    (224, "cover", [0]), (225, "cover", [0, 1]), (336, "cover", [0, 112]), (500, "cover", [0, 112, 224, 276]), (223, "cover", []),
    (500, "drop", [0, 112, 224]), (223, "drop", []), (225, "partial", [0, 112, 224]), (0, "partial", []),
])
def test_axis_starts(spark, length, edge, want):
    assert spark.range(1).select(axis_starts(F.lit(length), 224, 112, edge).alias("s")).first()["s"] == want


def test_stride():
    assert (stride_of(512), stride_of(224, 112), stride_of(512, overlap=0.5)) == (512, 112, 256)
    with pytest.raises(ValueError):
        stride_of(10, overlap=1.0)


def test_allocation():
    for recipe in RECIPES.values():
        for n in (0, 1, 7, 99, 5003):
            out = allocate(n, recipe)
            assert sum(out.values()) == n and all(abs(out[k] - n * recipe[k]) < 1 for k in recipe)


def test_thresholds():
    assert grid()[0] == 0.05 and grid()[-1] == 0.95 and len(grid()) == 19


def test_winner_from_text(spark):
    texts = ["Prefer SNAP-GRD", "prefer rtc over snap", "RTC stronger than SNAP", "SNAP and RTC mixed", "nothing"]
    got = [r[0] for r in values(spark, texts, "string").select(rules.winner_from_text(F.col("x"))).collect()]
    assert got == ["SNAP-GRD", "RTC", "SNAP-GRD", "Mixed", "Mixed"]


def test_greedy_validation_keeps_a_training_city():
    cities = pd.DataFrame([{"region": r, "city": f"{r}{i}", "patches": 100 + i, "positive_patches": i} for r, n in (("a", 3), ("b", 2), ("c", 1)) for i in range(n)])
    val = cities["city"][greedy_validation(cities, 0.5, 10, 1)].tolist()
    assert "c0" not in val
    for r, n in (("a", 3), ("b", 2)):
        assert sum(v.startswith(r) for v in val) < n


def test_token_map(spark):
    e = F.array(*[F.lit(float(i)) for i in range(10)])  # five tokens of two channels; the class token goes
    col, side = arrays.tokens_to_chw(e, 5, 2)
    assert side == 2 and spark.range(1).select(col.alias("v")).first()["v"] == [2, 4, 6, 8, 3, 5, 7, 9]
    with pytest.raises(ValueError):
        arrays.tokens_to_chw(e, 6, 2, drop_class_token=False)
