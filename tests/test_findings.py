"""Cases that the findings of a review showed."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import embeddings as E


def test_neighbours_memory_and_copies(spark, monkeypatch):
    """Rows before the search are one per training row and one per query and group, whatever the chunk; copies at equal
    distance are ranked by id."""
    monkeypatch.setattr(E, "GROUP_ROWS", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:180] = x[7]
    train = spark.createDataFrame([(r, 1000 - i, v.tolist(), i % 2) for r in (1, 2) for i, v in enumerate(x)], "run int, id long, embedding array<double>, label int")
    q = np.concatenate([rng.normal(size=(40, 8)), x[[7]]])
    queries = spark.createDataFrame([(r, f"q{i}", v.tolist()) for r in (1, 2) for i, v in enumerate(q)], "run int, query string, embedding array<double>")
    got = {}
    for chunk in (1, 50):
        for r in E.nearest_neighbours(train, queries, k=5, pivots=4, chunk=chunk).collect():
            got.setdefault((chunk, r["run"], r["query"]), {})[r["rank"]] = (r["neighbour"], r["distance"])
    assert len(got) == 2 * 2 * len(q)
    ids = 1000 - np.arange(len(x))
    for (_, _, name), rows in got.items():
        d = np.sqrt(((x - q[int(name[1:])]) ** 2).sum(1))
        order = np.lexsort((ids, d))[:5]
        assert [rows[i + 1][0] for i in range(5)] == ids[order].tolist()
        assert np.allclose([rows[i + 1][1] for i in range(5)], d[order], atol=1e-12)
    routed = next(E._route(x[:4], {c: (0.0, 9.0, [9.0] * 5) for c in range(4)}, 5)(iter([queries.toPandas()])))
    assert len(routed) == queries.count()  # a batch of queries leaves the task as it came, without a copy per visit


def test_products_by_time_equal_brute_force(spark):
    """Orbit or datatake of a name inside any part of a product, products alike but for stop and number, odd codes."""
    import random

    from gridloom.operators import candidates as Cd

    rnd = random.Random(5)
    orbits, takes = ["000125", "012345", "000000", "051A2B", "777777"], ["0A1B2C", "051A2B", "000125", "A", "C0FFEE"]

    def name():
        second = rnd.choice([0, 125, 400, 3500, 3590])
        start = f"20220413T{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
        stop = f"20220413T{rnd.choice(['000125', '010203', '012345'])}"
        head = f"{rnd.choice(['S1A', 'S1B'])}_{rnd.choice(['IW', 'S3', 'EW'])}_{rnd.choice(['GRDH', 'SLC', 'AB'])}_1S{rnd.choice(['DV', 'SV', 'DA'])}"
        tail = f"{rnd.choice([o for o in orbits if o.isdigit()])}_{rnd.choice(takes)}_{rnd.choice(takes + ['9F9F', 'AB12'])}"
        return f"{head}_{start}_{stop}_{tail}{rnd.choice(['', '.SAFE', '_COG'])}"

    names, products = sorted({name() for _ in range(150)}), sorted({name() for _ in range(400)})
    rows = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    got = {r["name"]: r for r in Cd.match_products(rows(names), rows(products)).collect()}

    def clock(x):
        t = x.split("_")[4].split("T")[1]
        return int(t[:2]) * 3600 + int(t[2:4]) * 60 + int(t[4:])

    checked = 0
    for n in names:
        part = n.split("_")
        values = [part[0], part[1], part[2], part[3][3:], part[6], part[7].split(".")[0]]
        near = [(-((-20 if "_COG" in p else 50) + 25 * sum(v in p for v in values) + 30), p) for p in products if abs(clock(p) - clock(n)) <= 600]
        if n in got and got[n]["method"] != "time_window":
            continue
        assert (n in got) == bool(near)
        if near:
            checked += 1
            assert (-got[n]["score"], got[n]["product"]) == min(near), n
    assert checked > 50


def test_mask_bbox_leaves_out_empty_masks(spark):
    from gridloom.operators import stats as St

    px = spark.createDataFrame([("a", 4, 5, 1), ("a", 9, 2, 1), ("a", 0, 0, 0), ("b", 3, 3, 0), ("c", 1, 1, None)], "raster_id string, r long, c long, v int")
    got = St.mask_bbox(px, ["raster_id"], F.col("v") > 0, F.lit(50).cast("bigint"), F.lit(50).cast("bigint"), 3).collect()
    assert [tuple(r) for r in got] == [("a", 1, 13, 0, 9)]


def test_patch_ids_beyond_six_digits(spark, tmp_path):
    """The query equals its SQL, which keeps six digits; the operator keeps all."""
    import duckdb

    import __spark_entry__ as entry
    from gridloom.functions.scalars import patch_id_224

    keys = [7, 999_999, 1_000_000, 1_234_567, 8_999_999]
    data = {
        "region": "SELECT 0::BIGINT AS r_regionkey, 'NEAR EAST' AS r_name", "nation": "SELECT 0::BIGINT AS n_nationkey, 'N_0' AS n_name, 0::BIGINT AS n_regionkey",
        "customer": "SELECT 1::BIGINT AS c_custkey, 0::BIGINT AS c_nationkey", "orders": f"SELECT unnest({keys})::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 70123.5::DOUBLE AS o_totalprice",
    }
    con = duckdb.connect()
    for name, sql in data.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = entry.queries()["patch_ids"](spark, str(tmp_path)).select("patch_id", "id_224", "id_512").collect()
    want = con.execute(f"SELECT patch_id, id_224, id_512 FROM ({entry.oracle_sql()['patch_ids']})").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == len(keys)
    n = F.lit(1_234_567)
    assert spark.range(1).select(patch_id_224(F.lit("a"), n, n, F.lit(224), F.lit(112))).first()[0] == "a__r1234567__c1234567__ps224__st112"


def test_curriculum_ranks_only_what_quotas_need(spark):
    """The rank is limited before rows move, and pools larger and smaller than their quotas give the rows of a full ranking."""
    from gridloom.operators import ranking as R, sampling as Sm

    train = spark.range(3000).select(F.col("id").alias("patch_id"), (F.col("id") % 2 == 0).alias("pool_big"), (F.col("id") % 300 == 0).alias("pool_small"))
    m = Sm.curriculum(train, {"big": 0.6, "small": 0.4}, 100)
    assert "WindowGroupLimit" in m._jdf.queryExecution().executedPlan().toString()
    got = [(r["sample_pool"], r["patch_id"]) for r in m.collect()]
    assert len(got) == 100 and sum(p == "small" for p, _ in got) == 40
    keyed = train.where("pool_big").withColumn("k", F.concat_ws("|", F.lit("big"), "patch_id"))
    want = R.take_sample(keyed.withColumn("g", F.lit(1)), ["g"], ["k"], F.lit(60), "42")
    assert {i for p, i in got if p == "big"} == {r["patch_id"] for r in want.collect()}
    assert {i for p, i in got if p == "small"} <= set(range(0, 3000, 300))


def test_candidates_are_hashed_and_dealt_by_size(spark, monkeypatch):
    """The candidates of a city are not sorted, and more rows give more partitions than the session's own number."""
    from gridloom.operators import candidates as Cd, ranking as R

    no_city = spark.createDataFrame([("a", "5")], "city string, item_id string")
    rows = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("city"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 97).cast("double").alias("overlap_percent"), F.lit(1.0).alias("temporal_distance_days"),
        F.array(F.lit("VV"), F.lit("VH")).alias("polarizations"), F.lit("IW").alias("instrument_mode"), F.lit("GRD").alias("product_type"), F.lit(False).alias("full_coverage"),
    )
    out = Cd.select_candidate(rows, no_city, no_city.where("item_id = '4'"))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in text and "SortAggregate" not in text
    assert out.first()["selected_item_id"] == "1066" and out.first()["num_candidates"] == 1000  # 1066 % 97 == 96, the smallest such text
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 100)
    dealt = R.spread(rows, ["city", "item_id"], 2000)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 2000
    assert R.spread(rows, ["city", "item_id"], 700) is rows


def test_match_products_tells_orders_beyond_six_digits_apart(spark, tmp_path):
    """Names that the SQL cuts to the same six digits are still one row per order, each matched by its own kind."""
    import duckdb

    import __spark_entry__ as entry

    keys = {d: [k + j for k in (4, 999_996, 1_000_000, 1_000_004, 12_345_676) for j in range(4)] for d in ("1995-01-01", "1995-01-02")}
    keys["1995-01-03"] = [1_000_003, 1_000_007]  # nothing within the window
    con = duckdb.connect()
    rows = " UNION ALL ".join(f"SELECT unnest({[k + 100 * i for k in v]})::BIGINT AS o_orderkey, TIMESTAMP '{d}' AS o_orderdate" for i, (d, v) in enumerate(keys.items()))
    con.execute(f"COPY ({rows}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = entry.queries()["match_products"](spark, str(tmp_path)).select("name", "method", "by_prefix").collect()
    want = con.execute(f"SELECT name, method, by_prefix FROM ({entry.oracle_sql()['match_products']})").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 40 > len(set(want))
