"""Vector searches against brute force."""

import numpy as np
import pytest

from gridloom.llm import kdtree, onebit, vectors

SF = "/root/testdata/sf0.01"


def brute(ids, m, q_ids, score, k=5):
    out = {}
    for q in q_ids:
        s = score(m, m[ids == q][0])
        rows = sorted(((-x, i) for x, i in zip(s.tolist(), ids.tolist()) if i != q))[:k]
        out[q] = [(i, -x) for x, i in rows]
    return out


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(3000, 16)), 2)
    m[100:900] = m[7]  # one vector with many copies
    m[1000:1100] = -m[7]
    ids = rng.permutation(3000)
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, m)]
    bad = [(5000, None, ""), (5050, [], ""), (5100, [1.0, None], ""), (5150, [float("nan")] * 16, ""), (5200, [float("inf")] * 16, ""), (None, [1.0] * 16, ""), (5250, [1.0, 2.0], "")]
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string").repartition(6), ids, m


def test_inner_products(hard, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 700)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    df, ids, m = hard
    got = kdtree.top_inner_products(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    want = brute(ids, np.floor(256 * m), [i for i in ids if i % 50 == 0], lambda a, q: a @ q)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want


def test_one_bit_recall(spark, hard, monkeypatch):
    df, ids, m = hard
    monkeypatch.setattr(vectors, "SHARD_ROWS", 700)
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    real = base.toPandas()
    for frame, i, x in ((df, ids, m), (base, real.vec_id.to_numpy(), np.array(real.embedding.tolist(), np.float64))):
        got = onebit.nearest_cosine(frame, frame.where("vec_id % 50 = 0")).collect()
        want = brute(i, x, [q for q in i if q % 50 == 0], lambda a, q: a @ q / np.linalg.norm(a, axis=1) / np.linalg.norm(q))
        pairs = {(r.query_id, r.vec_id): r.score for r in got}
        truth = {(q, v): s for q, rows in want.items() for v, s in rows}
        assert len(got) == len(truth)
        assert sum(p in pairs for p in truth) >= 0.9 * len(truth)
        assert all(abs(pairs[p] - s) < 1e-12 for p, s in truth.items() if p in pairs)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + i), 1.0, float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kdtree.top_inner_products(df, df.where("vec_id = 50"), k=3).orderBy("rank").collect()
    ints = {i: [int(256 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(ints[50], v)), i) for i, v in ints.items() if i != 50))[:3]
    assert [r.vec_id for r in got] == [i for _, i in want]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kdtree.top_inner_products(df, df).count() == 0
    assert onebit.nearest_cosine(df, df).count() == 0
