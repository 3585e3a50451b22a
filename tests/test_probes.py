"""Probes per fold, approximate neighbours and many city names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import candidates, embeddings, neighbours, probing


def rows_of(spark, n=240, dim=5, groups=4, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, dim)) * [1, 5, 0.1, 2, 1] + 3 + y[:, None] * [0.8, 0, 0.1, -1.5, 0]
    g = [f"g{i % groups}" for i in range(n)]
    data = [("m", g[i], int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "modality string, grp string, y int, x array<double>"), x, y, np.array(g)


def minimum(x, y, probe):
    """Plain gradient descent with a small step on scaled rows: (weights, intercept last)."""
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    sign, w = np.where(y == 1, 1.0, -1.0), np.zeros(z.shape[1])
    step = 1.0 / ((0.25 if probe == probing.LOGISTIC else 2.0) * np.linalg.eigvalsh(z.T @ (z * cost[:, None])).max() + 1)
    for _ in range(30_000):
        m = z @ w
        slope = cost * (1 / (1 + np.exp(-m)) - (y == 1)) if probe == probing.LOGISTIC else -2 * cost * sign * np.maximum(0, 1 - sign * m)
        w -= step * (z.T @ slope + np.append(w[:-1], 0.0))
    return w


def test_every_fold_reaches_its_own_optimum(spark):
    rows, x, y, g = rows_of(spark)
    fits = probing.fitted(rows.repartition(3), probing.started(probing.group_moments(rows), ["g0", "g2"], [probing.LOGISTIC, probing.SVM]))
    assert len(fits) == 4
    for f in fits:
        train = g != f.fold
        assert np.allclose(f.mean, x[train].mean(0)) and np.allclose(f.std, x[train].std(0))
        assert f.done and not f.notes and np.allclose(f.weights, minimum(x[train], y[train], f.probe), atol=1e-4)
    m = probing.margins(fits, x)
    z = (x - fits[0].mean) / fits[0].std
    assert np.allclose(m[:, 0], z @ fits[0].weights[:-1] + fits[0].weights[-1])


def test_evaluation_with_failed_and_skipped_folds(spark):
    rows, x, y, g = rows_of(spark)
    emb = rows.select("grp", "y", F.col("x").alias("embedding"), "modality")
    one_class = emb.where("grp <> 'g0' OR y = 1").where("grp = 'g0' OR y = 0").withColumn("modality", F.lit("split"))  # without g0 there is class 0 only
    out = probing.evaluate_probes(emb.unionByName(one_class), F.col("grp"), F.col("y"), F.col("modality"), min_test=10).toPandas()
    done = out[(out["modality"] == "m") & (out["status"] == "completed")]
    assert len(done) == 8 and (done["average_precision"] > 0.6).all() and (done["train_samples"] + done["test_samples"] == 240).all()
    assert (done["tp"] + done["fp"] + done["fn"] + done["tn"] == done["test_samples"]).all() and (done["threshold"].between(0, 1)).all()
    lost = out[(out["modality"] == "split") & (out["fold"] == "g0")]
    assert set(lost["status"]) == {"failed"} and lost["notes"].str.contains("one class").all() and lost["f1"].isna().all()
    few = probing.evaluate_probes(emb, F.col("grp"), F.col("y"), F.col("modality"), [probing.LOGISTIC], min_test=61)
    assert few.count() == 0


def test_small_network_and_its_failures(spark):
    rows, *_ = rows_of(spark, n=120, groups=2)
    scores, failed = probing.probe_scores(rows, ["g0"], [probing.MLP])
    assert failed.count() == 0 and scores.where("role = 'test'").count() == 60
    result = probing.probe_results(scores).first()
    assert result["probe"] == probing.MLP and result["average_precision"] > 0.6
    scores, failed = probing.probe_scores(rows.where("grp = 'g0'"), ["g0"], [probing.MLP])  # nothing to train on
    assert scores.count() == 0 and failed.first()["fold"] == "g0"


def vectors(spark, n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim)) * 3
    x = centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dim))
    rows = spark.createDataFrame([(1, i, [float(v) for v in x[i]], i % 2) for i in range(n)], "run int, id long, embedding array<double>, label int").repartition(4)
    queries = rows.where("id % 10 = 0").select("run", F.col("id").alias("query"), "embedding")
    return rows, queries, x


def test_approximate_neighbours_recall_and_growth(spark, monkeypatch):
    reached = {}
    real = neighbours._search

    for n in (2000, 4000):
        rows, queries, x = vectors(spark, n)
        kept = []
        monkeypatch.setattr(neighbours, "stored", lambda df, label: kept.append(df.persist()) or kept[-1])
        found = neighbours.approximate_neighbours(rows, queries, 10, tables=4, probes=16, bucket_rows=200, part_rows=100)
        got = found.toPandas()
        reached[n] = kept[0].count()
        near = {q: set(g["neighbour"]) for q, g in got.groupby("query")}
        hits = 0
        for q in range(0, n, 10):
            d = ((x - x[q]) ** 2).sum(1)
            hits += len(near[q] & set(np.lexsort((np.arange(n), d))[:10].tolist()))
        assert hits / (n // 10 * 10) >= 0.9
        assert (got.groupby("query")["rank"].max() <= 10).all()
        if n == 4000:
            continue
        exact = embeddings.nearest_neighbours(rows, queries, 10, pivots=8, chunk=2000)
        assert abs(neighbours.recall(found, exact).first()["recall"] - hits / (n // 10 * 10)) < 1e-9
    assert reached[4000] == 2 * reached[2000] == 4 * 4000
    assert real is neighbours._search


def test_ties_are_cut_by_id_in_the_task():
    import pandas as pd

    train = pd.DataFrame({"id": [5, 3, 9, 1], "embedding": [[0.0, 1.0]] * 3 + [[5.0, 5.0]], "label": [0, 1, 0, 1]})
    query = pd.DataFrame({"run": [1], "query": [7], "embedding": [[0.0, 0.0]]})
    out = embeddings._search(2)(query, train)
    assert out["neighbour"].tolist() == [3, 5]


def test_twenty_thousand_city_names(spark):
    names = [f"city_{i}_" for i in range(20_000)] + ["ab", "abc", "bc"]
    paths = spark.createDataFrame([(1, "/raw/City 17 /x.tif"), (2, "/raw/xABCx/city_19999_.tif"), (3, None), (4, "none")], "id int, path string")
    got = sorted((r["id"], r["city"]) for r in candidates.match_cities(paths, names).collect())
    assert got == [(1, "city_17_"), (2, "ab"), (2, "abc"), (2, "bc"), (2, "city_19999_")]
    assert candidates.match_cities(paths, []).count() == 0
    with pytest.raises(ValueError, match="bytes of city names"):
        candidates.match_cities(paths, ["x" * (candidates.MOST_NAME_BYTES + 1)])


@pytest.mark.parametrize("probe", ["linear_svm", "logistic_regression"])
def test_one_split_probe_separates(spark, probe):
    rows, x, y, g = rows_of(spark)
    emb = rows.select("grp", F.col("y").alias("label_binary"), F.col("x").alias("embedding"))
    out = embeddings.train_probe(emb.where("grp <> 'g0'"), emb.where("grp = 'g0'"), probe).toPandas()
    assert len(out) == 60 and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.5) == (out["label_binary"] == 1)).mean() > 0.7
