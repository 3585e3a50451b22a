"""Quality and toxicity by held-out accuracy, odd inputs, and the parts by small cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    got = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks = got.score.rank()
    ones = got[label] == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    return (got.predicted == got[label]).mean(), auc


@pytest.mark.parametrize("name,label,least", [("op3_quality", "quality", 0.98), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    accuracy, auc = held_out(spark, name, label)
    assert accuracy >= least and auc >= least


ODD = [(0, None), (1, ""), (2, " \n"), (3, "word " * 20000), (4, "é" * 10), (5, "same"), (5, "same"), (None, "no id")]


def test_odd_documents(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, 1, 1), (4, None, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(docs, known, F.lit(True))
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
        stats = quality.statistics_table(docs)
        got = quality.score(stats, quality.fit(stats, known, F.lit(True))).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert quality.statistics_table(docs.limit(0)).count() == 0


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.02) for _ in range(8)], 1).astype(np.float32)
    votes = np.concatenate((votes, votes[:, :1], votes[:, :1]), 1)  # two voters that only repeat another
    labels = np.where(rng.random(4000) < 0.05, ~truth, truth).astype(int)
    p = toxicity.label_model(votes, labels)
    assert ((p > 0.5) == truth).mean() > max(0.98, (labels == truth).mean())


def test_scores_do_not_move_with_the_bound(spark):
    rng = np.random.default_rng(3)
    toxic = rng.random(4000) < 0.1
    words = [" ".join(f"{w}{k}" for k in range(12) if rng.random() < (0.35 if t == (w == "bad") else 0.1)) for t in toxic for w in ("bad", "good")]
    rows = [(i, words[2 * i] + " " + words[2 * i + 1], int(t)) for i, t in enumerate(toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    models = [toxicity.fit(docs, docs, F.lit(True), per_class=n) for n in (4000, 300)]
    whole, cut = (1 / (1 + np.exp(-m.logits(pa.array([r[1] for r in rows])))) for m in models)
    assert abs(whole.mean() - 0.1) < 0.03 and abs(cut.mean() - whole.mean()) < 0.02 and abs(cut - whole).mean() < 0.04


def test_isotonic():
    x, level = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(level) >= 0).all() and len(x) == len(level)


def test_statistics():
    values = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["A a b!\nb"]))[0]))
    assert values["distinct_words"] == 3 / 4 and values["repeated_neighbours"] == 1 / 4 and values["new_lines"] == 1 / 8 and values["marked_words"] == 1 / 4
