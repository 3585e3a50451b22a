"""Scores against a plain trie walked byte by byte."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ppm, slices

BLANKS = " \t\n\x0b\x0c\r"


def symbols(text):
    return [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()] + [ppm.END]


def brute(texts, learn, order):
    trie = defaultdict(Counter)
    for text, on in zip(texts, learn):
        if on:
            past = [ppm.BEGIN] * order
            for s in symbols(text):
                for k in range(order + 1):
                    trie[tuple(past[len(past) - k :])][s] += 1
                past.append(s)
    out = []
    for text in texts:
        past, total = [ppm.BEGIN] * order, 0.0
        for s in symbols(text):
            gone: set = set()
            for k in range(order, -1, -1):
                node = trie.get(tuple(past[len(past) - k :]))
                if not node:
                    continue
                left = {x: n for x, n in node.items() if x not in gone}
                whole = 2 * sum(left.values())
                if s in left:
                    total += math.log10((2 * left[s] - 1) / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                gone |= set(node)
            else:
                total -= math.log10(256 - len(gone))
            past.append(s)
        out.append(total)
    return out


def base(texts, learn):
    words = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in BLANKS else c for c in t or "").split(" ") if w] + [None]
    count = Counter(w for t, on in zip(texts, learn) if on for w in words(t))
    n, v = sum(count.values()), len(count)
    rows = []
    for t in texts:
        own = words(t)
        rows.append((len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return rows


@pytest.mark.parametrize("any_training", [True, False])
def test_against_plain_trie(spark, monkeypatch, any_training):
    monkeypatch.setattr(slices, "SLICE_BYTES", 1500)
    rng = random.Random(5)
    texts = [None, "", " \n", "A b c É", "zzzz" * 30] + [" ".join(rng.choice("the of And thing ing ßa été x1 q").join(["", ""]) or rng.choice(["the", "Of", "and", "thing", "été", "ßa"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += texts[10:14]
    learn = [any_training and i % 4 != 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, on) for i, (t, on) in enumerate(zip(texts, learn))], "doc_id long, text string, slice boolean").repartition(3)
    got = ppm.score(df, F.col("slice")).orderBy("doc_id").collect()
    want = brute(texts, learn, ppm.ORDER)
    assert np.allclose([r.score for r in got], want, rtol=1e-5, atol=1e-4)
    for r, (tokens, known, n, score) in zip(got, base(texts, learn)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and abs(r.base_score - score) < 1e-6


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score(df, F.lit(True)).count() == 0
