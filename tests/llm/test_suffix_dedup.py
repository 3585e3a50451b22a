"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import slices
from gridloom.llm import suffix_dedup as S


def brute(texts, length):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()) if len(gone) else 0
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[: len(data)] if not len(data) else bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ß") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copy = prose(40), prose(120)
    texts = [None, "", "short", "a" * 500, "Of " * 300, copy, copy, copy[:300] + "X" + copy[300:], passage, "!" * 99 + "a" * 130]
    texts += [prose(rng.randint(1, 30)) + passage + prose(rng.randint(1, 30)) for _ in range(60)]
    texts += [copy[: rng.randint(0, 400)] + prose(5) + copy[rng.randint(0, 400) :] for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("many", [1000, 5])
def test_against_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(S, "MANY_RUNS", many)
    monkeypatch.setattr(slices, "SLICE_BYTES", 20_000)
    texts = corpus(many)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, slice int").repartition(3)
    got = S.repeated_bytes(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 100)
    cut = S.cut_repeats(df)
    assert cut.columns == df.columns and cut.where("text IS NULL").count() == 1
    assert cut.count() == len(texts)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_bytes(df).count() == 0
    twice = "z y x w v " * 12
    df = spark.createDataFrame([(None, twice), (1, twice), (1, twice)], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.repeated_bytes(df).collect())[1:] == [120, 120]


def test_two_stage_order():
    rng = np.random.default_rng(1)
    text = np.concatenate((rng.integers(97, 100, 2000).astype(np.uint8), np.full(140, S.END, np.uint8)))
    words = S.words_at(text)
    domain = np.zeros(len(text), bool)
    domain[:2001] = True
    order = S.two_stage_sort(text, words, domain, 100)
    keys = [bytes(text[i : i + 100]) for i in order]
    assert len(order) == 2001 and keys == sorted(keys)
    prefixes = S.common_prefixes(words, order, 100)
    for i in range(1, len(keys)):
        assert prefixes[i] == next((k for k in range(100) if keys[i][k] != keys[i - 1][k]), 100)
