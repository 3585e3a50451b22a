"""Packing against the tokenizer library and a plain best-fit bound."""

import ctypes
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing
from gridloom.llm import texts as texts_module
from gridloom.llm.packing import best_fit, best_fit_runs, pack, token_pieces

FILE = P.path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "Hello,  World. it's", "a <|endoftext|>b <|ENDOFTEXT|> c.", "é É é x. y", "ab cd " * 3000, "日本 語.\t42x", "same text", "same text", "K L. M n.,. o"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string")


def test_ids_and_places(spark):
    out = pack(token_pieces(frame(spark, TEXTS), FILE, 64), 64).toPandas()
    tok = Tokenizer.from_file(FILE)
    for i, text in enumerate(TEXTS):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = out[out.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 64)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 64].tobytes()) for s in own.start]
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 64
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 64) * 1.05 + 2


def test_tree_merges_partitions(spark):
    rows = [(i, 0, 0, 1 + i * 37 % 90, 0) for i in range(4000)] + [(None, 0, 0, 5, 0)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(40)
    out = pack(df, 100).toPandas()
    assert len(out) == len(rows) and out.doc_id.isna().sum() == 1
    assert out.groupby("sequence_id").length.sum().max() <= 100
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 100) * 1.05 + 2
    assert pack(df.limit(0), 100).count() == 0


def test_underfull_bins_are_merged_in_rounds(spark, monkeypatch):
    """Partitions of one length each: the tree brings complements together, by one bar at every level."""
    made = []
    real = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, label: made.append(label) or real(df, label))
    rows = [(i, 0, 0, 55 if i < 3000 else 45, 0) for i in range(6000)] + [(i, 0, 0, 35, 0) for i in range(6000, 6100)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 80), "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(df, 100).toPandas()
    assert made.count("merged-bins") == 3  # 80 nodes, 10, 2, 1
    assert len(out) == 6100 and out.sequence_id.nunique() == 3000 + 50
    fills = out.groupby("sequence_id").length.sum()
    early = fills[fills.index < packing.TOGETHER]
    assert (early > packing.CLOSE_AT * 100).all() and (early.index.to_numpy() >> 56 > 0).sum() > 2000  # most pairs were made in the tree
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 100


def test_lengths_that_differ_by_partition(spark):
    rows = [(i, 0, 0, 55 if i < 3000 else 45, 0) for i in range(6000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 80), "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(df, 100).toPandas()
    assert len(out) == out.doc_id.nunique() == 6000 and out.sequence_id.nunique() == 3000
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 100


def test_best_fit_by_runs_is_best_fit():
    rng = np.random.default_rng(4)
    for top in (3, 30, 100):
        sizes = rng.integers(1, top + 1, 3000).tolist()
        counts = {s: sizes.count(s) for s in set(sizes)}
        runs = best_fit_runs(counts, 100)
        spans = {}
        for s, r, b, o in runs.tolist():
            ends = [x[1] for x in runs.tolist() if x[0] == s and x[1] > r] + [counts[s]]
            for i in range(min(ends) - r):
                spans.setdefault(b + i, []).append((o, s))
        assert all([o for o, _ in sorted(x)] == np.cumsum([0] + [s for _, s in sorted(x)])[:-1].tolist() and sum(s for _, s in x) <= 100 for x in spans.values())
        assert sum(map(len, spans.values())) == 3000 and len(spans) == len(best_fit(sizes, 100)[2])


def test_best_fit_picks_the_fullest():
    bins, offsets, fill = best_fit([6, 5, 4, 4], 10)
    assert fill == [10, 9] and bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 6, 5]


def test_tokenizer_gets_few_words_at_once():
    tok, asked = Tokenizer.from_file(FILE), []

    class Counting:
        def encode_batch_fast(self, words, **options):
            asked.append(len(words))
            return tok.encode_batch_fast(words, **options)

    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(60)] + ["", "a <|endoftext|>b"]
    ids, ends = packing.word_ids(Counting(), pa.array(texts))
    assert sum(asked) >= 18000 and max(asked) <= packing.WORDS_AT_ONCE
    for text, own in zip(texts, np.split(ids, ends[:-1])):
        assert own.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_gathering_in_steps_changes_nothing(monkeypatch):
    tok = Tokenizer.from_file(FILE)
    texts = pa.array([t or "" for t in TEXTS])
    whole = packing.word_ids(tok, texts)
    monkeypatch.setattr(packing, "PLACES_AT_ONCE", 7)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, packing.word_ids(tok, texts)))


def anonymous_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs a C library that can be asked for its free memory")
def test_a_finished_task_gives_its_memory_back():
    pinned = []

    def run(batches):
        for batch in batches:
            held = [bytes([i % 256]) * 1000 for i in range(200_000)]
            pinned.extend(held[::2000])  # what stays is spread over all of it
            yield batch

    list(run([None]))
    kept, before = anonymous_mb(), anonymous_mb()
    pinned.clear()
    list(texts_module.lean(run)([None]))
    assert kept > 150 and anonymous_mb() < before - 100
