"""The transducer against the library, and exact round trips."""

import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from gridloom.llm import piece_fst

FILE = P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b \n\t c ", "▁x", "▁▁▁ y", "日本語𝔘 \x00", "hello   ", "   the  cat", "a" * 3000, "<s> </s> <unk> <0x0A>", " " * 37 + "the", "ababababab", "…––", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def fst():
    return piece_fst.PieceFst(FILE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" aeinorst.,ABéß|▁#\n0"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(fst, library, text):
    assert fst.encode_text(text) == library.encode(text)


def test_queries(spark, library):
    docs = [*ODD, *[r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = {i: library.encode(t or "") for i, t in enumerate(docs)}
    encoded = piece_fst.encode(df, FILE)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in piece_fst.decode(encoded, FILE).collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(docs)}
    for r in piece_fst.digest(df, FILE).collect():
        ids = np.array(want[r.doc_id], "<u4")
        assert (r.n_ids, r.ids_crc32, r.n_byte_ids) == (len(ids), zlib.crc32(ids.tobytes()), sum(library.is_byte(int(i)) for i in ids)) and r.round_trip
    assert piece_fst.encode(df.limit(0), FILE).count() == 0


def test_broken_bytes_decode(spark, fst):
    ids = [int(fst.bytes_at[0xE6])]
    df = spark.createDataFrame([(1, [fst.ids["▁a"], *ids]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in piece_fst.decode(df, FILE).collect()} == {1: "a�", 2: "", 3: ""}


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("   aeinorst.,ABéß|▁#\n0日𝔘"), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_any_batch(fst, library, texts):
    ids, ends = fst.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [library.encode(t or "") for t in texts]


@pytest.mark.parametrize("name, least", [("LONG", 1), ("PLACES", 7), ("KEPT_NUMBERED", 5)])
def test_bounds_change_nothing(fst, library, monkeypatch, name, least):
    texts = [*ODD, "a" * 1022, "b" * 1023, "ab" * 600 + "日"]
    monkeypatch.setattr(piece_fst, name, least)
    monkeypatch.setattr(fst, "numbered", None)
    ids, ends = fst.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [library.encode(t or "") for t in texts]


def test_agreement_by_number(fst):
    rng = np.random.default_rng(3)
    names = [p for p in fst.ids if len(p) == 1 or fst._parts(p)]
    names = names[:300] + [names[i] for i in rng.integers(0, len(names), 300)]
    number = {p: n for n, p in enumerate(fst.ids)}
    pairs = [(names[i], names[j]) for i, j in rng.integers(0, len(names), (20_000, 2))]
    found = fst.agree_all(*(np.array([number[p[k]] for p in pairs]) for k in (0, 1)))
    want = [fst.agree(*p) for p in pairs]
    assert found.tolist() == want and 0 < sum(want) < len(want)


def test_work_is_not_done_word_by_word(fst):
    """Python calls do not grow with the number of distinct words: before, each was a call of its own and several of each place."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(3, 9))) for _ in range(20_000)]
    texts = pa.array([" ".join(words[i : i + 200]) for i in range(0, len(words), 200)])
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        fst.encode(texts)
    finally:
        sys.setprofile(None)
    assert calls[0] < 2_000


def test_compiled_once(spark, tmp_path):
    """On the driver: tasks need neither the model's file nor this package."""
    file = tmp_path / "copy.model"
    file.write_bytes(Path(FILE).read_bytes())
    df = spark.createDataFrame([(i, f"word{i}") for i in range(40)], "doc_id long, text string").repartition(8)
    plan = piece_fst.digest(df, str(file))
    file.write_bytes(b"")
    assert plan.where("round_trip").count() == 40


def test_travels_by_value(fst, library, tmp_path):
    file = tmp_path / "fst"
    file.write_bytes(cloudpickle.dumps(fst))
    code = f"import pickle; print(pickle.load(open({str(file)!r}, 'rb')).encode_text('the  cat'))"
    out = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert out.stdout.strip() == str(library.encode("the  cat")), out.stderr
