import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe_lexicon as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary.read(PATH)


def mapped(vocabulary, words, folder):
    path = folder / "lexicon"
    path.write_bytes(B.Lexicon.pack(vocabulary, words))
    return B.Lexicon.mapped(str(path))


def texts(seed, n):
    rng = random.Random(seed)
    bits = [*"abXYZ019'., \n\t\r", "  ", " \n", "'s", "'ll", "'ve", "n't", "the", " the", " hello", "é", "ß", "漢字", "🙂", "́", "\xa0", " ", "\x00", "\x1c", END, "<|endof", "١٢"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def ids_of(lexicon, some):
    ids, counts = lexicon.encode(pa.array(some, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_equals_the_library(vocabulary, library, tmp_path):
    some = texts(1, 4000) + ["", "a" * 3000, "ab" * 900, "'s'ts''re", END * 3]
    lexicon = mapped(vocabulary, [b" the", b"the", b" hello", b"a", "é".encode(), b"'ll"], tmp_path)
    want = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    assert ids_of(lexicon, some) == want
    assert all(lexicon.decode(np.array(i, np.int64)) == library.decode(i, skip_special_tokens=False) for i in want)


def test_lexicon_changes_nothing(vocabulary, tmp_path):
    some = texts(2, 500)
    words = B.Words("".join(some).encode(), np.cumsum([len(t.encode()) for t in some]), vocabulary).distinct.to_pylist()
    assert ids_of(mapped(vocabulary, [], tmp_path), some) == ids_of(mapped(vocabulary, words, tmp_path), some)


def test_every_class_of_character(vocabulary, library, tmp_path):
    lexicon = mapped(vocabulary, [], tmp_path)
    points = [c for c in [*range(1, 0x3000), *range(0x1C80, 0x1C90), *range(0x10D40, 0x10DA0), *range(0x1E900, 0x1E960), 0x30000, 0xF0000, 0x10FFFD]]
    some = [f"a{chr(c)} 1{chr(c)} {chr(c)}!{chr(c)}" for c in points]
    assert ids_of(lexicon, some) == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_automaton_is_minimal_and_numbers_words(vocabulary, tmp_path):
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    a = B.automaton(words)
    arcs = {}
    for key, to in zip(a["arc_key"].tolist(), a["arc_to"].tolist()):
        arcs.setdefault(key >> 8, []).append((key & 255, to))
    right = {}  # the set of words that lead from a state to an end

    def language(state):
        if state not in right:
            right[state] = frozenset(([b""] if a["final"][state] else []) + [bytes([c]) + w for c, to in arcs.get(state, []) for w in language(to)])
        return right[state]

    assert language(int(a["root"][0])) == frozenset(words)
    assert len(set(map(language, range(len(a["final"]))))) == len(a["final"]) < sum(map(len, words)) / 4
    lexicon = mapped(vocabulary, words, tmp_path)
    assert lexicon.numbers(pa.array(words, pa.binary())).tolist() == list(range(len(words)))
    assert set(lexicon.numbers(pa.array([b"d", b"abcd", b"", b"c" * 50], pa.binary())).tolist()) == {-1}


def test_windows_of_a_long_text(vocabulary, library, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PART_BYTES", 200)
    lexicon = mapped(vocabulary, [b" the"], tmp_path)
    some = ["".join(texts(4, 300)), "x" * 2000, "word \n" * 300]
    assert [ids_of(lexicon, [t])[0] for t in some] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_spark_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(5, 300))] + [(None, "again and again"), (7, "again and again"), (8, None), (9, "")]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, ids string, decoded int").repartition(4)
    lexicon = B.build(df, PATH, words=50)
    out = B.decode(B.encode(df, lexicon), lexicon)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]  # the results win over columns of their names
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_tokens, sha256(bytes(r.ids)).hexdigest(), r.decoded) for r in out.collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i or 0, t or "", len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t or ""))
    assert got == sorted(want)
    empty = df.where("false")
    assert B.encode(empty, B.build(empty, PATH)).collect() == []


def test_frequent_words_are_bounded(spark, vocabulary):
    df = spark.createDataFrame([("one two two three three three " + "x" * 60,)] * 3, "text string")
    shared = B.share(spark, B.Lexicon.pack(vocabulary, []), "vocabulary")
    assert set(B.frequent_words(df, shared, 100)) == {b"one", b" two", b" three"}
    assert set(B.frequent_words(df, shared, 1)) == {b" three"}


def test_unknown_models_are_refused(tmp_path):
    with pytest.raises((ValueError, KeyError, TypeError)):
        B.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
