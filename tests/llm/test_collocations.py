import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import collocations as K


def plain(docs, least=10, share=50, top=2000):
    """Counts of all phrases in dictionaries, exact integers throughout."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    known = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in known.items():
        inside = [b for (l2, w2), b in known.items() if l2 == lang and len(w2) > len(words) and words in (w2[:2], w2[1:])] if len(words) == 2 else []
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = [(10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, size):
    rng = random.Random(seed)
    words = ["of", "the", "New", "york", "city", "ÉTÉ", "été", "a", "b", "naïve", "x" * 50, "rare"] + [f"w{i}" for i in range(40)]
    weights = [30, 30, 9, 9, 9, 3, 3, 20, 20, 2, 1, 1] + [1] * 40
    gaps = [" "] * 14 + ["\t", "  ", ". ", ",", "\n", " \x0b", "; ", "\xa0"]
    docs = []
    for i in range(size):
        text = "".join(rng.choices(words, weights)[0] + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
        docs.append((rng.choice(["en", "en", "fr", None]), rng.choice([text] * 12 + [None, "", "New york city " * 3])))
    return docs


@pytest.mark.parametrize("least, share, top", [(10, 50, 2000), (3, 90, 25)])
def test_equals_counting_by_hand(spark, least, share, top):
    docs = made(5, 300)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert found(K.collocations(df, least=least, share=share, top=top)) == sorted(plain(docs, least, share, top))


def test_small_slices_tiles_and_buckets(spark, monkeypatch):
    """Texts cut inside, several slices, a leading square that most pairs miss, sums and hand-overs all along the way."""
    for name, value in (("SLICE_BYTES", 400), ("DENSE", 4), ("HELD_KEYS", 50), ("HELD_CELLS", 60), ("BUCKET_WORDS", 500)):
        monkeypatch.setattr(K, name, value)
    docs = made(6, 150) + [("en", " ".join(t for _, t in made(7, 40) if t))]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    assert found(K.collocations(df)) == sorted(plain(docs))


def test_overlaps_repeats_and_extra_columns(spark):
    docs = [("de", "ja ja ja ja"), ("de", "ja ja ja ja")] * 4
    df = spark.createDataFrame([(x, *d, "z") for x, d in enumerate(docs)], "rank int, lang string, text string, phrase string")
    assert found(K.collocations(df)) == sorted(plain(docs)) == [("de", 1, "ja ja ja", 16, 32, 24, 32, 333333)]


def test_empty_tables(spark):
    assert K.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert K.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15 + 7, 2 * 10**15 + 1, 10**15 + 9)], "a long, l long, r long").select(K.score("a", "l", "r")).first()
    a, left, right = 10**15 + 7, 2 * 10**15 + 1, 10**15 + 9
    assert row[0] == 10**6 * a * a // (left * right)


def test_ids_survive_their_keys():
    import numpy as np

    left, right = np.array([0, 63, 64, 2**33 - 1, 1023]), np.array([0, 2**31 - 1, 4095, 2**31 - 1, 1])
    back = K.cell_ids(K.cell_keys(left, right))
    assert (back[0] == left).all() and (back[1] == right).all()


def test_no_row_between_steps_is_large(spark, monkeypatch):
    """A slice of 200,000 words is stored and shuffled in short rows, none of which has a list."""
    kept, types = [], set()

    def stored(df, label, whole=K.stored):
        kept.append(whole(df, label))
        return kept[-1]

    monkeypatch.setattr(K, "stored", stored)
    rng = random.Random(8)
    docs = [("en", " ".join(f"w{int(rng.paretovariate(0.6)) % 30000}" for _ in range(200000))), ("fr", "ja ja. ja " * 20), ("fr", None)]
    assert found(K.collocations(spark.createDataFrame(docs, "lang string, text string"))) == sorted(plain(docs))
    for df in kept:
        types |= {kind for _, kind in df.dtypes}
        for column in [c for c, kind in df.dtypes if kind == "binary"]:
            assert df.selectExpr(f"max(length({column}))").first()[0] < 1 << 17
    assert "binary" in types and not any(kind.startswith("array") for kind in types)


def test_every_step_gives_its_memory_back(spark, monkeypatch):
    steps, kind = [], type(spark.range(0))

    def map_in_arrow(self, func, *args, whole=kind.mapInArrow, **options):
        steps.append(func.__qualname__)
        return whole(self, func, *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", map_in_arrow)
    K.collocations(spark.createDataFrame([("en", "a b c " * 20)], "lang string, text string")).collect()
    assert len(steps) > 7 and set(steps) == {"lean.<locals>.whole"}


def part_batches(rows):
    schema = pa.schema([("slice", pa.int64()), ("at", pa.int32()), ("own", pa.int32()), ("data", pa.binary())])
    for i in range(0, len(rows), 3):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 3]], f.type) for k, f in enumerate(schema)], schema=schema)


def cells(batches):
    out = Counter()
    for batch in batches:
        for data in batch.column("data").to_pylist():
            rows = K.unpacked(data)
            for left, right, n in zip(*(x.tolist() for x in K.cell_ids(rows["key"])), rows["n"].tolist()):
                out[left, right] += n
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_parts_may_be_cut_anywhere(monkeypatch, size):
    """Words of two slices get their ids from several answers each, then pairs and phrases of three are counted over the cuts."""
    monkeypatch.setattr(K, "PART_CODES", size)
    rng = random.Random(size)
    ids = {code: 2 * code + 300 for code in range(12) if code != 5}  # a rare word
    rows, twos, threes, sequences = [], Counter(), Counter(), {}
    for number in (7, 9):
        codes, own = [rng.choice([-1, *range(14)]) for _ in range(300)], 290  # two words beyond all answers
        answers = [(number, code, ids[code]) for code in ids if number == 7 or code != 11]
        rng.shuffle(answers)
        for part in (answers[:4], answers[4:]):
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int32(), pa.int32()))], ["slice", "code", "id"])
            rows += [(s, None, None, data) for out in K._word_answers(iter([batch])) for s, data in zip(*(c.to_pylist() for c in out.columns))]
        rows += [(number, at, n, data) for at, (n, data) in enumerate(K.code_parts(np.array(codes), own))]
        known = {code: number_ for _, code, number_ in answers}
        sequences[number] = whole = [known.get(code, -1) for code in codes]
        twos.update(p for p in zip(whole[:own], whole[1:]) if min(p) >= 0)
        threes.update(t for t in zip(whole[:own], whole[1:], whole[2:]) if min(t) >= 0)
    coded = [tuple(c[0].as_py() for c in b.columns) for b in K._recoded(part_batches(rows))]
    assert cells(K._count_pairs(4)(part_batches(coded))) == twos
    numbers = {pair: i for i, pair in enumerate(sorted({p for s in sequences.values() for p in zip(s, s[1:]) if min(p) >= 0}))}
    numbered = np.array(sorted((int(K.cell_keys(np.array([a]), np.array([b]))[0]), i) for (a, b), i in numbers.items()), K.NUMBERED)
    replies = [[(n, None, None, K.numbered(half)) for half in (numbered[1::2], numbered[::2])] + [r for r in coded if r[0] == n] for n in (7, 9)]
    assert cells(K._count_triples(4)(part_batches(sum(replies, [])))) == Counter({(numbers[a, b], c): n for (a, b, c), n in threes.items()})
    asked = Counter(number for batch in K._requests(4)(part_batches(coded)) for number in batch.column("slice").to_pylist())
    assert set(asked) == {7, 9} and max(asked.values()) <= 4  # a message per bucket, not per part


def test_narrow_numbers_survive():
    for values in ([], [-1], [-1, 0, 254], [255, -1], [65534], [65535, 3], [2**24 - 1], [2**31 - 1, -1]):
        assert K.from_narrow(K.narrow(np.array(values, np.int64))).tolist() == values
    assert len(K.narrow(np.arange(-1, 1000))) == 1 + 2 * 1001
