"""The pipeline against its stages done plainly, and planted cases."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from gridloom.llm.queries import tokenizer_path
from gridloom.session import stored
from tests.llm.test_dedup import brute_components, drop_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean prose, toxic texts (labelled), a line in many documents, near copies and a passage that repeats."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abdefgilmnoprstu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.randint(30, 90))
        if i % 4 == 1:
            text += " dreckwort " + prose(5) + " dreckwort"
        if i % 5 == 2:
            text += "\nAll rights reserved.\n" + prose(10)
        rows.append((i, text))
        labels.append((i, 1, int(i % 4 == 1)))
    near = rows[8][1].split()
    near[20] = "changed"
    passage = prose(60)
    rows += [(240, " ".join(near)), (241, prose(20) + " " + passage), (242, prose(20) + " " + passage), (243, None), (244, ""), (245, "word " * 9000)]
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_stages(spark, planted):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "test-stage")
        assert docs.columns == COLUMNS
        seen.append({r.doc_id: r.text for r in docs.collect()})
    clean, lines, single, cut = seen
    assert set(clean) == {i for i, _ in rows if not (i < 240 and i % 4 == 1)}
    want = dict(zip(clean, (t for _, t, _ in drop_lines(list(clean.values()), 10))))
    assert lines == want
    ids = sorted(lines)
    first = [ids[c] for _, c in brute_components([lines[i] for i in ids])]
    assert set(single) == {i for i, c in zip(ids, first) if i == c} and 8 in single and 240 not in single
    assert passage in cut[241] and passage[120:] not in cut[242] and cut[242].startswith(rows[242][1][:20])
    assert all(cut[i] == single[i] for i in single if i not in (242, 245))
    packed = cp.STAGES[-1][1](spark, docs, folder).toPandas()
    assert set(packed.doc_id) == set(cut) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_equals_its_stages(spark, planted):
    got = entry.queries()["pipeline"](spark, planted[0]).toPandas()
    assert got.groupby("doc_id").start.min().eq(0).all() and not got.duplicated(["doc_id", "piece"]).any()


def without_repeats(texts, length=100):
    """The texts without every string of `length` bytes that starts earlier already."""
    seen, out = set(), []
    for data in (t.encode() for t in texts):
        gone = set()
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone.update(range(i, i + length))
            seen.add(data[i : i + length])
        out.append(bytes(b for i, b in enumerate(data) if i not in gone).decode())
    return out


def test_run_equals_plain_stages(spark, planted):
    folder, rows, _ = planted
    ids = sorted(i for i, _ in rows if not (i < 240 and i % 4 == 1))
    texts = dict(rows)
    lines = [t for _, t, _ in drop_lines([texts[i] for i in ids], 10)]
    single = [(i, t) for i, t, (_, c) in zip(ids, lines, brute_components(lines)) if ids[c] == i]
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for (i, _), text in zip(single, without_repeats([t for _, t in single])):
        tokens = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        cuts = range(0, len(tokens), 2048)
        want += [(i, k, s, len(tokens[s : s + 2048]), zlib.crc32(tokens[s : s + 2048].tobytes())) for k, s in enumerate(cuts)]
    got = entry.queries()["pipeline"](spark, folder).toPandas()
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist() and seq.length.sum() <= 2048
