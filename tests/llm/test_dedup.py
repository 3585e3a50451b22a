"""Line and near-duplicate removal against plain versions."""

import random

import pytest

from gridloom.llm import minhash
from gridloom.llm.components import components
from gridloom.llm.line_dedup import LineRuns, dedup_lines
from gridloom.llm.minhash import near_duplicates

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def drop_lines(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    count = {}
    for own in lines:
        for k in {key(x) for x in own} - {""}:
            count[k] = count.get(k, 0) + 1
    return [(len(own), "\n".join(kept := [x for x in own if count.get(key(x), 0) < least]), len(own) - len(kept)) for own in lines]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    rng = random.Random(batches)
    pool = ["Copyright", "  COPYRIGHT\t", "", " ", "\x0bx\r", "é", "É", *(f"line {i}" for i in range(40))]
    texts = [None, "", "\n\n", "x" * 5000] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, h1 string, batch int")
    out = dedup_lines(df, min_docs=10, batches=batches, fanout=fanout).orderBy("doc_id").collect()
    assert [(r.n_lines, r.text, r.n_dropped) for r in out] == drop_lines(texts, 10)
    assert out[0].h1 == "k" and out[0].batch == 1
    assert dedup_lines(df.limit(0)).count() == 0


def test_runs_move_frequent_keys_once(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for b in range(5):
        df = spark.createDataFrame([(b, "always"), (100 + b, f"once {b}"), (200 + b, "late" if b > 2 else "x")], "doc_id long, text string")
        runs.add(runs.lines(df))
    assert runs.frequent().count() == 2  # "always" and "x" reach three documents, "late" only two
    runs.close()


def sets_of(texts):
    out = []
    for t in texts:
        w = [x for x in "".join(" " if c in BLANKS else c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ") if x]
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def brute_components(texts):
    sets = sets_of(texts)
    label = list(range(len(texts)))
    for _ in texts:
        changed = False
        for i, x in enumerate(sets):
            for j in range(i):
                common = len(x & sets[j])
                if x and sets[j] and 100 * common >= 75 * (len(x) + len(sets[j]) - common) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    return [(len(s), c) for s, c in zip(sets, label)]


def test_near_copies(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randint(0, 30))
    texts = [None, "", " \n ", "one two", "One  two", "one two three four five", "x " * 3000]
    for family in range(6):
        original = [word() for _ in range(120)]
        for _ in range(25):
            own = list(original)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts += [" ".join(original)] * 3
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(4)
    got = near_duplicates(df).orderBy("doc_id").collect()
    want = brute_components(texts)
    assert [(r.n_shingles, r.component_id) for r in got] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(df.limit(0)).count() == 0


def test_lines_with_clashing_columns(spark):
    names = ["_bad", "_kept", "_line_doc", "bad", "kept", "every", "row", "id", "doc", "h1", "n", "batch"]
    rows = [(i % 11, "shared\nown %d" % i, -1, -2, *range(len(names))) for i in range(12)] + [(None, None, 0, 0, *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped int, " + ", ".join(f"{n} int" for n in names))
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    for r in out.collect():
        assert [r[n] for n in names] == list(range(len(names)))
        assert (r["n_lines"], r["n_dropped"], r["text"]) == ((1, 0, "") if r["doc_id"] is None else (2, 1, r["text"])) and "shared" not in r["text"]


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "A B c d e f g")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]


@pytest.mark.parametrize("turned", [False, True])
def test_one_id_with_two_texts(spark, turned):
    """Each of the texts keeps its own links, and the id joins them."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, "something else altogether here now"), (5, ""), (1, "")]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 1, 4, True), (5, 0, 5, True)]


def test_components_of_chains(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 90), (100, 100), (90, 80)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(31, 61)} == {31} and got[100] == got[80] == 80


def test_recall_of_the_tables():
    p = 0.75**minhash.WIDTH
    assert (1 - (1 - p) ** minhash.HALVES) ** 2 > 0.999
