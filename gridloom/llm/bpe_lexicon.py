"""Byte-level BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

The words of all texts are counted with Spark. The most frequent ones, at most `words` of them, are merged once and
compiled into a minimal acyclic automaton with shared suffixes, whose arc outputs add up to a word's number; the number
leads to its ids. Automaton, merge table, byte strings of ids and character classes stand in one file of the shared
folder that Spark hands to every executor (`addFile`) and that workers map into memory. Words the automaton does not
hold are merged exactly, all of a part at once, so the lexicon changes the speed and never a result.

Texts are cut as the tokenizers library cuts them: added tokens first, then contractions, runs of letters, of numbers,
of other characters (each with one space before it) and white space. Results equal `encode(text,
add_special_tokens=False)` without truncation and padding, and `decode(ids, skip_special_tokens=False)`.

Rows pass unchanged with their columns, so repeated rows, NULL and repeated ids and extra columns need no rule; the
added columns win over columns of the same name. A NULL text counts as empty and has no ids; NULL ids decode to ''.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from gridloom.llm.slices import ranges
from gridloom.llm.texts import parts
from gridloom.session import shared_folder, stored

PART_BYTES = 1 << 20  # text whose words are looked up at once
LONGEST = 40  # bytes of a word in the lexicon; longer ones are merged
WORDS = 1 << 17  # words in the lexicon
HELD_WORDS = 1 << 18  # distinct words a counting task holds before it hands them on
NO_PAIR = np.int32(2**31 - 1)

# Fixed values of byte-level BPE: white space, contractions, and the printable characters that stand for themselves.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def character_classes() -> np.ndarray:
    """Class of every code point, asked of the library's own splitter so that both know the same Unicode version."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    classes = np.zeros(0x110000, np.uint8)
    assigned = [*range(1, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]  # all other planes are unassigned or private
    for a in range(0, len(assigned), 1 << 14):
        points = assigned[a : a + (1 << 14)]
        for lead, kind in (("a", LETTER), ("1", NUMBER)):
            # 'a' and a letter are one word, 'a' and anything else are two
            spans = split("".join(f"{lead}{chr(c)}\n" for c in points))
            for _, (start, end) in spans:
                if start % 3 == 0 and end == start + 2:
                    classes[points[start // 3]] = kind
    classes[WHITE] = SPACE
    return classes


def byte_of_character() -> dict[str, int]:
    """The character by which a vocabulary file writes a byte, back to the byte: printable ones are themselves, the rest follow 255."""
    table = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Arrays of a tokenizer file: merges sorted by pair, byte strings of ids, added tokens, character classes."""

    def __init__(self, arrays: dict[str, np.ndarray], added: dict[str, int]):
        self.arrays, self.added = arrays, added
        for name, values in arrays.items():
            setattr(self, name, values)
        self.added_bytes = {k.encode(): v for k, v in added.items()}
        self.added_pattern = re.compile(b"|".join(re.escape(k) for k in sorted(self.added_bytes, key=len, reverse=True))) if added else None

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not spec["normalizer"]
        if not plain or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE model")
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]):
                raise ValueError(f"added token {t['content']!r} needs rules that are not built")
        ids, to_byte = model["vocab"], byte_of_character()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for word, i in ids.items():
            strings[i] = bytes(to_byte[c] for c in word)
        for word, i in added.items():
            strings[i] = word.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        pair = left << 32 | right
        order = np.argsort(pair, kind="stable")
        whole = np.array([ids[m[0] + m[1]] for m in merges], np.int32)
        first = np.array([ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int32)
        arrays = {
            "pairs": pair[order], "pair_rank": order.astype(np.int32), "pair_id": whole[order], "first_id": first,
            "string_ends": np.cumsum([len(s) for s in strings]), "string_bytes": np.frombuffer(b"".join(strings), np.uint8),
            "classes": character_classes(),
        }
        return Vocabulary(arrays, added)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id of the whole) of pairs of ids; NO_PAIR where they do not merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_rank[at], NO_PAIR), np.where(known, self.pair_id[at], -1)


def word_starts(body: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which the words of UTF-8 texts start; texts stand one after another and start at `text_starts`."""
    at = np.flatnonzero((body & 0xC0) != 0x80)
    if len(at) == 0:
        return at
    lead = body[at].astype(np.uint32)
    points = lead.copy()
    padded = np.append(body, np.zeros(4, np.uint8)).astype(np.uint32)
    for least, most, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        some = np.flatnonzero((lead >= least) & (lead < most))
        value = lead[some] & bits
        for k in range(1, more + 1):
            value = value << 6 | padded[at[some] + k] & 0x3F
        points[some] = value
    kind = classes[points]
    n = len(at)
    fresh = np.zeros(n + 4, bool)  # first character of a text; the end counts as one
    fresh[np.searchsorted(at, text_starts[text_starts < len(body)])] = True
    fresh[n:] = True
    start = fresh.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last white space before other text: a space joins the word behind it, any other stands alone
    joins = np.flatnonzero(start[1:n] & ~fresh[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[joins - 1] = True
    start[joins[points[joins - 1] == 0x20]] = False
    apostrophes = np.flatnonzero(start[:n] & (points == ord("'")))
    follow = np.append(points, np.zeros(3, np.uint32))
    for text in CONTRACTIONS:
        size = len(text)
        hit = apostrophes
        for k in range(1, size):
            hit = hit[(follow[hit + k] == ord(text[k])) & ~fresh[hit + k]]
        for k in range(1, size):
            start[hit + k] = False
        start[hit + size] = True
    return at[np.flatnonzero(start[:n])]


class Words:
    """The words of a part of texts: their codes in order, how many each text has, and the distinct byte strings."""

    def __init__(self, body: bytes, text_ends: np.ndarray, vocabulary: Vocabulary):
        raw = np.frombuffer(body, np.uint8)
        starts = np.append(0, text_ends[:-1]).astype(np.int64)
        found = [m.span() for m in vocabulary.added_pattern.finditer(body)] if vocabulary.added_pattern else []
        ends = set(text_ends.tolist())
        found = [(a, b) for a, b in found if not any(a < e < b for e in ends)] if found else found  # not across two texts
        cuts = np.unique(np.append(starts, np.array(found, np.int64).ravel()))
        begins = word_starts(raw, cuts, vocabulary.classes)
        for a, b in found:
            begins = begins[(begins <= a) | (begins >= b)]
        offsets = np.append(begins, len(body)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        self.codes = words.indices.to_numpy()
        self.distinct = words.dictionary
        self.text_words = np.diff(np.searchsorted(begins, np.append(0, text_ends)))


def windows(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, rows, bytes, ends of its texts): all texts at once, or one long text by windows cut before a space.

    A word never reaches over a space that follows a letter or digit, so the cuts change nothing.
    """
    texts = pc.fill_null(texts, "").cast(pa.binary())
    values = texts.to_pylist()
    if len(values) == 1 and len(values[0]) > PART_BYTES:
        body, start = values[0], 0
        while start < len(body):
            cut = re.compile(rb"[A-Za-z0-9] ").search(body, start + PART_BYTES)
            end = cut.start() + 1 if cut else len(body)
            yield 0, 1, body[start:end], np.array([end - start])
            start = end
    else:
        yield 0, len(values), b"".join(values), np.cumsum([len(v) for v in values])


def merged_word(ids: list[int], vocabulary: Vocabulary) -> list[int]:
    """Ids of one word of any length: pairs leave a heap by (rank, place)."""
    after = [*range(1, len(ids)), -1]
    before = [-1, *range(len(ids) - 1)]
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r, i = vocabulary.ranks(np.array([a]), np.array([b]))
            known[a, b] = int(r[0]), int(i[0])
        return known[a, b]

    heap = [(pair(ids[i], ids[i + 1])[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1)]
    heapq.heapify(heap)
    while heap and heap[0][0] < NO_PAIR:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = pair(a, b)[1], -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (pair(ids[i], ids[after[i]])[0], i, ids[i], ids[after[i]]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (pair(ids[p], ids[i])[0], p, ids[p], ids[i]))
    return [i for i in ids if i >= 0]


def merged(words: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, number of ids) of byte words by exact merging: all words of like length lose their best pair, round by round."""
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    body = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = np.zeros(len(sizes), np.int64)
    made: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their rows of ids)
    least = 0
    for most in (6, 10, 16, 28, 64):
        chosen = np.flatnonzero((sizes > least) & (sizes <= most))
        least = most
        if len(chosen) == 0:
            continue
        ids = np.full((len(chosen), most), -1, np.int32)
        inside = np.arange(most) < sizes[chosen, None]
        ids[inside] = vocabulary.first_id[body[ranges(begins[chosen], sizes[chosen])]]
        ranks, wholes = vocabulary.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            some = np.arange(len(ids))
            ends = ranks[some, best] == NO_PAIR if ranks.shape[1] else np.ones(len(ids), bool)
            if ends.any():
                done = ids[ends]
                counts[chosen[ends]] = (done >= 0).sum(axis=1)
                made.append((chosen[ends], done))
                chosen, ids, ranks, wholes, best = (x[~ends] for x in (chosen, ids, ranks, wholes, best))
            if len(chosen) == 0:
                break
            rows, width = np.arange(len(ids)), ids.shape[1]
            ids[rows, best] = wholes[rows, best]
            keep = np.ones(ids.shape, bool)
            keep[rows, best + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[rows, best] = False
            ranks, wholes = (x[keep].reshape(len(rows), width - 2) for x in (ranks, wholes))
            for place in (best - 1, best):
                r = np.flatnonzero((place >= 0) & (place < width - 2))
                p = place[r]
                ranks[r, p], wholes[r, p] = vocabulary.ranks(ids[r, p], ids[r, p + 1])
    for w in np.flatnonzero(sizes > least):
        ids = merged_word(vocabulary.first_id[body[begins[w] : begins[w] + sizes[w]]].tolist(), vocabulary)
        counts[w] = len(ids)
        made.append((np.array([w]), np.array([ids], np.int32)))
    places = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for w, ids in made:
        out[ranges(places[w], counts[w])] = ids[ids >= 0]
    return out, counts


def automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct sorted words; the outputs along a word's arcs add up to its number.

    States are frozen as soon as the sorted words leave them, and equal ones are shared, so no trie of all words is held.
    """
    register: dict[tuple, int] = {}
    open_states: list[list] = [[False, []]]  # final, arcs (label, state)
    prior = b""

    def freeze(depth: int) -> None:
        while len(open_states) > depth + 1:
            final, arcs = open_states.pop()
            state = register.setdefault((final, tuple(arcs)), len(register))
            open_states[-1][1].append((prior[len(open_states) - 1], state))

    for word in words:
        shared = 0
        while shared < min(len(prior), len(word)) and prior[shared] == word[shared]:
            shared += 1
        freeze(shared)
        open_states.extend([False, []] for _ in range(len(word) - shared))
        open_states[-1][0] = True
        prior = word
    freeze(0)
    root = register.setdefault((open_states[0][0], tuple(open_states[0][1])), len(register))
    key, target, output, finals, paths = [], [], [], [], []
    for state, (final, arcs) in enumerate(register):  # in the order of their numbers, children first
        total = int(final)
        for label, to in arcs:
            key.append(state << 8 | label)
            target.append(to)
            output.append(total)
            total += paths[to]
        finals.append(final)
        paths.append(total)
    return {
        "arc_key": np.array(key, np.int64), "arc_to": np.array(target, np.int32), "arc_out": np.array(output, np.int32),
        "final": np.array(finals, np.uint8), "root": np.array([root], np.int32),
    }


class Lexicon:
    """The mapped file: a vocabulary, the automaton, and the ids of its words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    @staticmethod
    def pack(vocabulary: Vocabulary, words: list[bytes]) -> bytes:
        words = sorted(set(words) - set(vocabulary.added_bytes))  # added tokens are looked up apart
        ids, counts = merged(pa.array(words, pa.binary()), vocabulary)
        arrays = vocabulary.arrays | automaton(words) | {"word_ids": ids, "word_ends": np.cumsum(counts)}
        places, at = {}, 0
        for name, a in arrays.items():
            places[name] = [str(a.dtype), len(a), at]
            at += -(-a.nbytes // 8) * 8
        head = json.dumps({"arrays": places, "added": vocabulary.added}).encode()
        head += b" " * (-len(head) % 8)
        body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())
        return np.array([len(head)], np.int64).tobytes() + head + body

    @staticmethod
    def mapped(path: str) -> Lexicon:
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int(np.frombuffer(view, np.int64, 1)[0])
        head = json.loads(view[8 : 8 + size])
        arrays = {k: np.frombuffer(view, t, n, 8 + size + at) for k, (t, n, at) in head["arrays"].items()}
        return Lexicon(Vocabulary(arrays, head["added"]))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of every word in the automaton, -1 for words it does not hold: all words step along their arcs at once."""
        v = self.vocabulary
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        body = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.full(len(sizes), v.root[0], np.int64)
        number = np.where(sizes > LONGEST, -1, 0)
        active = np.flatnonzero(number == 0)
        for k in range(LONGEST):
            active = active[sizes[active] > k]
            if len(active) == 0 or len(v.arc_key) == 0:
                break
            key = state[active] << 8 | body[begins[active] + k]
            at = np.minimum(np.searchsorted(v.arc_key, key), len(v.arc_key) - 1)
            hit = v.arc_key[at] == key
            number[active[~hit]] = -1
            active, at = active[hit], at[hit]
            state[active] = v.arc_to[at]
            number[active] += v.arc_out[at]
        return np.where((number >= 0) & (v.final[state] > 0) & (len(v.arc_key) > 0), number, -1)

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where a word's ids begin in it, how many it has): from the automaton, added tokens, or merged."""
        v = self.vocabulary
        number = self.numbers(words)
        unseen = np.flatnonzero(number < 0)
        texts = words.take(pa.array(unseen))
        added = pc.index_in(texts, pa.array(list(v.added_bytes), pa.binary())).fill_null(-1).to_numpy()
        fresh, counts = merged(texts, v)
        ends = np.append(0, v.word_ends)
        begin, size = ends[number], (ends[number + 1] - ends[number]) if len(number) else ends[:0]
        own = np.cumsum(counts) - counts + len(v.word_ids)
        begin[unseen], size[unseen] = own, counts
        tokens = np.array(list(v.added_bytes.values()), np.int32)
        whole = added >= 0
        begin[unseen[whole]], size[unseen[whole]] = len(v.word_ids) + len(fresh) + added[whole], 1
        return np.concatenate([v.word_ids, fresh, tokens]), begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids) of every text."""
        made, counts = [], np.zeros(len(texts), np.int64)
        for row, rows, body, ends in windows(texts):
            words = Words(body, ends, self.vocabulary)
            pool, begin, size = self.ids_of(words.distinct)
            sizes = size[words.codes]
            made.append(pool[ranges(begin[words.codes], sizes)])
            total = np.append(0, np.cumsum(sizes))
            bounds = np.append(0, np.cumsum(words.text_words))
            counts[row : row + rows] += np.diff(total[bounds])
        return np.concatenate(made) if made else np.zeros(0, np.int32), counts

    def decode(self, ids: np.ndarray) -> str:
        v = self.vocabulary
        ends = v.string_ends[ids]
        begins = np.where(ids > 0, v.string_ends[ids - 1], 0)
        return v.string_bytes[ranges(begins, ends - begins)].tobytes().decode("utf-8", "replace")


def share(spark: SparkSession, data: bytes, label: str) -> str:
    """Write a file into the shared folder and have Spark hand it to all executors; its name for `SparkFiles.get`."""
    jvm, name = spark.sparkContext._jvm, f"{label}-{uuid.uuid4().hex}"
    place = f"{shared_folder(spark)}/gridloom/{name}"
    path = jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    for a in range(0, len(data), 1 << 22):
        out.write(bytearray(data[a : a + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _counted(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Lexicon.mapped(SparkFiles.get(name)).vocabulary
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in parts(batches, 0, PART_BYTES):
            for _, _, body, ends in windows(batch.column(0)):
                words = Words(body, ends, vocabulary)
                table = pa.table({"word": words.distinct, "n": pa.array(np.bincount(words.codes, minlength=len(words.distinct)))})
                held.append(table.filter(pc.less_equal(pc.binary_length(table["word"]), LONGEST)))
            if sum(len(t) for t in held) > HELD_WORDS:
                held = [summed()]
                if len(held[0]) > HELD_WORDS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return run


def frequent_words(texts: DataFrame, shared: str, words: int = WORDS) -> list[bytes]:
    """The most frequent words of the one text column, at most `words`, that occur twice or more: counted over all texts.

    The driver sees a histogram of counts (eight classes per doubling) and the words above the class it picks.
    """
    counted = texts.mapInArrow(_counted(shared), StructType([StructField("word", BinaryType()), StructField("n", LongType())]))
    total = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    level = F.floor(F.log2("n") * 8)
    held = 0
    least = None
    for row in sorted(total.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += row["count"]
        if held > words:
            break
        least = row["level"]
    if least is None:
        return []
    return total.where(level >= least).select("word").toArrow()["word"].to_pylist()


def build(docs: DataFrame, path: str, text_col: str = "text", words: int = WORDS) -> str:
    """Count the words of `docs`, compile the lexicon for the tokenizer file and share it; the name goes to `encode` and `decode`."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(path)
    bare = share(spark, Lexicon.pack(vocabulary, []), "vocabulary")
    common = frequent_words(docs.select(text_col), bare, words)
    return share(spark, Lexicon.pack(vocabulary, common), "lexicon")


def _encoded(name: str, at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon.mapped(SparkFiles.get(name))
        for batch in parts(batches, at, PART_BYTES):
            ids, counts = lexicon.encode(batch.column(at))
            packed = ids.astype("<u4").tobytes()
            offsets = np.append(0, np.cumsum(counts) * 4)
            column = pa.array([packed[a:b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, column, pa.array(counts)], names=[*[batch.schema.names[k] for k in keep], "ids", "n_tokens"])

    return run


def encode(docs: DataFrame, lexicon: str, text_col: str = "text") -> DataFrame:
    """`docs` with `ids` (unsigned 32-bit little-endian numbers, packed) and `n_tokens`."""
    keep = [k for k, f in enumerate(docs.schema.fields) if f.name not in ("ids", "n_tokens")]
    fields = [docs.schema.fields[k] for k in keep] + [StructField("ids", BinaryType()), StructField("n_tokens", LongType())]
    return docs.mapInArrow(_encoded(lexicon, docs.columns.index(text_col), keep), StructType(fields))


def _decoded(name: str, at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon.mapped(SparkFiles.get(name))
        for batch in parts(batches, at, 4 * PART_BYTES):
            texts = [lexicon.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)) for x in batch.column(at).to_pylist()]
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*[batch.schema.names[k] for k in keep], "decoded"])

    return run


def decode(coded: DataFrame, lexicon: str) -> DataFrame:
    """`coded` with `decoded`, the text that its packed `ids` stand for; bytes that are no UTF-8 become U+FFFD."""
    keep = [k for k, f in enumerate(coded.schema.fields) if f.name != "decoded"]
    fields = [coded.schema.fields[k] for k in keep] + [StructField("decoded", StringType())]
    return coded.mapInArrow(_decoded(lexicon, coded.columns.index("ids"), keep), StructType(fields))
