"""Phrase collocations per language by direct-address tiles of frequency-ranked ids.

Texts become sequences of local word codes, stored in slices of bounded size with their own small dictionaries. Words are
summed over all slices; those frequent enough get dense ids by falling frequency, so that most pairs of neighbours fall
into the first tiles of the id plane. A task counts the leading square of tiles in one dense array (`bincount`) and all
other tiles as sorted coordinates with counts; both leave as packed messages by tile. Frequent pairs get dense ids by
falling frequency in turn and meet the word behind them in a plane of (pair, word), which counts the phrases of three.

Nothing is counted by text: a slice asks for the ids of its own words (a join) and pairs (packed keys by tile, answered
from a sorted stream), so neither vocabulary nor pairs are ever held as a whole. Codes are stored in short parts, in as few
bytes each as the largest needs, and meet their answers in a sorted stream, so that no row of Spark's is large.

Rules for odd rows: a NULL text is empty and has no words; a NULL language is `und`; repeated rows count as often as they
stand there; ids are not read, so NULL and repeated ones are harmless; other columns are ignored. A text of any length is
cut into slices that share the words a phrase may reach over the cut. Ids are below 2^31 (words) and 2^33 (pairs);
`frequent_ids` raises beyond.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from gridloom.llm.ppm import COUNTED, from_planes, packed, planes, unpacked
from gridloom.llm.slices import bucket_of, by_bucket
from gridloom.llm.texts import lean, parts
from gridloom.session import stored

SLICE_BYTES = 2 << 20  # text of a slice
REACH = 2  # words a phrase goes on after its first
PART_CODES = 1 << 14  # codes of a slice in one row
HELD_WORDS = 1 << 19  # answered words a task holds before it hands them on
DENSE = 1024  # ids of the leading square that is counted in one array
LOW = np.uint64(6)  # a tile is 64 x 64 ids
HELD_KEYS = 1 << 19  # keys a task holds before it sums them
HELD_CELLS = 1 << 19  # different cells a task holds before it hands them on
BUCKET_WORDS = 1 << 22  # words of the corpus per bucket of tiles
MOST_WORDS, MOST_PAIRS = 1 << 31, 1 << 33
CLASSES = 64  # classes of scores per doubling
U = np.uint64
CELL = COUNTED  # key, n
NUMBERED = np.dtype([("key", "u8"), ("id", "i8")])

WORD, BLANK, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[list(b".,;:!?\n\x0b\x0c\r")] = END
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
OUTSIDE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
NEXT_WORD = rb"[ \t.,;:!?\n\x0b\x0c\r]*[^ \t.,;:!?\n\x0b\x0c\r]*"


def text_windows(texts: pa.Array) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """(bytes, how many of them are its own, ends of its texts): a part of texts, or windows of one long text with the next words behind each."""
    values = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
    if len(values) == 1 and len(values[0]) > SLICE_BYTES:
        body, start = values[0], 0
        ahead = re.compile(NEXT_WORD * REACH)
        while start < len(body):
            cut = OUTSIDE.search(body, start + SLICE_BYTES)
            end = cut.start() if cut else len(body)
            seen = ahead.match(body, end).end()
            yield body[start:seen], end - start, np.array([seen - start])
            start = end
    else:
        ends = np.cumsum([len(v) + 1 for v in values])
        yield b"\n".join(values), int(ends[-1]) if len(ends) else 0, ends


def sequence(body: bytes, own: int, ends: np.ndarray, langs: list[str]) -> dict:
    """A slice: `codes` of its words in order, -1 where a piece ends; `own` of them may begin a phrase; its dictionary with counts."""
    raw = LOWER[np.frombuffer(body, np.uint8)]
    kind = KIND[raw]
    inside = kind == WORD
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())]).dictionary_encode()
    names, rows = np.unique(np.array(langs, object), return_inverse=True) if len(langs) else (np.array([]), np.zeros(0, np.int64))
    lang = rows[np.searchsorted(ends, starts, side="right")]
    both, codes = np.unique(words.indices.to_numpy().astype(np.int64) * max(1, len(names)) + lang, return_inverse=True)
    counts = np.bincount(codes[starts < own], minlength=len(both))
    breaks = np.diff(np.append(0, np.cumsum(kind == END, dtype=np.int32)[starts])) > 0 if len(starts) else np.zeros(0, bool)
    place = np.arange(len(starts)) + np.cumsum(breaks)
    out = np.full(int(place[-1]) + 1 if len(place) else 0, -1, np.int32)
    out[place] = codes
    owned = int((starts < own).sum())
    return {
        "codes": out, "own": int(place[owned - 1]) + 1 if owned else 0, "n": counts,
        "word": words.dictionary.take(pa.array(both // max(1, len(names)))).cast(pa.string()), "lang": pa.array(names.tolist(), pa.string()).take(pa.array(both % max(1, len(names)))),
    }


def narrow(values: np.ndarray) -> bytes:
    """Numbers from -1 on, one more of each, as planes of as many bytes as the largest needs; their count of planes first."""
    up = (values + 1).astype("<u4")
    width = max(1, (int(up.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + up.view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def from_narrow(data: bytes) -> np.ndarray:
    out = np.full((len(data) - 1) // data[0], -1, np.int64)
    for k, plane in enumerate(np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)):
        out += plane.astype(np.int64) << (8 * k)
    return out


def code_parts(codes: np.ndarray, own: int) -> list[tuple[int, bytes]]:
    """(how many codes are its own, they and those a phrase may reach behind them) for every part of a slice."""
    return [(min(PART_CODES, own - a), narrow(codes[a : min(a + PART_CODES, own) + REACH])) for a in range(0, own, PART_CODES)]


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every slice its parts, `at` their number, and its words, `at` their code."""
    number = TaskContext.get().partitionId() << 32
    for batch in parts(batches, 1, SLICE_BYTES):
        langs = pc.fill_null(batch.column(0), "und").to_pylist()
        for body, own, ends in text_windows(batch.column(1)):
            s = sequence(body, own, ends, langs)
            found = code_parts(s["codes"], s["own"])
            k, m = len(found), len(s["n"])
            stretches = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())]
            words = [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), s["lang"], s["word"], pa.array(s["n"], pa.int64())]
            for size, columns in ((k, stretches), (m, words)):
                places = [pa.array(np.full(size, number)), pa.array(np.arange(size, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*places, *columns], names=["slice", "at", "own", "codes", "lang", "word", "n"])
            number += 1


SEQUENCE = StructType([
    StructField("slice", LongType()), StructField("at", IntegerType()), StructField("own", IntegerType()), StructField("codes", BinaryType()),
    StructField("lang", StringType()), StructField("word", StringType()), StructField("n", LongType()),
])


def frequent_ids(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The rows with dense ids 0, 1, ... along `order`, stored. The driver sees one count per partition."""
    parts_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts_, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    if sum(c["count"] for c in counts) >= most:
        raise ValueError(f"ids reach {most}")
    offsets, total = {}, 0
    for c in counts:
        offsets[c["p"]] = total
        total += c["count"]
    if not offsets:
        return placed.withColumn("id", F.col("at")).drop("at")
    starts = rows.sparkSession.createDataFrame(list(offsets.items()), "p long, offset long")
    numbered = placed.withColumn("p", part).join(F.broadcast(starts), "p")  # one row per shuffle partition
    return numbered.withColumn("id", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "p", "offset")


def cell_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of a pair as one number, tile first: 27 bits of the left id, 25 of the right, then 6 and 6 of the place in the tile."""
    a, b, low = left.astype(U), right.astype(U), U(63)
    return ((a >> LOW) << U(37)) | ((b >> LOW) << U(12)) | ((a & low) << LOW) | (b & low)


def cell_ids(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = U(63)
    left = ((key >> U(37)) << LOW) | ((key >> LOW) & low)
    right = (((key >> U(12)) & U((1 << 25) - 1)) << LOW) | (key & low)
    return left.astype(np.int64), right.astype(np.int64)


def tile_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(key >> U(12), buckets)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates with their counts added."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[edges], np.add.reduceat(n, edges) if len(edges) else n


class Tiles:
    """Counts of (left, right): a dense array for the leading square, sorted coordinates for all other tiles."""

    def __init__(self):
        self.square = np.zeros(DENSE * DENSE, np.int64)
        self.pending: list[np.ndarray] = []
        self.places: list[np.ndarray] = []  # in the square, not yet counted
        self.key, self.n = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        leading = (left < DENSE) & (right < DENSE)
        self.places.append((left[leading] * DENSE + right[leading]).astype(np.int32))
        self.pending.append(cell_keys(left[~leading], right[~leading]))
        if sum(map(len, self.pending)) >= HELD_KEYS or sum(map(len, self.places)) >= HELD_KEYS:
            self.sum_up()

    def sum_up(self) -> None:
        if self.places:
            self.square += np.bincount(np.concatenate(self.places), minlength=DENSE * DENSE)
            self.places = []
        key = np.sort(np.concatenate([np.zeros(0, U), *self.pending]))
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(edges, len(key)))
        self.key, self.n = summed(np.concatenate([self.key, key[edges]]), np.concatenate([self.n, n]))
        self.pending = []

    def full(self) -> bool:
        return len(self.key) >= HELD_CELLS

    def cells(self) -> np.ndarray:
        """All counts so far, in the form of coordinates; counting begins anew."""
        self.sum_up()
        place = np.flatnonzero(self.square)
        out = np.empty(len(place) + len(self.key), CELL)
        out["key"] = np.append(cell_keys(place // DENSE, place % DENSE), self.key)
        out["n"] = np.append(self.square[place], self.n)
        self.square[:] = 0
        self.key, self.n = np.zeros(0, U), np.zeros(0, np.int64)
        return out[np.argsort(out["key"])]


def numbered(rows: np.ndarray) -> bytes:
    """NUMBERED rows in the order of their keys, as planes of key differences and of ids."""
    return planes(np.diff(rows["key"], prepend=U(0))) + planes(np.ascontiguousarray(rows["id"]))


def from_numbered(data: bytes) -> np.ndarray:
    rows = np.zeros(len(data) // NUMBERED.itemsize, NUMBERED)
    rows["key"] = np.cumsum(from_planes(data[: 8 * len(rows)], U), dtype=U)
    rows["id"] = from_planes(data[8 * len(rows) :], np.int64)
    return rows


def _message(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([packed(r[1]) for r in rows], pa.binary())], names=["bucket", "data"])


def pair_places(codes: np.ndarray) -> np.ndarray:
    """Places at which two known words of one piece stand side by side."""
    known = codes >= 0
    return np.flatnonzero(known[:-1] & known[1:])


PART = "slice long, at int, own int, data binary"


def part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, int | None, bytes]]:
    """The PART rows of batches one by one."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(column[row].as_py() for column in batch.columns)


def answered(parts_: DataFrame, answers: DataFrame, partitions: int) -> DataFrame:
    """PART rows by slice: its answers first, which have no `at`, then its parts."""
    both = parts_.unionByName(answers.select("slice", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("own"), "data"))
    return both.repartition(partitions, "slice").sortWithinPartitions("slice", F.col("at").asc_nulls_first())


def _count_pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for _, _, own, data in part_rows(batches):
            codes = from_narrow(data)
            at = pair_places(codes)
            at = at[at < own]
            tiles.add(codes[at], codes[at + 1])
            if tiles.full():
                yield _dealt(tiles, buckets)
        yield _dealt(tiles, buckets)

    return run


def _dealt(tiles: Tiles, buckets: int) -> pa.RecordBatch:
    cells = tiles.cells()
    return _message([(b, rows) for _, b, rows in by_bucket(0, tile_bucket(cells["key"], buckets), cells)])


def _merged(least: int):
    """Messages of one bucket after another, in order: cells are summed as they come and leave if frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        key, n = np.zeros(0, U), np.zeros(0, np.int64)

        def add() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([key, *[h["key"] for h in held]]), np.concatenate([n, *[h["n"].astype(np.int64) for h in held]]))

        def frequent() -> pa.RecordBatch:
            some = n >= least
            left, right = cell_ids(key[some])
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n[some])], names=["l", "r", "n"])

        for batch in batches:
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if b != bucket and bucket is not None:
                    key, n = add()
                    yield frequent()
                    held, key, n = [], np.zeros(0, U), np.zeros(0, np.int64)
                bucket = b
                held.append(unpacked(data))
                if sum(map(len, held)) > max(len(key) // 2, 1 << 18):
                    key, n = add()
                    held = []
        if bucket is not None:
            key, n = add()
            yield frequent()

    return run


def frequent_cells(messages: DataFrame, partitions: int, least: int) -> DataFrame:
    """(l, r, n) of all cells counted `least` times or more, from (bucket, data) messages."""
    ordered = messages.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(lean(_merged(least)), "l long, r long, n long")


def _requests(buckets: int):
    def asked(number: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        key = np.unique(np.concatenate(keys))
        rows = list(by_bucket(number, tile_bucket(key, buckets), key))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([planes(np.diff(r[2], prepend=U(0))) for r in rows], pa.binary())],
            names=["bucket", "slice", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys = None, []
        for number, _, _, data in part_rows(batches):
            if number != current and keys:
                yield asked(current, keys)
                keys = []
            codes = from_narrow(data)
            at = pair_places(codes)
            current = number
            keys.append(cell_keys(codes[at], codes[at + 1]))
        if keys:
            yield asked(current, keys)

    return run


def _numbered(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, NUMBERED)
            rows["key"] = cell_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            rows["id"] = batch.column(2).to_numpy()
            rows = rows[np.argsort(rows["key"])]
            found = list(by_bucket(0, tile_bucket(rows["key"], buckets), rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in found], pa.int64()), pa.nulls(len(found), pa.int64()), pa.array([numbered(r[2]) for r in found], pa.binary())], names=["bucket", "slice", "data"]
            )

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In every bucket the numbered pairs come first (no slice), then the requests; each gets the pairs it asked for that exist."""
    bucket, held, known = None, [], None
    for batch in batches:
        slices, found = [], []
        for b, number, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if b != bucket:
                bucket, held, known = b, [], None
            if number is None:
                held.append(from_numbered(data))
                continue
            if known is None:
                known = np.concatenate([np.zeros(0, NUMBERED), *held])
                known, held = known[np.argsort(known["key"])], []
            key = np.cumsum(from_planes(data, U), dtype=U)
            if len(known):
                at = np.minimum(np.searchsorted(known["key"], key), len(known) - 1)
                hits = known[at[known["key"][at] == key]]
                if len(hits):
                    slices.append(number)
                    found.append(numbered(hits))
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(found, pa.binary())], names=["slice", "data"])


def _count_triples(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        current, held, pairs = None, [], None
        for slice_, part, own, data in part_rows(batches):
            if slice_ != current:
                current, held, pairs = slice_, [], None
            if part is None:
                held.append(from_numbered(data))
                continue
            if pairs is None:
                pairs = np.concatenate([np.zeros(0, NUMBERED), *held])
                pairs, held = pairs[np.argsort(pairs["key"])], []
            if not len(pairs):
                continue
            codes = from_narrow(data)
            at = pair_places(codes)
            key = cell_keys(codes[at], codes[at + 1])
            place = np.minimum(np.searchsorted(pairs["key"], key), len(pairs) - 1)
            number = np.full(len(codes) + 1, -1, np.int64)
            number[at] = np.where(pairs["key"][place] == key, pairs["id"][place], -1)
            begin = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
            begin = begin[begin < own]
            tiles.add(number[begin], codes[begin + 2])
            if tiles.full():
                yield _dealt(tiles, buckets)
        yield _dealt(tiles, buckets)

    return run


def _word_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, code, id) rows in any order as one message per slice: planes of code differences, then of ids."""
    held, size = [], 0

    def handed() -> pa.RecordBatch:
        number, code, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((code, number))
        number, code, ids = number[order], code[order], ids[order]
        edges = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        data = [planes(np.diff(code[a:b], prepend=np.int32(0))) + planes(ids[a:b]) for a, b in zip(edges, np.append(edges[1:], len(number)))]
        return pa.RecordBatch.from_arrays([pa.array(number[edges]), pa.array(data, pa.binary())], names=["slice", "data"])

    for batch in batches:
        if batch.num_rows:
            held.append([column.to_numpy() for column in batch.columns])
            size += batch.num_rows
        if size >= HELD_WORDS:
            yield handed()
            held, size = [], 0
    if held:
        yield handed()


def _recoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local codes replaced by ids; -1 for rare words and ends of pieces."""
    current, held, table = None, [], None
    for slice_, part, own, data in part_rows(batches):
        if slice_ != current:
            current, held, table = slice_, [], None
        if part is None:
            half = len(data) // 2
            held.append((np.cumsum(from_planes(data[:half], np.int32)), from_planes(data[half:], np.int32)))
            continue
        if table is None:
            table = np.full(max((int(code[-1]) for code, _ in held), default=-1) + 2, -1, np.int64)  # the last place serves code -1 and all beyond
            for code, ids in held:
                table[code] = ids
            held = []
        ids = table[np.minimum(from_narrow(data), len(table) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([slice_]), pa.array([part], pa.int32()), pa.array([own], pa.int32()), pa.array([narrow(ids)], pa.binary())], names=["slice", "at", "own", "data"])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase counts from `least` occurrences; its score is that of its worst cut, floor(10^6 a^2 / (l r)). A phrase is left
    out if a longer one around it has at least `share` percent of its occurrences.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sequences = stored(texts.mapInArrow(lean(_sequences), SEQUENCE), "sequences")
    entries = sequences.where("own is null").select("slice", F.col("at").alias("code"), "lang", "word", "n")
    totals = stored(entries.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words_in_all = totals.agg(F.sum("total")).first()[0] or 0
    buckets = max(partitions, -(-int(words_in_all) // BUCKET_WORDS))

    counted = entries.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = frequent_ids(counted, [F.col("n").desc(), F.col("lang").asc(), F.col("word").asc()], MOST_WORDS)
    own_ids = entries.select("slice", "code", "lang", "word").join(words.select("lang", "word", F.col("id").cast("int").alias("id")), ["lang", "word"])
    replies = own_ids.select("slice", "code", "id").mapInArrow(lean(_word_answers), "slice long, data binary")
    asked = answered(sequences.where("own is not null").select("slice", "at", "own", F.col("codes").alias("data")), replies, partitions)
    coded = stored(asked.mapInArrow(lean(_recoded), PART), "coded")

    # stored, as placing them by rank reads them twice
    cells = stored(frequent_cells(coded.mapInArrow(lean(_count_pairs(buckets)), "bucket long, data binary"), partitions, least), "cells")
    pairs = frequent_ids(cells, [F.col("n").desc(), F.col("l").asc(), F.col("r").asc()], MOST_PAIRS)
    message = "bucket long, slice long, data binary"
    requests = coded.mapInArrow(lean(_requests(buckets)), message).unionByName(pairs.select("l", "r", "id").mapInArrow(lean(_numbered(buckets)), message))
    ordered = requests.repartition(partitions, "bucket").sortWithinPartitions("bucket", F.col("slice").asc_nulls_first())
    answers = ordered.mapInArrow(lean(_answers), "slice long, data binary")
    threes = answered(coded, answers, partitions).mapInArrow(lean(_count_triples(buckets)), "bucket long, data binary")
    triples = stored(frequent_cells(threes, partitions, least), "triples")
    return ranked_phrases(words, pairs, triples, totals, share, top)


def score(a: str, left: str, right: str) -> F.Column:
    """floor(10^6 a^2 / (l r)), exact: decimals of 38 digits hold the products."""
    d = "decimal(20,0)"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast(cast({a} as {d}) * cast({a} as {d}) as decimal(31,0))) div (cast({left} as {d}) * cast({right} as {d}))")


def leading(rows: DataFrame, classes: dict[str, F.Column], top: int) -> DataFrame:
    """Rows of each language down to the class that holds its rank `top`; classes fall along the ranking. Keeps the last
    sort of a language small: only counts per class meet before it."""
    marked, names = rows.withColumns(classes), list(classes)
    above = Window.partitionBy("lang").orderBy(*[F.col(n).desc() for n in names]).rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("lang", *names).count().withColumn("before", F.coalesce(F.sum("count").over(above), F.lit(0)))
    return marked.join(counts.where(F.col("before") < top).select("lang", *names), ["lang", *names]).drop(*names)


def ranked_phrases(words: DataFrame, pairs: DataFrame, triples: DataFrame, totals: DataFrame, share: int, top: int) -> DataFrame:
    """Scores, containment and ranks of words (id, lang, word, n), pairs (id, l, r, n) and triples (l: pair, r: word, n)."""

    def word(prefix: str) -> DataFrame:
        return words.select(F.col("id").alias(f"{prefix}_id"), F.col("word").alias(f"{prefix}_word"), F.col("n").alias(f"{prefix}_n"), F.col("lang"))

    first = pairs.select(F.col("id").alias("ij"), F.col("l").alias("i_id"), F.col("r").alias("j_id"), F.col("n").alias("ij_n"))
    second = pairs.select(F.col("id").alias("jk"), F.col("l").alias("j_id"), F.col("r").alias("k_id"), F.col("n").alias("jk_n"))
    threes = triples.select(F.col("l").alias("ij"), F.col("r").alias("k_id"), F.col("n").alias("a")).join(first, "ij").join(second, ["j_id", "k_id"])
    around = threes.select(F.col("ij").alias("id"), "a").unionByName(threes.select(F.col("jk").alias("id"), "a"))
    longest = around.groupBy("id").agg(F.max("a").alias("longer"))
    lone = pairs.join(longest, "id", "left").where(F.expr(f"longer is null or 100 * longer < {int(share)} * n"))
    two = lone.select(F.col("l").alias("i_id"), F.col("r").alias("j_id"), F.col("n").alias("a")).join(word("i"), "i_id").join(word("j").drop("lang"), "j_id")
    two = two.select("lang", F.concat_ws(" ", "i_word", "j_word").alias("phrase"), "a", F.col("i_n").alias("l"), F.col("j_n").alias("r")).withColumn("score", score("a", "l", "r"))
    three = threes.join(word("i"), "i_id").join(word("j").drop("lang"), "j_id").join(word("k").drop("lang"), "k_id")
    three = three.withColumn("cut1", score("a", "i_n", "jk_n")).withColumn("cut2", score("a", "ij_n", "k_n"))
    early = F.col("cut1") <= F.col("cut2")
    three = three.select(
        "lang", F.concat_ws(" ", "i_word", "j_word", "k_word").alias("phrase"), "a", F.when(early, F.col("i_n")).otherwise(F.col("ij_n")).alias("l"),
        F.when(early, F.col("jk_n")).otherwise(F.col("k_n")).alias("r"), F.least("cut1", "cut2").alias("score"),
    )
    scored = stored(two.unionByName(three), "phrases")
    rows = leading(scored, {"_s": F.floor(F.log2(F.col("score") + 1) * CLASSES)}, top)
    rows = leading(rows, {"_s": F.col("score"), "_a": F.floor(F.log2("a") * CLASSES)}, top)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").cast("long").alias("n"), "score")
