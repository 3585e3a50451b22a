"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Normaliser: a space in front of the text, every space as the word mark; with it texts fall into units (a word and the mark
before it) that no piece crosses. Pieces: a trie of arcs, one path per vocabulary piece; bytes: one arc per byte of a character
that no piece has. A state is a place in the unit and the piece that ended there. Two pieces may follow one another at weight 0
if the merges of the vocabulary, run on both together, leave them as they are, and at infinite weight otherwise; a
fallback arc weighs 1 a byte and is only open where no piece fits. Composed with a unit, the tropical shortest path is the
one segmentation whose neighbours all agree, which is the library's. Arcs, merges and the ends of pieces are compiled into
arrays once, on the driver; the distinct units of a batch are composed together, place by place.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.slices import ranges
from gridloom.llm.texts import parts

MARK = "▁"
FOREVER = 10**9
KEPT_PAIRS = 1_000_000  # remembered answers; forgotten together beyond that
KEPT_NUMBERED = 1 << 19  # the same for pairs by number
PLACES = 1 << 18  # composed at once
LONG = 1024  # longer units are composed one by one
CODES = 0x110000


def merged(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """The vocabulary's merges run on a sequence: best rank first, leftmost among equals."""
    symbols = list(symbols)
    left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(symbols) and (both := symbols[i] + symbols[j]) in rank:
            heapq.heappush(heap, (rank[both], i, both))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if symbols[i] is None or (j := right[i]) >= len(symbols) or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j] = both, None
        right[i] = right[j]
        if right[i] < len(symbols):
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [s for s in symbols if s is not None]


class Table:
    """Numbers by keys (both from 0 up) in arrays with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        bits = max(4, int(2 * max(len(keys), room)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.held = 0
        self.add(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        self.held += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            lost = self.keys[slots] != keys
            self.values[slots[~lost]] = values[~lost]
            keys, values, slots = keys[lost], values[lost], (slots[lost] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 without one."""
        slots = self._slots(keys)
        there = self.keys[slots]
        same = there == keys
        out = np.where(same, self.values[slots], np.int32(-1))
        rest = np.flatnonzero(~same & (there >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.values[slots[rest[same]]]
            rest = rest[~same & (there >= 0)]
        return out


class PieceFst:
    """The compiled transducer of a SentencePiece model with byte fallback and an identity normaliser."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, int] = {}
        self.bytes_at = np.zeros(256, np.int64)
        self.pieces: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            out = b""
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                out = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
                out = piece.replace(MARK, " ").encode()
            self.pieces.append(out)
        ranks = {score: n for n, score in enumerate(sorted(set(self.rank.values())))}
        self.rank = {p: ranks[r] for p, r in self.rank.items() if len(p) > 1}
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.spines: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._compile()

    def _compile(self) -> None:
        """Arcs, merges and ends of pieces by number; a character of a piece that is no piece itself has a number without an id."""
        names = list(dict.fromkeys([*self.ids, *sorted({c for p in self.ids for c in p})]))
        number = {p: n for n, p in enumerate(names)}
        self.symbol_ids = np.array([self.ids.get(p, -1) for p in names], np.int64)
        self.born = np.array([self.rank[p] if len(p) > 1 else -1 for p in names], np.int64)
        states = {"": 0} | {p: n for n, p in enumerate(sorted(self.starts), 1)}
        keys = [states[p[:-1]] * CODES + ord(p[-1]) for p in states if p]
        self.arcs = Table(np.array(keys, np.int64), np.array([n for p, n in states.items() if p], np.int64))
        self.final = np.full(len(states), -1, np.int32)
        for p in self.ids:
            if len(p) == 1 or self._parts(p):
                self.final[states[p]] = number[p]
        joins = {number[p[:k]] * len(names) + number[p[k:]]: r for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.merges = Table(np.array([*joins], np.int64), np.array([*joins.values()], np.int64))
        self.ends = []
        for side in (0, 1):
            spines = [self._spine(p, side) for p in names]
            counts = np.array([len(x) for x in spines], np.int64)
            own, ranks = (np.array([y[i] if i else number[y[i]] for x in spines for y in x], np.int64) for i in (0, 1))
            self.ends.append((np.cumsum(counts) - counts, counts, own, ranks))
        self.spines.clear()  # needed again for long units only
        self.numbered: Table | None = None

    def _spine(self, piece: str, side: int) -> list[tuple[str, int]]:
        """Symbols at the left (0) or right (1) end of the piece while it is made, each with the rank of the merge that ends it."""
        found = self.spines.get((piece, side))
        if found is None:
            found, own = [(piece, FOREVER)], piece
            while len(own) > 1 and (parts := self._parts(own)):
                found.append((parts[side], self.rank[own]))
                own = parts[side]
            self.spines[piece, side] = found
        return found

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece, found by running all merges but that one."""
        found = self.spines.get((piece, 2))
        if found is None:
            without = self.rank.pop(piece)
            parts = merged(list(piece), self.rank)
            self.rank[piece] = without
            found = tuple(parts) if len(parts) == 2 else ()
            self.spines[piece, 2] = found
        return found or None

    def agree(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b apart when both stand side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            found = True
            for x, x_ends in self._spine(a, 1):
                for y, y_ends in self._spine(b, 0):
                    r = self.rank.get(x + y)
                    # x is there until a merge to its left takes it (which comes first among equals), y until one to its right does
                    if r is not None and r < x_ends and r <= y_ends and self._born(x) < y_ends and self._born(y) < x_ends:
                        found = False
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def _born(self, piece: str) -> int:
        return self.rank[piece] if len(piece) > 1 else -1

    def shortest_path(self, unit: str) -> list[int]:
        """Ids of a unit that holds a word mark at its start at most."""
        n = len(unit)
        weight: list[int] = [0] + [FOREVER] * n
        ended: list[str | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        for i in range(n):
            if weight[i] == FOREVER:
                continue
            fits = unit[i] in self.ids
            j = i + 1
            while j <= n and (piece := unit[i:j]) in self.starts:
                if piece in self.ids and weight[i] < weight[j] and (ended[i] is None or self.agree(ended[i], piece)):
                    if len(piece) == 1 or self._parts(piece):
                        weight[j], ended[j], back[j] = weight[i], piece, i
                j += 1
            if not fits and weight[i] + (size := len(unit[i].encode())) < weight[i + 1]:
                weight[i + 1], ended[i + 1], back[i + 1] = weight[i] + size, None, i
        path = []
        at = n
        while at:
            i, piece = back[at], ended[at]
            path.append([self.ids[piece]] if piece else self.bytes_at[list(unit[i:at].encode())].tolist())
            at = i
        return [x for part in reversed(path) for x in part]

    def _agreeing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`agree` for pairs of numbers: every symbol at the right end of a meets every one at the left end of b."""
        (ly, ny, ys, y_ranks), (lx, nx, xs, x_ranks) = self.ends
        counts = nx[a] * ny[b]
        pair = np.repeat(np.arange(len(a)), counts)
        i, j = np.divmod(ranges(np.zeros(len(a), np.int64), counts), ny[b][pair])
        i, j = i + lx[a][pair], j + ly[b][pair]
        x, y, x_ends, y_ends = xs[i], ys[j], x_ranks[i], y_ranks[j]
        r = self.merges.get(x * len(self.symbol_ids) + y)
        apart = (r >= 0) & (r < x_ends) & (r <= y_ends) & (self.born[x] < y_ends) & (self.born[y] < x_ends)
        return np.bincount(pair[apart], minlength=len(a)) == 0

    def agree_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`agree` for pairs of numbers, with answers remembered."""
        if self.numbered is None or self.numbered.held > KEPT_NUMBERED:
            self.numbered = Table(np.zeros(0, np.int64), np.zeros(0, np.int64), 2 * KEPT_NUMBERED)
        keys = a.astype(np.int64) * len(self.symbol_ids) + b
        out = self.numbered.get(keys)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_inverse=True)
            found = self._agreeing(*np.divmod(new, len(self.symbol_ids))).astype(np.int64)
            if self.numbered.held + len(new) <= 2 * KEPT_NUMBERED:
                self.numbered.add(new, found)
            out[missing] = found[at]
        return out > 0

    def _compose(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in the unit, node before, node after, piece or -1 for bytes) of every arc, by place. Node k lies behind character k."""
        sizes = np.diff(np.append(starts, len(flat)))
        ends = np.repeat(starts + sizes, sizes)
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        at = np.arange(len(flat))
        state = np.zeros(len(flat), np.int64)
        found, depth = [], 0
        while len(at):
            state = self.arcs.get(state * CODES + flat[at + depth]).astype(np.int64)
            piece = np.where(state >= 0, self.final[state], -1)
            arc = piece >= 0
            found.append((at[arc], at[arc] + depth, piece[arc]))
            if depth == 0:
                found.append((at[~arc], at[~arc], piece[~arc]))
            depth += 1
            on = (state >= 0) & (at + depth < ends[at])
            at, state = at[on], state[on]
        before, after, piece = (np.concatenate(x) for x in zip(*found))
        place = place[before].astype(np.uint16)
        order = np.argsort(place, kind="stable")
        return place[order], before[order] - 1, after[order], piece[order]

    def shortest_paths(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each unit) of units of `LONG` characters at most, given as code points one after another."""
        size = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
        place, before, after, piece = self._compose(flat, starts)
        weight = np.full(len(flat), FOREVER, np.int64)
        ended, back = np.full(len(flat), -1, np.int32), np.zeros(len(flat), np.int64)
        cost = np.where(piece < 0, size[after], 0)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(place))))
        for p, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            i, j, own, w = before[lo:hi], after[lo:hi], piece[lo:hi], cost[lo:hi]
            if p:
                w = w + weight[i]
                better = np.flatnonzero(w < weight[j])
                i, j, own, w = i[better], j[better], own[better], w[better]
                last = ended[i]
                both = np.flatnonzero((last >= 0) & (own >= 0))
                apart = both[~self.agree_all(last[both], own[both])]
                if len(apart):
                    i, j, own, w = (np.delete(x, apart) for x in (i, j, own, w))
            weight[j], ended[j], back[j] = w, own, i
        used = np.zeros(len(flat), bool)
        at, first = np.append(starts[1:], len(flat)) - 1, starts
        while len(at):
            used[at] = True
            at = back[at]
            on = at >= first
            at, first = at[on], first[on]
        nodes = np.flatnonzero(used)
        symbols = ended[nodes]
        fell = symbols < 0
        counts = np.where(fell, size[nodes], 1)
        ids = np.repeat(self.symbol_ids[symbols], counts)
        if fell.any():
            text = flat[nodes[fell]].astype("<u4").tobytes().decode("utf-32-le")
            ids[np.repeat(fell, counts)] = self.bytes_at[np.frombuffer(text.encode(), np.uint8)]
        per_place = np.zeros(len(flat), np.int64)
        per_place[nodes] = counts
        return ids, np.add.reduceat(per_place, starts)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word), with a mark in front of each word; words hold no mark or space, an empty one is a mark."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        order = np.argsort(sizes, kind="stable")
        sizes, sorted_words = sizes[order], words.take(pa.array(order))
        short = int(np.searchsorted(sizes, LONG, side="right"))
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        block = np.cumsum(sizes[:short]) // PLACES
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            joined = pc.binary_join(pa.ListArray.from_arrays([0, b - a], sorted_words[a:b]), MARK)[0].as_py()
            flat = np.frombuffer((MARK + joined).encode("utf-32-le"), "<u4").astype(np.int64)
            for out, x in zip((ids, counts), self.shortest_paths(flat, np.cumsum(sizes[a:b]) - sizes[a:b])):
                out.append(x)
        for word in sorted_words[short:].to_pylist():
            ids.append(np.array(self.shortest_path(MARK + word), np.int64))
            counts.append(np.array([len(ids[-1])]))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        starts, there = np.cumsum(counts) - counts, np.argsort(order)
        return ids[ranges(starts[there], counts[there])], counts[there]

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode(pa.array([text], pa.string()))[0].tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after another, and where each text ends.

        Of n marks and the word after them the word's merges come first, since all merges of marks have the lowest rank: the marks
        before the word's own are merged among themselves, with that one if the word leaves it alone.
        """
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        flat, lengths = self.words(words.dictionary)
        starts = np.cumsum(lengths) - lengths
        begins, counts = starts[codes], lengths[codes]
        empty = pc.index(words.dictionary, "").as_py()
        if empty >= 0:  # runs of spaces, spaces at ends, texts without a character
            row = np.repeat(np.arange(len(texts)), np.diff(offsets))
            blank = codes == empty
            counts[blank] = 0
            blank &= (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)[row]
            at = np.flatnonzero(blank)
            opens = np.diff(at, prepend=-2) != 1
            opens |= np.diff(row[at], prepend=-1) != 0
            first = at[opens]
            marks = np.diff(np.append(np.flatnonzero(opens), len(at)))
            behind = first + marks
            led = np.flatnonzero(behind < offsets[row[first] + 1])  # runs with a word after them
            led = led[flat[begins[behind[led]]] == self.ids[MARK]]
            begins[behind[led]] += 1
            counts[behind[led]] -= 1
            marks[led] += 1
            kinds, kind = np.unique(marks, return_inverse=True)
            runs = [[self.ids[p] for p in merged([MARK] * n, self.rank)] for n in kinds.tolist()]
            sizes = np.array([len(r) for r in runs], np.int64)
            begins[first], counts[first] = (len(flat) + np.cumsum(sizes) - sizes)[kind], sizes[kind]
            flat = np.concatenate((flat, np.array([x for r in runs for x in r], np.int64)))
        ids = flat.astype("<u4")[ranges(begins, counts)]
        return ids, np.concatenate(([0], np.cumsum(counts)))[offsets[1:]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts: pieces and bytes joined, the space that the normaliser put in front taken off."""
        if not hasattr(self, "table"):
            sizes = np.array([len(p) for p in self.pieces], np.int64)
            self.table = np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum(sizes) - sizes, sizes
        flat, starts, sizes = self.table
        body = flat[ranges(starts[ids], sizes[ids])].tobytes() if len(ids) else b""
        done = np.concatenate(([0], np.cumsum(sizes[ids])))[np.concatenate(([0], ends))].tolist()
        return [body[a + 1 : b] if b > a else b"" for a, b in zip(done, done[1:])]


def _encode(compiled: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = pickle.loads(compiled.value)
        for batch in parts(batches, 1, 8 << 20):
            ids, ends = fst.encode(batch.column(1))
            offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def _decode(compiled: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = pickle.loads(compiled.value)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            texts = [t.decode("utf-8", "replace") for t in fst.decode(ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _digest(compiled: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = pickle.loads(compiled.value)
        fallback = np.zeros(len(fst.pieces), np.int64)
        fallback[fst.bytes_at] = 1
        for batch in parts(batches, 1, 8 << 20):
            texts = pc.fill_null(batch.column(1), "")
            ids, ends = fst.encode(texts)
            decoded = fst.decode(ids, ends)
            begins = np.concatenate(([0], ends[:-1]))
            view = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            fell = np.concatenate(([0], np.cumsum(fallback[ids])))
            normal = pc.replace_substring(texts, MARK, " ").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ends - begins),
                    pa.array(fell[ends] - fell[begins]),
                    pa.array(crc, pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array([a == b for a, b in zip(decoded, normal)]),
                ],
                ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return run


def _compiled(df: DataFrame, model_file: str) -> Broadcast:
    """The transducer for all tasks, with its class by value: executors need neither the model's file nor this package."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(PieceFst(model_file)))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document. NULL and empty texts have no ids; a literal word mark counts as a space, as in the library."""
    return _source(docs, id_col, text_col).mapInArrow(_encode(_compiled(docs, model_file)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; NULL and empty lists give empty texts, bytes that are no UTF-8 the replacement mark."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_compiled(encoded, model_file)), "doc_id long, text string")


def digest(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and crc32 of its ids, how many are bytes, the SHA-256 of the decoded text and whether that is the text."""
    schema = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return _source(docs, id_col, text_col).mapInArrow(_digest(_compiled(docs, model_file)), schema)
