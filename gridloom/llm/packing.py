"""Best-fit packing of token pieces into fixed-length sequences: by partition first, then up a tree of merge rounds.

Tokenizing: words repeat, so each Arrow batch splits its texts at ASCII white space, encodes every distinct word once and
gathers the ids by position. That gives the ids of the whole text because this tokenizer's pre-tokens never span white
space. Packing: every batch of a partition packs its pieces best fit, longest first, and the bins that are nearly full are
emitted. A bin of at most half becomes one item of its fill; a fuller one that missed the bar is taken apart again, as its
items may still find partners that fill a sequence. A merge round deals the items to an eighth of the nodes of the round
before, by a hash so that every node meets all sizes, packs them best fit, emits what is nearly full by the same bar, and
hands its underfull bins on as items. A node takes `NODE_ITEMS` on average; when the nodes cannot become fewer, what the
tree leaves is placed by how many items there are of each fill, at most `capacity` numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.texts import lean, parts
from gridloom.session import stored

CLOSE_AT = 0.99  # share of a sequence above which a bin is emitted, at every level
FAN_IN = 8  # nodes that become one in a merge round
NODE_ITEMS = 1 << 18  # items of a node, on average
BATCH_BYTES = 16 << 20  # text tokenized at once
WORDS_AT_ONCE = 1 << 12  # distinct words given to the tokenizer in one call, whose answer is far larger than their ids
PLACES_AT_ONCE = 1 << 18  # words whose ids are gathered in one step
TOGETHER = 1 << 60  # sequence numbers of the bins that the whole table shares start here
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every item, and the bins' fill: longest first, each into the fullest bin that holds it; ties keep the order given."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some bin has exactly r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = free >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                free ^= 1 << rest
        else:
            rest, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        rest -= size
        if rest:
            by_rest[rest].append(b)
            free |= 1 << rest
    return bins, offsets, fill


def _encoded(tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths): the ids of all strings one after another, and how many each has."""
    ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for a in range(0, len(words), WORDS_AT_ONCE):
        own = [e.ids for e in tokenizer.encode_batch_fast(words.slice(a, WORDS_AT_ONCE).to_pylist(), add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
        ids.append(np.fromiter(chain.from_iterable(own), "<u4", int(lengths[-1].sum())))
    return np.concatenate(ids), np.concatenate(lengths)


def word_ids(tokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all texts one after another, each text followed by id 0, and where each text ends."""
    special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    low = pc.ascii_lower(pc.if_else(pa.array(special), "", texts))  # the normaliser lower-cases anyway; added tokens match before it
    low = pc.replace_substring_regex(low, r"([a-z])([.,])(\s)", r"\1 \2\3")  # a mark between letter and space is a pre-token of its own
    split = pc.ascii_split_whitespace(low)
    words = split.values.dictionary_encode()
    coded = [_encoded(tokenizer, words.dictionary), _encoded(tokenizer, texts.filter(pa.array(special)))]
    flat = np.concatenate([*(ids for ids, _ in coded), np.zeros(1, "<u4")])
    lengths = np.concatenate([*(n for _, n in coded), np.ones(1, np.int64)])
    starts = np.cumsum(lengths) - lengths
    ends = split.offsets.to_numpy()[1:].astype(np.int64)
    at = np.repeat(ends, 1 + special)  # before its end mark, a text with added tokens is one "word"
    extra = np.full(len(at), len(lengths) - 1, np.int64)
    mark = np.cumsum(1 + special) - 1
    direct = np.flatnonzero(special)
    extra[mark[direct] - 1] = len(words.dictionary) + np.arange(len(direct))
    index = np.insert(words.indices.to_numpy().astype(np.int64), at, extra)
    counts = lengths[index]
    done = np.cumsum(counts)
    ids = np.empty(int(counts.sum()), "<u4")
    for a in range(0, len(index), PLACES_AT_ONCE):
        b = slice(a, a + PLACES_AT_ONCE)
        begins = done[b] - counts[b]
        ids[begins[0] : done[b][-1]] = flat[np.repeat(starts[index[b]] - begins, counts[b]) + np.arange(begins[0], done[b][-1])]
    return ids, done[ends + mark]


def _pieces(tokenizer_file: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        for batch in parts(batches, 1, BATCH_BYTES):
            keys = batch.column(0)
            ids, ends = word_ids(tokenizer, pc.fill_null(batch.column(1), ""))
            begins = np.concatenate(([0], ends[:-1]))
            n = -(-(ends - begins) // capacity)
            doc = np.repeat(np.arange(len(ends)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.repeat(ends - begins, n) - start)
            view, first = memoryview(ids.view(np.uint8)), begins[doc] + start
            crc = [zlib.crc32(view[4 * s : 4 * (s + k)]) for s, k in zip(first.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids plus id 0, cut into pieces of `capacity`: (doc_id, piece, start, length, ids_crc32).

    NULL and empty texts give one piece that holds only id 0. Strings of added tokens in a text give their ids, as the
    library does by default.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(_pieces(tokenizer_file, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit of `counts` items by size as rows (size, rank, bin, offset), sorted.

    The items of a size from that rank to the next row's go one each into consecutive bins from `bin` on, at `offset`.
    Bins of equal fill are kept as runs, so there are few rows however many items.
    """
    rows: list[tuple[int, int, int, int]] = []
    by_rest: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some run of bins has exactly r left
    opened = 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = free >> size
            if fits:
                rest = size + (fits & -fits).bit_length() - 1
                first, n = by_rest[rest].pop()
                take = min(n, left)
                if take < n:
                    by_rest[rest].append((first + take, n - take))
                if not by_rest[rest]:
                    free ^= 1 << rest
            else:
                rest, first, take = capacity, opened, max(1, left // (capacity // size))
                opened += take
            rows.append((size, counts[size] - left, first, capacity - rest))
            left -= take
            rest -= size
            if rest:
                by_rest[rest].append((first, take))
                free |= 1 << rest
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def settled(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill of every item after best fit, with bins between a half and the bar taken apart."""
    bins, offsets, fill = best_fit(sizes.tolist(), capacity)
    fills = np.array(fill, np.int64)[bins]
    apart = np.flatnonzero((fills > capacity / 2) & (fills <= CLOSE_AT * capacity))
    bins[apart], offsets[apart], fills[apart] = len(fill) + np.arange(len(apart)), 0, sizes[apart]
    return bins, offsets, fills


def _pack_batches(capacity: int):
    """Pieces with their bin of one batch, its fill and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):  # one Arrow batch at a time: memory is bounded however large the partition
            bins, offsets, fills = settled(batch.column(3).to_numpy(), capacity)
            columns = [*batch.columns, pa.array((part << 36) + (k << 17) + bins), pa.array(offsets), pa.array(fills)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"])

    return run


def _merge(capacity: int, level: int):
    """One merge round at a node: (item, parent, offset in the parent, the parent's fill)."""

    def packed(items: np.ndarray, fills: np.ndarray, first: int) -> pa.RecordBatch:
        order = np.argsort(items)  # the same bins in whatever order the rows arrive
        bins, offsets, parents = settled(fills[order], capacity)
        return pa.RecordBatch.from_arrays([pa.array(items[order]), pa.array(first + bins), pa.array(offsets), pa.array(parents)], names=["item", "parent", "offset", "fill"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) + (TaskContext.get().partitionId() << 36)
        held: list[pa.RecordBatch] = []
        made = 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * NODE_ITEMS:
                table = pa.Table.from_batches(held)
                yield packed(table["item"].to_numpy(), table["fill"].to_numpy(), base + made)
                held, made = [], made + 2 * len(table)  # more numbers than bins and single items
        if held:
            table = pa.Table.from_batches(held)
            yield packed(table["item"].to_numpy(), table["fill"].to_numpy(), base + made)

    return run


def _ranked(capacity: int):
    """Items with this task's number and their rank in it among those of their fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            fill = batch.column(1).to_numpy()
            order = np.argsort(fill, kind="stable")
            sizes, begins, n = np.unique(fill[order], return_index=True, return_counts=True)
            rank = np.zeros(len(fill), np.int64)
            rank[order] = np.arange(len(fill)) - np.repeat(begins - seen[sizes], n)
            seen[sizes] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(fill), part)), pa.array(rank)], names=["item", "fill", "part", "rank"])

    return run


def _place(runs: np.ndarray):
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fill, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = runs[np.searchsorted(keys, (fill << 48) + rank, "right") - 1].reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(TOGETHER + at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names=["item", "parent", "offset"])

    return run


def _by_fill(items: DataFrame, capacity: int) -> DataFrame:
    """(item, parent, offset) of items packed together by how many there are of each fill; at most `capacity` counts reach the driver."""
    ranked = stored(items.select("item", "fill").mapInArrow(_ranked(capacity), "item long, fill long, part long, rank long"), "ranked-bins")
    counted = stored(ranked.groupBy("part", "fill").agg(F.count(F.lit(1)).alias("n")), "fills")
    counts = {r["fill"]: r["n"] for r in counted.groupBy("fill").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("fill").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("part", "fill", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    whole = ranked.join(begins, ["part", "fill"]).select("item", "fill", (F.col("begin") + F.col("rank")).alias("rank"))
    return whole.mapInArrow(_place(best_fit_runs(counts, capacity)), "item long, parent long, offset long")


def merge_rounds(items: DataFrame, capacity: int, nodes: int) -> DataFrame:
    """(item, sequence, offset) of underfull bins (item, fill): rounds of fewer and fewer nodes, then one placement by fills."""
    bar = F.lit(CLOSE_AT * capacity)
    left, level = items, 0
    where = items.select("item", F.col("item").alias("now"), F.lit(0).cast("long").alias("offset"))  # of every first bin: the bin that holds it now
    done = None
    while True:
        n = left.count()
        fewer = max(-(-nodes // FAN_IN), -(-n // NODE_ITEMS), 1)
        if not n or fewer >= nodes and level:
            break
        nodes, level = fewer, level + 1
        dealt = left.repartition(nodes, F.xxhash64("item", F.lit(level)))
        made = stored(dealt.mapInArrow(lean(_merge(capacity, level)), "item long, parent long, offset long, fill long"), "merged-bins")
        step = made.select(F.col("item").alias("now"), "parent", F.col("offset").alias("_more"), "fill")
        moved = stored(where.join(step, "now").select("item", F.col("parent").alias("now"), (F.col("offset") + F.col("_more")).alias("offset"), "fill"), "placed-bins")
        full = moved.where(F.col("fill") > bar).select("item", F.col("now").alias("sequence"), "offset")
        done = full if done is None else done.unionByName(full)
        where = moved.where(F.col("fill") <= bar).drop("fill")
        left = made.where(F.col("fill") <= bar).select(F.col("parent").alias("item"), "fill").distinct()
        if nodes == 1:
            break
    last = _by_fill(left, capacity).select(F.col("item").alias("now"), F.col("parent").alias("sequence"), F.col("offset").alias("_more"))
    rest = where.join(last, "now").select("item", "sequence", (F.col("offset") + F.col("_more")).alias("offset"))
    return rest if done is None else done.unionByName(rest)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` with sequence_id and the gapless offset of each piece in its sequence of at most `capacity`.

    Needs doc_id, piece, start, length (1 to capacity) and ids_crc32; other columns are left out, repeated rows are packed
    as often as they come, an empty table gives an empty table. The sequence numbers are unique, not dense.
    """
    types = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    source = pieces.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    dealt = stored(source.mapInArrow(lean(_pack_batches(capacity)), f"{PLACED}, fill long"), "bins")
    still = dealt.where(F.col("fill") <= CLOSE_AT * capacity)
    bins = still.groupBy(F.col("sequence_id").alias("item")).agg(F.first("fill").alias("fill"), F.min(F.shiftright("sequence_id", 36)).alias("part"))
    bins = stored(bins, "underfull-bins")
    nodes = bins.agg(F.count_distinct("part")).first()[0]
    merged = merge_rounds(bins.select("item", "fill"), capacity, max(1, nodes))
    placed = still.join(merged.select(F.col("item").alias("sequence_id"), "sequence", F.col("offset").alias("_more")), "sequence_id")
    placed = placed.select(*types, F.col("sequence").alias("sequence_id"), (F.col("offset") + F.col("_more")).alias("offset"))
    out = dealt.where(F.col("fill") > CLOSE_AT * capacity).select(*types, "sequence_id", "offset").unionByName(placed)
    return out.select(*types, "sequence_id", "offset")
