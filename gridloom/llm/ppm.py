"""Language-model scores by prediction by partial matching over a byte-context trie.

Training counts how often each byte follows each context of up to `ORDER` bytes; the documents' beginnings and ends count
too. A text's probability is coded byte by byte from the longest context known. Where that has not seen the byte, an
escape leads to the next shorter context, from which the followers already ruled out are excluded; every distinct follower
hands half a count to the escape. Below the empty context all bytes that training never saw are equal.

The trie is never in one place. Slices of the corpus send their distinct context-byte strings with training counts to
buckets by their two nearest bytes, where all longer contexts of a string meet; a bucket builds its part of the trie and
answers with the log-probability of every string asked for, so each slice then adds up its texts. Only the first-order
table, at most 256 x 256 counts, travels with the plan. Word counts for the unigram base go the same way by word hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.slices import Slice, Slices, U, bucket_of, by_bucket, ranges, slices_in
from gridloom.llm.texts import word_codes
from gridloom.session import stored

ORDER = 5
BEGIN, END = 0xFE, 0xFF  # occur in no UTF-8 text
COUNTED = np.dtype([("key", "u8"), ("n", "u4")])
GRAMS, WORDS, FIRST = 0, 1, 2  # kinds of messages
MESSAGE = "slice long, kind long, bucket long, data binary"
END_WORD = U(xxhash.xxh3_64_intdigest(b"\xff"))


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the upper ones of small numbers are zeros that any codec removes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, of) -> np.ndarray:
    width = np.dtype(of).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(of).ravel()


def packed(rows: np.ndarray) -> bytes:
    """COUNTED rows in the order of their keys, as planes of key differences and of counts."""
    return planes(np.diff(rows["key"], prepend=U(0))) + planes(np.ascontiguousarray(rows["n"]))


def unpacked(data: bytes) -> np.ndarray:
    rows = np.zeros(len(data) // COUNTED.itemsize, COUNTED)
    rows["key"] = np.cumsum(from_planes(data[: 8 * len(rows)], U), dtype=U)
    rows["n"] = from_planes(data[8 * len(rows) :], np.uint32)
    return rows


def grams(body: np.ndarray, ends: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): for every byte and every text's end its context, nearest byte first, and the byte itself; where texts end."""
    sizes = np.diff(ends, prepend=0)
    places = ranges(np.arange(len(ends)) * (order + 1) + order + (ends - sizes), sizes)
    padded = np.full(len(body) + len(ends) * (order + 1), BEGIN, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    padded[places] = lower[body]
    stops = np.arange(1, len(ends) + 1) * (order + 1) - 1 + ends
    padded[stops] = END
    keys = padded.astype(U)
    for j in range(1, order + 1):
        keys[j:] |= padded[:-j].astype(U) << U(8 * (order + 1 - j))
    wanted = np.zeros(len(padded), bool)
    wanted[places] = wanted[stops] = True
    return keys[wanted], np.cumsum(sizes + 1)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by key, keys in order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[edges], np.add.reduceat(values[order], edges) if len(edges) else values[:0]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are in it."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys).clip(max=len(table) - 1)
    return at, table[at] == keys


class Level:
    """Contexts of one length with their totals, distinct followers and (context, byte) counts."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts
        of = pairs >> U(8)
        self.edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        self.contexts = of[self.edges]
        self.total = np.add.reduceat(counts, self.edges) if len(of) else counts[:0]
        self.distinct = np.diff(np.append(self.edges, len(of)))

    def rest(self, lower: Level) -> tuple[np.ndarray, np.ndarray]:
        """Of each context's next shorter one, the total and the distinct followers without those seen here."""
        if not len(self.pairs):
            return self.total, self.distinct
        at, _ = _found(lower.pairs, ((self.pairs >> U(16)) << U(8)) | (self.pairs & U(255)))
        where, _ = _found(lower.contexts, self.contexts >> U(8))
        return lower.total[where] - np.add.reduceat(lower.counts[at], self.edges), lower.distinct[where] - self.distinct


def log_probabilities(keys: np.ndarray, counts: np.ndarray, first: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 of the model's probability of every key's byte in its context.

    keys: sorted, with all trained keys that share two nearest bytes with any of them; counts: how often training had
    each. first: training counts by (nearest byte, byte), of all keys.
    """
    trained = counts > 0
    levels: dict[int, Level] = {}
    for k in range(order, 1, -1):
        pairs = ((keys[trained] >> U(8 * (order - k) + 8)) << U(8)) | (keys[trained] & U(255))
        levels[k] = Level(*_grouped(pairs, counts[trained].astype(np.int64)))
    cells = np.flatnonzero(first.ravel())
    levels[1] = Level(cells.astype(U), first.ravel()[cells])
    zero = first.sum(0)
    levels[0] = Level(np.flatnonzero(zero).astype(U), zero[zero > 0])
    out = np.zeros(len(keys))
    alive = np.ones(len(keys), bool)
    above = np.full(len(keys), -1)  # the place of the longer context, if it was seen
    for k in range(order, -1, -1):
        level = levels[k]
        context = keys >> U(8 * (order - k + 1)) if k else np.zeros(len(keys), U)
        at, seen = _found(level.contexts, context)
        if len(level.contexts):
            total, distinct = level.total[at], level.distinct[at]
            if k < order and len(levels[k + 1].contexts):
                rest_total, rest_distinct = levels[k + 1].rest(level)
                after = above >= 0
                total = np.where(after, rest_total[above], total)
                distinct = np.where(after, rest_distinct[above], distinct)
            pair, hit = _found(level.pairs, (context << U(8)) | (keys & U(255)))
            whole = np.maximum(2 * total, 1)  # halves: of every follower's count one half goes to the escape
            coded = alive & seen & hit
            out[coded] += np.log10((2 * level.counts[pair[coded]] - 1) / whole[coded])
            escaped = alive & seen & ~hit & (distinct > 0)
            out[escaped] += np.log10(distinct[escaped] / whole[escaped])
            alive &= ~coded
        above = np.where(seen, at, -1)
    out[alive] -= np.log10(256 - len(levels[0].pairs))
    return out


def _learns(part: Slice) -> np.ndarray:
    return part.table.column(2).to_numpy()


def _slice_grams(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, number of each position's key, text of each position, where texts end)."""
    keys, ends = grams(part.body, part.ends)
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, which, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), ends


def _slice_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes, number of each token's word, text of each token); every text's end is a token too."""
    names, codes, rows = word_codes(part.texts)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names] + [END_WORD], U)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = len(part.texts)
    return hashes[order], place[np.append(codes, np.full(n, len(names)))], np.append(rows, np.arange(n))


def _gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(keys >> U(8 * (ORDER - 1)), buckets)


def _report(buckets: int):
    """A slice's strings and words with their training counts, and its part of the first-order table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in slices_in(batches, (0, 1)):
            learn, out = _learns(part), []
            for kind, (keys, which, text, *_) in ((GRAMS, _slice_grams(part)), (WORDS, _slice_words(part))):
                rows = np.zeros(len(keys), COUNTED)
                rows["key"], rows["n"] = keys, np.bincount(which, learn[text], len(keys))
                bucket = _gram_bucket(keys, buckets) if kind == GRAMS else bucket_of(keys, buckets)
                out += [(part.number, kind, b, packed(r)) for _, b, r in by_bucket(0, bucket, rows)]
                if kind == GRAMS:
                    pairs, n = _grouped(((keys >> U(8 * ORDER)) << U(8)) | (keys & U(255)), rows["n"].astype(np.int64))
                    table = np.zeros(len(pairs), COUNTED)
                    table["key"], table["n"] = pairs, n
                    out += [(part.number, FIRST, b, packed(r)) for _, b, r in by_bucket(0, (pairs >> U(8)).astype(np.int64), table)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.binary()) for i in range(4)], ["slice", "kind", "bucket", "data"])

    return run


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The messages, their distinct keys, the training counts of those, and each sent key's number."""
    data = [unpacked(x) for x in table["data"].to_pylist()]
    rows = np.concatenate(data)
    keys, which = np.unique(rows["key"], return_inverse=True)
    return data, keys, np.bincount(which, rows["n"], len(keys)).astype(np.int64), which


def _first_order(table: pa.Table) -> pa.Table:
    """Summed counts of one nearest byte."""
    _, keys, counts, _ = _merged(table)
    return pa.table({"cells": pa.array([keys.astype(np.int64)]), "counts": pa.array([counts])})


ANSWER = np.dtype([("kind", "i8"), ("bucket", "i8")])


def _answers(table: pa.Table, data: list[np.ndarray], values: np.ndarray, extra: list[tuple[int, bytes]]) -> pa.Table:
    """One reply per message: its kind and bucket, then the values of its keys in order."""
    head = np.array([(table["kind"][0].as_py(), table["bucket"][0].as_py())], ANSWER).tobytes()
    cuts = np.cumsum([len(d) for d in data])[:-1]
    rows = [(s, head + planes(v)) for s, v in zip(table["slice"].to_pylist(), np.split(values, cuts))] + extra
    return pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _answer_grams(first: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        data, keys, counts, which = _merged(table)
        return _answers(table, data, log_probabilities(keys, counts, first).astype(np.float32)[which], [])

    return run


def _answer_words(table: pa.Table) -> pa.Table:
    """Counts of words; a row for slice -1 holds the bucket's tokens and distinct words."""
    data, _, counts, which = _merged(table)
    return _answers(table, data, counts[which], [(-1, np.array([counts.sum(), (counts > 0).sum()]).tobytes())])


def _replied(replies: list[bytes], kind: int, keys: np.ndarray, bucket: np.ndarray, of) -> np.ndarray:
    """The values of a slice's keys from the replies of their buckets."""
    out = np.zeros(len(keys), of)
    order = np.argsort(bucket, kind="stable")
    at, starts = np.unique(bucket[order], return_index=True)
    begin = dict(zip(at.tolist(), starts.tolist()))
    for reply in replies:
        own_kind, b = np.frombuffer(reply, ANSWER, 1)[0]
        if own_kind == kind:
            values = from_planes(reply[ANSWER.itemsize :], of)
            out[order[begin[int(b)] : begin[int(b)] + len(values)]] = values
    return out


def _sum_up(buckets: int, tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in slices_in(batches, (0, 1)):
            n = len(part.texts)
            keys, which, text, _ = _slice_grams(part)
            logs = _replied(replies, GRAMS, keys, _gram_bucket(keys, buckets), np.float32).astype(np.float64)
            score = np.bincount(text, logs[which], n)
            keys, which, text = _slice_words(part)
            counts = _replied(replies, WORDS, keys, bucket_of(keys, buckets), np.int64)
            base = np.log10((counts + 0.1) / (tokens + 0.1 * (types + 1)))
            columns = [part.table.column(0).combine_chunks(), pa.array(np.bincount(text, minlength=n))]
            columns += [pa.array(np.bincount(text, (counts > 0)[which], n).astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(np.bincount(text, base[which], n)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): how probable every text is to a model of the texts where `learn` holds.

    Both scores are log10 probabilities of the text with A-Z in lower case, its end included: `score` of its bytes under
    the context trie, `base_score` of its words under their smoothed frequencies. NULL and empty texts are an end alone; a
    NULL id passes through; rows count as often as they come; without any text to learn from every byte is equally
    probable. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).cast("double").alias("learn"))
    slices = Slices(rows, "text")
    sent = stored(slices.table.mapInArrow(_report(slices.buckets), MESSAGE), "gram-counts")
    first = np.zeros((256, 256), np.int64)
    for row in sent.where(F.col("kind") == FIRST).groupBy("bucket").applyInArrow(_first_order, "cells array<long>, counts array<long>").collect():
        first.ravel()[row["cells"]] = row["counts"]
    by = ["kind", "bucket"]
    grams_said = sent.where(F.col("kind") == GRAMS).groupBy(*by).applyInArrow(_answer_grams(first), "slice long, data binary")
    words_said = sent.where(F.col("kind") == WORDS).groupBy(*by).applyInArrow(_answer_words, "slice long, data binary")
    said = stored(grams_said.unionByName(words_said), "gram-answers")
    totals = [np.frombuffer(bytes(r["data"]), np.int64) for r in said.where("slice = -1").select("data").collect()]  # two numbers a bucket
    tokens, types = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slices.with_replies(said.where("slice >= 0")).mapInArrow(_sum_up(slices.buckets, tokens, types), schema)
