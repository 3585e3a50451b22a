"""Removal of repeated byte strings with suffix arrays over the parts of the corpus that can repeat.

A string of `length` bytes that occurs twice carries the same smallest hashed 32-gram at both places. So every text is cut
into runs of windows with the same smallest 32-gram (their key), and only runs whose key occurs elsewhere go on:

1. Texts are stored in slices (tables of some megabytes, bucketed by slice number), so that what is found later joins them
   without moving the texts again.
2. Every slice reports its distinct keys; a key reported twice may repeat. Each slice learns which of its keys do.
3. Runs with equal bytes count once: per slice, then over all slices, only the first goes on; the others are removed whole.
4. First runs meet by key. There a suffix array is built in two stages: windows smaller than their successors are sorted
   directly, the others are induced by one scan over the buckets of first bytes; adjacent common prefixes of at least
   `length` bytes then tell equal windows, of which all but the first are removed.
5. A key with too many different runs (a passage in countless contexts) is not sorted in one place: its windows are
   compared one by one through an ordinary aggregate.

Messages between the steps are packed arrays, one row per slice and bucket of keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.slices import KEYED, MESSAGE, MIX1, ODD, Slice, Slices, U, bucket_of, by_bucket, messages, mixed, ranges, repeated_keys, slices_in
from gridloom.llm.texts import lean
from gridloom.session import stored

GRAM = 32  # a power of two
BUCKET_BYTES = 8 << 20  # of run bytes sorted in one group
WINDOW = 256 << 10  # places whose runs are found at once
MANY_RUNS = 1000  # a key with more different runs is handled as a hot one, and so is one that very many slices have
END = 0xFF  # occurs in no UTF-8 text
RUN = np.dtype([("key", "u8"), ("c", "u8"), ("doc", "i8"), ("slice", "i8"), ("row", "i4"), ("start", "i4"), ("n", "i4"), ("hot", "i4")])
MARK = np.dtype([("row", "i4"), ("start", "i4"), ("n", "i4")])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: -(width - span)], values[width - span :]) if span < width else values


def runs_of(body: np.ndarray, ends: np.ndarray, length: int, window: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The runs of all texts in `body` (RUN without doc and slice), and whether a run may hold equal windows itself.

    The bytes are walked by windows of WINDOW starts, so working memory does not depend on the size of the slice or of a
    text; a run that a window cuts off is left to the next one, which begins with it, and a run longer than a window makes
    that window longer.
    """
    begins = np.concatenate(([0], ends[:-1]))
    found, inner = [np.zeros(0, RUN)], [np.zeros(0, bool)]
    start, size = 0, window or WINDOW
    while start + length <= len(body):
        end = min(len(body), start + size + length - 1)
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, end, side="left")) + 1
        runs, twice = _window_runs(body[start:end], np.minimum(ends[first:last], end) - start, length)
        at = begins[first:last][runs["row"]].clip(min=start) + runs["start"]  # place in the body
        following = end - length + 1
        if end < len(body) and len(at) and at[-1] + runs["n"][-1] == following and ends[first + runs["row"][-1]] > end:
            if at[-1] == start:
                size *= 2
                continue
            following, runs, twice, at = int(at[-1]), runs[:-1], twice[:-1], at[:-1]
        runs["row"] += first
        runs["start"] = at - begins[runs["row"]]
        found.append(runs)
        inner.append(twice)
        start, size = following, window or WINDOW
    return np.concatenate(found), np.concatenate(inner)


def _window_runs(body: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of one window; rows and starts are counted in it."""
    if len(body) < length:
        return np.zeros(0, RUN), np.zeros(0, bool)
    base = mixed(np.arange(1, 257, dtype=U))[body]
    h, factor, span = base, int(ODD), 1
    while span < GRAM:
        h = h[:-span] * U(factor) + h[span:]
        factor = factor * factor % 2**64
        span *= 2
    h = mixed(h)
    width = length - GRAM + 1
    low = _sliding(h, width, np.minimum)
    begins = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - begins)[: len(low)]
    inside = np.arange(len(low)) + length <= ends[text]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(low)))
    at, count = at[inside[at]], count[inside[at]]
    # an anchor is a 32-gram that is the smallest of some window; equal windows in a run need two equal anchors in it
    padded = np.concatenate((np.zeros(width - 1, U), low, np.zeros(width - 1, U)))
    anchors = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    twice = np.zeros(len(h) + 1, np.int64)
    twice[anchors[1:][h[anchors[1:]] == h[anchors[:-1]]] + 1] = 1
    twice = np.cumsum(twice)
    inner = twice[at + count + width - 1] > twice[at]
    power = np.cumprod(np.full(len(body), ODD), dtype=U)
    total = np.concatenate((np.zeros(1, U), np.cumsum(base * power, dtype=U)))
    back = np.cumprod(np.full(len(body), U(pow(int(ODD), -1, 2**64))), dtype=U)
    out = np.zeros(len(at), RUN)
    out["key"], out["row"], out["start"], out["n"] = low[at], text[at], at - begins[text[at]], count
    out["c"] = mixed((total[at + count + length - 1] - total[at]) * back[at] + count.astype(U) * MIX1)
    return out, inner


def slice_runs(part: Slice, length: int) -> tuple[np.ndarray, np.ndarray]:
    runs, inner = runs_of(part.body, part.ends, length)
    runs["slice"] = part.number
    runs["doc"] = part.ids[runs["row"]]
    return runs, inner


def _distinct_keys(runs: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice's keys in order, and which of them occur twice in it."""
    keys, which, count = np.unique(runs["key"], return_inverse=True, return_counts=True)
    return keys, (count > 1) | (np.bincount(which, inner, len(keys)) > 0)


def _report_keys(at, length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in slices_in(batches, at):
            keys, twice = _distinct_keys(*slice_runs(part, length))
            rows = np.zeros(len(keys), KEYED)
            rows["key"], rows["twice"] = keys, twice
            if len(rows):
                yield messages(list(by_bucket(part.number, bucket_of(keys, buckets), rows)))

    return run


def _first_in_groups(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by (key, bytes, place), and which of them are the first of their bytes."""
    runs = runs[np.lexsort((runs["start"], runs["row"], runs["slice"], runs["doc"], runs["c"], runs["key"]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs["key"][1:] != runs["key"][:-1]) | (runs["c"][1:] != runs["c"][:-1])
    return runs, first


def _report_runs(at, length: int, buckets: int):
    """From slices and their repeating keys: first runs by bucket, and (bucket -1) marks of runs that repeat one of the slice itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in slices_in(batches, at):
            if not replies:
                continue
            known = np.concatenate([np.frombuffer(r, KEYED) for r in replies])
            known = known[np.argsort(known["key"])]
            runs, _ = slice_runs(part, length)
            place = np.searchsorted(known["key"], runs["key"]).clip(max=len(known) - 1)
            hit = known["key"][place] == runs["key"]
            runs, place = runs[hit], place[hit]
            runs["hot"] = known["twice"][place] == 2
            runs, first = _first_in_groups(runs)
            firsts = runs[first]
            spread = np.where(firsts["hot"] > 0, firsts["c"], 0)
            yield messages([*by_bucket(part.number, bucket_of(firsts["key"] + spread, buckets), firsts), (part.number, -1, _marks(runs[~first]))])

    return run


def _marks(runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(runs), MARK)
    for name in MARK.names:
        out[name] = runs[name]
    return out


def _first_runs(table: pa.Table) -> pa.Table:
    """One bucket of runs: which runs each slice has to send (kind 1), and which are repeats to be removed whole (kind 0)."""
    runs, first = _first_in_groups(np.concatenate([np.frombuffer(x, RUN) for x in table["data"].to_pylist()]))
    firsts = runs[first]
    edges = np.flatnonzero(np.diff(firsts["key"], prepend=firsts["key"][0] ^ U(1)))
    count = np.diff(np.append(edges, len(firsts)))
    firsts["hot"] = np.maximum(firsts["hot"], np.repeat(count > MANY_RUNS, count))
    out = [(s, 0, _marks(r)) for s, _, r in by_bucket(0, runs["slice"][~first], runs[~first]) for s in [int(r["slice"][0])]]
    out += [(int(r["slice"][0]), 1, r) for _, _, r in by_bucket(0, firsts["slice"], firsts)]
    return pa.table(messages(out).rename_columns(["slice", "kind", "data"]).to_pydict(), schema=pa.schema([("slice", pa.int64()), ("kind", pa.int64()), ("data", pa.binary())]))


def _send_runs(at, length: int, buckets: int):
    """From slices and the runs they have to send: (bucket, runs, bytes), bucket -1 for hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in slices_in(batches, at):
            runs = np.concatenate([np.frombuffer(r, RUN) for r in replies]) if replies else np.zeros(0, RUN)
            if not len(runs):
                continue
            bucket = np.where(runs["hot"] > 0, -1, bucket_of(runs["key"], buckets))
            rows = []
            for _, b, own in by_bucket(part.number, bucket + 1, runs):
                begin = part.begins[own["row"]] + own["start"]
                rows.append((b - 1, own.tobytes(), part.body[ranges(begin, own["n"] + (length - 1))].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "runs", "bytes"]
            )

    return run


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number that sorts like them; the text must end in eight END bytes."""
    w, bits = text.astype(U), 8
    for span in (1, 2, 4):
        w = (w[:-span] << U(bits)) | w[span:]
        bits *= 2
    return w


def sort_directly(words: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """`places` in the order of the `length` bytes (rounded up to eights) that start there."""
    order = places[np.argsort(words[places], kind="stable")]
    group = np.cumsum(np.append(True, words[order[1:]] != words[order[:-1]])) if len(order) else np.zeros(0, np.int64)
    for depth in range(8, length, 8):
        size = np.bincount(group)[group] if len(group) else group
        tied = np.flatnonzero(size > 1)  # groups stay where they are; only their insides are sorted
        if not len(tied):
            break
        own, key = order[tied], words[order[tied] + depth]
        inner = np.lexsort((key, group[tied]))
        order[tied] = own[inner]
        key, of = key[inner], group[tied]
        new = np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]))
        step = np.ones(len(order), np.int64)
        step[1:] = group[1:] != group[:-1]
        step[tied] = new
        group = np.cumsum(step)
    return order


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Of every suffix, whether it is smaller than the one after it; among equal bytes the next difference decides."""
    step = np.append(np.diff(text.astype(np.int16)), 1)
    decides = np.where(step != 0, np.arange(len(step)), len(step))
    return step[np.minimum.accumulate(decides[::-1])[::-1]] > 0


def two_stage_sort(text: np.ndarray, words: np.ndarray, domain: np.ndarray, length: int) -> np.ndarray:
    """Suffix array of the positions where `domain` is true, in the order of their first `length` bytes at least.

    Whenever a position of the domain is larger than its successor, the successor has to be in the domain too.
    """
    smaller = smaller_than_next(text)
    small = sort_directly(words, np.flatnonzero(domain & smaller), length)
    firsts = text[small]
    edges = np.searchsorted(firsts, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    large = domain & ~smaller

    def scan(c: int, found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[large[before]]
        for b in np.unique(text[before]).tolist():
            induced[b].append(before[text[before] == b])

    for c in range(256):
        while induced[c]:  # larger suffixes of this bucket; scanning them may induce more of the same byte
            found = np.concatenate(induced[c])
            induced[c] = []
            out.append(found)
            scan(c, found)
        found = small[edges[c] : edges[c + 1]]
        out.append(found)
        if len(found):
            scan(c, found)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of every suffix with the one before it, in bytes, up to `length`."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, length, 8):
        x, y = words[order[live] + depth], words[order[live - 1] + depth]
        differ = x ^ y
        same = differ == 0
        ended = live[~same]
        shift = np.zeros(len(ended), np.int64)
        for k in range(1, 8):
            shift += (differ[~same] >> U(64 - 8 * k)) == 0
        out[ended] = depth + shift
        live = live[same]
        out[live] = depth + 8
    return np.minimum(out, length)


def _repeats(length: int):
    """One bucket of runs with their bytes: marks of the windows that also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        runs = np.concatenate([np.frombuffer(x, RUN) for x in table["runs"].to_pylist()])
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        place = np.lexsort((runs["start"], runs["row"], runs["slice"], runs["doc"]))
        sizes = runs["n"].astype(np.int64) + (length - 1)
        begins = (np.cumsum(sizes) - sizes)[place]
        runs, sizes = runs[place], sizes[place]
        at = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.full(int((sizes + 1).sum()) + length + 16, END, np.uint8)
        text[ranges(at, sizes)] = data[ranges(begins, sizes)]
        words = words_at(text)
        window = np.zeros(len(text), np.int64)  # windows, and what follows one as far as a suffix is larger than its successor
        np.add.at(window, at, 1)
        np.add.at(window, at + runs["n"], -1)
        valid = np.cumsum(window) > 0
        falling = ~smaller_than_next(text)
        domain = valid.copy()
        edge = at + runs["n"]
        while len(edge):  # the last window of a run, and on to the next suffix that is smaller than its successor
            edge = edge[falling[edge - 1]]
            domain[edge] = True
            edge = edge + 1
        order = two_stage_sort(text, words, domain, length)
        order = order[valid[order]]
        new = common_prefixes(words, order, length) < length
        group = np.cumsum(new)
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        repeated = order[order != first[group - 1]] if len(order) else order
        return marks_table(runs, at, np.sort(repeated))

    return run


def marks_table(runs: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> pa.Table:
    """Maximal sequences of repeated windows as marks, packed by slice; `repeated` are places in the joined text, sorted."""
    of = np.searchsorted(at, repeated, side="right") - 1
    start = runs["start"][of] + (repeated - at[of])
    new = np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)) if len(of) else np.zeros(0, bool)
    edges = np.flatnonzero(new)
    marks = np.zeros(len(edges), RUN)
    marks["slice"], marks["row"], marks["start"] = runs["slice"][of[edges]], runs["row"][of[edges]], start[edges]
    marks["n"] = np.diff(np.append(edges, len(of)))
    rows = [(int(r["slice"][0]), _marks(r).tobytes()) for _, _, r in by_bucket(0, marks["slice"], marks)]
    return pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _windows(length: int):
    """The windows of hot runs, one row each: 128 bits of hash and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                runs, data = np.frombuffer(batch.column(1)[i].as_buffer(), RUN), np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                sizes = runs["n"].astype(np.int64) + (length - 1)
                begins = ranges(np.cumsum(sizes) - sizes, runs["n"])
                hashes = []
                for seed in (1, 2):
                    value = mixed(np.arange(1, 257, dtype=U) * U(seed))[data]
                    total = np.zeros(len(begins), U)
                    for k in range(length):
                        total = total * ODD + value[begins + k]
                    hashes.append(mixed(total).view(np.int64))
                of = np.repeat(np.arange(len(runs)), runs["n"])
                start = runs["start"][of] + ranges(np.zeros(len(runs), np.int64), runs["n"])
                place = [runs["doc"][of], runs["slice"][of], runs["row"][of].astype(np.int64), start.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*hashes, *place)], ["w1", "w2", "doc", "slice", "row", "start"])

    return run


def _pack_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.zeros(batch.num_rows, RUN)
        for i, name in enumerate(("slice", "row", "start")):
            rows[name] = batch.column(i).to_numpy()
        rows["n"] = 1
        out = [(int(r["slice"][0]), _marks(r).tobytes()) for _, _, r in by_bucket(0, rows["slice"], rows)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["slice", "data"])


def _cut(at, length: int, columns: list[str] | None):
    """Apply the marks of a slice. columns: give back these columns with the shortened text; else the report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in slices_in(batches, at):
            marks = np.concatenate([np.frombuffer(r, MARK) for r in replies]) if replies else np.zeros(0, MARK)
            change = np.zeros(len(part.body) + 1, np.int64)
            begin = part.begins[marks["row"]] + marks["start"]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + marks["n"] + (length - 1), -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = [part.body[a:b][~gone[a:b]].tobytes() for a, b in zip(part.begins.tolist(), part.ends.tolist())]
            if columns is not None:
                texts = [k.decode("utf-8", "ignore") for k in kept]
                old = part.table.column(at[1])
                texts = pa.array([None if n else t for n, t in zip(old.is_null().to_pylist(), texts)], old.type)
                table = part.table.set_column(at[1], part.table.field(at[1]), texts)
                yield from table.combine_chunks().to_batches()
                continue
            total = np.concatenate(([0], np.cumsum(gone)))
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = part.begins[part.begins < len(gone)]
            starts[inner] = gone[inner]
            spans = np.concatenate(([0], np.cumsum(starts)))
            a, b = part.begins, part.ends
            yield pa.RecordBatch.from_arrays(
                [part.table.column(at[0]).cast(pa.int64()).combine_chunks(), pa.array(b - a), pa.array(total[b] - total[a]), pa.array(spans[b] - spans[a]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _dedup(docs: DataFrame, id_col: str, text_col: str, length: int, cut: bool) -> DataFrame:
    spark, columns = docs.sparkSession, docs.columns
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    at = (columns.index(id_col), columns.index(text_col))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = Slices(docs, text_col)
    with_replies = slices.with_replies

    keys = slices.table.mapInArrow(lean(_report_keys(at, length, buckets)), MESSAGE)
    repeated = stored(keys.groupBy("bucket").applyInArrow(repeated_keys, "slice long, data binary"), "repeated-keys")
    sent = stored(with_replies(repeated).mapInArrow(lean(_report_runs(at, length, buckets)), MESSAGE), "runs")
    sorted_out = stored(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_first_runs, "slice long, kind long, data binary"), "first-runs")
    wanted = sorted_out.where("kind = 1").select("slice", "data")
    total = wanted.agg(F.sum(F.octet_length("data"))).first()[0] or 0  # of descriptions; a run has about three times as many bytes
    groups = max(buckets, -(-3 * total // BUCKET_BYTES))
    runs = stored(with_replies(wanted).mapInArrow(lean(_send_runs(at, length, groups)), "bucket long, runs binary, bytes binary"), "run-bytes")
    found = runs.where("bucket >= 0").groupBy("bucket").applyInArrow(_repeats(length), "slice long, data binary")
    windows = stored(runs.where("bucket < 0").mapInArrow(lean(_windows(length)), "w1 long, w2 long, doc long, slice long, row long, start long"), "hot-windows")
    place = F.struct("doc", "slice", "row", "start")
    firsts = stored(windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "hot-firsts")
    hot = windows.join(firsts, ["w1", "w2"]).where(place != F.col("first")).select("slice", "row", "start").mapInArrow(lean(_pack_marks), "slice long, data binary")
    marks = sent.where("bucket < 0").select("slice", "data").unionByName(sorted_out.where("kind = 0").select("slice", "data"))
    marks = stored(marks.unionByName(found).unionByName(hot), "marks")
    schema = docs.schema if cut else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_replies(marks).mapInArrow(lean(_cut(at, length, columns if cut else None)), schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): what `cut_repeats` would remove from every text.

    A byte goes if a string of `length` bytes around it also starts earlier: in a smaller id or earlier in the same text.
    NULL and empty texts count as no bytes; a NULL id comes before all others; rows that repeat an id count as documents
    one after another. Matches never cross documents. An empty table gives an empty table.
    """
    return _dedup(docs, id_col, text_col, length, False)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """`docs` with every repeated string of `length` bytes cut from its text; all columns stay, NULL texts stay NULL.

    Bytes of a character that was cut in two are dropped with it. Rows and ids as for `repeated_bytes`.
    """
    return _dedup(docs, id_col, text_col, length, True)
