"""Words of Arrow text columns, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text handled at once in a task


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by the bytes of one text column."""
    for batch in batches:
        for a, b in slices(batch.column(column), most):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Freed memory goes back to the system, which the C library and Arrow else keep for later; where they cannot, nothing happens."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for `mapInArrow`, after which a worker is no larger than before: Spark keeps workers for the tasks of all later steps."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def word_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of every word in order, row of every word): white space as `[\\x20\\x09-\\x0D]`, A-Z lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().dictionary_encode()
    counts = np.diff(split.offsets.to_numpy())
    rows = np.repeat(np.arange(len(texts)), counts)
    codes = words.indices.to_numpy().astype(np.int64)
    names = words.dictionary.to_pylist()
    if "" in names:  # ends of texts with outer white space
        keep = codes != names.index("")
        codes, rows = codes[keep], rows[keep]
    return names, codes, rows
