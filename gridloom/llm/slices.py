"""Corpora stored as slices that later answers can join without moving the texts again.

A slice holds some megabytes of rows, all columns, as an Arrow stream. Slices are stored once, bucketed by their number.
Steps send packed messages by key bucket and get replies by slice number; only messages and replies are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from gridloom.llm.texts import lean, parts
from gridloom.session import shared_folder

SLICE_BYTES = 4 << 20
MANY_SLICES = 2000  # a key met in more slices than this is marked as hot
NO_ID = -(2**63)  # order of a NULL id: before all others
MESSAGE = "slice long, bucket long, data binary"
U = np.uint64
KEYED = np.dtype([("key", "u8"), ("twice", "u1")])
ODD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX1
    h = (h ^ (h >> U(27))) * MIX2
    return h ^ (h >> U(31))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(values) % U(buckets)).astype(np.int64)


def by_bucket(number: int, buckets: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, bucket, its rows in order) for every bucket that has rows."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
        yield number, int(buckets[order[a]]), rows[order[a:b]]


def messages(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
        ["slice", "bucket", "data"],
    )


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after another."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Slice:
    """A stored slice: the original rows and their texts as bytes, one after another; NULL texts are empty."""

    def __init__(self, number: int, data, id_at: int, text_at: int):
        self.number = number
        self.table = pa.ipc.open_stream(data).read_all().combine_chunks()
        texts = pc.fill_null(self.table.column(text_at), "")
        self.texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        sizes = pc.binary_length(self.texts).to_numpy().astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.body = np.frombuffer(b"".join(self.texts.cast(pa.binary()).to_pylist()), np.uint8)
        self.ids = pc.fill_null(self.table.column(id_at).cast(pa.int64()), NO_ID).to_numpy()


def slices_in(batches: Iterator[pa.RecordBatch], at: tuple[int, int]) -> Iterator[tuple[Slice, list[bytes]]]:
    """Slices of (slice, data[, replies]) rows; replies are packed arrays in any order."""
    for batch in batches:
        for i in range(batch.num_rows):
            replies = batch.column(2)[i].as_py() if batch.num_columns > 2 else None
            yield Slice(batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer(), *at), [bytes(r) for r in replies or []]


def _to_slices(columns: list[str], text_at: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "data"])

        for batch in parts(batches, text_at, most):
            for a in range(0, batch.num_rows, 200):
                piece = batch.slice(a, 200).rename_columns(columns)
                added = pc.sum(pc.binary_length(piece.column(text_at))).as_py() or 0
                if held and size + added > most:
                    yield packed()
                    held, size, number = [], 0, number + 1
                held.append(piece)
                size += added
        if held:
            yield packed()

    return run


class Slices:
    """The rows of `docs` in stored slices of about `most` bytes of text, or of one row."""

    def __init__(self, docs: DataFrame, text_col: str, most: int | None = None):
        spark, columns = docs.sparkSession, docs.columns
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"text_slices_{uuid.uuid4().hex}"
        kept = StructType([StructField("slice", LongType()), StructField("data", BinaryType())])
        packed = docs.mapInArrow(lean(_to_slices(columns, columns.index(text_col), most or SLICE_BYTES)), kept)
        place = f"{shared_folder(spark)}/gridloom/{name}"
        packed.write.format("parquet").option("path", place).option("compression", "zstd").bucketBy(self.buckets, "slice").saveAsTable(name)
        self.table = spark.table(name)

    def with_replies(self, replies: DataFrame) -> DataFrame:
        """(slice, data, replies): slices with what (slice, data) rows address to them."""
        own = replies.groupBy("slice").agg(F.collect_list("data").alias("replies"))
        return self.table.hint("merge").join(own, "slice", "left").select("slice", "data", "replies")


def repeated_keys(table: pa.Table) -> pa.Table:
    """One bucket of keys: per slice, 1 for a key that also occurs elsewhere, 2 if it does in very many slices."""
    data = [np.frombuffer(x, KEYED) for x in table["data"].to_pylist()]
    rows = np.concatenate(data)
    order = np.argsort(rows["key"], kind="stable")
    keys = rows["key"][order]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(edges, len(keys)))
    twice = np.maximum.reduceat(rows["twice"][order], edges) > 0
    state = np.where(count > MANY_SLICES, 2, (count > 1) | twice).astype(np.uint8)
    out = np.empty(len(rows), np.uint8)
    out[order] = np.repeat(state, count)
    cuts = np.cumsum([len(d) for d in data])[:-1]
    found = [(s, d["key"][o > 0], o[o > 0]) for s, d, o in zip(table["slice"].to_pylist(), data, np.split(out, cuts))]
    packed = []
    for s, k, o in found:
        rows = np.zeros(len(k), KEYED)
        rows["key"], rows["twice"] = k, o
        packed.append((s, rows.tobytes()))
    packed = [p for p in packed if p[1]]
    return pa.table({"slice": pa.array([p[0] for p in packed], pa.int64()), "data": pa.array([p[1] for p in packed], pa.binary())})
