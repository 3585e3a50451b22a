"""Vector tables as shards of packed rows, query blocks, and the pairing of the two in waves.

Rows go into shards of bounded size, queries into blocks of bounded size; every block meets every shard exactly once. The
first wave pairs a block with one shard; its k-th scores then travel with the block to all other shards, where they prune.
Neither the rows nor the queries are ever in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored

SHARD_ROWS = 8192
BLOCK_ROWS = 512
SHARD = "shard long, dim int, ids binary, data binary"
HIT = "query_id long, vec_id long, score double"
NO_BOUND = (-np.inf, 2**63 - 1)


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, every component present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def shards(rows: DataFrame, prepare: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, bytes]]], most: int, label: str) -> DataFrame:
    """(id, v array<double>) rows packed by dimension into shards of at most `most` rows.

    prepare(ids, matrix) gives the packed forms of one such group of rows, each as (ids, data).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, data = zip(*held.pop(dim))
            out = prepare(np.concatenate(ids), np.concatenate(data))
            numbers = list(range(number, number + len(out)))
            number += len(out)
            columns = [pa.array(numbers, pa.int64()), pa.array([dim] * len(out), pa.int32()), pa.array([i.tobytes() for i, _ in out]), pa.array([d for _, d in out])]
            return pa.RecordBatch.from_arrays(columns, ["shard", "dim", "ids", "data"])

        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim))
                for a in range(0, own.num_rows, most):
                    part = own.slice(a, most)
                    if sum(len(i) for i, _ in held.get(dim, [])) + part.num_rows > most:
                        yield packed(dim)
                    held.setdefault(dim, []).append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dim)))
        for dim in list(held):
            yield packed(dim)

    return stored(rows.mapInArrow(run, SHARD), label)


def few_copies(ids: np.ndarray, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows without the copies of a vector that have `most` or more copies with smaller ids: those cannot be among the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], np.ascontiguousarray(matrix[order]) + 0.0  # no negative zeros
    _, which = np.unique(matrix.view(np.dtype((np.void, matrix.dtype.itemsize * matrix.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    starts = np.flatnonzero(np.diff(which[order], prepend=-1))
    nth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    keep = np.sort(order[nth < most])
    return ids[keep], matrix[keep]


def nearest(rows: DataFrame, queries: DataFrame, prepare, search, k: int, label: str) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k best rows, ties to the smaller id.

    rows and queries: (id, v array<double>). prepare: see `shards`. search(query_ids, query_matrix, ids, data, k, bounds)
    gives (query index, vec_id, score) arrays of all rows of one shard that may be among a query's best; bounds holds per
    query the score and id that a row has to beat.
    """

    def blocks_of(ids: np.ndarray, matrix: np.ndarray):
        return [(ids, np.ascontiguousarray(matrix, np.float64).tobytes())]

    base = shards(rows, prepare, SHARD_ROWS, f"{label}-shards")
    blocks = shards(queries, blocks_of, BLOCK_ROWS, f"{label}-queries")
    # the first shard of a block: one of the same dimension, chosen by hash
    pairs = blocks.select(F.col("shard").alias("block"), "dim").join(base.select("shard", "dim"), "dim")
    pairs = pairs.withColumn("first", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("block", "shard"), "shard")) == 1)
    pairs = stored(pairs.select("block", "shard", "first"), f"{label}-pairs")

    def met(wanted: DataFrame, bounded: DataFrame) -> DataFrame:
        block = bounded.select(F.col("shard").alias("block"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "bounds")
        both = wanted.join(block, "block").join(base.select("shard", "ids", "data"), "shard")
        both = both.repartition(F.xxhash64("block", "shard")).select("dim", "q_ids", "q_data", "bounds", "ids", "data")
        return both.mapInArrow(_met(search, k), HIT)

    none = blocks.withColumn("bounds", F.lit(None).cast("binary"))
    first = stored(met(pairs.where("first").select("block", "shard"), none), f"{label}-first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    ids = blocks.select("shard", "dim", "ids", "data").mapInArrow(_block_ids, "shard long, id long")
    kth = ids.join(kth.select(F.col("query_id").alias("id"), "score", "vec_id"), "id").groupBy("shard").agg(F.collect_list(F.struct("id", "score", "vec_id")).alias("bound"))
    packed = kth.mapInArrow(_pack_bounds, "shard long, bounds binary")
    rest = met(pairs.where("NOT first").select("block", "shard"), blocks.join(packed, "shard", "left"))
    hits = first.unionByName(rest)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


BOUND = np.dtype([("id", "i8"), ("score", "f8"), ("vec", "i8")])


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard)), pa.array(own)], ["shard", "id"])


def _pack_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bounds in batch.column(1).to_pylist():
            rows = np.array([(b["id"], b["score"], b["vec_id"]) for b in bounds], BOUND)
            out.append(np.sort(rows, order="id").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["shard", "bounds"])


def _met(search, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                queries = np.frombuffer(row["q_data"]).reshape(len(q_ids), row["dim"])
                scores, vecs = np.full(len(q_ids), NO_BOUND[0]), np.full(len(q_ids), NO_BOUND[1])
                if row["bounds"]:
                    known = np.frombuffer(row["bounds"], BOUND)
                    at = np.searchsorted(known["id"], q_ids).clip(max=len(known) - 1)
                    hit = known["id"][at] == q_ids
                    scores[hit], vecs[hit] = known["score"][at[hit]], known["vec"][at[hit]]
                q, vec, score = search(q_ids, queries, np.frombuffer(row["ids"], np.int64), row["data"], k, (scores, vecs))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        bar = np.partition(scores, len(scores) - k)[-k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
