"""Approximate nearest neighbours by multi-probe hash tables, for tables too large for the exact search.

A table hashes a row to the signs of its projections on random directions, about the mean of all rows. A query looks into
its own bucket and into those it would fall into if its least certain signs were flipped. The number of signs follows from
the number of rows, so a bucket keeps its size as the table grows; a bucket that is larger all the same is cut into parts
by the hash of the id, and a query meets all of them. Rows that reach the search: tables times training rows, and tables
times probes (times parts) queries. `recall` measures the result against exact neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.operators.embeddings import _matrix, _search, n_rows
from gridloom.operators.ranking import hash_order, top_k
from gridloom.session import stored

BUCKET_ROWS = 2_000  # rows of an average bucket
PART_ROWS = 20_000  # rows of a part of a bucket
MOST_BITS = 40


def directions(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """tables * bits unit vectors, orthogonal in groups of `dim`."""
    rng, made = np.random.default_rng(seed), []
    while sum(map(len, made)) < tables * bits:
        made.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0].T)
    return np.concatenate(made)[: tables * bits]


def codes_of(x: np.ndarray, planes: np.ndarray, centre: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) of codes and (rows, tables, bits) of signed distances to the directions' planes."""
    side = ((x - centre) @ planes.T).reshape(len(x), tables, bits)
    return (side > 0) @ (1 << np.arange(bits, dtype=np.int64)), side


def flips(bits: int, probes: int) -> list[tuple[int, ...]]:
    """The first `probes` sets of signs to flip, signs counted from the least certain one: sums of squared positions grow."""
    short = min(bits, max(1, probes.bit_length() + 2))
    sets = [tuple(i for i in range(short) if k >> i & 1) for k in range(1 << short)]
    return sorted(sets, key=lambda s: (sum((i + 1) ** 2 for i in s), s))[:probes]


def _placed(planes: np.ndarray, centre: np.ndarray, tables: int, bits: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, _ = codes_of(_matrix(pdf["embedding"]), planes, centre, tables, bits) if len(pdf) else (np.zeros((0, tables), np.int64), None)
            for t in range(tables):
                yield pdf.assign(table=np.int32(t), code=codes[:, t])

    return run


def _probed(planes: np.ndarray, centre: np.ndarray, tables: int, bits: int, probes: int) -> Callable:
    sets = flips(bits, probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            codes, side = codes_of(_matrix(pdf["embedding"]), planes, centre, tables, bits)
            doubt = np.argsort(np.abs(side), axis=2, kind="stable")  # least certain sign first
            for t in range(tables):
                for s in sets:
                    change = np.zeros(len(pdf), np.int64)
                    for i in s:
                        change ^= 1 << doubt[:, t, i].astype(np.int64)
                    yield pdf.assign(table=np.int32(t), code=codes[:, t] ^ change)

    return run


def approximate_neighbours(
    train: DataFrame, queries: DataFrame, k: int = 15, tables: int = 4, probes: int = 16, bucket_rows: int = BUCKET_ROWS, part_rows: int = PART_ROWS, seed: int = 7
) -> DataFrame:
    """k near training rows of each query, as (run, query, neighbour, distance, label, rank); ties go to the smaller id.

    `train` holds run, id, embedding, label; `queries` run, query, embedding. Distances are exact; a true neighbour is missed
    if no table puts it into a bucket the query looks into.
    """
    kinds = {c: train.schema[c].dataType.simpleString() for c in ("run", "id", "label")}
    qkind = queries.schema["query"].dataType.simpleString()
    dbl = F.transform("embedding", lambda v: v.cast("double")).alias("embedding")
    rows = train.select("run", "id", dbl, "label")
    mean = rows.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()  # one row per dimension
    largest = rows.groupBy("run").agg(n_rows().alias("n")).agg(F.max("n")).first()[0] or 0
    centre = np.array([r["m"] for r in mean])
    bits = int(min(MOST_BITS, max(1, math.ceil(math.log2(max(2.0, largest / bucket_rows))))))
    planes = directions(max(1, len(centre)), tables, bits, seed)
    placed = stored(rows.mapInPandas(_placed(planes, centre, tables, bits), f"run {kinds['run']}, id {kinds['id']}, embedding array<double>, label {kinds['label']}, table int, code bigint"), "hashed")
    keys = ["run", "table", "code"]
    sizes = placed.groupBy(*keys).agg(F.ceil(n_rows() / part_rows).cast("int").alias("parts"))
    spread = placed.join(sizes, keys).withColumn("part", (hash_order(F.col("id"), salt="part") % F.col("parts")).cast("int")).drop("parts")
    asked = queries.select("run", "query", dbl).mapInPandas(_probed(planes, centre, tables, bits, probes), f"run {kinds['run']}, query {qkind}, embedding array<double>, table int, code bigint")
    routed = asked.join(sizes, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    group = [*keys, "part"]
    found = routed.groupBy(*group).cogroup(spread.groupBy(*group)).applyInPandas(
        _search(k), f"run {kinds['run']}, query {qkind}, neighbour {kinds['id']}, distance double, label {kinds['label']}"
    )
    once = found.groupBy("run", "query", "neighbour").agg(F.min("distance").alias("distance"), F.first("label").alias("label"))
    return top_k(once, ["run", "query"], [F.col("distance"), F.col("neighbour")], k, "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours (run, query, neighbour) that were found, per run."""
    hit = found.select("run", "query", "neighbour", F.lit(1).alias("hit"))
    g = exact.join(hit, ["run", "query", "neighbour"], "left").groupBy("run")
    return g.agg(n_rows().alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
