"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector's difference from the corpus mean is scaled to length one, padded to `BITS` dimensions and turned by a fixed
random rotation; its signs are the code. Two scalars per row, the length of the difference and how well the code agrees
with it, correct the inner product of code and query into an unbiased estimate with a known error bound. A row is compared
exactly when its estimate plus its error reaches the k-th best of the lower estimates and of what other shards have found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.vectors import best_of, few_copies, nearest, usable

BITS = 256
ERRORS = 2.5  # width of the error bound, in standard deviations of the estimate's error
SEED = 20240521


def rotation(dim: int) -> np.ndarray:
    """The first `dim` rows of a random orthogonal matrix of at least BITS columns, the same everywhere."""
    bits = max(BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of a batch by component and dimension."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column(0)])
        for dim in np.unique(sizes).tolist():
            m = batch.filter(pa.array(sizes == dim)).column(0).flatten().to_numpy().reshape(-1, dim)
            unit = m / np.linalg.norm(m, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(unit.sum(0)), pa.array(np.full(dim, len(m)))], ["dim", "i", "total", "n"])


def encode(ids: np.ndarray, matrix: np.ndarray, mean: np.ndarray, copies: int) -> list[tuple[np.ndarray, bytes]]:
    """Originals, packed codes and correction scalars of a shard, one after another."""
    ids, matrix = few_copies(ids, matrix, copies)
    turn = rotation(matrix.shape[1])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    rest = unit - mean
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-30)[:, None]) @ turn
    signs = turned >= 0
    agree = np.abs(turned).sum(1) / np.sqrt(turn.shape[1])
    scalars = np.stack((length, np.maximum(agree, 1e-6), unit @ mean), 1)
    return [(ids, matrix.tobytes() + scalars.tobytes() + np.packbits(signs, axis=1).tobytes())]


def search_with(means: dict[int, np.ndarray]):
    def search(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: bytes, k: int, known):
        n, dim = len(ids), queries.shape[1]
        mean, turn = means[dim], rotation(dim)
        matrix = np.frombuffer(data, count=n * dim).reshape(n, dim)
        scalars = np.frombuffer(data, count=3 * n, offset=8 * n * dim).reshape(n, 3)
        codes = np.frombuffer(data, np.uint8, offset=8 * n * (dim + 3)).reshape(n, -1)
        length, agree, to_mean = scalars.T
        bits = turn.shape[1]
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        norms, q_norms = np.linalg.norm(matrix, axis=1), np.linalg.norm(queries, axis=1)
        unit = queries / q_norms[:, None]
        rest = unit - mean
        products = (rest @ turn).astype(np.float32) @ signs.T / np.sqrt(bits)  # of the query's difference and the codes
        error = ERRORS * length * np.sqrt(np.maximum(0, 1 - agree**2)) / agree / np.sqrt(bits - 1)
        out_q, out_id, out_score = [], [], []
        for i, own in enumerate(q_ids.tolist()):
            estimate = products[i] / agree * length + to_mean + unit[i] @ mean - mean @ mean
            spread = error * np.linalg.norm(rest[i]) + 1e-6
            lower = np.where(ids == own, -np.inf, estimate - spread)
            bar = max(known[0][i], np.partition(lower, n - k)[n - k] if n >= k else -np.inf)
            some = np.flatnonzero((estimate + spread >= bar) & (ids != own))
            score = np.einsum("ij,j->i", matrix[some], queries[i]) / (norms[some] * q_norms[i])
            best = best_of(ids[some], score, k)
            out_q.append(np.full(len(best), i))
            out_id.append(ids[some][best])
            out_score.append(score[best])
        return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)

    return search


def nearest_cosine(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every query the k rows of largest cosine that the codes find.

    The score is the exact cosine in double precision. Rows with the query's own id are no candidates. Vectors that are
    NULL, empty, zero or hold NULL or non-finite components and rows without an id take no part; vectors of different
    lengths never meet; of query rows that repeat an id the smallest vector counts, candidate rows that repeat an id count
    each. All rows are indexed; the only fitted number is their mean direction.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        zero = F.forall(vector_col, lambda x: x == 0)
        return df.where(usable(F.col(vector_col)) & ~zero & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    base = whole(rows)
    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    sums = base.select("v").mapInArrow(_sums, "dim long, i long, total double, n long").groupBy("dim", "i").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    means = {d: np.zeros(d) for d in {r["dim"] for r in sums}}
    for r in sums:
        means[r["dim"]][r["i"]] = r["mean"]
    copies = k + 1

    def prepare(ids: np.ndarray, matrix: np.ndarray):
        return encode(ids, matrix, means[matrix.shape[1]], copies)

    return nearest(base, asked, prepare, search_with(means), k, "onebit")
