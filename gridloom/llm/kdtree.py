"""Exact inner-product search: a KD-tree per shard, searched best first.

A shard's rows are ordered by median splits along the widest side of their box, down to leaves of `LEAF_ROWS` rows, each
node with the tight box of its rows. The largest inner product a box allows bounds its rows from above, so nodes are
taken in the order of their bounds until none can beat the k-th score, which starts from the one found in an earlier shard.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.vectors import best_of, few_copies, nearest, usable

LEAF_ROWS = 128
EXACT = 2.0**53  # whole numbers up to here are exact as doubles


def _split(matrix: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The leaves in order, each half of a node being the smaller or larger values along the widest side of its box."""
    if len(rows) <= LEAF_ROWS:
        return [rows]
    own = matrix[rows]
    side = np.argmax(own.max(0) - own.min(0))
    order = rows[np.argsort(own[:, side], kind="stable")]
    middle = len(rows) // 2
    return _split(matrix, order[:middle]) + _split(matrix, order[middle:])


def build(ids: np.ndarray, matrix: np.ndarray, copies: int) -> list[tuple[np.ndarray, bytes]]:
    """The rows in the order of their tree's leaves; the tree's shape follows from their number."""
    ids, matrix = few_copies(ids, matrix, copies)
    order = np.concatenate(_split(matrix, np.arange(len(ids))))
    return [(ids[order], matrix[order].tobytes())]


class Tree:
    """Boxes, row ranges and smallest ids of a shard's tree."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.ranges: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self._node(0, len(ids))

    def _node(self, a: int, b: int) -> int:
        number = len(self.ranges)
        self.ranges.append((a, b))
        self.children.append(None)
        for values in (self.low, self.high, self.least):
            values.append(None)
        if b - a <= LEAF_ROWS:
            self.low[number], self.high[number], self.least[number] = self.matrix[a:b].min(0), self.matrix[a:b].max(0), int(self.ids[a:b].min())
        else:
            x, y = self._node(a, (a + b) // 2), self._node((a + b) // 2, b)
            self.children[number] = (x, y)
            self.low[number], self.high[number] = np.minimum(self.low[x], self.low[y]), np.maximum(self.high[x], self.high[y])
            self.least[number] = min(self.least[x], self.least[y])
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each node's box."""
        return np.maximum(queries, 0) @ np.array(self.high).T + np.minimum(queries, 0) @ np.array(self.low).T


def search(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: bytes, k: int, known):
    matrix = np.frombuffer(data).reshape(len(ids), -1)
    tree = Tree(ids, matrix)
    exact = matrix.shape[1] * np.abs(matrix).max() * max(1.0, np.abs(queries).max()) < EXACT
    whole = None if exact else matrix.astype(np.int64)
    bounds = tree.bounds(queries)
    if not exact:
        bounds = bounds + np.abs(bounds) * 1e-9
    out_q, out_id, out_score = [], [], []
    for i, (own, query) in enumerate(zip(q_ids.tolist(), queries)):
        bar, bar_id = known[0][i], known[1][i]
        found_ids, found = np.zeros(0, np.int64), np.zeros(0)
        reach = bounds[i]
        heap = [(-reach[0], 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            if -upper < bar:
                break
            if -upper == bar and tree.least[node] > bar_id:
                continue
            children = tree.children[node]
            if children:
                for child in children:
                    if reach[child] >= bar:
                        heapq.heappush(heap, (-reach[child], child))
                continue
            a, b = tree.ranges[node]
            scores = matrix[a:b] @ query if exact else (whole[a:b] @ query.astype(np.int64)).astype(np.float64)
            some = np.flatnonzero((scores >= bar) & (ids[a:b] != own))
            if len(some):
                found_ids, found = np.concatenate((found_ids, ids[a:b][some])), np.concatenate((found, scores[some]))
                best = best_of(found_ids, found, k)
                found_ids, found = found_ids[best], found[best]
                if len(found) == k and (found[-1], -found_ids[-1]) > (bar, -bar_id):
                    bar, bar_id = found[-1], found_ids[-1]
        out_q.append(np.full(len(found), i))
        out_id.append(found_ids)
        out_score.append(found)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k rows of the highest inner product of floor(scale * component) vectors.

    Rows with the query's own id are no candidates. Vectors that are NULL, empty or hold NULL or non-finite components
    and rows without an id take no part; vectors of different lengths never meet; of query rows that repeat an id the
    smallest vector counts, candidate rows that repeat an id count each. Scores are exact up to 2^53.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
        return df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    copies = k + 1

    def prepare(ids: np.ndarray, matrix: np.ndarray):
        return build(ids, matrix, copies)

    out = nearest(whole(rows), asked, prepare, search, k, "kd")
    return out.withColumn("score", F.col("score").cast("long"))
