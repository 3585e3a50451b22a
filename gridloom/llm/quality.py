"""Document quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every text are computed once from Arrow buffers. Cosines of random projections of the standardised
statistics approximate a Gaussian kernel; every task sums its rows' normal equations, Spark adds those sums, and the
driver solves one small system. Scores of the training rows, counted by value on a fixed grid, are calibrated by the
pool-adjacent-violators rule. What reaches the driver depends on the number of features and the grid only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.texts import parts, word_codes
from gridloom.session import stored

FEATURES = 256
RIDGE = 1.0
SEED = 7
GRID = 1000  # cells of the calibration grid per unit of score
STATISTICS = (
    "log_bytes log_words word_bytes upper digits stops commas bars bangs signs other_marks new_lines wide "
    "distinct_words repeated_neighbours most_frequent_word marked_words line_bytes capital_words".split()
)
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".", "commas": b",;:", "bars": b"|", "bangs": b"!?", "signs": b"#$%&*@^~<>=+", "other_marks": b"\"'()[]{}-_/\\`", "new_lines": b"\n"}


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for number, members in enumerate(CLASSES.values(), 1):
        table[list(members)] = number
    table[128:] = len(CLASSES) + 1
    return table


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for every text; texts without words have zeros where nothing can be counted."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    body = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    row = np.repeat(np.arange(n), size)
    width = len(CLASSES) + 2
    counts = np.bincount(row * width + _classes()[body], minlength=n * width).reshape(n, width)[:, 1:]
    names, codes, rows = word_codes(texts)
    words = np.bincount(rows, minlength=n)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
    distinct, first, times = np.unique(rows * max(1, len(names)) + codes, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, rows[first], times)
    same = np.bincount(rows[1:][(codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])], minlength=n) if len(codes) else np.zeros(n)
    marked = np.array([not w[-1:].isalnum() and w[-1:] not in ".,;:" for w in names], bool)
    ended = np.bincount(rows[marked[codes]], minlength=n) if len(codes) else np.zeros(n)
    lines = counts[:, list(CLASSES).index("new_lines")] + 1
    out = [np.log1p(size), np.log1p(words), size / some, *(counts / bytes_[:, None]).T]
    out += [np.bincount(rows[first], minlength=n) / some, same / some, most / some, ended / some, np.log1p(size / lines), counts[:, 0] / some]
    return np.stack(out, 1)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1):
        values = statistics(batch.column(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "stats"])


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(source.mapInArrow(_statistics_of, "doc_id long, stats array<double>"), "statistics")


@dataclass
class QualityModel:
    """Standardisation, projection, ridge weights and the calibration curve. Without labels the score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier(np.clip((stats - self.mean) / self.scale, -6, 6))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1)  # the second part only orders ties


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, a constant and the rows themselves."""
    rng = np.random.default_rng(SEED)
    turn = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1] / 2)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(x @ turn + shift), np.ones((len(x), 1)), x / 10), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _normal_equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = np.concatenate((model.features(_matrix(batch.column(0))), batch.column(1).to_numpy()[:, None]), 1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            upper = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.ravel_multi_index(upper, total.shape)), pa.array(total[upper])], ["cell", "value"])

    return run


def _raw(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], ["raw", "label"])

    return run


def isotonic(x: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over sorted x: the centre and the level of each pool."""
    pools: list[list[float]] = []
    for a, k, m in zip(x.tolist(), n.tolist(), mean.tolist()):
        pools.append([a * k, k, m * k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.5 * p[2] / p[1]) / (p[1] + 0.5) for p in pools])


def fit(stats: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Learn from all labelled rows for which `learn` (a condition on `labels`) holds.

    Labels other than 0 and 1 are left out; of several labels of an id the largest counts.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    rows = stored(stats.join(known, "doc_id").select("stats", "label"), "quality-rows")
    moments = [f(F.col("stats")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    first = rows.agg(F.count(F.lit(1)), *moments).first()
    constant = np.zeros(len(STATISTICS))
    if not first[0]:
        return QualityModel(constant, constant + 1, np.zeros(FEATURES + 1 + len(STATISTICS)), np.array([0.0]), np.array([0.5]))
    model = QualityModel(np.array(first[1::2]), np.maximum(np.array(first[2::2]), 1e-6), constant, constant, constant)
    cells = rows.mapInArrow(_normal_equations(model), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    size = FEATURES + 2 + len(STATISTICS)
    total = np.zeros(size * size)
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    total = total.reshape(size, size)
    total = total + np.triu(total, 1).T
    model.weights = np.linalg.solve(total[:-1, :-1] + RIDGE * np.eye(size - 1), total[:-1, -1])
    grid = F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * GRID)
    counted = rows.mapInArrow(_raw(model), "raw double, label double").groupBy(grid.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).orderBy("cell").toPandas()
    model.knots, model.levels = isotonic(counted["cell"].to_numpy() / GRID, counted["n"].to_numpy(), counted["mean"].to_numpy())
    return model


def _scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))], ["doc_id", "score"])

    return run


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of `statistics_table`, 0 to 1; NULL and empty texts are scored by their statistics, which are zeros."""
    return stats.select("doc_id", "stats").mapInArrow(_scores(model), "doc_id long, score double")
