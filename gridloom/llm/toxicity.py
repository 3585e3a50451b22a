"""Toxicity by weak supervision: mined lexicon and pattern voters, a generative label model, a linear classifier.

1. From a bounded, class-balanced sample of labelled documents Spark counts in how many toxic and clean texts each word
   and each word beginning (a pattern) occurs, and the most telling terms become voters.
2. The label model takes every voter's vote and the given label as noisy witnesses of the hidden truth. EM estimates each
   witness's two accuracies and the prior; correlations left over given the truth shrink the weight of voters that say
   the same thing.
3. A logistic regression is trained on the model's posterior labels and scores every document.

The model is a few hundred terms with weights, whatever the corpus; it travels with the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.texts import lean, parts, word_codes
from gridloom.session import stored

PREFIXES = (4, 5, 6, 7, 8)
MARKS = ".,;:!?\"'()[]{}*#&%$|"
LABEL_ACCURACY = 0.97  # where EM starts for the given labels


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a NULL key counts as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0))


def terms_of(word: str) -> set[str]:
    """The lexicon and pattern terms of a lower-case word: itself without outer marks, and its beginnings as `abcd*`."""
    core = word.strip(MARKS)
    return {core} | {core[:n] + "*" for n in PREFIXES if len(core) > n} if core else set()


@dataclass
class ToxicModel:
    """Weights by term, and what a text without any term scores. Without two classes to learn from, that is all there is."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -20.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        names, codes, rows = word_codes(texts)
        numbers = {t: i for i, t in enumerate(self.weights)}
        weights = np.array([*self.weights.values(), 0.0])
        hits = [[numbers[t] for t in terms_of(w) if t in numbers] for w in names]
        row, col = present(hits, codes, rows, len(numbers))
        return self.intercept + np.bincount(row, weights[col], len(texts))


def present(hits: list[list[int]], codes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term number) pairs of the words at `codes`, given the term numbers of each distinct word."""
    counts = np.array([len(h) for h in hits], np.int64)
    some = np.flatnonzero(counts[codes]) if len(codes) else np.zeros(0, np.int64)
    pairs = {int(r) * (width + 1) + h for c, r in zip(codes[some].tolist(), rows[some].tolist()) for h in hits[c]}
    keys = np.fromiter(pairs, np.int64, len(pairs))
    keys.sort()
    return keys // (width + 1), keys % (width + 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of a task each term occurs."""
    for batch in parts(batches, 0):
        names, codes, rows = word_codes(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        numbers: dict[str, int] = {}
        hits = [[numbers.setdefault(t, len(numbers)) for t in terms_of(w)] for w in names]
        if not numbers:
            continue
        row, col = present(hits, codes, rows, len(numbers))
        toxic = np.bincount(col, label[row] == 1, len(numbers)).astype(np.int64)
        every = np.bincount(col, minlength=len(numbers))
        yield pa.RecordBatch.from_arrays([pa.array(list(numbers)), pa.array(toxic), pa.array(every - toxic)], ["term", "toxic", "clean"])


def _votes(terms: list[str]):
    numbers = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            names, codes, rows = word_codes(batch.column(0))
            hits = [[numbers[t] for t in terms_of(w) if t in numbers] for w in names]
            row, col = present(hits, codes, rows, len(numbers))
            votes = [v.astype(np.int32) for v in np.split(col, np.searchsorted(row, np.arange(1, batch.num_rows)))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.list_(pa.int32()))], ["label", "votes"])

    return run


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Posterior of the hidden truth for each row, from 0/1 votes of many voters and the given labels.

    A voter's log-odds count is divided by one plus the sum of its positive correlations with other voters that remain
    when the truth is given. `weight` says how many rows each row stands for.
    """
    weight = np.ones(len(labels)) if weight is None else weight
    witnesses = np.concatenate([votes, labels[:, None]], 1).astype(np.float64)
    p = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    for k in range(rounds):
        toxic, clean = weight * p, weight * (1 - p)
        yes = (toxic @ witnesses + 0.1) / (toxic.sum() + 1)
        no = (clean @ witnesses + 0.1) / (clean.sum() + 1)
        prior = np.clip(toxic.sum() / weight.sum(), 1e-4, 1 - 1e-4)
        if k % 5 == 0:
            rest = witnesses - p[:, None] * yes - (1 - p)[:, None] * no
            rest *= np.sqrt(weight / weight.mean())[:, None]
            scale = np.sqrt((rest**2).mean(0)) + 1e-9
            tied = np.clip((rest.T @ rest) / len(rest) / np.outer(scale, scale), 0, 1)
            np.fill_diagonal(tied, 0)
            tied[tied < 0.05] = 0  # noise of the estimate
            tied[-1] = tied[:, -1] = 0
            share = 1 / (1 + tied.sum(1))
        for_yes = share * (np.log(yes) - np.log(no))
        for_no = share * (np.log1p(-yes) - np.log1p(-no))
        logit = np.log(prior / (1 - prior)) + witnesses @ for_yes + (1 - witnesses) @ for_no
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression on soft targets, by Newton steps; `weight` by row."""
    weight = np.ones(len(x)) if weight is None else weight
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (target - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 6000, voters: int = 384, min_texts: int = 5) -> ToxicModel:
    """Learn from the labelled rows for which `learn` (a condition on `labels`) holds.

    per_class bounds the labelled documents of either class that are read, those with the smallest hash of their id. Each
    counts for its share of all labelled documents of its class, so the bound does not move the prior or the scores.
    Labels other than 0 and 1 are left out; of several labels of an id the largest counts.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = stored(known, "toxic-labels")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    chosen = stored(chosen[0].unionByName(chosen[1]), "toxic-sample-ids")
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "_id").select("text", "label")
    sample = stored(sample, "toxic-sample")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return ToxicModel(intercept=20.0 if 1 in size else -20.0)
    rate = {c: total[c] / min(total[c], per_class) for c in size}  # labelled documents that one of the sample stands for
    mean = sum(rate[c] * size[c] for c in size) / sum(size.values())
    counts = sample.mapInArrow(lean(_term_counts), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = {c: (F.col(n) + 0.5) / (size[c] + 1.0) for c, n in ((1, "toxic"), (0, "clean"))}
    odds = F.log(share[1] / share[0]) - 2.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))  # what chance hardly explains
    telling = counts.where(F.col("toxic") + F.col("clean") >= min_texts).withColumn("odds", odds).withColumn("worth", F.abs("odds") * F.sqrt(F.greatest("toxic", "clean").cast("double")))
    terms = [r["term"] for r in telling.where(F.col("odds") > 0.5).orderBy(F.desc("worth"), "term").limit(voters).collect()]
    if not terms:
        return ToxicModel(intercept=float(np.log(size[1] * rate[1] / (size[0] * rate[0]))))
    rows = sample.mapInArrow(lean(_votes(terms)), "label int, votes array<int>").collect()
    votes = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        votes[i, r["votes"]] = 1
    given = np.array([r["label"] for r in rows])
    weight = np.where(given == 1, rate[1], rate[0]) / mean  # as much evidence as rows were read
    weights, intercept = logistic(votes.astype(np.float64), label_model(votes, given, weight=weight), weight=weight)
    return ToxicModel(dict(zip(terms, weights.tolist())), intercept)


def _scores(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            logits = np.clip(model.logits(batch.column(1)), -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-logits)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document, 0 to 1. NULL and empty texts score as texts without any term; repeated rows are scored alike."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_scores(model)), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, with all their columns."""
    docs_text = docs.columns.index(text_col)
    columns = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, docs_text):
            scores = 1 / (1 + np.exp(-np.clip(model.logits(batch.column(docs_text)), -30, 30)))
            yield batch.filter(pa.array(scores < threshold)).rename_columns(columns)

    return docs.mapInArrow(lean(kept), docs.schema)
