"""Probes of embeddings evaluated per fold: every fold, modality and linear probe in the same passes over the rows.

A fold leaves one group out. Means and deviations of its training rows are the totals less those of its group. Logistic
regression and the squared-hinge SVM are fitted by Newton steps: a task adds up, for each fit, the loss, gradient and
curvature of its rows, one task per fit sums them and solves the step, and the driver keeps only the weights. The number
of passes is that of the slowest fit, not the number of fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.metrics import segmentation_metrics
from gridloom.functions.scalars import safe_div
from gridloom.operators.metrics import best_f1_threshold, ranking_metrics
from gridloom.operators.splits import probe_folds
from gridloom.session import stored

LOGISTIC, SVM, MLP = "logistic_regression", "linear_svm", "small_mlp"
PENALTY = 1.0  # of half the squared weights; the intercept is free
MAX_PASSES, TOLERANCE = 60, 1e-6
MOST_WEIGHTS = 1 << 24  # numbers the driver and every task hold: fits times dimensions


@dataclass
class Fit:
    """One linear fit: its fold, and weights on the rows as they are (the scaling is folded in)."""

    modality: str
    probe: str
    fold: str
    mean: np.ndarray
    std: np.ndarray
    balance: tuple[float, float]  # weight of a row of class 0 and 1
    weights: np.ndarray  # on scaled features, intercept last
    loss: float = np.inf
    done: bool = False
    notes: str = ""
    prior: np.ndarray | None = None

    def raw(self) -> tuple[np.ndarray, float]:
        w = self.weights[:-1] / self.std
        return w, float(self.weights[-1] - w @ self.mean)


def group_moments(rows: DataFrame) -> dict[str, dict[str, tuple]]:
    """Per modality and group: (rows by class, sums, sums of squares about the modality's mean). One row per group reaches the driver."""
    x = rows.select("modality", "grp", "y", F.posexplode("x").alias("i", "v"))
    centre = rows.select("modality", F.posexplode("x").alias("i", "v")).groupBy("modality", "i").agg(F.avg("v").alias("m"))
    d = x.join(centre, ["modality", "i"]).withColumn("d", F.col("v") - F.col("m"))
    per = d.groupBy("modality", "grp", "i").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.first("m").alias("m"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    packed = per.groupBy("modality", "grp").agg(F.sort_array(F.collect_list(F.struct("i", "s", "q", "m"))).alias("x"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    out: dict[str, dict[str, tuple]] = {}
    for r in packed.collect():
        s, q, m = (np.array([v[k] for v in r["x"]]) for k in ("s", "q", "m"))
        out.setdefault(r["modality"], {})[r["grp"]] = (np.array([r["n0"], r["n1"]]), s, q, m)
    return out


def started(moments: dict[str, dict[str, tuple]], folds: Sequence[str], probes: Sequence[str]) -> list[Fit]:
    """One fit per modality, linear probe and fold, with the moments of its training rows; fits without both classes are failed."""
    out = []
    for modality, groups in moments.items():
        total = [sum(g[k] for g in groups.values()) for k in range(3)]
        centre = next(iter(groups.values()))[3]
        for fold in folds:
            own = groups.get(fold)
            n, s, q = (t - own[k] for k, t in enumerate(total)) if own else total
            rows = max(int(n.sum()), 1)
            mean = s / rows
            std = np.sqrt(np.maximum(q / rows - mean**2, 0.0))
            std = np.where(std > 1e-12 * (1 + np.abs(centre)), std, 1.0)
            balance = tuple(float(n.sum() / (2 * max(k, 1))) for k in n)
            notes = "" if n.min() > 0 else "the training rows hold one class only"
            for probe in probes:
                out.append(Fit(modality, probe, fold, centre + mean, std, balance, np.zeros(len(mean) + 1), done=bool(notes), notes=notes))
    return out


def margins(fits: list[Fit], x: np.ndarray) -> np.ndarray:
    w, b = zip(*(f.raw() for f in fits))
    return x @ np.stack(w).T + np.array(b)


def contributions(fit: Fit, x: np.ndarray, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature (packed in one vector) of rows about a fit's weights on scaled features."""
    cost = np.where(y == 1, fit.balance[1], fit.balance[0])
    sign = np.where(y == 1, 1.0, -1.0)
    if fit.probe == LOGISTIC:
        loss = cost * np.logaddexp(0.0, -sign * margin)
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
        slope, bend = cost * (p - (y == 1)), cost * p * (1 - p)
    else:
        gap = np.maximum(0.0, 1.0 - sign * margin)
        loss, slope, bend = cost * gap**2, -2 * cost * sign * gap, 2 * cost * (gap > 0)
    z = np.hstack([(x - fit.mean) / fit.std, np.ones((len(x), 1))])
    return np.concatenate([[loss.sum()], z.T @ slope, (z.T @ (z * bend[:, None])).ravel()])


def _sums(fits: list[Fit]):
    """Sums over a task's rows for every open fit; a row never counts for the fold that leaves its group out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            modality, group = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
            y = batch.column(2).to_numpy()
            for name in set(modality.tolist()):
                rows = np.flatnonzero(modality == name)
                x = np.stack(batch.column(3).take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64)
                own = [k for k, f in enumerate(fits) if f.modality == name and not f.done]
                if not own:
                    continue
                m = margins([fits[k] for k in own], x)
                for j, k in enumerate(own):
                    train = group[rows] != fits[k].fold
                    part = contributions(fits[k], x[train], y[rows][train], m[train, j])
                    total[k] = total[k] + part if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fit", "data"])

    return run


def newton(total: np.ndarray, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(penalised loss, largest slope, step) from a fit's sums."""
    n = len(weights)
    keep = np.append(np.full(n - 1, PENALTY), 0.0)
    loss = total[0] + 0.5 * float((keep * weights**2).sum())
    slope = total[1 : n + 1] + keep * weights
    bend = total[n + 1 :].reshape(n, n) + np.diag(keep + 1e-10)
    return loss, float(np.abs(slope).max()), np.linalg.solve(bend, slope)


def _steps(fits: list[Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, total = None, None

        def solved() -> pa.RecordBatch:
            loss, slope, step = newton(total, fits[fit].weights)
            return pa.RecordBatch.from_arrays([pa.array([fit], pa.int64()), pa.array([loss]), pa.array([slope]), pa.array([step.tobytes()], pa.binary())], names=["fit", "loss", "slope", "step"])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data)
                if k != fit:
                    if fit is not None:
                        yield solved()
                    fit, total = k, part.copy()
                else:
                    total += part
        if fit is not None:
            yield solved()

    return run


def fitted(rows: DataFrame, fits: list[Fit], max_passes: int = MAX_PASSES) -> list[Fit]:
    """Newton passes until the slope of every fit is below TOLERANCE times its start; a step that raises the loss is halved."""
    if sum(len(f.weights) for f in fits) > MOST_WEIGHTS:
        raise ValueError(f"all fits together have more than {MOST_WEIGHTS} weights; evaluate modalities or probes apart")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first: dict[int, float] = {}
    for _ in range(max_passes):
        if all(f.done for f in fits):
            break
        parts = rows.select("modality", "grp", "y", "x").coalesce(n).mapInArrow(_sums(fits), "fit long, data binary")
        solved = parts.repartition(n, "fit").sortWithinPartitions("fit").mapInArrow(_steps(fits), "fit long, loss double, slope double, step binary")
        for r in solved.collect():
            f = fits[r["fit"]]
            if r["loss"] > f.loss * (1 + 1e-12) and f.prior is not None:
                f.weights = (f.weights + f.prior) / 2
                f.done = bool(np.abs(f.weights - f.prior).max() < 1e-13)
                continue
            f.loss, f.prior = r["loss"], f.weights
            if r["slope"] <= TOLERANCE * max(1.0, first.setdefault(r["fit"], r["slope"])):
                f.done = True
            else:
                f.weights = f.weights - np.frombuffer(r["step"])
    for f in fits:
        f.notes = f.notes or ("" if f.done else f"no optimum after {max_passes} passes")
    return fits


def _scored(fits: list[Fit]):
    names = ["modality", "probe", "fold", "role", "y", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            modality, group = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
            y = batch.column(2).to_numpy()
            for name in set(modality.tolist()):
                own = [f for f in fits if f.modality == name and not f.notes]
                if not own:
                    continue
                rows = np.flatnonzero(modality == name)
                x = np.stack(batch.column(3).take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64)
                scores = 1.0 / (1.0 + np.exp(-np.clip(margins(own, x), -500, 500)))
                for j, f in enumerate(own):
                    role = np.where(group[rows] == f.fold, "test", "train")
                    columns = [pa.repeat(v, len(rows)) for v in (name, f.probe, f.fold)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(role, pa.string()), pa.array(y[rows], pa.int32()), pa.array(scores[:, j])], names=names)

    return run


def probe_scores(rows: DataFrame, folds: Sequence[str], probes: Sequence[str] = (LOGISTIC, SVM)) -> tuple[DataFrame, DataFrame]:
    """(scores, failures) of all fits over rows (modality, grp, y, x).

    scores: modality, probe, fold, role, y, score in [0, 1]; failures: modality, probe, fold, notes. The small network is
    fitted by Spark ML, one fit at a time; an error of a fit becomes a failure.
    """
    spark = rows.sparkSession
    linear = [p for p in probes if p != MLP]
    fits = fitted(rows, started(group_moments(rows), folds, linear)) if linear else []
    scores = rows.select("modality", "grp", "y", "x").mapInArrow(_scored(fits), "modality string, probe string, fold string, role string, y int, score double")
    failed = [(f.modality, f.probe, f.fold, f.notes) for f in fits if f.notes]
    if MLP in probes:
        from gridloom.operators.embeddings import train_probe

        for modality in sorted(r["modality"] for r in rows.select("modality").distinct().collect()):
            own = rows.where(F.col("modality") == modality).select("modality", "grp", "y", F.col("x").alias("embedding"))
            for fold in folds:
                try:
                    out = train_probe(own.where(F.col("grp") != fold), own, "mlp", "y")
                    scores = scores.unionByName(
                        out.select("modality", F.lit(MLP).alias("probe"), F.lit(fold).alias("fold"), F.when(F.col("grp") == fold, "test").otherwise("train").alias("role"), F.col("y").cast("int"), "score")
                    )
                except Exception as e:  # noqa: BLE001 - a failed fit is a row of the report
                    failed.append((modality, MLP, fold, f"{type(e).__name__}: {str(e)[:200]}"))
    return stored(scores, "probe-scores"), spark.createDataFrame(failed, "modality string, probe string, fold string, notes string")


def probe_results(scores: DataFrame, by: Sequence[str] = ("modality", "probe", "fold"), n: int = 101) -> DataFrame:
    """Sizes, threshold and metrics per fit from rows (by, role, y, score): the threshold has the best F1 on the training
    rows, all metrics are those of the test rows at it. Fits without test or training rows get no row."""
    by = list(by)
    train, test = scores.where("role = 'train'"), scores.where("role = 'test'")
    count = lambda role, y: F.count_if((F.col("role") == role) & (F.col("y") == y))
    sizes = scores.groupBy(*by).agg(*[count(r, y).alias(f"{r}_{k}") for r in ("train", "test") for y, k in ((1, "positive"), (0, "negative"))])
    cut = best_f1_threshold(train, by, "score", "y", n)
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    cells = {"tp": pos & hit, "fp": ~pos & hit, "fn": pos & ~hit, "tn": ~pos & ~hit}
    at = test.join(cut.select(*by, "threshold"), by).groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in cells.items()])
    ranks = ranking_metrics(test, by, "score", "y").select(*by, "average_precision", "roc_auc")
    m = segmentation_metrics(*[F.col(k) for k in ("tp", "fp", "fn", "tn")], 0)
    out = sizes.join(cut.withColumnRenamed("train_f1", "train_best_f1"), by).join(at, by).join(ranks, by)
    samples = {f"{r}_samples": F.col(f"{r}_positive") + F.col(f"{r}_negative") for r in ("train", "test")}
    tested = F.col("test_positive") + F.col("test_negative")
    return out.select(
        *by, *[v.alias(k) for k, v in samples.items()], "train_positive", "train_negative", "test_positive", "test_negative", "threshold", "train_best_f1", "average_precision", "roc_auc",
        m["dice_pos"].alias("f1"), m["precision_pos"].alias("precision"), m["recall_pos"].alias("recall"), m["balanced_accuracy"].alias("balanced_accuracy"),
        m["accuracy"].alias("accuracy"), "tp", "fp", "fn", "tn", safe_div(100.0 * F.col("test_positive"), tested).alias("test_positive_percent"),
        safe_div(100.0 * (F.col("tp") + F.col("fp")), tested).alias("pred_positive_percent"),
    )


def evaluate_probes(emb: DataFrame, group: Column, label: Column, modality: Column, probes: Sequence[str] = (LOGISTIC, SVM), fold_mode: str = "leave_one_region_out", **limits: int) -> DataFrame:
    """One row per modality, probe and usable fold, `status` completed or failed: sizes, threshold, metrics, notes.

    Folds leave one group out and are taken from `probe_folds` with its limits; skipped folds have no row.
    """
    rows = emb.select(modality.cast("string").alias("modality"), group.cast("string").alias("grp"), label.cast("int").alias("y"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    rows = stored(rows.where(F.col("grp").isNotNull() & F.col("y").isin(0, 1) & F.col("modality").isNotNull()), "probe-rows")
    one = rows.select("modality").limit(1).collect()
    if not one:
        raise ValueError("no rows with a modality, a group and a label of 0 or 1")
    table = stored(probe_folds(rows.where(F.col("modality") == one[0]["modality"]), "grp", "y", **limits), "folds")
    folds = sorted(r["heldout_value"] for r in table.where("skip_reason = ''").select("heldout_value").collect())
    scores, failed = probe_scores(rows, folds, probes)
    done = probe_results(scores).withColumns({"status": F.lit("completed"), "notes": F.lit("")})
    lost = failed.join(table.select(F.col("heldout_value").alias("fold"), *[c for c in table.columns if c.startswith(("train_", "test_"))]), "fold").withColumn("status", F.lit("failed"))
    return done.unionByName(lost, allowMissingColumns=True).withColumn("fold_mode", F.lit(fold_mode))
