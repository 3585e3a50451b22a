"""Embedding checks and comparisons, exact nearest neighbours, silhouette, PCA and linear probes.

Embeddings are `array<float>` columns. Per-dimension statistics use the ML summarizer (one mergeable vector per task)
instead of one row per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import rules as R
from gridloom.functions.arrays import cosine, dot, norm
from gridloom.operators.ranking import hash_order, top_k

MAX_SILHOUETTE_SAMPLE = 20_000  # rows of the sample that travels to every task
GROUP_ROWS = 1 << 15  # training rows of a cell that meet in one task
SEARCH_CELLS = 1 << 22  # distances a task computes at once


def n_rows() -> Column:
    return F.count(F.lit(1))


def pair_embeddings(a: DataFrame, b: DataFrame, key: str = "patch_id") -> DataFrame:
    return a.select(key, F.col("embedding").alias("a")).join(b.select(key, F.col("embedding").alias("b")), key)


def row_cosine(pairs: DataFrame, key: str = "patch_id") -> DataFrame:
    return pairs.select(key, cosine(F.col("a"), F.col("b")).alias("cosine"))


def consistency(rows: DataFrame, groups: Sequence[str], tol: float = 1e-8) -> DataFrame:
    """Similarity of two variants to the optical embedding, for the whole table and each value of the group columns.

    `rows` holds cos_snap, cos_rtc and label_binary. Each row is laid out once per grouping, then aggregated; medians
    and quartiles are exact.
    """
    from gridloom.operators.stats import grouped_quantiles

    delta = F.col("cos_rtc") - F.col("cos_snap")
    kinds = [F.struct(F.lit("overall").alias("group_type"), F.lit("all_patches").alias("group_value"))]
    kinds += [F.struct(F.lit(g).alias("group_type"), F.col(g).cast("string").alias("group_value")) for g in groups]
    laid = rows.withColumn("delta", delta).select("cos_snap", "cos_rtc", "delta", "label_binary", F.inline(F.array(*kinds)))
    by = ["group_type", "group_value"]
    short = {"cos_snap": "snap", "cos_rtc": "rtc", "delta": "delta"}
    stats = [(F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max")]
    up, down = F.count_if(F.col("delta") > tol), F.count_if(F.col("delta") < -tol)
    base = laid.groupBy(*by).agg(
        n_rows().alias("n"), F.count_if(F.col("label_binary") == 1).alias("positive_count"), F.count_if(F.col("label_binary") == 0).alias("empty_count"),
        *[f(c).alias(f"{s}_{name}") for c, s in short.items() for f, name in stats], up.alias("rtc_wins"), down.alias("snap_wins"), (n_rows() - up - down).alias("ties"),
    )
    q = grouped_quantiles(laid, by, list(short), [0.25, 0.5, 0.75])
    q = q.select(*by, *[F.col(f"{c}_{p}").alias(f"{s}_{n}") for c, s in short.items() for p, n in (("p25", "q25"), ("p50", "median"), ("p75", "q75"))])
    c = F.col
    hi, lo = c("delta_mean") > tol, c("delta_mean") < -tol
    decision = R.first_true(
        [
            (hi & (c("rtc_wins") > c("snap_wins")), "RTC higher consistency"), (lo & (c("snap_wins") > c("rtc_wins")), "SNAP-GRD higher consistency"),
            (F.abs("delta_mean") <= tol, "Near tie"), (hi, "RTC higher mean, mixed patches"),
        ],
        "SNAP-GRD higher mean, mixed patches",
    )
    return base.join(q, by).withColumn("decision", decision)


def check_embeddings(emb: DataFrame, by: Sequence[str] = ("modality",), zero_variance: float = 1e-12, min_norm: float = 1e-8, min_std: float = 1e-8) -> DataFrame:
    """Shape, finiteness, norms, variance, duplicates and label counts per modality."""
    from pyspark.ml.stat import Summarizer

    by, e = list(by), F.col("embedding")
    finite = F.forall(e, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    add = lambda f: F.aggregate(e, F.lit(0.0), lambda s, v: s + f(v.cast("double")))
    rows = emb.select(
        *by, "patch_id", "label_binary", F.size(e).alias("_d"), finite.alias("_ok"), norm(e).alias("_norm"), add(lambda v: v).alias("_s"), add(lambda v: v * v).alias("_q"),
        array_to_vector(F.transform(e, lambda v: v.cast("double"))).alias("_v"),
    )
    var = vector_to_array(Summarizer.variance(F.col("_v")))
    n, cells = n_rows(), F.sum("_d")
    mean = F.sum("_s") / cells
    g = rows.groupBy(*by).agg(
        n.alias("n_rows"), F.max("_d").alias("embedding_dim"), (F.min("_d") == F.max("_d")).alias("one_shape"), F.bool_and("_ok").alias("all_finite"),
        F.count_if(F.col("label_binary") == 1).alias("positive_count"), F.count_if(F.col("label_binary") == 0).alias("empty_count"),
        mean.alias("global_mean"), F.sqrt(F.greatest(F.sum("_q") / cells - mean * mean, F.lit(0.0))).alias("global_std"),
        F.avg("_norm").alias("mean_l2_norm"), F.min("_norm").alias("min_l2_norm"), F.max("_norm").alias("max_l2_norm"), var.alias("_var"),
    )
    flat = F.filter("_var", lambda v: F.sqrt(v) <= zero_variance)
    dup = emb.groupBy(*by, "patch_id").agg(n_rows().alias("_n")).groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("duplicate_ids"))
    out = g.withColumn("zero_variance_dimensions", F.size(flat)).drop("_var").join(dup, by)
    c = F.col
    ok = (
        c("one_shape") & c("all_finite") & (c("global_std") > min_std) & (c("zero_variance_dimensions") < c("embedding_dim"))
        & (c("min_l2_norm") > min_norm) & (c("duplicate_ids") == 0)
    )
    return out.withColumn("status", F.when(ok, "passed").otherwise("failed"))


def pairwise_check(pairs: DataFrame, atol: float = 1e-8, rtol: float = 1e-6) -> DataFrame:
    """Difference of two modalities over all paired patches; all values close means they are suspiciously identical."""
    d = F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    close = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)), lambda ok: ok)
    rows = pairs.select((F.size("a") == F.size("b")).alias("_same"), F.array_max(d).alias("_max"), F.aggregate(d, F.lit(0.0), lambda s, v: s + v).alias("_sum"), F.size(d).alias("_n"), cosine(F.col("a"), F.col("b")).alias("_cos"), close.alias("_close"))
    g = rows.agg(
        F.bool_and("_same").alias("same_shape"), F.max("_max").alias("max_abs_diff"), (F.sum("_sum") / F.sum("_n")).alias("mean_abs_diff"),
        F.avg("_cos").alias("mean_cosine_similarity"), F.bool_and("_close").alias("allclose"),
    )
    return g.withColumn("status", F.when(F.col("allclose") | ~F.col("same_shape"), "failed").otherwise("passed"))


def metadata_agreement(a: DataFrame, b: DataFrame, cols: Sequence[str], key: str = "patch_id", tol: float = 1e-6) -> DataFrame:
    """Mismatches per metadata column between two modalities, and keys only one of them has."""
    left = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(1).alias("_in_a"))
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols], F.lit(1).alias("_in_b"))
    j = left.join(right, key, "full")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    types = dict(a.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        return F.abs(x - y) > tol if types[c] in ("double", "float") else ~x.eqNullSafe(y)

    counts = {c: F.count_if(both & differs(c)) for c in cols} | {"unpaired_keys": F.count_if(~both)}
    agg = j.agg(*[v.alias(k) for k, v in counts.items()])
    laid = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("mismatches")) for k in counts])
    return agg.select(F.inline(laid))


def standardize(emb: DataFrame, stats_of: DataFrame | None = None) -> DataFrame:
    """Columns standardised by the population std (constant columns only centred). The statistics are two vectors of
    the embedding's length, whatever the number of rows, so they travel as literals."""
    from pyspark.ml.stat import Summarizer

    e = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    row = (stats_of if stats_of is not None else emb).select(e.alias("v")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("m"), vector_to_array(Summarizer.variance(F.col("v"))).alias("s"), n_rows().alias("n")
    ).first()
    n = max(1, row["n"])
    std = [(max(v, 0.0) * (n - 1) / n) ** 0.5 or 1.0 for v in row["s"]]
    pairs = F.arrays_zip(F.col("embedding").alias("x"), F.lit([float(v) for v in row["m"]]).alias("m"), F.lit([float(v) for v in std]).alias("s"))
    return emb.withColumn("embedding", F.transform(pairs, lambda p: (p["x"].cast("double") - p["m"]) / p["s"]))


def pca(emb: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows with `pca` coordinates, explained variance ratios). Signs of the axes are arbitrary."""
    from pyspark.ml.feature import PCA

    v = emb.withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    rows = model.transform(v).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
    ratios = [(i + 1, float(r)) for i, r in enumerate(model.explainedVariance)]
    return rows, emb.sparkSession.createDataFrame(ratios, "component int, explained_variance_ratio double")


# --- exact nearest neighbours ----------------------------------------------------------------------------------------


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0.0))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def _assign(pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(_matrix(pdf["embedding"]), pivots)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype("int32"), pd=d[np.arange(len(d)), cell])

    return run


def _route(pivots: np.ndarray, bounds: dict[int, tuple[float, float, list[float]]], k: int) -> Callable:
    """Cells each query must visit, as a list: those whose lower distance bound does not exceed an upper bound of its
    k-th neighbour. Both bounds follow from the triangle inequality, so no true neighbour is ever skipped."""
    cells = sorted(bounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(_matrix(pdf["embedding"]), pivots)[:, cells]
            upper = np.concatenate([d[:, [i]] + np.asarray(bounds[c][2])[None, :] for i, c in enumerate(cells)], axis=1)
            kth = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
            lo = np.asarray([bounds[c][0] for c in cells])
            hi = np.asarray([bounds[c][1] for c in cells])
            lower = np.maximum(np.maximum(d - hi, lo - d), 0.0)
            visit = lower <= kth[:, None] * (1 + 1e-9) + 1e-9
            yield pdf.assign(cells=[np.asarray(cells, dtype="int32")[row] for row in visit])

    return run


def _vectors(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _first_copies(y: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows without those that follow k copies of themselves, which no query can need."""
    _, number = np.unique(np.ascontiguousarray(y + 0.0).view(f"V{y.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.argsort(number, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[place < k])


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y, ties to the smaller row. The matrix product only picks
    what may be among them; distances are those of the differences, so copies of a vector are equally far."""
    m = min(k, len(y))
    yy = (y * y).sum(1)
    xx = (x * x).sum(1)[:, None]
    d = xx + yy[None, :] - 2.0 * (x @ y.T)
    kth = np.partition(d, m - 1, axis=1)[:, [m - 1]]
    rows, hits = np.nonzero(d <= kth + 1e-12 * (xx + yy.max()))
    step = max(1, SEARCH_CELLS // y.shape[1])
    exact = [np.sqrt(((x[rows[s : s + step]] - y[hits[s : s + step]]) ** 2).sum(1)) for s in range(0, len(rows), step)]
    distance = np.concatenate(exact) if exact else np.zeros(0)
    order = np.lexsort((hits, distance, rows))
    starts = np.searchsorted(rows, np.arange(len(x)))  # np.nonzero gives the rows in order, and so does the sort
    kept = order[np.arange(len(order)) - starts[rows[order]] < m]
    return rows[kept], hits[kept], distance[kept]


def _stream(k: int, chunk: int) -> Callable:
    """Rows come ordered by group, training rows before queries and those by id: a group's training rows are held, its
    queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, y = None, [], np.zeros((0, 0))
        for batch in batches:
            numbers = batch.column("group").to_numpy()
            kinds = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(numbers)]):
                if e == s:
                    continue
                part = batch.slice(s, e - s)
                if numbers[s] != group:
                    group, held, y = numbers[s], [], np.zeros((0, 0))
                if not kinds[s]:
                    held.append(part.select(["id", "label", "embedding"]))
                    continue
                if not held:
                    continue
                if not len(y):
                    train = pa.Table.from_batches(held).combine_chunks()
                    y = _vectors(train.column("embedding").combine_chunks())
                    first = _first_copies(y, k)
                    y, ids, labels = y[first], train.column("id").take(first).combine_chunks(), train.column("label").take(first).combine_chunks()
                    del train
                step = max(1, min(chunk, SEARCH_CELLS // len(y)))
                for q in range(0, len(part), step):
                    block = part.slice(q, step)
                    rows, hits, distance = _nearest(_vectors(block.column("embedding")), y, k)
                    out = [block.column("run").take(pa.array(rows)), block.column("query").take(pa.array(rows)), ids.take(pa.array(hits)), pa.array(distance), labels.take(pa.array(hits))]
                    yield pa.RecordBatch.from_arrays(out, ["run", "query", "neighbour", "distance", "label"])

    return run


def _search(k: int) -> Callable:
    def run(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        cols = ["run", "query", "neighbour", "distance", "label"]
        if queries.empty or train.empty:
            return pd.DataFrame({c: [] for c in cols})
        x, y = _matrix(queries["embedding"]), _matrix(train["embedding"])
        ids, labels = train["id"].to_numpy(), train["label"].to_numpy()
        out = []
        for s in range(0, len(x), 1024):
            d = _distances(x[s : s + 1024], y)
            m = min(k, d.shape[1])
            kth = np.partition(d, m - 1, axis=1)[:, m - 1]
            rows, hits = np.nonzero(d <= kth[:, None])
            q = queries.iloc[s : s + 1024]
            near = pd.DataFrame({"run": q["run"].to_numpy()[rows], "query": q["query"].to_numpy()[rows], "neighbour": ids[hits], "distance": d[rows, hits], "label": labels[hits], "_q": rows})
            out.append(near.sort_values(["_q", "distance", "neighbour"]).groupby("_q").head(m).drop(columns="_q"))  # ties are cut by id
        return pd.concat(out)

    return run


def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int = 15, pivots: int = 64, chunk: int = 20_000) -> DataFrame:
    """Exact k nearest training rows of each query, as (run, query, neighbour, distance, label).

    `train` holds run, id, embedding, label; `queries` holds run, query, embedding; `run` keeps repeats apart. Rows are
    assigned to the nearest of a fixed number of pivots (a seeded sample); each cell's radius and k smallest pivot
    distances bound what any query can find there, so a query is sent only to cells that may hold a neighbour. A cell is
    cut into groups of some GROUP_ROWS training rows. A training row goes to one group, a query to every group it must
    visit; a task holds the training rows of a group and lets the queries pass by, at most `chunk` at once, so its memory
    does not depend on their number. In many dimensions most cells are visited: meant for up to some 10^10 pairs of rows,
    `neighbours.approximate_neighbours` for more.
    """
    picks = train.select("id", "embedding").dropDuplicates(["id"]).withColumn("_h", hash_order(F.col("id"), salt="pivot")).orderBy("_h", "id").limit(pivots).collect()
    points = np.array([np.asarray(r["embedding"], dtype=np.float64) for r in picks])
    kinds = {c: train.schema[c].dataType.simpleString() for c in ("run", "id", "label")}
    qkind = queries.schema["query"].dataType.simpleString()
    fields = f"run {kinds['run']}, id {kinds['id']}, embedding array<double>, label {kinds['label']}, cell int, pd double"
    dbl = F.transform("embedding", lambda v: v.cast("double")).alias("embedding")
    placed = train.select("run", "id", dbl, "label").mapInPandas(_assign(points), fields)
    # One row per (run, cell): radii, k smallest pivot distances and size. The rank limit keeps k rows per task.
    near = top_k(placed.select("run", "cell", "pd"), ["run", "cell"], [F.col("pd")], k, "_rn").groupBy("run", "cell").agg(F.collect_list("pd").alias("near"))
    stats = placed.groupBy("run", "cell").agg(F.min("pd").alias("lo"), F.max("pd").alias("hi"), n_rows().alias("n")).join(near, ["run", "cell"]).collect()
    out = f"run {kinds['run']}, query {qkind}, neighbour {kinds['id']}, distance double, label {kinds['label']}"
    if not stats:
        return train.sparkSession.createDataFrame([], out + ", rank int")
    # Every run sees the same pivots; the loosest bounds over the runs hold for each of them.
    bounds: dict[int, tuple[float, float, list[float]]] = {}
    for r in stats:
        lo, hi, ds = bounds.get(r["cell"], (np.inf, 0.0, []))
        mine = sorted(r["near"]) + [np.inf] * (k - len(r["near"]))
        ds = [max(a, b) for a, b in zip(ds, mine)] if ds else mine
        bounds[r["cell"]] = (min(lo, r["lo"]), max(hi, r["hi"]), ds)
    runs = {r["run"] for r in stats}
    for c in bounds:  # a cell that some run does not have promises nothing to that run
        if len({r["run"] for r in stats if r["cell"] == c}) < len(runs):
            bounds[c] = (bounds[c][0], bounds[c][1], [np.inf] * k)
    groups, entries = 0, []
    for r in sorted(stats, key=lambda r: (r["cell"], str(r["run"]))):
        parts = -(-r["n"] // GROUP_ROWS)
        cell = F.struct(F.lit(r["run"]).cast(kinds["run"]).alias("run"), F.lit(r["cell"]).alias("cell"))
        entries += [cell, F.struct(F.lit(groups).alias("first"), F.lit(parts).alias("parts"))]
        groups += parts
    at = F.create_map(*entries)[F.struct(F.col("run").alias("run"), F.col("cell").alias("cell"))]
    part = (hash_order(F.col("id"), salt="part") % F.col("_at.parts")).cast("int")
    null = lambda kind: F.lit(None).cast(kind)
    held = placed.withColumn("_at", at).select((F.col("_at.first") + part).alias("group"), F.lit(False).alias("is_query"), "run", "id", "label", null(qkind).alias("query"), "embedding")
    routed = queries.select("run", "query", dbl).mapInPandas(_route(points, bounds, k), f"run {kinds['run']}, query {qkind}, embedding array<double>, cells array<int>")
    sent = routed.withColumn("cell", F.explode("cells")).withColumn("_at", at).where("_at IS NOT NULL")
    sent = sent.select(F.explode(F.expr("sequence(_at.first, _at.first + _at.parts - 1)")).alias("group"), F.lit(True).alias("is_query"), "run", null(kinds["id"]).alias("id"), null(kinds["label"]).alias("label"), "query", "embedding")
    met = held.unionByName(sent).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "is_query", "id")
    found = met.mapInArrow(_stream(k, chunk), out).repartition("run", "query")
    return top_k(found, ["run", "query"], [F.col("distance"), F.col("neighbour")], k, "rank")


def knn_scores(neighbours: DataFrame) -> DataFrame:
    """Distance-weighted share of positive neighbours per query; neighbours at distance zero take the whole vote."""
    zero = F.col("distance") == 0
    pos = F.col("label") == 1
    exact, inverse = F.count_if(zero), F.sum(F.when(~zero, 1.0 / F.col("distance")))
    score = F.when(exact > 0, F.count_if(zero & pos) / exact).otherwise(F.coalesce(F.sum(F.when(~zero & pos, 1.0 / F.col("distance"))), F.lit(0.0)) / inverse)
    return neighbours.groupBy("run", "query").agg(score.alias("score"))


def _cluster_sums(points: np.ndarray, clusters: np.ndarray, n_clusters: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_hot = np.eye(n_clusters)[clusters]
        sizes = one_hot.sum(0)
        for pdf in batches:
            x, own = _matrix(pdf["embedding"]), pdf["cluster"].to_numpy()
            diff = [np.sqrt(((points - row) ** 2).sum(1)) for row in x]
            sums = np.asarray(diff) @ one_hot
            rows = np.arange(len(x))
            alone = sizes[own] <= 1
            a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
            means = sums / np.maximum(sizes, 1)
            means[rows, own] = np.inf
            means[:, sizes == 0] = np.inf
            b = means.min(1)
            s = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
            yield pdf[["id"]].assign(silhouette=s)

    return run


def silhouette(emb: DataFrame, cluster: str, key: str = "patch_id") -> DataFrame:
    """Silhouette of every row with squared Euclidean distances, as (id, silhouette); a row alone in its cluster has 0.

    The mean squared distance to a cluster follows from its size, its sum vector and its sum of squared norms, so rows are
    never paired: two aggregates over (cluster, component), then one pass that compares a row with each cluster. Vectors
    are centred first, which keeps the differences of large norms exact.
    """
    rows = emb.select(F.col(key).alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col(cluster).cast("string").alias("_c"))
    in_order = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("i", v))), lambda p: p["v"])
    mean = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).agg(in_order(F.col("v")).alias("_m")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(mean, "_one").select("id", "_c", F.zip_with("x", "_m", lambda a, b: a - b).alias("x"))
    sums = rows.select("_c", F.posexplode("x").alias("i", "v")).groupBy("_c", "i").agg(F.sum("v").alias("v")).groupBy("_c").agg(in_order(F.col("v")).alias("s"))
    sizes = rows.groupBy("_c").agg(n_rows().alias("n"), F.sum(dot(F.col("x"), F.col("x"))).alias("q"))
    clusters = sums.join(sizes, "_c").agg(F.collect_list(F.struct("_c", "n", "s", "q")).alias("_k")).withColumn("_one", F.lit(1))
    far = lambda k: k["n"] * dot(F.col("x"), F.col("x")) - 2.0 * dot(F.col("x"), k["s"]) + k["q"]
    own = lambda k: k["_c"].eqNullSafe(F.col("_c"))
    joined = rows.withColumn("_one", F.lit(1)).join(clusters, "_one")
    mine = F.filter("_k", own)[0]
    a = F.greatest(far(mine), F.lit(0.0)) / (mine["n"] - 1)
    b = F.array_min(F.transform(F.filter("_k", lambda k: ~own(k)), lambda k: F.greatest(far(k), F.lit(0.0)) / k["n"]))
    return joined.select("id", F.when(mine["n"] > 1, (b - a) / F.greatest(a, b, F.lit(1e-300))).otherwise(0.0).alias("silhouette"))


def silhouette_sample(emb: DataFrame, cluster: str, key: str = "patch_id", sample: int = 5000, seed: str = "42") -> DataFrame:
    """Euclidean silhouette of each row of a seeded sample, with the number of rows that were scored in `sample_rows`.

    The sample size is the operator's own parameter and is checked, so the sample can travel to every task; each task
    then scores its rows against it. `silhouette` scores whole tables.
    """
    if not 0 < sample <= MAX_SILHOUETTE_SAMPLE:
        raise ValueError(f"the silhouette sample must hold between 1 and {MAX_SILHOUETTE_SAMPLE} rows")
    rows = emb.select(F.col(key).alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), F.col(cluster).cast("string").alias("_c"))
    picked = rows.withColumn("_h", hash_order(F.col("id"), salt=seed)).orderBy("_h", "id").limit(sample)
    local = picked.select("id", "embedding", "_c").toPandas()
    names = sorted(local["_c"].unique())
    index = {n: i for i, n in enumerate(names)}
    ids = local["_c"].map(index).to_numpy()
    number = F.create_map(*[F.lit(x) for n, i in index.items() for x in (n, i)])
    kind = emb.schema[key].dataType.simpleString()
    scored = picked.select("id", "embedding", number[F.col("_c")].alias("cluster")).repartition(emb.sparkSession.sparkContext.defaultParallelism, "id")
    out = scored.mapInPandas(_cluster_sums(_matrix(local["embedding"]), ids, len(names)), f"id {kind}, silhouette double")
    return out.withColumn("sample_rows", F.lit(len(local)))


# --- probes and model hooks ------------------------------------------------------------------------------------------


def train_probe(train: DataFrame, test: DataFrame, probe: str = "logistic_regression", label: str = "label_binary", seed: int = 42) -> DataFrame:
    """`test` with a `score` in [0, 1] from a frozen probe: features scaled on the training rows, classes balanced."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    vec = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    fit_rows = train.withColumn("_x", vec).withColumn("_y", F.col(label).cast("double"))
    counts = {r["_y"]: r["n"] for r in fit_rows.groupBy("_y").agg(n_rows().alias("n")).collect()}
    n = sum(counts.values())
    weight = F.create_map(*[F.lit(v) for y, k in counts.items() for v in (float(y), n / (len(counts) * k))])
    fit_rows = fit_rows.withColumn("_w", weight[F.col("_y")])
    scaler = StandardScaler(inputCol="_x", outputCol="features", withMean=True, withStd=True).fit(fit_rows)
    fit_rows, eval_rows = scaler.transform(fit_rows), scaler.transform(test.withColumn("_x", vec))
    if probe == "linear_svm":
        model = LinearSVC(labelCol="_y", weightCol="_w", maxIter=100, regParam=0.01).fit(fit_rows)
        margin = vector_to_array("rawPrediction")[1]
        score = 1.0 / (1.0 + F.exp(-margin))
    elif probe == "mlp":
        dim = len(fit_rows.select("features").first()["features"])
        model = MultilayerPerceptronClassifier(labelCol="_y", layers=[dim, 32, 2], maxIter=60, seed=seed).fit(fit_rows)
        score = vector_to_array("probability")[1]
    elif probe == "logistic_regression":
        model = LogisticRegression(labelCol="_y", weightCol="_w", maxIter=200).fit(fit_rows)
        score = vector_to_array("probability")[1]
    else:
        raise ValueError(f"unknown probe {probe!r}")
    return model.transform(eval_rows).withColumn("score", score).select(*test.columns, "score")


def extract(tiles: DataFrame, model: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], keys: Sequence[str] = ("patch_id",), bands: str = "bands") -> DataFrame:
    """Embedding per row of packed bands. `model` is called once per task and returns a function from a batch of
    (bands, cells) arrays to a matrix of vectors."""
    fields = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = model()
        for pdf in batches:
            x = [np.stack([np.asarray(b, dtype=np.float32) for b in row]) for row in pdf[bands]]
            yield pdf[list(keys)].assign(embedding=[v.astype("float32") for v in np.asarray(embed(x))])

    return tiles.select(*keys, bands).mapInPandas(run, f"{fields}, embedding array<float>")


def band_statistics_model() -> Callable[[list[np.ndarray]], np.ndarray]:
    """The built-in embedder: mean, population std, minimum and maximum of each band."""

    def embed(batch: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.concatenate([x.mean(1), x.std(1), x.min(1), x.max(1)]) for x in (b.astype(np.float64) for b in batch)])

    return embed


def score_patches(tiles: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], threshold: float = 0.5, keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """Confusion counts per row of packed bands (`bands`, `label`, `mask`): `model` maps (bands, cells) to cell
    probabilities. Only four counts per patch leave the task."""
    fields = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for pdf in batches:
            out = []
            for bands, label, mask in zip(pdf["bands"], pdf["label"], pdf["mask"]):
                p = np.asarray(predict(np.stack([np.asarray(b, dtype=np.float32) for b in bands]))) >= threshold
                y, ok = np.asarray(label) >= 0.5, np.asarray(mask, dtype=bool)
                out.append([int((ok & a).sum()) for a in (p & y, p & ~y, ~p & y, ~p & ~y)])
            yield pdf[list(keys)].assign(**dict(zip(("tp", "fp", "fn", "tn"), np.array(out, dtype="int64").reshape(-1, 4).T)))

    return tiles.select(*keys, "bands", "label", "mask").mapInPandas(run, f"{fields}, tp bigint, fp bigint, fn bigint, tn bigint")


