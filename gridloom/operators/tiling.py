"""Patch windows over rasters and statistics of the cells they cover.

Patches overlap, so joining every cell to every patch repeats each cell up to (size / stride)^2 times. Mergeable
statistics avoid that: the starts and ends of all windows cut a raster into blocks, each cell is aggregated into its
block once, and a patch sums the few blocks it is made of.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.scalars import patch_id_224


def n_rows() -> Column:
    return F.count(F.lit(1))


def stride_of(size: int, stride: int | None = None, overlap: float = 0.0) -> int:
    if size <= 0 or (stride is not None and stride <= 0) or not 0 <= overlap < 1:
        raise ValueError("size and stride must be positive and 0 <= overlap < 1")
    step = stride if stride is not None else round(size * (1.0 - overlap))
    if step <= 0:
        raise ValueError(f"overlap {overlap} leaves no stride")
    return step


def axis_starts(length: Column, size: int, stride: int, edge: str = "cover") -> Column:
    """Window starts along one axis. `cover` adds a shifted last window, `drop` leaves the remainder out, `partial`
    also starts short windows."""
    step = F.lit(stride).cast("bigint")
    length = length.cast("bigint")
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")
    if edge == "partial":
        return F.when(length > 0, F.sequence(zero, length - 1, step)).otherwise(none)
    last = length - size
    regular = F.sequence(zero, last, step)
    if edge == "cover":
        regular = F.array_union(regular, F.array(last))
    elif edge != "drop":
        raise ValueError(f"unknown edge mode {edge!r}")
    return F.when(last >= 0, regular).otherwise(none)


def tile_patches(meta: DataFrame, size: int = 224, stride: int | None = None, edge: str = "cover", overlap: float = 0.0, city: str = "city") -> DataFrame:
    """Patch index: windows of every raster as a generator product, with ids and edge flags. `meta` has width, height."""
    step = stride_of(size, stride, overlap)
    rows = meta.withColumn("row_start", F.explode(axis_starts(F.col("height"), size, step, edge)))
    cells = rows.withColumn("col_start", F.explode(axis_starts(F.col("width"), size, step, edge)))
    cells = cells.withColumns({"city_height": F.col("height"), "city_width": F.col("width")})
    end = lambda start, length: F.least(F.col(start) + size, F.col(length).cast("bigint"))
    cells = cells.withColumns({"row_end": end("row_start", "city_height"), "col_end": end("col_start", "city_width")})
    h, w = F.col("row_end") - F.col("row_start"), F.col("col_end") - F.col("col_start")
    edge_flag = (F.col("row_start") == 0) | (F.col("col_start") == 0) | (F.col("row_end") == F.col("city_height")) | (F.col("col_end") == F.col("city_width"))
    return cells.withColumns(
        {
            "patch_id": patch_id_224(F.col(city), F.col("row_start"), F.col("col_start"), F.lit(size), F.lit(step)),
            "height": h, "width": w, "patch_size": F.lit(size), "stride": F.lit(step), "edge_mode": F.lit(edge),
            "is_full_size": (h == size) & (w == size), "is_edge_patch": edge_flag,
        }
    )


def window_geo(patches: DataFrame, transform: str = "transform") -> DataFrame:
    """Map bounds and centroid of each window from the six-number affine of its raster."""
    t = F.col(transform)
    x = lambda c, r: t[0] * c + t[1] * r + t[2]
    y = lambda c, r: t[3] * c + t[4] * r + t[5]
    r0, r1, c0, c1 = (F.col(k) for k in ("row_start", "row_end", "col_start", "col_end"))
    xs = [x(c, r) for c in (c0, c1) for r in (r0, r1)]
    ys = [y(c, r) for c in (c0, c1) for r in (r0, r1)]
    out = patches.withColumns({"minx": F.least(*xs), "maxx": F.greatest(*xs), "miny": F.least(*ys), "maxy": F.greatest(*ys)})
    return out.withColumns({"centroid_x": (F.col("minx") + F.col("maxx")) / 2, "centroid_y": (F.col("miny") + F.col("maxy")) / 2})


def block_start(i: Column, length: Column, size: int, stride: int) -> Column:
    """Largest window start or end at or below cell `i`."""
    cuts = [F.floor(i / stride) * stride]
    if size % stride:
        cuts.append(F.when(i >= size, F.floor((i - size) / stride) * stride + size).otherwise(0))
    cuts.append(F.when(i >= length - size, length - size).otherwise(0))
    return F.greatest(*[c.cast("bigint") for c in cuts])


def _blocks_in(start: Column, end: Column, length: Column, size: int, stride: int) -> Column:
    """Block starts inside [start, end): the same cuts, listed for one window."""
    up = lambda v, off: F.ceil((v - off) / stride).cast("bigint")

    def multiples(off: int) -> Column:
        first, last = F.greatest(up(start, off), F.lit(0).cast("bigint")), up(end, off) - 1
        ks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(ks, lambda k: k * stride + off)

    cuts = multiples(0)
    if size % stride:
        cuts = F.array_union(cuts, multiples(size))
    shifted = (length - size).cast("bigint")
    inside = (shifted >= start) & (shifted < end)
    return F.when(inside, F.array_union(cuts, F.array(shifted))).otherwise(cuts)


def patch_blocks(patches: DataFrame, size: int, stride: int, raster: str = "raster_id", keep: Sequence[str] = ("patch_id",)) -> DataFrame:
    """Each patch with the blocks it is made of: (raster, block_row, block_col)."""
    c = F.col
    rows = _blocks_in(c("row_start"), c("row_end"), c("city_height"), size, stride)
    cols = _blocks_in(c("col_start"), c("col_end"), c("city_width"), size, stride)
    laid = patches.select(raster, *keep, F.explode(rows).alias("block_row"), cols.alias("_cols"))
    return laid.select(raster, *keep, "block_row", F.explode("_cols").alias("block_col"))


def with_blocks(px: DataFrame, meta: DataFrame, size: int, stride: int, raster: str = "raster_id") -> DataFrame:
    sized = px.join(meta.select(raster, F.col("height").alias("_h"), F.col("width").alias("_w")), raster)
    return sized.withColumns(
        {"block_row": block_start(F.col("r"), F.col("_h"), size, stride), "block_col": block_start(F.col("c"), F.col("_w"), size, stride)}
    ).drop("_h", "_w")


def merged_moments(parts: Column) -> Column:
    """(n, mean, m2) of a union from the (n, mean, m2) of its parts, m2 being the sum of squared deviations; no large squares cancel."""

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, zero, merge)


def patch_stats(px: DataFrame, meta: DataFrame, patches: DataFrame, size: int, stride: int, counts: Mapping[str, Column], values: Mapping[str, tuple[Column, Column]] | None = None, raster: str = "raster_id") -> DataFrame:
    """Counts of conditions and min / max / mean / population std of values per patch, in two small aggregates.

    `counts` maps a name to a condition, `values` a name to (value, validity).
    """
    values = values or {}
    blocks = with_blocks(px, meta, size, stride, raster)
    aggs = [n_rows().alias("total_pixels"), *[F.count_if(cond).alias(k) for k, cond in counts.items()]]
    for k, (v, ok) in values.items():
        x = F.when(ok, v.cast("double"))
        aggs += [F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")).alias(f"_m_{k}"), F.min(x).alias(f"_lo_{k}"), F.max(x).alias(f"_hi_{k}")]
    cells = blocks.groupBy(raster, "block_row", "block_col").agg(*aggs)
    joined = patch_blocks(patches, size, stride, raster).join(cells, [raster, "block_row", "block_col"])
    out = [F.sum("total_pixels").alias("total_pixels"), *[F.sum(k).alias(k) for k in counts]]
    for k in values:
        m = merged_moments(F.array_sort(F.collect_list(F.when(F.col(f"_m_{k}.n") > 0, F.col(f"_m_{k}")))))  # a patch has a few blocks
        out += [F.min(f"_lo_{k}").alias(f"{k}_min"), F.max(f"_hi_{k}").alias(f"{k}_max"), F.when(m["n"] > 0, m["mean"]).alias(f"{k}_mean"), F.when(m["n"] > 0, F.sqrt(m["m2"] / m["n"])).alias(f"{k}_std")]
    return joined.groupBy("patch_id").agg(*out)


def patch_weights(patches: DataFrame, size: int, stride: int, raster: str = "raster_id") -> DataFrame:
    """How many patches cover each block."""
    return patch_blocks(patches, size, stride, raster).groupBy(raster, "block_row", "block_col").agg(n_rows().alias("weight"))


def normalization_stats(long: DataFrame, meta: DataFrame, train: DataFrame, size: int, stride: int, qs: Mapping[str, float], by: Sequence[str] = ("band",), raster: str = "raster_id") -> DataFrame:
    """Band statistics over the training patches. A cell counts once per patch that covers it, as a weight, so cells
    are read once and never repeated."""
    from gridloom.operators.stats import quantiles

    w = patch_weights(train, size, stride, raster)
    rows = with_blocks(long, meta, size, stride, raster).join(w, [raster, "block_row", "block_col"])
    v, k = F.when(F.col("is_valid"), F.col("value").cast("double")), F.col("weight")
    # all cells of a block have one weight: central moments per block first, then blocks against the weighted mean
    blocks = rows.groupBy(*by, raster, "block_row", "block_col", "weight").agg(
        n_rows().alias("_all"), F.count(v).alias("_n"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count(v)).alias("_m2"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    n = F.sum(F.col("_n") * k)
    base = blocks.groupBy(*by).agg(n.alias("valid_count"), (F.sum(F.col("_all") * k) - n).alias("invalid_count"), F.min("_lo").alias("min"), F.max("_hi").alias("max"), (F.sum(F.col("_mean") * F.col("_n") * k) / n).alias("mean"))
    off = F.col("_mean") - F.col("mean")
    spread = blocks.join(base.select(*by, "mean"), list(by)).groupBy(*by).agg(F.sum((F.col("_m2") + F.col("_n") * off * off) * k).alias("_m2"))
    base = base.join(spread, list(by)).withColumn("std", F.sqrt(F.col("_m2") / F.col("valid_count"))).drop("_m2")
    q = quantiles(rows.where("is_valid"), by, "value", list(qs.values()), list(qs), weight=k)
    return base.join(q, list(by), "left")


def patch_pixels(patches: DataFrame, tiles: DataFrame, names: Sequence[str], tile: int, raster: str = "raster_id") -> DataFrame:
    """Cells of each patch, for models that need them: patches are laid out over the tiles they touch, joined on the
    tile id, and cells outside the window dropped."""
    from gridloom.sources.tiles import tiles_to_pixels

    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(b) - 1) / tile).cast("int"))
    bounds = ["row_start", "row_end", "col_start", "col_end"]
    laid = patches.select(raster, "patch_id", *bounds, F.explode(span("row_start", "row_end")).alias("tile_row"), span("col_start", "col_end").alias("_c"))
    laid = laid.select(raster, "patch_id", *bounds, "tile_row", F.explode("_c").alias("tile_col"))
    hit = laid.join(tiles, [raster, "tile_row", "tile_col"])
    cells = tiles_to_pixels(hit, names, (raster, "patch_id", *bounds))
    inside = (F.col("r") >= F.col("row_start")) & (F.col("r") < F.col("row_end")) & (F.col("c") >= F.col("col_start")) & (F.col("c") < F.col("col_end"))
    return cells.where(inside).withColumns({"pr": F.col("r") - F.col("row_start"), "pc": F.col("c") - F.col("col_start")}).drop(*bounds)
