"""Connected components of raster masks, without any task holding a whole raster.

1. Cells are labelled inside their tile (a group is one tile).
2. Facing cells of neighbouring tiles give a small list of label pairs.
3. The label graph is contracted: every label hooks to its smallest neighbour, chains are compressed by pointer
   jumping, and edges are relabelled, until no edge is left. The number of rounds grows with the logarithm of the
   longest chain of tiles; lineage is cut by a reliable checkpoint each round.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.session import cut_lineage

SPAN = 1 << 31  # label of a cell = row * SPAN + column


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-neighbour components of the set cells of one tile; a label is the smallest cell id of its component."""
    r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
    r0, c0 = r.min(), c.min()
    h, w = int(r.max() - r0) + 1, int(c.max() - c0) + 1
    big = np.int64(h * w)
    grid = np.full((h + 2, w + 2), big, dtype=np.int64)
    inside = grid[1:-1, 1:-1]
    inside[r - r0, c - c0] = (r - r0) * w + (c - c0)
    mask = inside < big
    while True:  # minimum over a cell and its neighbours, then jump to the label of the label
        low = np.minimum.reduce([inside, grid[:-2, 1:-1], grid[2:, 1:-1], grid[1:-1, :-2], grid[1:-1, 2:]])
        low[~mask] = big
        flat = np.append(low.ravel(), big)
        low = flat[np.minimum(low, big)]
        if np.array_equal(low, inside):
            break
        inside[:] = low
    lab = inside[r - r0, c - c0]
    return pdf.assign(label=(r0 + lab // w) * SPAN + (c0 + lab % w))


def tile_labels(cells: DataFrame, tile: int) -> DataFrame:
    """(raster_id, r, c, label) for set cells, labels local to tiles."""
    ids = [F.floor(F.col(k) / tile).cast("bigint") for k in ("r", "c")]
    rows = cells.select("raster_id", F.col("r").cast("bigint"), F.col("c").cast("bigint"))
    kind = rows.schema["raster_id"].dataType.simpleString()
    schema = f"raster_id {kind}, r bigint, c bigint, label bigint"
    return rows.groupBy("raster_id", ids[0].alias("_tr"), ids[1].alias("_tc")).applyInPandas(_label_tile, schema)


def facing_labels(labels: DataFrame, tile: int) -> DataFrame:
    """Distinct label pairs that touch across a tile edge. Only the edge rows and columns take part in the joins."""
    out = None
    for axis, other in (("r", "c"), ("c", "r")):
        last = labels.where(F.col(axis) % tile == tile - 1).select("raster_id", (F.col(axis) + 1).alias(axis), other, F.col("label").alias("a"))
        first = labels.where(F.col(axis) % tile == 0).select("raster_id", axis, other, F.col("label").alias("b"))
        pairs = last.join(first, ["raster_id", axis, other]).select("raster_id", "a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _compress(parent: DataFrame, jumps: int = 2) -> DataFrame:
    """Point every node straight at the end of its chain. A pass makes `jumps` pointer jumps, each of which doubles
    the distance covered, before it is checkpointed."""
    while True:
        step = parent
        for _ in range(jumps):
            up = step.select("raster_id", F.col("node").alias("parent"), F.col("parent").alias("_next"))
            step = step.select("raster_id", "node", "parent").join(up, ["raster_id", "parent"], "left").select(
                "raster_id", "node", F.coalesce("_next", "parent").alias("parent"), F.col("_next").isNotNull().alias("_moved")
            )
        parent = cut_lineage(step)
        if not parent.where("_moved").limit(1).count():
            return parent.drop("_moved")


def contract(edges: DataFrame) -> DataFrame:
    """(raster_id, node, root) for every node that is not the smallest of its component."""
    roots = None
    edges = cut_lineage(edges.where("a <> b"))
    while edges.limit(1).count():
        hook = edges.select("raster_id", F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        parent = _compress(cut_lineage(hook.groupBy("raster_id", "node").agg(F.min("parent").alias("parent"))))
        new = parent.select("raster_id", "node", F.col("parent").alias("root"))
        if roots is not None:
            moved = parent.select("raster_id", F.col("node").alias("root"), F.col("parent").alias("_to"))
            old = roots.join(moved, ["raster_id", "root"], "left").select("raster_id", "node", F.coalesce("_to", "root").alias("root"))
            new = old.unionByName(new)
        roots = cut_lineage(new)
        for end in ("a", "b"):
            to = parent.select("raster_id", F.col("node").alias(end), F.col("parent").alias("_to"))
            edges = edges.join(to, ["raster_id", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = cut_lineage(edges.where("a <> b").distinct())
    return roots if roots is not None else edges.select("raster_id", F.col("a").alias("node"), F.col("b").alias("root"))


def components(cells: DataFrame, tile: int = 256) -> DataFrame:
    """(raster_id, r, c, component) for the set cells of all rasters; a component is named by its smallest label."""
    labels = cut_lineage(tile_labels(cells, tile))
    roots = contract(facing_labels(labels, tile)).select("raster_id", F.col("node").alias("label"), "root")
    named = labels.join(roots, ["raster_id", "label"], "left")
    return named.select("raster_id", "r", "c", F.coalesce("root", "label").alias("component"))


def border_components(cells: DataFrame, height: Column, width: Column, margin: int = 128, tile: int = 256) -> DataFrame:
    """Set cells with `border_connected`: whether their component reaches the margin zone of the raster.

    `cells` holds the set cells with the columns the size expressions need.
    """
    m = max(1, margin)
    c = F.col
    touch = (c("r") < m) | (c("c") < m) | (c("r") >= height - m) | (c("c") >= width - m)
    seeds = cells.where(touch).select("raster_id", c("r").cast("bigint"), c("c").cast("bigint"), F.lit(True).alias("_seed"))
    comp = components(cells, tile)
    hit = comp.join(seeds, ["raster_id", "r", "c"]).select("raster_id", "component", F.lit(True).alias("border_connected")).distinct()
    out = comp.join(hit, ["raster_id", "component"], "left")
    return out.withColumn("border_connected", F.coalesce("border_connected", F.lit(False)))


def mask_regions(cells: DataFrame, min_pixels: int = 1, pixel_m: float = 10.0, tile: int = 256) -> DataFrame:
    """Components as regions: size, area in hectares, bounds; small ones are left out."""
    g = components(cells, tile).groupBy("raster_id", "component").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c")
    )
    return g.where(F.col("pixels") >= min_pixels).withColumn("area_ha", F.col("pixels") * (pixel_m * pixel_m / 10000.0))


def row_runs(cells: DataFrame) -> DataFrame:
    """Region geometry as row runs (raster, row, first column, last column), exact and compact."""
    from pyspark.sql import Window

    w = Window.partitionBy("raster_id", "r").orderBy("c")
    island = F.col("c") - F.row_number().over(w)
    return cells.withColumn("_g", island).groupBy("raster_id", "r", "_g").agg(F.min("c").alias("c_first"), F.max("c").alias("c_last")).drop("_g")


def outline(cells: DataFrame) -> DataFrame:
    """Set cells with at least one 4-neighbour outside the mask: each cell offers itself to its neighbours once, and
    cells that receive fewer than four offers are on the outline."""
    around = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit(k).alias("_own")) for dr, dc, k in ((0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0))])
    g = cells.select("raster_id", F.inline(around)).groupBy("raster_id", "r", "c").agg(F.sum("_own").alias("_own"), F.count(F.lit(1)).alias("_n"))
    return g.where("_own > 0 AND _n < 5").select("raster_id", "r", "c")


def dilate(cells: DataFrame, radius: int, height: Column | None = None, width: Column | None = None) -> DataFrame:
    """Cells within a Euclidean radius of the mask.

    Row by row: the mask's row runs are widened for each row offset and the runs laid out, so the work follows the
    number of runs, not cells times disc area.
    """
    runs = row_runs(cells)
    offsets = F.array(*[F.struct(F.lit(dr).alias("_dr"), F.lit(int((radius * radius - dr * dr) ** 0.5)).alias("_dc")) for dr in range(-radius, radius + 1)])
    wide = runs.select("raster_id", "r", "c_first", "c_last", F.inline(offsets))
    spans = wide.select("raster_id", (F.col("r") + F.col("_dr")).alias("r"), (F.col("c_first") - F.col("_dc")).alias("_a"), (F.col("c_last") + F.col("_dc")).alias("_b"))
    out = merge_runs(spans).select("raster_id", "r", F.explode(F.sequence("_a", "_b")).alias("c"))
    ok = (F.col("r") >= 0) & (F.col("c") >= 0)
    if height is not None:
        ok = ok & (F.col("r") < height) & (F.col("c") < width)
    return out.where(ok)


def merge_runs(spans: DataFrame) -> DataFrame:
    """Overlapping column spans of a raster row merged; a group is one raster row."""
    from pyspark.sql import Window

    w = Window.partitionBy("raster_id", "r").orderBy("_a", "_b")
    before = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(before.isNull() | (F.col("_a") > before + 1), 1).otherwise(0)
    g = spans.withColumn("_new", start).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("raster_id", "r", "_k").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_k")


