"""Holes filled from their neighbours ring by ring, labelled tile by tile.

A hole's ring is its distance to the nearest source along holes (8 neighbours). Each tile labels its own holes from its
sources and from the labels of the cells around it, and hands the labels of its border to the tiles next to it. Only tiles
that were handed something new work again, so the number of rounds counts tile borders on a path of holes, not its cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.masks import is_finite
from gridloom.functions.rules import first_true
from gridloom.session import stored

# Neighbour offsets (row, column) in the order in which they may fill a hole.
OFFSETS = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1))
TILE = 256
FAR = np.iinfo(np.int64).max
LABELS = "r array<bigint>, c array<bigint>, ring array<bigint>, root_r array<bigint>, root_c array<bigint>"


def ring_labels(hole: np.ndarray, ring: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Rings of the inner holes of a flat grid with an unused frame; `ring` holds what is known, FAR elsewhere.

    Every hole is reached once and looked at from its eight neighbours, so the work follows the number of holes.
    """
    ring = ring.copy()
    width = int(np.sqrt(len(hole)))
    steps = np.array([dr * width + dc for dr, dc in OFFSETS])
    open_ = hole & inner & (ring == FAR)
    given = np.flatnonzero(ring < FAR)
    order = np.argsort(ring[given], kind="stable")
    given, at, front, k = given[order], 0, np.zeros(0, np.int64), 0
    while at < len(given) or len(front):
        if not len(front):
            k = int(ring[given[at]])
        end = at + int(np.searchsorted(ring[given[at:]], k, side="right"))
        front, at = np.append(front, given[at:end]), end
        near = np.unique((front[:, None] + steps).ravel())
        front = near[open_[near]]
        k += 1
        ring[front] = k
        open_[front] = False
    return ring


def first_parents(hole: np.ndarray, ring: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """For every labelled inner hole the first neighbour one ring nearer; every other cell is its own parent."""
    width = int(np.sqrt(len(hole)))
    parent = np.arange(len(hole))
    todo = np.flatnonzero(hole & inner & (ring < FAR))
    for dr, dc in OFFSETS:
        near = todo + dr * width + dc
        hit = ring[near] == ring[todo] - 1
        parent[todo[hit]] = near[hit]
        todo = todo[~hit]
    return parent


def _solved(tile: int):
    side = tile + 4  # the tile, a ring of neighbours, an unused frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, col = np.divmod(np.arange(side * side), side)
        inner = (row >= 2) & (row < side - 2) & (col >= 2) & (col < side - 2)
        for pdf in batches:
            out = []
            for _, x in pdf.iterrows():
                r0, c0 = x["tr"] * tile - 2, x["tc"] * tile - 2
                hole, ring = np.zeros(side * side, bool), np.full(side * side, FAR)
                root_r, root_c = row + r0, col + c0
                at = (np.asarray(x["r"]) - r0) * side + np.asarray(x["c"]) - c0
                is_hole = np.asarray(x["hole"], bool)
                hole[at[is_hole]] = True
                ring[at[~is_hole]] = 0
                if x["halo"] is not None:
                    h = {k: np.array([m[k] for m in x["halo"]], np.int64) for k in ("r", "c", "ring", "root_r", "root_c")}
                    at = (h["r"] - r0) * side + h["c"] - c0
                    ring[at], root_r[at], root_c[at] = h["ring"], h["root_r"], h["root_c"]
                ring = ring_labels(hole, ring, inner)
                root = first_parents(hole, ring, inner)
                while (root != root[root]).any():  # halves the way to the source each time
                    root = root[root]
                own = np.flatnonzero(hole & inner & (ring < FAR))
                src = root[own]
                out.append((x["raster_id"], x["tr"], x["tc"], row[own] + r0, col[own] + c0, ring[own], root_r[src], root_c[src]))
            yield pd.DataFrame(out, columns=["raster_id", "tr", "tc", "r", "c", "ring", "root_r", "root_c"])

    return run


def _spread(cells: DataFrame, tile: int) -> DataFrame:
    """Cells once for every tile whose area or ring of neighbours they lie in."""
    near = lambda x: F.array_distinct(F.array(*[F.floor((F.col(x) + k) / tile).cast("bigint") for k in (-1, 0, 1)]))
    return cells.withColumn("tr", F.explode(near("r"))).withColumn("tc", F.explode(near("c")))


def hole_sources(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(raster_id, r, c, ring, root_r, root_c) of all holes that a source reaches; `cells` holds holes and sources (hole boolean)."""
    key = ["raster_id", "tr", "tc"]
    kind = cells.schema["raster_id"].dataType.simpleString()
    at = lambda x: F.floor(F.col(x) / tile).cast("bigint")
    busy = stored(cells.where("hole").select("raster_id", at("r").alias("tr"), at("c").alias("tc")).distinct(), "hole-tiles")
    copies = _spread(cells.select("raster_id", F.col("r").cast("bigint"), F.col("c").cast("bigint"), "hole"), tile).join(busy, key, "left_semi")
    tiles = stored(copies.groupBy(*key).agg(*[F.collect_list(x).alias(x) for x in ("r", "c", "hole")]), "tiles")
    schema = f"raster_id {kind}, tr bigint, tc bigint, {LABELS}"

    def border(out: DataFrame) -> DataFrame:
        edge = lambda x: (x % tile == 0) | (x % tile == tile - 1)
        rows = F.arrays_zip("r", "c", "ring", "root_r", "root_c")
        cut = out.select("raster_id", F.col("tr").alias("_tr"), F.col("tc").alias("_tc"), F.inline(F.filter(rows, lambda x: edge(x["r"]) | edge(x["c"]))))
        return _spread(cut, tile).where("tr <> _tr OR tc <> _tc").drop("_tr", "_tc").join(busy, key, "left_semi")

    halo_type = "array<struct<r:bigint,c:bigint,ring:bigint,root_r:bigint,root_c:bigint>>"
    out = stored(tiles.withColumn("halo", F.lit(None).cast(halo_type)).mapInPandas(_solved(tile), schema).withColumn("round", F.lit(1)), "labels")
    labels, halo, fresh, n = out, None, stored(border(out).withColumn("round", F.lit(1)), "borders"), 1
    cell = [*key, "r", "c"]
    while fresh.limit(1).count():
        n += 1
        told = fresh if halo is None else halo.unionByName(fresh)
        halo = stored(told.groupBy(*cell).agg(F.max_by(F.struct("ring", "root_r", "root_c", "round"), "round").alias("x")).select(*cell, "x.*"), "halo")
        given = halo.groupBy(*key).agg(F.collect_list(F.struct("r", "c", "ring", "root_r", "root_c")).alias("halo"), F.max("round").alias("last")).where(F.col("last") == n - 1)
        out = stored(tiles.join(given.drop("last"), key).mapInPandas(_solved(tile), schema).withColumn("round", F.lit(n)), "labels")
        labels = labels.unionByName(out)
        if n % 8 == 0:
            labels = stored(_newest(labels, key), "labels")
        fresh = stored(border(out).join(halo.drop("round"), [*cell, "ring", "root_r", "root_c"], "left_anti").withColumn("round", F.lit(n)), "borders")
    return _newest(labels, key).select("raster_id", F.inline(F.arrays_zip("r", "c", "ring", "root_r", "root_c")))


def _newest(labels: DataFrame, key: list[str]) -> DataFrame:
    """The latest labels of every tile."""
    last = labels.groupBy(*key).agg(F.max("round").alias("round"))
    return labels.join(last, [*key, "round"], "left_semi")


def propagate_fill(px: DataFrame, hole: Column, bands: Sequence[str], max_iter: int = 2048, max_share: float | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(cells with `is_filled`, report): a hole takes all bands of the first neighbour, in the order of OFFSETS, one ring nearer to a source.

    Sources are finite cells that are no holes. The report has raster_id, total_pixels, holes, filled, rings and status:
    `clean` without holes, `too_many_holes` above `max_share` percent, `stalled` if a hole touches no source over holes,
    `iteration_cap` if a ring is above `max_iter`, else `filled`. Only rasters of the last kind change.
    """
    finite = [is_finite(F.col(b).cast("double")) for b in bands]  # NULL, NaN and infinite cells are no source
    cells = px.withColumn("_hole", F.coalesce(hole, F.lit(False)))
    source = reduce(Column.__and__, finite, ~F.col("_hole"))
    counts = cells.groupBy("raster_id").agg(F.count(F.lit(1)).alias("total_pixels"), F.count_if("_hole").alias("holes"))
    share = F.lit(False) if max_share is None else 100.0 * F.col("holes") / F.col("total_pixels") > max_share
    counts = stored(counts.withColumn("_many", share), "holes")
    todo = counts.where("holes > 0 AND NOT _many").select("raster_id")
    wanted = cells.where(F.col("_hole") | source).join(todo, "raster_id", "left_semi").select("raster_id", "r", "c", F.col("_hole").alias("hole"))
    found = stored(hole_sources(wanted, tile), "sources")
    reached = found.groupBy("raster_id").agg(F.count(F.lit(1)).alias("_reached"), F.max("ring").alias("rings"))
    report = counts.join(reached, "raster_id", "left").withColumn("rings", F.coalesce("rings", F.lit(0)))
    status = first_true(
        [
            (F.col("holes") == 0, "clean"), (F.col("_many"), "too_many_holes"), (F.coalesce("_reached", F.lit(0)) < F.col("holes"), "stalled"),
            (F.col("rings") > max_iter, "iteration_cap"),
        ],
        "filled",
    )
    report = report.withColumn("status", status)
    report = stored(report.select("raster_id", "total_pixels", "holes", F.when(status == "filled", F.col("holes")).otherwise(0).alias("filled"), "rings", "status"), "report")
    good = report.where("status = 'filled'").select("raster_id")
    values = px.select("raster_id", F.col("r").alias("root_r"), F.col("c").alias("root_c"), *[F.col(b).alias(f"_f_{b}") for b in bands])
    new = found.join(good, "raster_id", "left_semi").join(values, ["raster_id", "root_r", "root_c"]).select("raster_id", "r", "c", F.lit(True).alias("is_filled"), *[f"_f_{b}" for b in bands])
    out = px.join(new, ["raster_id", "r", "c"], "left").withColumn("is_filled", F.coalesce("is_filled", F.lit(False)))
    chosen = {b: F.when(F.col("is_filled"), F.col(f"_f_{b}")).otherwise(F.col(b)) for b in bands}
    return out.withColumns(chosen).drop(*[f"_f_{b}" for b in bands]), report
