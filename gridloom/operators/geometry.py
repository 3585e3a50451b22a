"""Polygons on grids, resampling between grids, areas and map coordinates, in closed-form column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridloom.sources.tiles import TILE, packed_cells

# WGS84 ellipsoid and UTM constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996


def edges(vertices: DataFrame) -> DataFrame:
    """Closed-ring edges (geom_id, x0, y0, x1, y1) of polygons with at least three distinct vertices per ring. A window
    group is one ring."""
    ring = Window.partitionBy("geom_id", "ring").orderBy("seq")
    whole = Window.partitionBy("geom_id", "ring")
    good = vertices.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    e = good.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "x1": F.coalesce(F.lead("x").over(ring), F.first("x").over(ring)),
            "y1": F.coalesce(F.lead("y").over(ring), F.first("y").over(ring)),
        }
    )
    return e.where("_n >= 3").select("geom_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def rasterize_runs(vertices: DataFrame, grids: DataFrame, key: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Cells whose centre lies inside a polygon, as column runs (key, geom_id, r, c_first, c_last).

    `vertices` holds the key of the grid each polygon is drawn on, `grids` the key, a north-up six-number `transform`,
    `width` and `height`. Each edge is laid out over the rows whose centre line it crosses (half-open, so a shared
    vertex counts once); the sorted crossings of a polygon and row pair up into runs. The work follows the number of
    polygon rows, not cells times polygons.
    """
    key = list(key)
    geom = edges(vertices.withColumn("geom_id", F.struct(*key, "geom_id")))
    e = geom.select(*[F.col("geom_id")[k].alias(k) for k in key], F.col("geom_id")["geom_id"].alias("geom_id"), "x0", "y0", "x1", "y1")
    j = e.join(grids.select(*key, "transform", "width", "height"), key)
    t = F.col("transform")
    row = lambda y: (y - t[5]) / t[4]
    lo, hi = F.least(row(F.col("y0")), row(F.col("y1"))), F.greatest(row(F.col("y0")), row(F.col("y1")))
    first = F.greatest(F.ceil(lo - 0.5), F.lit(0)).cast("bigint")
    last = F.least(F.ceil(hi - 0.5) - 1, F.col("height") - 1).cast("bigint")
    rows = j.withColumns({"_a": first, "_b": last}).where("_b >= _a").withColumn("r", F.explode(F.sequence("_a", "_b")))
    y = t[5] + (F.col("r") + 0.5) * t[4]
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    crossings = rows.select(*key, "geom_id", "r", ((x - t[2]) / t[0]).alias("_x"), "width")
    g = crossings.groupBy(*key, "geom_id", "r").agg(F.array_sort(F.collect_list("_x")).alias("_xs"), F.max("width").alias("width"))
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1), lambda i: F.struct(F.col("_xs")[i * 2].alias("a"), F.col("_xs")[i * 2 + 1].alias("b"))
    )
    runs = g.where(F.size("_xs") >= 2).select(*key, "geom_id", "r", "width", F.inline(pairs))
    c0 = F.greatest(F.ceil(F.col("a") - 0.5), F.lit(0)).cast("bigint")
    c1 = F.least(F.ceil(F.col("b") - 0.5) - 1, F.col("width") - 1).cast("bigint")
    return runs.select(*key, "geom_id", "r", c0.alias("c_first"), c1.alias("c_last")).where("c_last >= c_first")


def rasterize(vertices: DataFrame, grids: DataFrame, key: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Distinct cells covered by any polygon. Overlapping runs are merged first, so no cell is produced twice."""
    from gridloom.operators.components import merge_runs

    key = list(key)
    runs = rasterize_runs(vertices, grids, key)
    if key == ["raster_id"]:
        spans = runs.select("raster_id", "r", F.col("c_first").alias("_a"), F.col("c_last").alias("_b"))
        return merge_runs(spans).select("raster_id", "r", F.explode(F.sequence("_a", "_b")).alias("c"))
    return runs.select(*key, "r", F.explode(F.sequence("c_first", "c_last")).alias("c")).distinct()


def _cell_of(grid: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional (row, column) of a map point on a grid."""
    det = grid[0] * grid[4] - grid[1] * grid[3]
    dx, dy = x - grid[2], y - grid[5]
    return (grid[0] * dy - grid[3] * dx) / det, (grid[4] * dx - grid[1] * dy) / det


def _box(a: Column, b: Column, r0: Column, r1: Column, c0: Column, c1: Column) -> tuple[Column, Column, Column, Column]:
    """Least and largest row, then column, on grid b of a rectangle of grid a (an affine map keeps corners outermost)."""
    corners = [_cell_of(b, a[0] * c + a[1] * r + a[2], a[3] * c + a[4] * r + a[5]) for r in (r0, r1) for c in (c0, c1)]
    rows, cols = [p[0] for p in corners], [p[1] for p in corners]
    return F.least(*rows), F.greatest(*rows), F.least(*cols), F.greatest(*cols)


def _resampled(tile: int, bands: Sequence[str], method: str):
    """Cells of one target tile after another, from the source cells that were routed to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("_tr", "_tc", "_t", "_s", "_w", "_h")}
                r = np.arange(row["_tr"] * tile, min((row["_tr"] + 1) * tile, row["_h"]))
                c = np.arange(row["_tc"] * tile, min((row["_tc"] + 1) * tile, row["_w"]))
                r, c = np.repeat(r, len(c)), np.tile(c, len(r))
                t, u = row["_t"], row["_s"]
                x = t[0] * (c + 0.5) + t[1] * (r + 0.5) + t[2] - u[2]
                y = t[3] * (c + 0.5) + t[4] * (r + 0.5) + t[5] - u[5]
                det = u[0] * u[4] - u[1] * u[3]
                fc, fr = (u[4] * x - u[1] * y) / det, (u[0] * y - u[3] * x) / det
                cells = batch.column("_cells")[k].values
                values = _nearest(cells, fr, fc, bands) if method == "nearest" else _bilinear(cells, fr, fc, bands)
                names = [batch.schema.names[0], "r", "c", *bands]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(r)), pa.array(r, pa.int64()), pa.array(c, pa.int64()), *values], names=names)

    return run


class _Places:
    """Source cells by row and column."""

    def __init__(self, cells: pa.StructArray):
        self.cells = cells
        key = self.key(cells.field("r").to_numpy(), cells.field("c").to_numpy())
        self.order = np.argsort(key)
        self.sorted = key[self.order]

    @staticmethod
    def key(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (r.astype(np.int64) << 32) + c.astype(np.int64)

    def find(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Index of each cell, -1 where there is none."""
        if not len(self.sorted):
            return np.full(len(r), -1)
        key = self.key(r, c)
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where(self.sorted[at] == key, self.order[at], -1)


def _nearest(cells: pa.StructArray, fr: np.ndarray, fc: np.ndarray, bands: Sequence[str]) -> list[pa.Array]:
    at = _Places(cells).find(np.floor(fr), np.floor(fc))
    index = pa.array(at, mask=at < 0)
    return [cells.field("v").field(b).take(index) for b in bands]


def _bilinear(cells: pa.StructArray, fr: np.ndarray, fc: np.ndarray, bands: Sequence[str]) -> list[pa.Array]:
    """Mean of the four cells around, by weights that drop out where a cell is missing."""
    places = _Places(cells)
    own = [pc.fill_null(cells.field("v").field(b).cast(pa.float64()), 0.0).to_numpy() for b in bands]
    r0, c0 = np.floor(fr - 0.5), np.floor(fc - 0.5)
    wr, wc = fr - 0.5 - r0, fc - 0.5 - c0
    sums, total = [np.zeros(len(fr)) for _ in bands], np.zeros(len(fr))
    for dr in (0, 1):
        for dc in (0, 1):
            weight = (wr if dr else 1.0 - wr) * (wc if dc else 1.0 - wc)
            at = places.find(r0 + dr, c0 + dc)
            hit = np.flatnonzero((weight > 0) & (at >= 0))
            total[hit] += weight[hit]
            for out, v in zip(sums, own):
                out[hit] += weight[hit] * v[at[hit]]
    some = total > 0
    return [pa.array(np.divide(v, total, out=np.zeros(len(v)), where=some), mask=~some) for v in sums]


def resample(
    src: DataFrame, src_grid: DataFrame, dst_grid: DataFrame, bands: Sequence[str], valid: Column, method: str = "bilinear", key: str = "raster_id", tile: int = TILE
) -> DataFrame:
    """Source cells onto the cells of a reference grid in the same CRS, by nearest or bilinear, skipping nodata.

    Both grids hold key, `transform`, `width`, `height`. The unit of work is a target tile: each source tile sends it the
    cells of its footprint and one cell around, and the task lays the tile out. Weights of missing cells drop out of the
    mean, and a target without any valid neighbour stays NULL.
    """
    if method not in ("nearest", "bilinear"):
        raise ValueError(f"unknown resampling {method!r}")
    grids = dst_grid.select(key, F.col("transform").alias("_t"), F.col("width").cast("bigint").alias("_w"), F.col("height").cast("bigint").alias("_h")).join(
        src_grid.select(key, F.col("transform").alias("_s")), key
    )
    t, s, whole = F.col("_t"), F.col("_s"), float(tile)
    span = lambda n: F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / tile))
    area = grids.where("_w > 0 AND _h > 0")
    tiles = area.withColumn("_tr", F.explode(span("_h"))).withColumn("_tc", F.explode(span("_w")))
    packed = packed_cells(src.where(valid), {b: F.col(b) for b in bands}, tile, (key,)).join(grids, key)
    r0, c0 = F.col("tile_row") * whole, F.col("tile_col") * whole
    low_r, high_r, low_c, high_c = _box(s, t, r0 - 1, r0 + whole + 1, c0 - 1, c0 + whole + 1)
    last = lambda n: F.floor((F.col(n) - 1) / tile)
    met = lambda a, b, n: F.filter(
        F.sequence(F.greatest(F.floor(a / tile), F.lit(0).cast("bigint")), F.greatest(F.least(F.floor(b / tile), last(n)), F.lit(0).cast("bigint"))), lambda k: (k * tile <= b) & ((k + 1) * tile >= a) & (k <= last(n))
    )
    inside = (high_r >= 0) & (high_c >= 0) & (low_r <= F.col("_h")) & (low_c <= F.col("_w"))
    sent = packed.where(inside).withColumn("_tr", F.explode(met(low_r, high_r, "_h"))).withColumn("_tc", F.explode(met(low_c, high_c, "_w")))
    d0, e0 = F.col("_tr") * whole, F.col("_tc") * whole
    a, b, c, d = _box(t, s, d0, d0 + whole, e0, e0 + whole)
    near = F.filter("cells", lambda x: (x["r"] >= F.floor(a) - 1) & (x["r"] <= F.ceil(b) + 1) & (x["c"] >= F.floor(c) - 1) & (x["c"] <= F.ceil(d) + 1))
    routed = sent.select(key, "_tr", "_tc", near.alias("_n")).where(F.size("_n") > 0).groupBy(key, "_tr", "_tc").agg(F.flatten(F.collect_list("_n")).alias("_cells"))
    work = tiles.join(routed, [key, "_tr", "_tc"], "left").withColumn("_cells", F.coalesce("_cells", F.array().cast(routed.schema["_cells"].dataType)))
    kinds = [StructField(n, src.schema[n].dataType if method == "nearest" else DoubleType()) for n in bands]
    schema = StructType([dst_grid.schema[key], StructField("r", LongType()), StructField("c", LongType()), *kinds])
    return work.select(key, "_tr", "_tc", "_t", "_s", "_w", "_h", "_cells").mapInArrow(_resampled(tile, list(bands), method), schema)


def with_lonlat(df: DataFrame, x: str, y: str, epsg: str, names: Sequence[str] = ("lon", "lat")) -> DataFrame:
    """Longitude and latitude of UTM coordinates on WGS84 (EPSG 326zz north, 327zz south); NULL for any other code.

    The inverse series to sixth order, good to well under a millimetre inside a zone. Intermediate results are columns
    of their own, so each is computed once.
    """
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    code, c = F.col(epsg), F.col
    hemisphere = F.floor(code / 100)
    zone = code % 100
    m = (c(y) - F.when(hemisphere == 327, 10_000_000.0).otherwise(0.0)) / UTM_K0
    out = df.withColumn("_mu", m / (WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)))
    series = {2: 3 * e1 / 2 - 27 * e1**3 / 32, 4: 21 * e1**2 / 16 - 55 * e1**4 / 32, 6: 151 * e1**3 / 96, 8: 1097 * e1**4 / 512}
    foot = c("_mu")
    for k, factor in series.items():
        foot = foot + factor * F.sin(k * c("_mu"))
    out = out.withColumn("_p", foot).withColumns({"_s": F.sin("_p"), "_c": F.cos("_p")})
    out = out.withColumns({"_t1": F.pow(c("_s") / c("_c"), F.lit(2.0)), "_c1": ep2 * c("_c") * c("_c"), "_w": 1 - e2 * c("_s") * c("_s")})
    out = out.withColumns({"_n": WGS84_A / F.sqrt("_w"), "_r": WGS84_A * (1 - e2) / (c("_w") * F.sqrt("_w"))})
    out = out.withColumn("_q", (c(x) - 500_000.0) / (c("_n") * UTM_K0)).withColumn("_q2", c("_q") * c("_q"))
    t, k, q2 = c("_t1"), c("_c1"), c("_q2")
    fourth = 5 + 3 * t + 10 * k - 4 * k * k - 9 * ep2
    sixth = 61 + 90 * t + 298 * k + 45 * t * t - 252 * ep2 - 3 * k * k
    lat = c("_p") - (c("_n") * c("_s") / (c("_c") * c("_r"))) * (q2 / 2 - fourth * q2 * q2 / 24 + sixth * q2 * q2 * q2 / 720)
    fifth = 5 - 2 * k + 28 * t - 3 * k * k + 8 * ep2 + 24 * t * t
    lon = c("_q") * (1 - (1 + 2 * t + k) * q2 / 6 + fifth * q2 * q2 / 120) / c("_c")
    known = hemisphere.isin(326, 327) & (zone >= 1) & (zone <= 60)
    out = out.withColumns({names[0]: F.when(known, zone * 6 - 183 + F.degrees(lon)), names[1]: F.when(known, F.degrees(lat))})
    return out.drop("_mu", "_p", "_s", "_c", "_t1", "_c1", "_w", "_n", "_r", "_q", "_q2")


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates with standard parallel 30 degrees (the global EASE grid projection)."""
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    s0 = math.sin(math.radians(30))
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - e2 * s0 * s0)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))
    return WGS84_A * k0 * F.radians(lon), WGS84_A * q / (2 * k0)


def polygon_area(vertices: DataFrame, lonlat: bool = False) -> DataFrame:
    """Shoelace area per polygon; with `lonlat`, in square metres through the equal-area projection. Inner rings must
    run against the outer ring."""
    v = vertices
    if lonlat:
        x, y = equal_area_xy(F.col("x"), F.col("y"))
        v = v.withColumns({"x": x, "y": y})
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return edges(v).groupBy("geom_id").agg((F.abs(F.sum(cross)) / 2).alias("area"))


def bbox_overlap(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(intersection, share of a, share of b) of two boxes given as (minx, miny, maxx, maxy)."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    inter = side(0, 2) * side(1, 3)
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    share = lambda z: F.when(area(z) > 0, 100.0 * inter / area(z)).otherwise(0.0)
    return inter, share(a), share(b)


def cell_overlap(aoi: DataFrame, footprints: DataFrame, grids: DataFrame, weight: Column | None = None) -> DataFrame:
    """Share of an area of interest (cells of a raster) that each product footprint covers.

    Footprints are drawn as row runs on the same grid and joined to the area's cells on (raster, row), so no pair of
    product and cell outside a common row is formed. `weight` is the area of a cell (default one).
    """
    w = F.lit(1.0) if weight is None else weight
    cells = aoi.select("raster_id", "r", "c", w.alias("_w"))
    runs = rasterize_runs(footprints, grids).withColumnRenamed("geom_id", "item_id")
    # One running sum along each row over cells and run ends together: a run is the sum at its last column less the sum
    # before its first one.
    ends = F.array(F.struct((F.col("c_first") - 1).alias("c"), F.lit(-1.0).alias("_s")), F.struct(F.col("c_last").alias("c"), F.lit(1.0).alias("_s")))
    marks = runs.select("raster_id", "item_id", "r", F.inline(ends)).withColumns({"_w": F.lit(0.0), "_k": F.lit(1)})
    line = Window.partitionBy("raster_id", "r").orderBy("c", "_k").rowsBetween(Window.unboundedPreceding, 0)
    events = marks.unionByName(cells.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    part = events.withColumn("_p", F.sum("_w").over(line)).where("_k = 1").withColumn("_in", F.col("_s") * F.col("_p"))
    total = cells.groupBy("raster_id").agg(F.sum("_w").alias("aoi_area"))
    got = part.groupBy("raster_id", "item_id").agg(F.sum("_in").alias("overlap_area"))
    out = got.where("overlap_area > 0").join(total, "raster_id")
    return out.withColumn("overlap_percent", 100.0 * F.col("overlap_area") / F.col("aoi_area"))
