"""Raster tiles: the storage form of rasters, and the explicit pixel form operators work on.

`raster_tile` holds one row per tile with its bands as arrays in row-major order; a tile bounds what any task holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

TILE = 256


def read_tiles(spark: SparkSession, path: str, bands: Sequence[int] | None = None) -> DataFrame:
    """Tile table from Parquet; `bands` (1-based) keeps only those arrays. Filters on partition columns (product, city)
    and tile ids reach the scan."""
    tiles = spark.read.parquet(path)
    if bands is None:
        return tiles
    return tiles.withColumn("bands", F.array(*[F.col("bands")[b - 1] for b in bands]))


def tile_ids(r: Column, c: Column, tile: int = TILE) -> tuple[Column, Column]:
    return F.floor(r / tile).cast("int"), F.floor(c / tile).cast("int")


def pixels_to_tiles(px: DataFrame, bands: Sequence[str], valid: Column, tile: int = TILE, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Tiles from a full pixel table. A group is one tile, so it holds at most tile * tile cells."""
    tr, tc = tile_ids(F.col("r"), F.col("c"), tile)
    cell = F.struct("r", "c", *[F.col(b).cast("float").alias(b) for b in bands], valid.alias("_ok"))
    g = px.select(*keys, tr.alias("tile_row"), tc.alias("tile_col"), cell.alias("_cell")).groupBy(*keys, "tile_row", "tile_col")
    t = g.agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))
    cells = F.col("_cells")
    last = F.element_at(cells, -1)
    return t.select(
        *keys, "tile_row", "tile_col", (F.col("tile_row") * tile).alias("row_off"), (F.col("tile_col") * tile).alias("col_off"),
        (last["r"] - F.col("tile_row") * tile + 1).cast("int").alias("height"), (last["c"] - F.col("tile_col") * tile + 1).cast("int").alias("width"),
        F.array(*[cells[b] for b in bands]).alias("bands"), cells["_ok"].alias("mask"),
    )


def tiles_to_pixels(tiles: DataFrame, names: Sequence[str], keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """One row per cell, with global row and column."""
    zipped = F.arrays_zip(*[F.col("bands")[i].alias(n) for i, n in enumerate(names)], F.col("mask").alias("is_valid"))
    cells = tiles.select(*keys, "row_off", "col_off", "width", F.posexplode(zipped).alias("_i", "_x"))
    r = F.col("row_off") + F.floor(F.col("_i") / F.col("width"))
    c = F.col("col_off") + F.col("_i") % F.col("width")
    return cells.select(*keys, r.cast("bigint").alias("r"), c.cast("bigint").alias("c"), *[F.col("_x").getField(str(n)).alias(n) for n in names], F.col("_x").getField("is_valid").alias("is_valid"))


def join_tiles(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("raster_id",), how: str = "inner", other: Sequence[str] = ("bands", "mask")) -> DataFrame:
    """Two products on one grid, tile by tile: one equi join on the tile id, cells stay packed in arrays."""
    on = [*keys, "tile_row", "tile_col"]
    return a.join(b.select(*on, *[F.col(c).alias(f"other_{c}") for c in other]), on, how)


def packed_cells(px: DataFrame, values: dict[str, Column], tile: int = TILE, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Pixels packed by tile: `cells`, an array of structs of the cell's place in its tile, r, c and the values, by place.

    Unlike a tile table it need not hold every cell. A group is one tile, so it holds at most tile * tile cells.
    """
    tr, tc = tile_ids(F.col("r"), F.col("c"), tile)
    place = ((F.col("r") % tile) * tile + F.col("c") % tile).cast("int")
    cell = F.struct(place.alias("i"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.struct(*[v.alias(n) for n, v in values.items()]).alias("v"))
    packed = px.select(*keys, tr.alias("tile_row"), tc.alias("tile_col"), cell.alias("_cell")).groupBy(*keys, "tile_row", "tile_col")
    return packed.agg(F.sort_array(F.collect_list("_cell")).alias("cells"))


def tile_cells(tiles: DataFrame, names: Sequence[str], tile: int = TILE, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """The same form from a tile table, without a shuffle; the values are its bands and `is_valid`."""
    zipped = F.arrays_zip(*[F.col("bands")[i].alias(n) for i, n in enumerate(names)], F.col("mask").alias("is_valid"))

    def cell(x: Column, k: Column) -> Column:
        r, c = F.floor(k / F.col("width")).cast("bigint"), (k % F.col("width")).cast("bigint")
        own = F.struct(*[x[n].alias(n) for n in [*names, "is_valid"]]).alias("v")
        return F.struct((r * tile + c).cast("int").alias("i"), (r + F.col("row_off")).alias("r"), (c + F.col("col_off")).alias("c"), own)

    return tiles.select(*keys, "tile_row", "tile_col", F.transform(zipped, cell).alias("cells"))


def _paired(keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = batch.column("cells"), batch.column("other_cells")
            for k in range(batch.num_rows):
                mine, theirs = own[k].values, far[k].values
                place = mine.field("i").to_numpy()
                if theirs is None or not len(theirs):
                    other = pa.nulls(len(place), far.type.value_type.field("v").type)
                else:
                    there = theirs.field("i").to_numpy()
                    at = np.searchsorted(there, place).clip(max=len(there) - 1)
                    other = theirs.field("v").take(pa.array(at, mask=there[at] != place))
                whole = [pa.repeat(batch.column(j)[k], len(place)) for j in range(keys)]
                yield pa.RecordBatch.from_arrays([*whole, mine.field("r"), mine.field("c"), mine.field("v"), other], names=[*batch.schema.names[:keys], "r", "c", "v", "w"])

    return run


def pair_cells(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("raster_id",), carry: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Cells of a with those of b in the same place: keys, carry (columns of a), r, c, own values `v`, the other's values `w`.

    One join on the tile id; inside a tile the two sorted arrays are matched by place, and `w` is NULL where b lacks the
    cell. `cells` of b must hold a place once.
    """
    joined = join_tiles(a, b, keys, how, other=("cells",)).select(*keys, *carry, "cells", "other_cells")
    value = lambda c: joined.schema[c].dataType.elementType["v"].dataType
    shape = [*[joined.schema[k] for k in (*keys, *carry)], StructField("r", LongType()), StructField("c", LongType()), StructField("v", value("cells")), StructField("w", value("other_cells"))]
    return joined.mapInArrow(_paired(len(keys) + len(carry)), StructType(shape))


def downsample(px: DataFrame, height: Column, width: Column, longest: int = 1800) -> DataFrame:
    """Preview by taking every k-th row and column, so that the longer side has at most `longest` cells."""
    k = F.greatest(F.lit(1), F.ceil(F.greatest(height, width) / longest)).cast("bigint")
    return px.where((F.col("r") % k == 0) & (F.col("c") % k == 0)).withColumns({"pr": F.floor(F.col("r") / k), "pc": F.floor(F.col("c") / k)})


def pad_or_crop(px: DataFrame, windows: DataFrame, size: int, bands: Sequence[str], fill: float = 0.0, key: str = "patch_id") -> DataFrame:
    """Cells of each window on a full size * size grid; cells the window does not have get the fill value."""
    span = F.sequence(F.lit(0), F.lit(size - 1))
    grid = windows.select(key, F.explode(span).alias("pr")).select(key, "pr", F.explode(span).alias("pc"))
    have = px.where((F.col("pr") < size) & (F.col("pc") < size)).select(key, F.col("pr").cast("int"), F.col("pc").cast("int"), *bands)
    out = grid.join(have, [key, "pr", "pc"], "left")
    return out.withColumns({b: F.coalesce(F.col(b), F.lit(fill)) for b in bands})
