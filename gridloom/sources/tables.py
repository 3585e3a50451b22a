"""Typed table sources with alias resolution, and sinks with an overwrite guard."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.scalars import safe_bool
from gridloom.operators.ranking import best_per_key, spread

# Names under which the columns of a patch table are met.
PATCH_ALIASES = {
    "patch_id": ("patch_id", "patch", "patch_name", "sample_id", "tile_id"),
    "city": ("city", "city_name", "city_slug", "municipality"),
    "region": ("region", "macro_region", "macroregion", "region_name"),
    "modality": ("modality", "input_modality", "embedding_modality"),
    "label_positive_pixels": ("label_positive_pixels", "positive_pixels", "positive_pixel_count", "n_positive_pixels"),
    "label_positive_percent": ("label_positive_percent", "positive_percent", "label_percent", "gt_pos_pct"),
    "label_binary": ("label_binary", "patch_label_binary", "is_positive_patch", "is_positive", "has_positive"),
    "s1_snap_valid_percent": ("s1_snap_valid_percent", "s1_snap_grd_valid_percent"),
    "source_s1_snap_path": ("source_s1_snap_path", "source_s1_snap_grd_path"),
    "row_start": ("row_start", "row_off", "y", "row"),
    "col_start": ("col_start", "col_off", "x", "col"),
}


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def find_column(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias that names a column, whatever its case and punctuation."""
    known = {_plain(c): c for c in columns}
    return next((known[_plain(a)] for a in aliases if _plain(a) in known), None)


def resolve(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Rename known columns to their standard names in one projection; unknown columns stay."""
    found = {name: find_column(df.columns, names) for name, names in aliases.items()}
    missing = [name for name in required if found.get(name) is None]
    if missing:
        raise ValueError(f"no column found for {missing}; columns are {df.columns}")
    renames = {c: name for name, c in found.items() if c is not None}
    return df.select(*[F.col(f"`{c}`").alias(renames.get(c, c)) for c in df.columns])


# Words of a text flag that mark a positive patch.
POSITIVE_WORDS = ("true", "yes", "y", "positive", "pos", "1")


def with_positive(df: DataFrame, threshold: float = 0.0, name: str = "is_positive") -> DataFrame:
    """Whether a patch is positive, from the best column there is: a flag, else positive pixels, else a positive share.

    Numbers count as positive above the threshold, missing ones as 0. A flag column without any number is read as words;
    a one-row aggregate decides that. Raises where no such column is known.
    """
    found = [find_column(df.columns, PATCH_ALIASES[k]) for k in ("label_binary", "label_positive_pixels", "label_positive_percent")]
    column = next((c for c in found if c is not None), None)
    if column is None:
        raise ValueError(f"no column tells whether a patch is positive; columns are {df.columns}")
    text = F.trim(F.col(f"`{column}`").cast("string"))
    number = text.try_cast("double")
    words = column == found[0] and not df.agg(F.count(number).alias("n")).first()["n"]
    return df.withColumn(name, F.coalesce(F.lower(text).isin(*POSITIVE_WORDS) if words else number > threshold, F.lit(False)))


def filter_modality(df: DataFrame, wanted: str, column: str = "modality") -> DataFrame:
    """Rows of a modality: by normalised name, else by a name that holds every part of it; raises when there is neither.

    Which of the two holds is decided by a one-row aggregate, so any number of names will do.
    """
    slug = lambda v: re.sub(r"[^a-z0-9]+", "_", v.lower()).strip("_")
    name = F.btrim(F.regexp_replace(F.lower(F.col(column).cast("string")), "[^a-z0-9]+", "_"), F.lit("_"))
    exact = name == slug(wanted)
    partly = reduce(Column.__and__, [F.contains(name, F.lit(p)) for p in slug(wanted).split("_")])
    found = df.agg(F.bool_or(exact).alias("exact"), F.bool_or(partly).alias("partly")).first()
    if not (found["exact"] or found["partly"]):
        raise ValueError(f"no rows for modality {wanted!r} in column {column!r}")
    return df.where(exact if found["exact"] else partly)


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema: safe casts, empty text and NaN to NULL, absent columns NULL."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(df.schema[f.name].dataType, T.StringType):
            c = F.when(F.trim(c) != "", c)
        if isinstance(f.dataType, T.BooleanType):
            v = F.when(c.isNotNull(), safe_bool(c))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            v = c.try_cast("double").try_cast(f.dataType)
        else:
            v = c.try_cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.when(~F.isnan(v), v)
        out.append(v.alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, aliases: Mapping[str, Sequence[str]] | None = None, format: str = "csv", required: Sequence[str] = ()) -> DataFrame:
    """CSV or Parquet table with aliases resolved and columns cast. CSV is read as text, so no pass infers types."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    df = reader.format(format).load(paths)
    return cast_to(resolve(df, aliases or {}, required), schema)


def read_candidates(spark: SparkSession, glob: str) -> DataFrame:
    """All candidate tables under a glob, with the path of each row; the best row per (city, item) is kept."""
    df = spark.read.option("header", True).csv(glob).withColumn("candidate_path", F.col("_metadata.file_path"))
    aliases = {
        "city": ("city",),
        "item_id": ("item_id", "product_id"),
        "overlap_percent": ("overlap_percent", "overlap_percent_of_missing_aoi"),
        "temporal_distance_days": ("temporal_distance_days", "temporal_distance_days_from_ranking_date"),
    }
    df = resolve(df, aliases, ["city", "item_id"])
    for name, kind in (("overlap_percent", "double"), ("temporal_distance_days", "double"), ("rank", "int")):
        df = df.withColumn(name, F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind))
    order = [-F.coalesce("overlap_percent", F.lit(0.0)), F.coalesce("temporal_distance_days", F.lit(999999.0)), F.coalesce("rank", F.lit(999999))]
    return best_per_key(spread(df, ["city", "item_id"], df.count()), ["city", "item_id"], order)


def read_splits(spark: SparkSession, paths: Mapping[str, str], format: str = "csv") -> DataFrame:
    """One table from per-split files, with the split as a column; columns a file lacks are NULL."""
    out = None
    for split, path in paths.items():
        reader = spark.read.option("header", True) if format == "csv" else spark.read
        part = reader.format(format).load(path).drop("split").withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_embeddings(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    """Embedding table; the modality is a partition column, so one modality reads only its files."""
    df = spark.read.parquet(path)
    return df if modality is None else df.where(F.col("modality") == modality)


def write_table(df: DataFrame, path: str, overwrite: bool = False, format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Parquet, CSV or JSON; fails on an existing path unless told to overwrite. Arrays become `;` lists in CSV."""
    if format == "csv":
        flat = [F.array_join(F.transform(F.col(f"`{c}`"), lambda v: v.cast("string")), ";").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
        df = df.select(*flat)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by)
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def write_partitioned(df: DataFrame, path: str, key: str, overwrite: bool = False, format: str = "parquet") -> None:
    """One folder per filter set, fold or pool, readable as one membership table. Rows of a key may come from many
    tasks and so fill many files; a large key is never gathered into one task."""
    write_table(df, path, overwrite, format, [key])


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    write_table(df, path, overwrite, "json")


def only_missing(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not written yet (resume by key)."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def stored_keys(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Distinct keys of a stored table, or None if there is no table; partition keys are read from folder names."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write the partitions that `df` holds in place of those in the table; all other partitions stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_missing(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Resume a partitioned table: only partitions that are not stored yet are computed and written.

    A partition appears as a whole when its job commits, so one that is there is complete.
    """
    done = stored_keys(df.sparkSession, path, keys)
    replace_partitions(df if done is None else only_missing(df, done.select(*[F.col(k).cast(df.schema[k].dataType) for k in keys]), keys), path, keys)
