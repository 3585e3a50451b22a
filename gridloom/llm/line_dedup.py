"""Corpus-wide line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of line keys (128-bit hashes) bucketed and sorted by key. Frequent keys and keys that may still become
frequent live in separate families of runs. A new batch of documents is reduced to one row per key (map-side sums, so a
line that a third of all documents share is one row per task), merge-anti-joined with the frequent runs, and what is left
becomes its own run. When a level holds `fanout` runs they are compacted into one run of the next level; keys whose sum
has reached the threshold move to the frequent family. All runs are bucketed and sorted alike, so runs are merged and
anti-joined by sort-merge joins that do not shuffle them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_folder, stored

KEY = ["h1", "h2"]
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; NULL and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits as two longs; the second hash starts from another seed."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Levelled runs of (h1, h2, n): in how many documents a line key was met.

    min_docs: from how many documents on a key counts as frequent. min_chars: shorter keys (in code points) are never
    counted. fanout: runs of a level before they are compacted. Only the names of runs are on the driver.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 4):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark)}/gridloom/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.frequent_runs: list[str] = []
        self.made: list[str] = []

    def lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row (doc, h1, h2) per document and distinct line key of at least min_chars."""
        keys = F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= self.min_chars)
        hashes = F.array_distinct(F.transform(keys, key_hash))
        return docs.select(F.col(id_col).alias("doc"), F.inline(hashes).alias("h1", "h2"))

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.write.format("parquet")
            .option("path", f"{self.folder}/{name}")
            .bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .saveAsTable(name)
        )
        self.made.append(name)
        return name

    def _summed(self, names: list[str]) -> DataFrame:
        """Runs merged into one row per key. Merge joins, because a union of bucketed tables claims a partitioning it does not have."""

        def merge(one: DataFrame, two: DataFrame) -> DataFrame:
            n = F.coalesce(one["n"], F.lit(0)) + F.coalesce(two["n"], F.lit(0))
            return one.join(two, KEY, "full_outer").select(*KEY, n.alias("n"))

        return reduce(merge, [self.spark.table(n) for n in names])

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of `lines()` rows whose documents are in no earlier batch."""
        own = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for name in self.frequent_runs:
            own = own.join(self.spark.table(name), KEY, "left_anti")
        self.levels[0].append(self._write(own))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """Sum the runs of a level into one run of the next; frequent keys leave for a run of their own.

        A key may have reached the threshold in one run after another run took it in, so a sum never counts what the
        frequent family holds already.
        """
        total = self._summed(self.levels[level])
        for name in self.frequent_runs:
            total = total.join(self.spark.table(name), KEY, "left_anti")
        summed = self._write(total)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        table = self.spark.table(summed)
        self.frequent_runs.append(self._write(table.where(F.col("n") >= self.min_docs).select(*KEY)))
        self.levels[level + 1].append(self._write(table.where(F.col("n") < self.min_docs)))

    def frequent(self) -> DataFrame:
        """All keys met in at least min_docs documents so far, once each."""
        runs = [n for level in self.levels for n in level]
        parts = [self.spark.table(n).select(*KEY) for n in self.frequent_runs]
        if runs:
            total = self._summed(runs).where(F.col("n") >= self.min_docs).select(*KEY)
            for name in self.frequent_runs:
                total = total.join(self.spark.table(name), KEY, "left_anti")
            parts.append(total)
        if not parts:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return stored(reduce(DataFrame.unionByName, parts), "frequent-lines")

    def close(self) -> None:
        """Forget the runs' table names; the files stay in the shared folder until that is cleaned."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """`docs` with `text_col` freed of every line whose key is found in at least min_docs documents, plus n_lines and n_dropped.

    NULL and empty texts are one empty line, which has no key and stays; a text of which all lines go becomes empty. An
    id that repeats counts as one document per row. Other columns pass through whatever their names; columns named n_lines
    or n_dropped give way to the new ones. An empty table gives an empty table.
    batches: into how many batches the documents are dealt for the runs; the result does not depend on it.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, min_chars, fanout)
    lines = stored(runs.lines(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(batches))), "lines")
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    bad = lines.join(runs.frequent(), KEY, "left_semi").groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias("bad"))
    runs.close()
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    out = own.join(bad, F.col("row")[id_col].eqNullSafe(F.col("doc")), "left").withColumn("every", lines_of(F.col("row")[text_col]))
    kept = F.when(F.col("bad").isNull(), F.col("every")).otherwise(
        F.filter("every", lambda x: ~((F.char_length(line_key(x)) >= min_chars) & F.array_contains(F.col("bad"), key_hash(line_key(x)))))
    )
    out = out.select("row", "every", kept.alias("kept"))
    rest = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*rest, F.size("every").cast("long").alias("n_lines"), (F.size("every") - F.size("kept")).cast("long").alias("n_dropped"))
