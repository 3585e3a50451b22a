"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets.

Two small collections of half keys are computed per document, each half key from `WIDTH` minhashes. A table key joins one
half key of either collection, so `HALVES`^2 tables cost only 2 * HALVES * WIDTH minhashes. A pair of similarity s shares
a table with probability (1 - (1 - s^WIDTH)^HALVES)^2: 0.9995 at 0.75, 0.99996 at 0.8.

Work is kept near linear. Documents with equal shingle sets are one class. Half keys that no second class has are dropped
before they are combined. Shingles that no other candidate has cannot be shared: they are counted and left out of the sets,
and what remains bounds a document's similarity to any other. Within a table's bucket, members are compared with the member
that has the largest share of shared shingles. Components of the confirmed links then tell which buckets still hold members
that may be unconnected; of all members gathered round one such set, pairs across components are compared unless what both
lack of it already rules a link out. A pair of one bucket is therefore connected, compared or ruled out exactly: no link
that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.slices import KEYED, MESSAGE, Slices, bucket_of, by_bucket, messages, repeated_keys, slices_in
from gridloom.llm.texts import lean, parts, word_codes
from gridloom.session import stored

WIDTH = 2
HALVES = 10
BIT_WORDS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
SHORT = 0x5851F42D4C957F2D  # seed that keeps short texts apart from shingles


def _mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of every text's word shingles; fewer words than `size` are one shingle, none give none."""
    names, codes, rows = word_codes(texts)
    by_word = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64) if names else np.zeros(0, np.uint64)
    words = by_word[codes]
    ends = np.cumsum(np.bincount(rows, minlength=len(texts))) if len(rows) else np.zeros(len(texts), np.int64)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        rolled = rolled * MIX + words[i : i + len(rolled)]
    rolled = _mixed(rolled)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            out.append(np.unique(rolled[start : end - size + 1]))
        elif end > start:
            powers = MIX ** np.arange(end - start, dtype=np.uint64)
            out.append(_mixed((words[start:end] * powers).sum(keepdims=True) + np.uint64(end - start), SHORT))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * HALVES half keys of every non-empty set: the first HALVES belong to one collection, the others to the second."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = np.zeros((len(sets), 2 * HALVES), np.uint64)
    for j in range(2 * HALVES):
        own = np.full(len(sets), j + 1, np.uint64)
        for k in range(WIDTH):
            seed = _mixed(np.array([j * WIDTH + k + 1], np.uint64) * MIX)[0]
            own = _mixed(own * MIX + np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), starts))
        keys[:, j] = own
    return keys


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            sets = shingle_sets(batch.column(1), size)
            some = [i for i, s in enumerate(sets) if len(s)]
            halves: list = [None] * len(sets)
            if some:
                for i, keys in zip(some, half_keys([sets[i] for i in some]).view(np.int64)):
                    halves[i] = keys
            prints = np.array([[_mixed(s, seed).sum() for seed in (1, 2)] for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(halves, pa.list_(pa.int64()))],
                ["doc", "h", "n", "f1", "f2", "halves"],
            )

    return run


def _report_shingles(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in slices_in(batches, (0, 1)):
            keys, count = np.unique(np.concatenate(shingle_sets(part.texts, size)), return_counts=True)
            rows = np.zeros(len(keys), KEYED)
            rows["key"], rows["twice"] = keys, count > 1
            if len(rows):
                yield messages(list(by_bucket(part.number, bucket_of(keys, buckets), rows)))

    return run


def _shared_sets(size: int):
    """Of every text its number of shingles and those shingles, sorted, that another text has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, replies in slices_in(batches, (0, 1)):
            shared = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r, KEYED)["key"] for r in replies)])
            shared.sort()
            sets = shingle_sets(part.texts, size)
            flat = np.concatenate(sets)
            hit = shared[np.searchsorted(shared, flat).clip(max=len(shared) - 1)] == flat if len(shared) else np.zeros(len(flat), bool)
            own = [s[h] for s, h in zip(sets, np.split(hit, np.cumsum([len(s) for s in sets])[:-1]))]
            yield pa.RecordBatch.from_arrays(
                [part.table.column(0).combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                ["doc", "n", "u", "shingles"],
            )

    return run


def _confirm(percent: int):
    """Of pairs with their sets: whether they are similar, how much they share, and which of b's shingles a lacks (as hashed bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, shared, lacks = [], [], np.zeros((batch.num_rows, 64 * BIT_WORDS), np.uint8)
            total = batch.column(2).to_numpy()
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(4))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (int(total[i]) - common))
                shared.append(common)
                missing = y[x[np.searchsorted(x, y).clip(max=len(x) - 1)] != y] if len(x) else y
                lacks[i, (missing >> np.uint64(17)) % np.uint64(64 * BIT_WORDS)] = 1
            bits = np.packbits(lacks, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(shared, pa.int64()), pa.array(list(bits), pa.list_(pa.int64()))], ["a", "b", "linked", "common", "lacks"]
            )

    return run


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the outcome of the comparison of their sets."""
    one = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("total"), "x", "y")
    return both.mapInArrow(lean(_confirm(percent)), "a long, b long, linked boolean, common long, lacks array<long>")


def _table_keys(sketches: DataFrame) -> DataFrame:
    """(key, doc, n): the table keys that may have company, from half keys that at least two classes share."""
    halves = stored(sketches.select("doc", "n", F.posexplode("halves").alias("j", "half")), "halves")
    shared = stored(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "shared-halves")
    own = halves.join(shared, "half", "left_semi").groupBy("doc", "n").agg(F.collect_list(F.struct("j", "half")).alias("all"))
    first = F.filter("all", lambda x: x["j"] < HALVES)
    second = F.filter("all", lambda x: x["j"] >= HALVES)
    keys = F.flatten(F.transform(first, lambda u: F.transform(second, lambda v: F.xxhash64(u["half"], v["half"]))))
    keys = stored(own.select("doc", "n", F.explode(keys).alias("key")), "table-keys")
    buckets = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "buckets")
    return stored(keys.join(buckets, "key", "left_semi"), "bucket-members")


def _reaches(common, n, m, percent: int):
    """Whether sets of n and m shingles can be similar when they share `common` at most."""
    return 100 * common >= percent * (n + m - common)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the components of documents linked at `percent` Jaccard similarity or more.

    Words are split at `[\\x20\\x09-\\x0D]` with A-Z lower-cased. NULL and empty texts and texts without words have no
    shingles and are linked with nothing; so are rows with a NULL id, whose component is NULL and which are kept. Rows
    that repeat an id count as copies of one document if their texts agree and otherwise as linked by the id. Between
    the first and the last step, `doc` is the number of a class of equal shingle sets.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("h"))
    sketch = stored(source.mapInArrow(lean(_sketch(size)), "doc long, h long, n long, f1 long, f2 long, halves array<long>"), "sketches")
    full = sketch.where("n > 0 AND doc IS NOT NULL")
    prints = ["n", "f1", "f2"]
    row = F.struct("doc", "h")
    classes = full.groupBy(*prints).agg(F.min(row).alias("rep"), F.min_by("halves", row).alias("halves"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    heads = classes.select(F.col("class").alias("doc"), "n", "halves")
    members = _table_keys(heads)

    wanted = members.select(F.col("doc").alias("class")).distinct().join(classes.select("class", "rep.*"), "class")
    texts = source.join(wanted, ["doc", "h"]).select(F.col("class").alias("doc"), "text").dropDuplicates(["doc"])
    slices = Slices(texts, "text")
    said = slices.table.mapInArrow(lean(_report_shingles(size, slices.buckets)), MESSAGE)
    shared = stored(said.groupBy("bucket").applyInArrow(repeated_keys, "slice long, data binary"), "shared-shingles")
    sets = stored(slices.with_replies(shared).mapInArrow(lean(_shared_sets(size)), "doc long, n long, u long, shingles binary"), "shingles")
    able = sets.where(100 * F.col("u") >= percent * F.col("n")).select("doc", "u")
    of = stored(members.join(able, "doc"), "able-members")

    # every member of a bucket against the one with the largest share of shared shingles, which is closest to the original
    hub = F.max_by(F.struct("doc", "n", "u"), F.struct(F.col("u") / F.col("n"), -F.col("doc")))
    hubs = stored(of.groupBy("key").agg(hub.alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("h.doc").alias("b"), F.col("h.n").alias("bn"), F.col("h.u").alias("bu")), "hubs")
    pairs = of.join(hubs, "key").where(F.col("doc") != F.col("b")).where(_reaches(F.least("u", "bu"), F.col("n"), F.col("bn"), percent))
    pairs = stored(pairs.select(F.col("doc").alias("a"), "b").distinct(), "pairs")
    stars = stored(compared(pairs, sets, percent), "stars")
    links = stars.where("linked").select("a", "b")
    grouped = stored(components(links), "components")

    # buckets whose members are not all connected now, gathered by their hub: the pairs across components that may still be similar
    of = of.join(grouped.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", "u", F.coalesce("component", "doc").alias("label"))
    of = stored(of, "bucket-labels")
    mixed = of.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    mixed = stored(mixed.join(hubs.select("key", "b", "bu"), "key"), "mixed-buckets")
    known = stars.select(F.col("a").alias("doc"), "b", "common", *[F.col("lacks")[i].alias(f"l{i}") for i in range(BIT_WORDS)])
    family = of.join(mixed, "key").select("b", "bu", "doc", "n", "u", "label").distinct()
    rest = family.join(known, ["doc", "b"], "left").join(family.where("doc = b").select("b", F.col("label").alias("hub_label")), "b")
    common = F.when(F.col("doc") == F.col("b"), F.col("u")).otherwise(F.coalesce("common", F.lit(0)))
    rest = stored(rest.withColumn("common", common).fillna(0, [f"l{i}" for i in range(BIT_WORDS)]), "mixed-members")
    other = rest.select("b", *[F.col(c).alias(f"o_{c}") for c in rest.columns if c not in ("b", "bu", "hub_label")])
    # two members share at most the hub's shingles that neither lacks, and outside the hub what the poorer one has there
    lacked = sum((F.bit_count(F.col(f"l{i}").bitwiseOR(F.col(f"o_l{i}"))) for i in range(BIT_WORDS)), F.lit(0))
    most = F.least("u", "o_u", F.col("bu") - lacked + F.least(F.col("u") - F.col("common"), F.col("o_u") - F.col("o_common")))
    once = (F.col("o_label") == F.col("hub_label")) | (F.col("label") < F.col("o_label"))
    open_pairs = rest.where("label <> hub_label").join(other, "b").where(once & _reaches(most, F.col("n"), F.col("o_n"), percent))
    open_pairs = stored(open_pairs.select(F.least("doc", "o_doc").alias("a"), F.greatest("doc", "o_doc").alias("b")).distinct(), "pairs")
    links = links.unionByName(compared(open_pairs, sets, percent).where("linked").select("a", "b"))
    texts_of = full.groupBy("doc").agg(F.min(F.struct(*prints)).alias("x"), F.max(F.struct(*prints)).alias("y")).where("x <> y").select("doc")
    owners = full.join(texts_of, "doc").select("doc", *prints).distinct().join(classes.select(*prints, "class"), prints).select("doc", "class")
    same_id = owners.join(owners.groupBy("doc").agg(F.min("class").alias("b")), "doc").select(F.col("class").alias("a"), "b").where("a <> b")
    grouped = components(links.unionByName(same_id)).withColumnRenamed("node", "class")
    labels = stored(classes.select("class", *prints, F.col("rep.doc").alias("doc")).join(grouped, "class", "left").select(*prints, "doc", F.coalesce("component", "class").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("doc").alias("least"))
    out = sketch.select("doc", *prints).join(labels.drop("doc").join(least, "label").drop("label"), prints, "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))
