"""Candidate products: scoring, ranking, selection per city, catalogue search and name matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.products import days_from, has_polarisations, parse_product, passes_filters, product_inside, product_prefix
from gridloom.functions.rules import weighted_candidate_score
from gridloom.operators.ranking import best_per_key, top_k
from gridloom.session import stored


def n_rows() -> Column:
    return F.count(F.lit(1))
FAR = 999999.0


def first_candidates(df: DataFrame) -> DataFrame:
    """One row per (city, item) out of many searches: largest overlap, then closest in time, then best rank."""
    order = [-F.coalesce("overlap_percent", F.lit(0.0)), F.coalesce("temporal_distance_days", F.lit(FAR)), F.coalesce("rank", F.lit(999999))]
    return best_per_key(df, ["city", "item_id"], order)


def rank_candidates(df: DataFrame, k: int) -> DataFrame:
    order = [F.col("overlap_percent").desc(), F.coalesce("temporal_distance_days", F.lit(FAR)), F.col("item_id")]
    return top_k(df, ["city"], order, k)


def score_candidates(
    df: DataFrame, min_overlap: float = 95.0, required: Sequence[str] = ("VV", "VH"), mode: str = "IW", product_type: str = "GRD"
) -> DataFrame:
    """Test columns and the weighted score of every candidate (`polarizations` is an array)."""
    no = F.lit(False)
    out = df.withColumns(
        {
            "polarizations_ok": F.coalesce(has_polarisations(F.col("polarizations"), required), no),
            "instrument_mode_ok": F.coalesce(F.upper("instrument_mode") == mode, no),
            "product_type_ok": F.coalesce(F.contains(F.upper("product_type"), F.lit(product_type)), no),
            "meets_min_overlap": F.coalesce(F.col("overlap_percent") >= min_overlap, no),
            "full_coverage": F.coalesce("full_coverage", no),
        }
    )
    score = weighted_candidate_score(
        F.col("overlap_percent"), F.col("full_coverage"), F.col("polarizations_ok"), F.col("instrument_mode_ok"),
        F.col("product_type_ok"), F.col("temporal_distance_days"),
    )
    return out.withColumn("selection_score", score)


def select_candidate(df: DataFrame, cities: DataFrame, manual: DataFrame | None = None, min_overlap: float = 95.0) -> DataFrame:
    """One product per city: the manual choice, else the best that passes all tests, else the best at hand, flagged.

    Counts and the best rows are mergeable aggregates, so a city with most of the candidates needs no large sort. The set of
    a city's manual choices makes Catalyst hash the cities; with `max` in its place it would sort the candidates by city.
    """
    scored = score_candidates(df, min_overlap)
    ok = F.col("meets_min_overlap") & F.col("polarizations_ok") & F.col("instrument_mode_ok") & F.col("product_type_ok")
    days = F.coalesce("temporal_distance_days", F.lit(FAR))
    overlap, score = -F.coalesce("overlap_percent", F.lit(0.0)), -F.col("selection_score")
    row = F.struct("item_id", "overlap_percent", "selection_score", "full_coverage", "temporal_distance_days")
    strict = F.struct(overlap, (~F.col("full_coverage")).cast("int"), score, days, F.col("item_id"))
    loose = F.struct(overlap, score, days, F.col("item_id"))
    if manual is not None:
        scored = scored.join(manual.select("city", F.col("item_id").alias("_manual")), "city", "left")
    else:
        scored = scored.withColumn("_manual", F.lit(None).cast("string"))
    per = scored.groupBy("city").agg(
        n_rows().alias("num_candidates"), F.count_if("meets_min_overlap").alias("num_meeting_min_overlap"), F.count_if("full_coverage").alias("num_full_coverage"),
        F.min_by(F.when(ok, row), F.when(ok, strict)).alias("_ok"), F.min_by(row, loose).alias("_any"),
        F.max(F.when(F.col("item_id") == F.col("_manual"), row)).alias("_chosen"), F.array_max(F.collect_set("_manual")).alias("_manual"),
    )
    wanted = F.col("_manual").isNotNull()
    best = F.when(wanted, F.col("_chosen")).otherwise(F.coalesce("_ok", "_any"))
    status = (
        F.when(F.col("num_candidates").isNull(), "no_candidates").when(wanted & F.col("_chosen").isNull(), "manual_selection_not_found")
        .when(wanted, "selected_manual").when(F.col("_ok").isNotNull(), "selected_auto").otherwise("best_available_but_below_threshold")
    )
    out = cities.select("city").distinct().join(per, "city", "left")
    return out.select(
        "city", status.alias("selection_status"), F.coalesce(best["item_id"], F.col("_manual")).alias("selected_item_id"),
        best["overlap_percent"].alias("overlap_percent"), best["selection_score"].alias("selection_score"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_candidates", "num_meeting_min_overlap", "num_full_coverage")],
    )


def best_by_score(df: DataFrame, by: Sequence[str], score: Column, ties: Sequence[Column]) -> DataFrame:
    """Row with the highest score per key; candidates that score nothing are not considered."""
    scored = df.withColumn("score", score).where(F.col("score") > 0)
    return best_per_key(scored, by, [-F.col("score"), *ties])


def product_score(city: Column, path: Column, product: Column, selected: Column, has_vv: Column, has_vh: Column, pol: Column, valid: Column, unpacked: Column) -> Column:
    """Additive match of a product folder with a city: path, selected ids, measurement files, validity, packing."""
    parts = F.transform(F.split(F.lower(path), "/"), lambda p: F.regexp_replace(p, r"[^a-z0-9]+", "_"))
    exact = F.array_contains(selected, product)
    partly = F.exists(selected, lambda s: F.contains(s, product) | F.contains(product, s))
    pts = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    files = F.when(has_vv & has_vh, 20).when(F.contains(pol, F.lit("DV")), 15).otherwise(0)
    return pts(F.array_contains(parts, city), 50) + pts(exact, 100) + pts(partly, 80) + files + pts(valid, 20) + pts(unpacked, 5)


def safe_status(valid: Column, found: Column, raw_pair: Column) -> Column:
    return (
        F.when(valid & raw_pair, "SAFE_READY").when(valid, "SAFE_FOUND_RAW_INCOMPLETE").when(found, "SAFE_FOUND_BUT_INCOMPLETE")
        .when(raw_pair, "RAW_VV_VH_ONLY_NO_SAFE").otherwise("MISSING_SAFE_AND_RAW_INCOMPLETE")
    )


def best_fill_candidate(df: DataFrame, min_zero: float = 10.0, min_label: float = 1.0) -> DataFrame:
    """Fallback raster per city that fills most label holes, then most holes."""
    usable = df.where(
        (F.col("status") == "ok") & ((F.col("fillable_current_zero_percent") >= min_zero) | (F.col("fillable_label_zero_percent") >= min_label))
    )
    order = [-F.col("fillable_label_zero_percent"), -F.col("fillable_current_zero_percent"), F.col("is_primary_source"), F.col("candidate_id")]
    return best_per_key(usable, ["city"], order)


def search_candidates(catalogue: DataFrame, reference_time: Column, min_overlap: float = 1.0, full: float = 95.0, k: int = 20, **filters) -> DataFrame:
    """Catalogue rows per city that pass the filters and the overlap, ranked by overlap, time distance and id."""
    ok = passes_filters(F.col("item_id"), F.col("polarizations"), F.col("instrument_mode"), F.col("product_type"), F.col("orbit_state"), **filters)
    rows = catalogue.where(ok & (F.col("overlap_percent") >= min_overlap))
    rows = rows.withColumns({"full_coverage": F.col("overlap_percent") >= full, "temporal_distance_days": days_from(F.col("acquired_at"), reference_time)})
    return rank_candidates(rows, k)


def _pieces(text: Column, kind: str, lengths: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths that consist of characters of a class, such as `[0-9]`."""

    def of_length(n: int) -> Column:
        runs = F.regexp_extract_all(text, F.lit(f"({kind}{{{n},}})"), F.lit(1))
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substr(r, i, F.lit(n)))))

    return F.array_distinct(F.concat(*[of_length(n) for n in lengths]))


def _timed_pairs(names: DataFrame, products: DataFrame, hour: Callable[[Column], Column]) -> DataFrame:
    """Pairs of a name and a product of its hours, among them the best of each name; not all pairs, which grow with the square
    of the names of an hour.

    A product is its head (platform to polarisation), its two times and its tail. Platform, mode, type and polarisation
    of a name can only stand in the head or the times, the orbit and the datatake (digits, hexadecimal digits) in the times or the
    tail. So the best product is the first of its head and times, or holds the orbit in its tail, or is the first of its head and
    times to hold the datatake there; the last two meet by equality with the pieces of a tail. A name whose platform,
    mode, type or polarisation might stand in a tail is compared with every product of its hours.
    """
    short = [F.col(k) for k in ("platform", "acquisition_mode", "product_type", "polarization_code")]
    odd = reduce(Column.__or__, [c.rlike("^[0-9A-Fa-f]*$") | F.contains(F.lit("_COG.SAFE.zip"), c) for c in short])
    lengths = names.agg(*[F.sort_array(F.collect_set(F.length(c))).alias(c) for c in ("absolute_orbit", "datatake")]).first()
    p = products.withColumn("_hour", hour(F.col("s")))
    if not lengths["datatake"]:
        return names.join(p, "_hour")
    upto = lambda n: F.substring_index("product", "_", n)
    alike = {"_head": upto(4), "_times": F.substring_index(upto(6), "_", -2), "_tail": F.substr("product", F.length(upto(6)) + 2)}
    cut = p.withColumns(alike)
    by = ["_hour", "s", "_head", "_times", "_cog"]
    first = cut.groupBy(*by).agg(F.min("product").alias("product"))
    orbit = cut.withColumn("absolute_orbit", F.explode(_pieces(F.col("_tail"), "[0-9]", lengths["absolute_orbit"])))
    take = cut.withColumn("datatake", F.explode(_pieces(F.col("_tail"), "[0-9A-Fa-f]", lengths["datatake"]))).groupBy(*by, "datatake").agg(F.min("product").alias("product"))
    plain = names.where(~odd)
    pairs = plain.join(first, "_hour").select(*names.columns, "s", "product")
    for key, side in (("absolute_orbit", orbit), ("datatake", take)):
        pairs = pairs.unionByName(plain.join(side.select("_hour", key, "s", "product"), ["_hour", key]).select(*names.columns, "s", "product"))
    return pairs.unionByName(names.where(odd).join(p, "_hour").select(*names.columns, "s", "product"))


def match_products(wanted: DataFrame, products: DataFrame, minutes: int = 10, prefer_cog: bool = False) -> DataFrame:
    """Best catalogue product for each wanted name: same prefix, else a name that holds the prefix, else a start time within the window.

    Either match by prefix outscores any match by time, and one at the start outscores one inside, so only names without
    the better match go on to the next. All ways are equi joins, on the prefix, on the product name that stands inside a
    longer one (a copy, a path), and on the hour (a window of minutes touches at most two hours, so a name is laid out at most
    twice). Products are reduced to the first of those that score alike before they meet the names (`_timed_pairs`), and the
    best match is a mergeable aggregate.
    """
    fields = ("platform", "acquisition_mode", "product_type", "polarization_code", "absolute_orbit", "datatake")

    def parsed(df: DataFrame, name: str) -> DataFrame:
        f = parse_product(F.col("name"))
        return df.select(
            F.col("name").alias(name), product_prefix(F.col("name")).alias("prefix"), F.unix_seconds(f["acquisition_start"]).alias("s"), *[f[k].alias(k) for k in fields]
        )

    hit = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    cog = F.contains("product", F.lit("_COG"))
    packing = F.when(cog, 80 if prefer_cog else -20).otherwise(50)
    parts = packing
    for k in fields:
        parts = parts + hit(F.contains("product", F.col(k)), 25)
    best = lambda df, score: best_per_key(df.select("name", "product", score.alias("score")), ["name"], [-F.col("score"), F.col("product")])
    w = parsed(wanted.distinct(), "name")
    p = parsed(products.distinct(), "product").select("product", "prefix", "s", *[F.col(k).alias(f"_{k}") for k in fields])
    same = F.col("product") == F.col("name")
    whole = parts + hit(same, 1000) + hit(F.startswith("product", "prefix"), 800) + hit(F.contains("product", F.col("prefix")), 500) + F.when(same, 100).otherwise(80)
    by_prefix = best(w.join(p.select("product", "prefix"), "prefix"), whole).withColumn("method", F.lit("prefix"))
    inside = p.select("product", product_inside(F.col("product")).alias("prefix"), F.col("prefix").alias("_own")).where("prefix IS NOT NULL AND prefix <> _own")
    held = hit(F.contains("product", F.col("prefix")), 500) + 80
    by_part = best(w.join(by_prefix.select("name"), "name", "left_anti").join(inside.drop("_own"), "prefix"), parts + held).withColumn("method", F.lit("contains"))
    by_name = by_prefix.unionByName(by_part)
    span = minutes * 60
    hour = lambda s: F.floor(s / 3600).cast("bigint")
    s = F.col("s")
    by_name = stored(by_name, "products-by-name")
    left = stored(w.where(s.isNotNull()).join(by_name.select("name"), "name", "left_anti").select("name", *fields, s.alias("_s")), "names-left")
    timed = stored(p.where(s.isNotNull()).select("product", "s", cog.alias("_cog")), "timed-products")
    pairs = _timed_pairs(left.withColumn("_hour", F.explode(F.sequence(hour(F.col("_s") - span), hour(F.col("_s") + span)))), timed, hour)
    near = pairs.where(F.abs(s - F.col("_s")) <= span)
    by_time = best(near, parts + 30).withColumn("method", F.lit("time_window"))
    return by_name.unionByName(by_time).select("name", "product", "method", "score")


MOST_NAME_BYTES = 64 << 20  # city names that travel to every task


def _names_in(cities: Sequence[str]) -> Callable:
    """The names that occur in each text, in the order of the list: one automaton of all names per task, one walk per text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for i, name in enumerate(cities):
            places.setdefault(name, []).append(i)
        everywhere, automaton = places.pop("", []), ahocorasick.Automaton()
        for name, at in places.items():
            automaton.add_word(name, at)
        automaton.make_automaton()
        for texts in batches:
            found = []
            for text in texts:
                hits = set(everywhere) if text is not None else set()
                if text and places:
                    for _, at in automaton.iter(text):
                        hits.update(at)
                found.append([cities[i] for i in sorted(hits)])
            yield pd.Series(found)

    return run


def match_cities(paths: DataFrame, cities: Sequence[str], path: str = "path") -> DataFrame:
    """Cities whose key occurs in the normalised path, as one row per (path, city); a NULL path has none.

    The names form an automaton, so a path is read once, however many names there are. They travel to every task, which
    their total size is checked for.
    """
    size = sum(len(c.encode()) for c in cities)
    if size > MOST_NAME_BYTES:
        raise ValueError(f"{size} bytes of city names are more than the {MOST_NAME_BYTES} that may travel to every task")
    text = F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9_/.]+", "_"), "_+", "_")
    found = F.pandas_udf(_names_in(list(cities)), "array<string>")
    return paths.withColumn("city", F.explode(found(text)))
