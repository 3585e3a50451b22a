"""Roll-ups that compare two variants and turn the evidence into a recommendation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.rules import dense_usable, direction, first_true, winner_from_text
from gridloom.operators.joins import pair_variants


def n_rows() -> Column:
    return F.count(F.lit(1))


def compare_variants(results: DataFrame, comparisons: Mapping[str, tuple[str, str]], metrics: Sequence[str], tie: float = 1e-12, min_delta: float = 1e-4) -> DataFrame:
    """Means, wins and ties of the second variant against the first, per comparison, fold mode, probe and metric.

    `comparisons` maps a name to (base, other) modalities. Only folds with a finite value of both are matched.
    """
    out = None
    for name, (snap, rtc) in comparisons.items():
        pairs = pair_variants(results, ["fold_mode", "probe", "fold"], "modality", rtc, snap, metrics)
        laid = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("rtc"), F.col(f"{m}_b").alias("snap")) for m in metrics])
        rows = pairs.select(F.lit(name).alias("comparison"), "fold_mode", "probe", F.inline(laid))
        out = rows if out is None else out.unionByName(rows)
    both = out.where(~F.isnan("rtc") & ~F.isnan("snap"))
    diff = F.col("rtc") - F.col("snap")
    g = both.groupBy("comparison", "fold_mode", "probe", "metric").agg(
        n_rows().alias("n_matched_folds"), F.avg("rtc").alias("rtc_mean"), F.avg("snap").alias("snap_mean"),
        (F.avg("rtc") - F.avg("snap")).alias("delta"), F.count_if(diff > tie).alias("rtc_wins"), F.count_if(diff < -tie).alias("snap_wins"),
        F.count_if(F.abs(diff) <= tie).alias("ties"),
    )
    return g.withColumn("direction", direction(F.col("delta"), F.col("rtc_wins"), F.col("snap_wins"), min_delta))


def decide(comparison: DataFrame, min_delta: float = 1e-4) -> DataFrame:
    """Decision per comparison from the number of higher means and the pooled wins. The joint and the radar-only
    comparison also need the wins to agree, and word their decision differently."""
    up, down = F.count_if(F.col("delta") > min_delta), F.count_if(F.col("delta") < -min_delta)
    g = comparison.groupBy("comparison").agg(
        n_rows().alias("n_summaries"), up.alias("rtc_higher"), down.alias("snap_higher"), (n_rows() - up - down).alias("near_ties"),
        F.sum("rtc_wins").alias("rtc_wins"), F.sum("snap_wins").alias("snap_wins"), F.sum("ties").alias("ties"), F.avg("delta").alias("mean_delta"),
    )
    c = F.col
    snap, rtc = c("snap_higher") > c("rtc_higher"), c("rtc_higher") > c("snap_higher")
    snap_all, rtc_all = snap & (c("snap_wins") > c("rtc_wins")), rtc & (c("rtc_wins") > c("snap_wins"))
    joint, sar = c("comparison") == "joint_rtc_vs_snap", c("comparison") == "sar_only_rtc_vs_snap"
    decision = first_true(
        [
            (joint & snap_all, "Prefer SNAP-GRD"),
            (joint & rtc_all, "Prefer RTC"),
            (joint, "Mixed / inconclusive"),
            (sar & snap_all, "SNAP-GRD stronger overall"),
            (sar & rtc_all, "RTC stronger overall"),
            (sar, "Very close / mixed"),
            (snap, "SNAP-GRD stronger overall"),
            (rtc, "RTC stronger overall"),
        ],
        "Mixed / inconclusive",
    )
    return g.withColumn("decision", decision)


def separability_decision(delta_knn: Column, delta_silhouette: Column, min_delta: float = 1e-4) -> Column:
    return first_true(
        [
            (delta_knn > min_delta, "RTC stronger separability"),
            (delta_knn < -min_delta, "SNAP-GRD stronger separability"),
            (delta_silhouette > min_delta, "Near tie by kNN, RTC higher label silhouette"),
            (delta_silhouette < -min_delta, "Near tie by kNN, SNAP-GRD higher label silhouette"),
        ],
        "Near tie / mixed",
    )


def named_winner(delta: Column, min_delta: float = 1e-4) -> Column:
    return first_true([(delta > min_delta, "RTC"), (delta < -min_delta, "SNAP-GRD")], "Mixed")


# Names of the two comparisons in the evidence table.
PRETTY = {"sar_only_rtc_vs_snap": "SAR-only RTC vs SNAP-GRD", "joint_rtc_vs_snap": "Joint S2+S1 RTC vs SNAP-GRD"}


def pretty(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in PRETTY.items() for x in kv])
    return F.coalesce(names[c], c)


def _evidence(df: DataFrame, rank: int, comparison: Column, kind: Column, snap: Column, rtc: Column, delta: Column, winner: Column) -> DataFrame:
    num = lambda x: x.cast("double")
    return df.select(
        F.lit(f"Criterion {rank}").alias("criterion"), F.lit(rank).alias("criterion_rank"), comparison.alias("comparison"), kind.alias("evidence_type"),
        num(snap).alias("snap_value"), num(rtc).alias("rtc_value"), num(delta).alias("delta"), winner.alias("winner"),
    )


def evidence(decisions: DataFrame, primary: DataFrame, consistency: DataFrame, separability: DataFrame, min_delta: float = 1e-4) -> DataFrame:
    """Evidence rows of the three criteria: probes, optical-radar consistency, separability."""
    c, lit = F.col, F.lit
    w = lambda d: named_winner(c(d), min_delta)
    parts = [
        _evidence(decisions, 1, pretty(c("comparison")), lit("overall_decision"), c("snap_higher"), c("rtc_higher"), c("mean_delta"), winner_from_text(c("decision"))),
        _evidence(
            primary, 1, pretty(c("comparison")), F.concat_ws("_", lit("average_precision"), c("fold_mode"), c("probe")),
            c("snap_mean"), c("rtc_mean"), c("delta"), w("delta"),
        ),
        _evidence(
            consistency.where(c("group_type").isin("overall", "label_binary", "region")), 2, lit("Optical-radar consistency"),
            F.concat_ws("_", "group_type", "group_value"), c("snap_mean"), c("rtc_mean"), c("delta_mean"), w("delta_mean"),
        ),
        _evidence(separability, 3, pretty(c("comparison")), lit("kNN_average_precision_mean"), c("snap_knn"), c("rtc_knn"), c("delta_knn"), w("delta_knn")),
        _evidence(separability, 3, pretty(c("comparison")), lit("label_silhouette"), c("snap_sil"), c("rtc_sil"), c("delta_sil"), w("delta_sil")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommend(rows: DataFrame) -> DataFrame:
    """Recommendation and confidence per comparison: the probe decision first, then separability, then the votes."""
    c, kind = F.col, F.col("evidence_type")
    pick = lambda r, k: F.coalesce(F.max(F.when((c("criterion_rank") == r) & (kind == k), c("winner"))), F.lit("Mixed"))
    votes = {v: F.count_if(c("winner") == v) for v in ("SNAP-GRD", "RTC", "Mixed")}
    g = rows.where(c("comparison").isin(*PRETTY.values())).groupBy("comparison").agg(
        pick(1, "overall_decision").alias("criterion1_winner"), pick(3, "kNN_average_precision_mean").alias("criterion3_winner"),
        votes["SNAP-GRD"].alias("snap_votes"), votes["RTC"].alias("rtc_votes"), votes["Mixed"].alias("mixed_votes"),
    )
    one, three = c("criterion1_winner"), c("criterion3_winner")
    rec = first_true(
        [
            (one == "SNAP-GRD", "Prefer SNAP-GRD"), (one == "RTC", "Prefer RTC"), (three == "SNAP-GRD", "Lean SNAP-GRD"), (three == "RTC", "Lean RTC"),
            (c("snap_votes") > c("rtc_votes"), "Lean SNAP-GRD"), (c("rtc_votes") > c("snap_votes"), "Lean RTC"),
        ],
        "Inconclusive",
    )
    prefer = F.startswith(rec, F.lit("Prefer"))
    confidence = first_true(
        [(prefer & (one == three), "high"), (prefer, "medium"), (F.startswith(rec, F.lit("Lean")), "low-to-medium")], "low"
    )
    return g.withColumns({"recommendation": rec, "confidence": confidence})


def recommend_overall(by_comparison: DataFrame, rows: DataFrame) -> DataFrame:
    """One final row: the joint comparison decides, then the radar-only one, then the votes of all evidence."""
    c = F.col
    at = lambda k, col: F.max(F.when(c("comparison") == PRETTY[k], c(col)))
    recs = by_comparison.agg(at("joint_rtc_vs_snap", "recommendation").alias("joint"), at("sar_only_rtc_vs_snap", "recommendation").alias("sar"), F.lit(1).alias("_one"))
    two = F.coalesce(F.max(F.when((c("criterion_rank") == 2) & (c("evidence_type") == "overall_all_patches"), c("winner"))), F.lit("Mixed"))
    votes = rows.agg(F.count_if(c("winner") == "SNAP-GRD").alias("s"), F.count_if(c("winner") == "RTC").alias("r"), two.alias("c2"), F.lit(1).alias("_one"))
    final = first_true(
        [
            (c("joint") == "Prefer SNAP-GRD", "SNAP-GRD"), (c("joint") == "Prefer RTC", "RTC"), (c("sar") == "Prefer SNAP-GRD", "SNAP-GRD"),
            (c("sar") == "Prefer RTC", "RTC"), (c("s") > c("r"), "SNAP-GRD"), (c("r") > c("s"), "RTC"),
        ],
        "Inconclusive",
    )
    agree = (c("joint") == "Prefer SNAP-GRD") & F.contains(c("sar"), F.lit("SNAP-GRD")) & (c("c2") == "SNAP-GRD")
    confidence = first_true([((final == "SNAP-GRD") & agree, "high"), (final == "SNAP-GRD", "medium-to-high"), (final == "RTC", "medium")], "low")
    return recs.join(votes, "_one").select(final.alias("final_recommendation"), confidence.alias("confidence"))


def sar_tables(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main table, variant table) from one row per product and band (mean, std, quartiles, shares, reference)."""
    c = F.col
    flag = c("plausibility_flag")
    text = first_true(
        [(flag == "broadly_plausible", "Broadly plausible"), (c("product") == "RTC", "Shifted high-tail distribution; inspect before primary use")],
        "Distribution requires inspection",
    )
    main = stats.withColumns(
        {"iqr": c("p75") - c("p25"), "mean_difference": c("mean") - c("ref_mean"), "std_ratio": c("std") / c("ref_std"), "interpretation": text}
    )
    at = lambda p, col: F.max(F.when(c("product") == p, c(col)))
    wide = stats.groupBy("band").agg(
        *[at(p, col).alias(f"{s}_{col}") for col in ("mean", "p50", "std", "db_gt_10_pct") for p, s in (("SNAP-GRD", "snap"), ("RTC", "rtc"))]
    )
    delta, gt10 = c("rtc_mean") - c("snap_mean"), c("rtc_db_gt_10_pct") - c("snap_db_gt_10_pct")
    variant = wide.withColumns(
        {
            "mean_delta": delta, "median_delta": c("rtc_p50") - c("snap_p50"), "std_ratio": c("rtc_std") / c("snap_std"), "gt10_delta": gt10,
            "interpretation": F.when((delta > 5) | (gt10 > 5), "RTC much brighter with a larger high tail").otherwise("broadly similar"),
        }
    )
    return main, variant


def feature_decision(arrays: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """What the stored arrays (modality, file, role) of each wanted modality allow: dense features, global vectors only, or neither."""
    dense = dense_usable(F.col("role"))
    any_of = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    found = arrays.groupBy(F.col("modality").alias("target_modality")).agg(
        F.count_distinct("file").alias("target_files"), any_of(F.col("role") == "global_patch_embedding").alias("has_global_embedding"),
        any_of(F.col("role").startswith("dense_token")).alias("has_dense_tokens"), any_of(F.col("role").startswith("dense_feature_map")).alias("has_dense_feature_map"), any_of(dense).alias("has_usable_features"),
    )
    everywhere = arrays.agg(any_of(dense).alias("any_file_has_usable_features"), F.lit(1).alias("_one"))
    wanted = arrays.sparkSession.createDataFrame([(m, 1) for m in modalities], "target_modality string, _one int")
    j = wanted.join(everywhere, "_one").join(found, "target_modality", "left").drop("_one")
    flags = ("has_global_embedding", "has_dense_tokens", "has_dense_feature_map", "has_usable_features")
    j = j.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {"target_files": F.coalesce("target_files", F.lit(0))})
    advice = first_true(feature_advice(F.col("target_files"), F.col("has_usable_features"), F.col("has_global_embedding")), "manual_inspection_needed")
    return j.withColumns({"recommendation": advice, "can_proceed": (F.col("target_files") > 0) & F.col("has_usable_features")})


def feature_advice(files: Column, usable: Column, whole: Column) -> list[tuple[Column, str]]:
    """The recommendations, in the order in which they apply."""
    return [(files == 0, "target_modality_file_missing"), (usable, "dense_features_available"), (whole, "global_only_extract_dense_features_next")]
