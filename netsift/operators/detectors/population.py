"""Candidates that stand out from the population of one analysis in a beacon-like direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.stats import exact_quantile
from netsift.operators.evidence import evidence
from netsift.operators.features import share, size_cv
from netsift.params import Params

# The direction in which each feature speaks for a beacon.
DIRECTIONS = {
    "interval_cv": "LOW",
    "size_cv": "LOW",
    "payload_stability": "HIGH",
    "port_stability": "HIGH",
    "fingerprint_stability": "HIGH",
    "domain_diversity_ratio": "LOW",
}
MAD_TO_SIGMA = 1.4826


def feature_vectors(features: DataFrame, p: Params) -> DataFrame:
    """Six features per candidate with enough rows; missing telemetry stays null."""
    known = lambda part, whole: F.when(F.col(whole) > 0, share(part, whole))
    return features.filter(F.col("n") >= max(3, p.ml_anomaly_min_candidate_samples)).withColumns(
        {
            "f_interval_cv": F.col("mean_host_cv"),
            "f_size_cv": size_cv(positive=True),
            "f_payload_stability": known("hash_max", "hash_n"),
            "f_port_stability": known("port_max", "port_n"),
            "f_fingerprint_stability": known("print_max", "print_n"),
            "f_domain_diversity_ratio": known("dnorm_distinct", "dnorm_n"),
        }
    )


def long_features(vectors: DataFrame) -> DataFrame:
    pairs = [
        F.struct(F.lit(k).alias("feature"), F.col(f"f_{k}").cast("double").alias("value"))
        for k in DIRECTIONS
    ]
    return vectors.select("candidate_ip", F.inline(F.array(*pairs))).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def robust_baselines(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and scale per key: 1.4826·MAD, or the population deviation where the MAD vanishes."""
    center = exact_quantile(values, keys, value, 0.5, "center")
    spread = values.groupBy(*keys).agg(
        F.stddev_pop(value).alias("__sd"), F.count(F.lit(1)).alias("population")
    )
    off = values.join(center, keys).withColumn("__dev", F.abs(F.col(value) - F.col("center")))
    mad = exact_quantile(off, keys, "__dev", 0.5, "__mad")
    scale = F.when(F.col("__mad") > 1e-9, MAD_TO_SIGMA * F.col("__mad")).otherwise(F.col("__sd"))
    return (
        center.join(mad, keys)
        .join(spread, keys)
        .select(*keys, "center", scale.alias("scale"), "population")
    )


def population_anomaly(features: DataFrame, p: Params, table=lambda df, name: df) -> DataFrame:
    """Evidence of the anomaly detector; ``table`` may store the feature values read repeatedly."""
    minimum = max(8, p.ml_anomaly_min_population)
    floor = max(0.0, p.ml_anomaly_feature_z_floor)
    threshold = max(2.0, p.ml_anomaly_z_threshold)
    wanted = max(1, min(len(DIRECTIONS), p.ml_anomaly_min_directional_features))
    cap = max(0.0, min(5.0, p.ml_anomaly_contribution_cap))
    vectors = feature_vectors(features, p)
    values = table(long_features(vectors), "feature-values")
    baselines = table(
        robust_baselines(values, ["feature"], "value").filter(
            (F.col("population") >= max(8, minimum // 2)) & (F.col("scale") > 1e-9)
        ),
        "baselines",
    )
    size = vectors.agg(F.count(F.lit(1)).alias("c")).scalar()
    usable = baselines.agg(F.count(F.lit(1)).alias("c")).scalar()
    low = F.col("feature").isin(*[k for k, d in DIRECTIONS.items() if d == "LOW"])
    raw = (F.col("value") - F.col("center")) / F.col("scale")
    item = F.struct(
        "feature", F.col("raw").alias("raw_z"), F.col("z"), F.col("population").alias("population")
    )
    scored = (
        values.join(baselines, "feature")
        .withColumn("raw", raw)
        .withColumn("z", F.when(low, -F.col("raw")).otherwise(F.col("raw")))
        .groupBy("candidate_ip")
        .agg(
            F.count_if(F.col("z") >= floor).alias("contributors"),
            F.sqrt(F.sum(F.when(F.col("z") >= floor, F.col("z") * F.col("z")))).alias("score"),
            F.count(F.lit(1)).alias("available"),
            F.sort_array(F.collect_list(item)).alias("items"),  # at most six
        )
        .filter((F.col("contributors") >= wanted) & (F.col("score") >= threshold))
    )
    hits = (
        vectors.join(scored, "candidate_ip")
        .withColumn("population_size", size)
        .filter((F.col("population_size") >= minimum) & (usable >= wanted))
    )
    as_map = lambda f: F.map_from_entries(
        F.transform("items", lambda x: F.struct(x["feature"], f(x)))
    )
    ranked = F.sort_array(
        F.transform(
            F.filter("items", lambda x: x["z"] >= floor),
            lambda x: F.struct(
                F.round(x["z"], 4).alias("directional_z_score"), x["feature"].alias("feature")
            ),
        ),
        asc=False,
    )
    metrics = {
        "anomaly_score": F.round("score", 4),
        "z_threshold": threshold,
        "feature_z_floor": floor,
        "population_size": F.col("population_size"),
        "minimum_feature_population": max(8, minimum // 2),
        "available_feature_count": F.col("available"),
        "directional_feature_count": F.col("contributors"),
        "feature_vector": F.struct(*[F.round(f"f_{k}", 4).alias(k) for k in DIRECTIONS]),
        "raw_z_scores": as_map(lambda x: F.round(x["raw_z"], 4)),
        "directional_z_scores": as_map(lambda x: F.round(F.greatest(x["z"], F.lit(0.0)), 4)),
        "baseline_population": as_map(lambda x: x["population"]),
        "top_contributing_features": F.slice(ranked, 1, 3),
        "sample_count": F.col("n"),
    }
    row = evidence(
        "ML_POPULATION_ANOMALY",
        "ml_population_anomaly",
        F.least(F.lit(cap), F.greatest(F.lit(0.0), 1 + 2 * (F.col("score") - threshold))),
        metrics,
        "the mix of beacon-like features is unusual among the candidates of this analysis",
        confidence=F.least(F.lit(0.7), 0.45 + 0.05 * F.col("contributors")),
        warnings=("unsupervised_no_ground_truth", "population_relative_signal"),
    )
    return hits.select(F.inline(F.array(row)))
