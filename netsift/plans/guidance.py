"""Why a flow was or was not detected, and which weights would change that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.params import MAX_DETECTOR_WEIGHT, WEIGHT_STEPS, Params
from netsift.plans.scoring import cap_of, detector_weight, score_candidates


def conditions(evidence: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The share of its capped type score that each piece of evidence carries."""
    same = Window.partitionBy("candidate_ip", "type")
    plain = F.greatest(F.lit(0.0), F.col("contribution"))
    cap = cap_of(F.col("type"))
    total, weighted = F.sum(plain).over(same), F.sum(plain * F.col("__w")).over(same)
    rows = evidence.withColumn("__w", detector_weight(weights)).withColumns(
        {"__total": total, "__weighted": weighted}
    )
    score = F.least(
        cap * MAX_DETECTOR_WEIGHT,
        F.least(cap, F.col("__total")) * F.try_divide(F.col("__weighted"), F.col("__total")),
    )
    applied = F.coalesce(score * F.try_divide(plain, F.col("__total")), F.lit(0.0))
    return rows.select(
        "candidate_ip",
        F.col("type").alias("evidence_type"),
        "detector",
        "description",
        "raw_score",
        "contribution",
        F.col("__w").alias("current_weight"),
        F.round(applied, 2).alias("weighted_contribution"),
        "metrics",
    )


def weight_search(
    evidence: DataFrame, profiles: DataFrame | None, p: Params, minimum_score: int
) -> DataFrame:
    """Per candidate and detector, the smallest larger weight that reaches the minimum score.

    Weights act on scoring only, so no detector runs again: evidence is repeated per scenario
    (at most detectors × steps for one candidate) and all scenarios are scored in one plan.
    """
    pairs = evidence.select("candidate_ip", F.col("detector").alias("changed")).distinct()
    steps = F.array(*[F.lit(float(s)) for s in WEIGHT_STEPS])
    current = detector_weight(p.detector_weights)
    scenarios = (
        pairs.withColumn("detector", F.col("changed"))
        .withColumn("current_value", current)
        .withColumn("step", F.explode(steps))
        .filter(F.col("step") > F.col("current_value"))
        .drop("detector")
    )
    replayed = evidence.join(scenarios, "candidate_ip")
    weight = F.when(F.col("detector") == F.col("changed"), F.col("step")).otherwise(current)
    scored = score_candidates(
        replayed, profiles, p, weight=weight, by=("changed", "current_value", "step")
    )
    now = score_candidates(evidence, profiles, p).select(
        "candidate_ip", F.col("score").alias("current_score")
    )
    best = F.min_by(F.col("score"), F.col("step"))
    return (
        scored.filter(F.col("score") >= minimum_score)
        .groupBy("candidate_ip", F.col("changed").alias("detector"), "current_value")
        .agg(F.min("step").alias("recommended_value"), best.alias("projected_score"))
        .join(now, "candidate_ip")
        .select(
            "candidate_ip",
            "detector",
            "current_value",
            "recommended_value",
            "projected_score",
            (F.col("projected_score") - F.col("current_score")).alias("score_gain"),
            F.when(F.col("recommended_value") <= 1.5, "MEDIUM").otherwise("HIGH").alias("risk"),
        )
    )


def guidance(
    flows: DataFrame,
    scored: DataFrame,
    allowed: DataFrame,
    searches: DataFrame,
    minimum_score: int,
) -> DataFrame:
    """The decision for each reviewed flow (flow_id, external_ip, payload_hash).

    ``scored`` are candidates without suppression, ``allowed`` the suppressed candidate addresses,
    ``searches`` the result of ``weight_search``.
    """
    order = F.struct(
        F.col("recommended_value") - F.col("current_value"), -F.col("projected_score"), "detector"
    )
    best = searches.groupBy("candidate_ip").agg(
        F.min_by(F.struct("detector", "recommended_value", "projected_score"), order).alias("best")
    )
    table = (
        flows.select("flow_id", F.col("external_ip").alias("candidate_ip"), "payload_hash")
        .filter(F.col("candidate_ip").isNotNull())
        .join(scored.select("candidate_ip", "score"), "candidate_ip", "left")
        .join(allowed.select("candidate_ip", F.lit(True).alias("listed")), "candidate_ip", "left")
        .join(best, "candidate_ip", "left")
    )
    score = F.coalesce("score", F.lit(0))
    found = F.col("score").isNotNull()
    suppressed = found & F.coalesce("listed", F.lit(False))
    below = found & (score < minimum_score)
    kind = (
        F.when(suppressed, "POLICY_REVIEW")
        .when(below & F.col("best").isNotNull(), "DETECTOR_WEIGHT")
        .when(below & (score > 0), "MINIMUM_SCORE")
        .when(found, F.lit(None))
        .when(F.coalesce(F.col("payload_hash"), F.lit("")) != "", "PAYLOAD_SIGNATURE")
        .otherwise("NEW_DETECTOR_CONDITION")
    )
    return table.select(
        "flow_id",
        "candidate_ip",
        (found & ~suppressed & (score >= minimum_score)).alias("initially_detected"),
        suppressed.alias("suppressed_by_policy"),
        score.alias("current_score"),
        F.lit(minimum_score).alias("minimum_candidate_score"),
        F.greatest(F.lit(0), minimum_score - score).alias("score_gap"),
        kind.alias("recommendation"),
        F.when(kind == "DETECTOR_WEIGHT", F.col("best.detector")).alias("detector"),
        F.when(kind == "DETECTOR_WEIGHT", F.col("best.recommended_value")).alias(
            "recommended_weight"
        ),
        F.when(kind == "MINIMUM_SCORE", score).otherwise(F.lit(minimum_score)).alias(
            "recommended_minimum_score"
        ),
    )
