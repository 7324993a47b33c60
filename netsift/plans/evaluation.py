"""Quality of verdicts and policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.ranking import with_position

from netsift.functions.stats import exact_quantile

POSITIVE = ("LIKELY_C2", "SUSPICIOUS")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4), F.lit(0.0))


def evaluate(cases: DataFrame, by: str = "model_profile") -> DataFrame:
    """Confusion counts, precision, recall, F1, Brier score, safety rates and latency per model."""
    positive = F.col("predicted_verdict").isin(*POSITIVE)
    bad = F.col("expected_malicious")
    chance = F.when(F.col("predicted_verdict") == "LIKELY_BENIGN", 1 - F.col("confidence")).otherwise(
        F.col("confidence")
    )
    miss = chance - bad.cast("double")
    totals = cases.groupBy(by).agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(bad & positive).alias("true_positive"),
        F.count_if(~bad & positive).alias("false_positive"),
        F.count_if(~bad & ~positive).alias("true_negative"),
        F.count_if(bad & ~positive).alias("false_negative"),
        F.round(F.avg(miss * miss), 4).alias("brier_score"),
        F.count_if("evidence_valid").alias("__valid"),
        F.count_if("unsafe_recommendation").alias("__unsafe"),
        F.sum("input_tokens").alias("input_tokens_total"),
        F.sum("output_tokens").alias("output_tokens_total"),
        F.round(F.sum("estimated_cost_usd"), 6).alias("estimated_cost_usd"),
    )
    for name, p in (("latency_ms_p50", 0.5), ("latency_ms_p95", 0.95)):
        at = exact_quantile(cases, [by], "latency_ms", p, name)
        totals = totals.join(at.withColumn(name, F.round(name, 2)), by)
    tp = F.col("true_positive")
    precision, recall = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.round(F.try_divide(2 * precision * recall, precision + recall), 4), F.lit(0.0))
    return (
        totals.withColumn("precision", _ratio(tp, tp + F.col("false_positive")))
        .withColumn("recall", _ratio(tp, tp + F.col("false_negative")))
        .withColumn("f1", f1)
        .withColumn("evidence_valid_rate", _ratio(F.col("__valid"), F.col("case_count")))
        .withColumn("unsafe_recommendation_rate", _ratio(F.col("__unsafe"), F.col("case_count")))
        .drop("__valid", "__unsafe")
    )


def rank_models(reports: DataFrame) -> DataFrame:
    """Models ordered by recall, safe output, valid evidence, F1, then latency and name.

    There is one report per model, so the order runs over a handful of rows.
    """
    order = Window.orderBy(
        F.desc("recall"),
        "unsafe_recommendation_rate",
        F.desc("evidence_valid_rate"),
        F.desc("f1"),
        "latency_ms_p95",
        "model_profile",
    )
    return reports.withColumn("position", F.row_number().over(order)).withColumn(
        "recommended", F.col("position") == 1
    )


def recall_at_k(ranked: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """Recall and precision among the top k peers, and how much the top k reduces the list."""
    top = ranked.orderBy(F.desc("prefilter_score"), "candidate_ip").limit(k)
    found = top.join(known.select("candidate_ip").distinct(), "candidate_ip", "left_semi")
    peers = ranked.agg(F.count(F.lit(1)).alias("peer_count"))
    one = lambda df: df.agg(F.count(F.lit(1)).alias("c")).scalar()
    hits, bad = one(found), one(known.select("candidate_ip").distinct())
    shown = F.least(F.lit(k), F.col("peer_count"))
    return peers.select(
        _ratio(hits, bad).alias("recall_at_k"),
        _ratio(hits, shown).alias("precision_at_k"),
        F.round(1 - shown / F.col("peer_count"), 4).alias("candidate_reduction_ratio"),
        "peer_count",
    )


def known_ranks(ranked: DataFrame, known: DataFrame) -> DataFrame:
    """The rank of every known peer: one plus the peers before it by score, then address."""
    numbered = with_position(
        ranked.select("candidate_ip", "prefilter_score"), [F.desc("prefilter_score"), "candidate_ip"], "rank"
    )
    return numbered.join(known.select("candidate_ip").distinct(), "candidate_ip", "left_semi").select(
        "candidate_ip", "prefilter_score", "rank"
    )


@dataclass(frozen=True)
class Policy:
    name: str
    cap: int | None = None
    strong_cap: int | None = None
    penalty: int | None = None


# The three policies under comparison.
POLICIES = (
    Policy("cap-20", cap=20),
    Policy("strong-evidence-cap-40", cap=20, strong_cap=40),
    Policy("fixed-penalty-25", penalty=25),
)


def policy_score(policy: Policy) -> Column:
    raw = F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw_score").cast("int")))
    if policy.penalty is not None:
        return F.greatest(F.lit(0), raw - policy.penalty)
    cap = F.lit(policy.cap)
    if policy.strong_cap is not None:
        cap = F.when(F.col("strong_evidence"), policy.strong_cap).otherwise(cap)
    return F.coalesce(F.least(raw, cap), raw)


def backtest(cases: DataFrame, policies=POLICIES, threshold: int = 40) -> DataFrame:
    """Recall, false-positive rate and queue size per policy over affected cases.

    Policies are literals: each case is read once and scored under all of them.
    """
    affected = F.col("high_volume") & ~F.col("analyst_exact_match")
    rows = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), policy_score(p).alias("score"))
            for p in policies
        ]
    )
    scored = cases.withColumn("affected", affected).select("*", F.inline(rows))
    seen = F.col("affected") & (F.col("score") >= threshold)
    bad = F.col("label") == "C2"
    return (
        scored.groupBy("policy")
        .agg(
            F.count_if("affected").alias("evaluated_case_count"),
            F.count_if(~F.col("affected")).alias("exempt_case_count"),
            F.count_if(seen & bad).alias("true_positive"),
            F.count_if(seen & ~bad).alias("false_positive"),
            F.count_if(F.col("affected") & bad).alias("__bad"),
            F.count_if(F.col("affected") & ~bad).alias("__good"),
            F.count_if(seen).alias("analyst_queue_visible"),
        )
        .withColumn("recall", _ratio(F.col("true_positive"), F.col("__bad")))
        .withColumn("false_positive_rate", _ratio(F.col("false_positive"), F.col("__good")))
        .withColumn("triage_threshold", F.lit(threshold))
        .drop("__bad", "__good")
    )
