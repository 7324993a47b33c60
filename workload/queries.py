"""The registered queries: each one runs an engine operator over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.params import Params
from netsift.plans.context import AnalysisContext
from netsift.plans.detection import detect, run_detectors
from netsift.plans.scoring import score_candidates
from workload.tables import flows, time_span

_CONTEXTS: dict[tuple[str, str], AnalysisContext] = {}

PARAMS = Params(
    cdn_domain_suffixes=("cdn.example.com",),
    trusted_dns_servers=("192.0.2.53",),
    ml_anomaly_enabled=True,
)


def signatures(scoped: DataFrame) -> DataFrame:
    """Signatures derived from the flows: the most frequent payload per protocol and direction."""
    counts = (
        scoped.filter(F.col("payload_hash").isNotNull())
        .groupBy("protocol", "direction", "payload_hash")
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.min("payload_prefix_hash").alias("payload_prefix_hash"),
            F.min("payload_length").alias("payload_length"),
            F.min("payload_entropy").alias("payload_entropy"),
            F.min("payload_simhash").alias("payload_simhash"),
        )
    )
    order = F.struct((-F.col("c")).alias("c"), F.col("payload_hash"))
    top = counts.groupBy("protocol", "direction").agg(F.min_by(F.struct("*"), order).alias("v"))
    features = ["payload_prefix_hash", "payload_length", "payload_entropy", "payload_simhash"]
    rows = top.select("protocol", "direction", "v.payload_hash", *[f"v.{c}" for c in features])
    kinds = F.explode(F.array(F.lit("exact"), F.lit("alike")))
    return rows.withColumn("kind", kinds).select(
        F.concat_ws("-", "kind", "protocol", "direction").alias("id"),
        F.lit(True).alias("enabled"),
        "protocol",
        "direction",
        F.when(F.col("kind") == "exact", F.col("payload_hash")).alias("payload_hash"),
        *features,
    )


def context(spark: SparkSession, sf_dir: str, fresh: bool = False) -> AnalysisContext:
    """The analysis over all flows; its shared tables are built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _CONTEXTS:
        ctx = AnalysisContext(flows(spark, sf_dir), PARAMS, *time_span(spark, sf_dir))
        ctx.signatures = signatures(ctx.scoped)
        if fresh:
            return ctx
        _CONTEXTS[key] = ctx
    return _CONTEXTS[key]


def us(col: str, name: str | None = None):
    return F.unix_micros(col).alias(name or col)


def evidence_columns(df: DataFrame, metrics: dict[str, int] | None = None, *more: str) -> DataFrame:
    metric = lambda m, d: F.round(
        F.get_json_object("metrics", f"$.{m}").cast("double"), d
    ).alias(m)
    return df.select(
        "candidate_ip",
        F.round("contribution", 6).alias("contribution"),
        "sample_count",
        us("first_seen", "first_us"),
        us("last_seen", "last_us"),
        "min_host",
        "max_host",
        F.size("sensors").alias("n_sensors"),
        *[metric(m, d) for m, d in (metrics or {}).items()],
        *more,
    )


DETECTOR_QUERIES = {
    "d_common_destination": (
        "common_destination",
        dict.fromkeys(
            ["distinct_hosts", "connections_per_host", "duration_seconds", "dominant_port_ratio",
             "fingerprint_ratio", "distinct_domains"], 6),
        ("public_dns_ntp", "cdn_cloud"),
    ),
    "d_non_well_known_port": (
        "non_well_known_port",
        {"non_well_known_ratio": 4, "observed_flow_count": 6, "dominant_port": 6,
         "dominant_port_ratio": 6},
        (),
    ),
    "d_periodic_beacon": (
        "periodic_beacon",
        dict.fromkeys(
            ["period_seconds", "coefficient_of_variation", "matching_hosts", "size_similarity"], 6),
        (),
    ),
    "d_single_host_beacon": (
        "single_host_composite_beacon",
        dict.fromkeys(
            ["period_seconds", "coefficient_of_variation", "payload_stability", "average_packets"],
            6),
        (),
    ),
    "d_payload_signature": ("analyst_payload_signature", {}, ("evidence_key", "match_mode")),
    "d_synchronized": (
        "synchronized_communication",
        dict.fromkeys(["synchronized_hosts", "repetition_count", "observed_spread"], 6),
        (),
    ),
    "d_command_attack": (
        "command_attack_correlation",
        dict.fromkeys(["command_size", "affected_hosts", "increase_ratio", "target_port"], 6),
        (),
    ),
    "d_persistence": (
        "persistence_rarity",
        dict.fromkeys(["duration_seconds", "average_packets", "rarity"], 6),
        (),
    ),
    "d_similarity": (
        "protocol_similarity",
        dict.fromkeys(["dominant_feature_ratio", "domain_diversity"], 6),
        (),
    ),
    "d_multi_sensor": (
        "multi_sensor_context",
        dict.fromkeys(["distinct_sensors", "independent_hosts"], 6),
        (),
    ),
    "d_anomaly": (
        "ml_population_anomaly",
        {"anomaly_score": 4, "directional_feature_count": 6, "population_size": 6},
        (),
    ),
    "d_tcp_quality": (
        "tcp_session_quality",
        dict.fromkeys(
            ["outbound_initiated_connections", "established_connections",
             "qualified_tcp_connections", "scan_suppressed_connections"], 6),
        (),
    ),
}


def detector_query(key: str):
    name, metrics, more = DETECTOR_QUERIES[key]
    return lambda spark, sf: evidence_columns(detect(context(spark, sf), name), metrics, *more)


def evidence_table(ctx: AnalysisContext) -> DataFrame:
    """All evidence of the analysis, stored once: scoring and review read it many times."""
    if "evidence" not in ctx.__dict__:
        ctx.__dict__["evidence"] = run_detectors(ctx)
    return ctx.__dict__["evidence"]


def scored_table(ctx: AnalysisContext) -> DataFrame:
    if "candidates" not in ctx.__dict__:
        scored = score_candidates(evidence_table(ctx), ctx.profile, ctx.params)
        ctx.__dict__["candidates"] = ctx._table(scored, "candidates")
    return ctx.__dict__["candidates"]


def candidate_scores(ctx: AnalysisContext) -> DataFrame:
    return scored_table(ctx).select(
        "candidate_ip",
        "score",
        "severity",
        F.round("base_score", 6).alias("base_score"),
        "evidence_count",
        "min_host",
        "max_host",
        us("first_seen", "first_us"),
        us("last_seen", "last_us"),
    )


def gated_rows(ctx: AnalysisContext) -> DataFrame:
    return ctx.gated.groupBy("candidate_ip", "protocol").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_bytes").alias("bytes"),
        F.count_distinct("host_ip").alias("hosts"),
    )


def tcp_profiles(ctx: AnalysisContext) -> DataFrame:
    return ctx.judged.select(
        "sensor_id", "candidate_ip", "host_ip", "internal_key", "service_key", "row_count",
        "total_packets", "metadata_available", "internally_initiated", "established", "qualified",
        "suppressed", "kept",
    )


def evidence_union(ctx: AnalysisContext) -> DataFrame:
    return evidence_table(ctx).select(
        "candidate_ip",
        "type",
        "detector",
        F.round("contribution", 6).alias("contribution"),
        "sample_count",
        us("first_seen", "first_us"),
        us("last_seen", "last_us"),
    )


def queries() -> dict:
    from workload.queries_more import more_queries

    on = lambda fn: lambda spark, sf: fn(context(spark, sf))
    out = {
        "candidate_orientation": on(
            lambda c: c.oriented.select(
                "flow_no", "candidate_ip", "host_ip", "service_port", "internal_port",
                "norm_direction",
            )
        ),
        "tcp_profiles": on(tcp_profiles),
        "gated_rows": on(gated_rows),
        "traffic_profile": on(lambda c: c.profile),
        "evidence_union": on(evidence_union),
        "candidate_scores": on(candidate_scores),
        **{k: detector_query(k) for k in DETECTOR_QUERIES},
    }
    out.update(more_queries())
    return out
