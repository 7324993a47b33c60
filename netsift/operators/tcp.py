"""TCP connection profiles, scan suppression and the gating of rows by connection quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.params import Params

# A missing port is a value of its own in a connection key.
CONNECTION = ["sensor_id", "candidate_ip", "host_ip", "internal_key", "service_key"]


def _keyed(oriented: DataFrame) -> DataFrame:
    return oriented.withColumns(
        {
            "internal_key": F.coalesce("internal_port", F.lit(-1)),
            "service_key": F.coalesce("service_port", F.lit(-1)),
        }
    )


def _is_tcp():
    return F.upper("protocol") == "TCP"


def tcp_profiles(oriented: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per connection with its counters, its predicates and whether its rows are kept."""
    out, inb = F.col("norm_direction") == "OUTBOUND", F.col("norm_direction") == "INBOUND"
    payload = (F.coalesce(F.col("payload_hash"), F.lit("")) != "") | (
        F.coalesce("payload_length", F.lit(0)) > 0
    )
    sides = {"outbound": out, "inbound": inb}
    counters = [
        F.sum(F.when(side, F.greatest(F.col(f"tcp_{c}_count"), F.lit(0))).otherwise(0)).alias(
            f"{name}_{c}"
        )
        for name, side in sides.items()
        for c in ("syn_only", "syn_ack", "ack_only", "rst")
    ]
    profiles = (
        _keyed(oriented.filter(_is_tcp()))
        .groupBy(*CONNECTION)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.max("tcp_flags_observed").alias("metadata_available"),
            F.max("bidirectional").alias("bidirectional"),
            F.sum(F.greatest(F.col("packet_count"), F.lit(0))).alias("total_packets"),
            *counters,
            *[F.max(side & payload).alias(f"{name}_payload") for name, side in sides.items()],
        )
    )
    n = lambda c: F.col(c) > 0
    handshake_out = n("outbound_syn_only") & n("inbound_syn_ack") & n("outbound_ack_only")
    handshake_in = n("inbound_syn_only") & n("outbound_syn_ack") & n("inbound_ack_only")
    midstream = n("outbound_ack_only") & n("inbound_ack_only")
    replied = F.col("bidirectional") & (
        (F.col("outbound_payload") & n("inbound_ack_only"))
        | (F.col("inbound_payload") & n("outbound_ack_only"))
        | (F.col("outbound_payload") & F.col("inbound_payload"))
    )
    meta = F.col("metadata_available")
    initiated, established = F.col("internally_initiated"), F.col("established")
    return (
        profiles.withColumn("internally_initiated", n("outbound_syn_only"))
        .withColumn("established", handshake_out | handshake_in | midstream | replied)
        .withColumns(
            {
                "qualified": initiated | established,
                "syn_unanswered": meta
                & initiated
                & (F.col("inbound_syn_ack") == 0)
                & (F.col("outbound_ack_only") == 0),
                "scan_like": meta & n("inbound_syn_only") & ~initiated & ~established,
                "connect_probe": meta
                & n("inbound_syn_only")
                & ~initiated
                & (F.col("total_packets") <= max(1, p.tcp_scan_probe_max_packets))
                & ~F.col("outbound_payload")
                & ~F.col("inbound_payload"),
            }
        )
    )


def judged_profiles(profiles: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``suppressed`` (probes of a scanning candidate) and ``kept`` (rows pass the gate)."""
    meta = F.col("metadata_available")
    if p.tcp_scan_suppression_enabled:
        probe = F.col("connect_probe")
        share = min(1.0, max(0.0, p.tcp_scan_probe_ratio))
        scanners = (
            profiles.filter(meta)
            .groupBy("candidate_ip")
            .agg(
                F.count_if(probe).alias("__probes"),
                F.count(F.lit(1)).alias("__observed"),
                F.count_distinct(F.when(probe, F.col("host_ip"))).alias("__targets"),
            )
            .filter(
                (F.col("__targets") >= max(2, p.tcp_scan_min_targets))
                & (F.col("__probes") / F.col("__observed") >= share)
            )
            .select("candidate_ip", F.lit(True).alias("__scanner"))
        )
        profiles = profiles.join(scanners, "candidate_ip", "left").withColumn(
            "suppressed", F.coalesce("__scanner", F.lit(False)) & probe
        ).drop("__scanner")
    else:
        profiles = profiles.withColumn("suppressed", F.lit(False))
    unanswered = F.lit(p.tcp_require_established_outbound) & F.col("syn_unanswered")
    passes = F.when(meta, F.col("qualified")).otherwise(F.lit(p.tcp_allow_legacy_without_flags))
    return profiles.withColumn("unanswered", unanswered).withColumn(
        "kept", ~F.col("suppressed") & ~unanswered & passes
    )


def gate(oriented: DataFrame, judged: DataFrame | None, p: Params = Params()) -> DataFrame:
    """Drop TCP rows of connections that are probes, unanswered or never became a session.

    Other protocols never enter the join, so they are not shuffled; a busy connection is on the
    streamed side of a semi join, which AQE may split.
    """
    if not p.tcp_session_gating_enabled:
        return oriented
    kept = judged.filter("kept").select(*CONNECTION)
    tcp = _keyed(oriented.filter(_is_tcp())).join(kept, CONNECTION, "left_semi")
    rest = oriented.filter(~_is_tcp())
    return rest.unionByName(tcp.select(*rest.columns))
