"""Detectors that are decided by the totals of one candidate.

Each returns a struct column over the feature table (null when it does not fire), so any number of
them is one pass over that table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift.functions.stats import ratio
from netsift.operators.evidence import evidence
from netsift.operators.features import share, size_cv
from netsift.params import Params


def _seconds() -> Column:
    return (F.col("last_us") - F.col("first_us")) / 1e6


def _average_packets() -> Column:
    return share("packets", "n")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _in(values: set[str]) -> Column:
    return F.col("candidate_ip").isin(*sorted(values)) if values else F.lit(False)


def common_destination(p: Params) -> Column:
    shared = set(p.public_dns_ntp_servers)
    only = lambda n: F.col("service_ports") == F.lit([n])
    listed = lambda name: F.coalesce(F.col(name), F.lit(False))
    trusted = ((_in(shared | set(p.trusted_dns_servers)) | listed("trusted_dns")) & only(53)) | (
        (_in(shared | set(p.trusted_ntp_servers)) | listed("trusted_ntp")) & only(123)
    )
    suffixes = sorted({s.lower().lstrip(".").rstrip(".") for s in p.cdn_domain_suffixes})
    suffix = F.coalesce(
        *[F.when(F.col(f"suffix_{i}"), F.lit(s)) for i, s in enumerate(suffixes)],
        F.lit(None).cast("string"),
    )
    hosts = F.col("hosts")
    minimum = p.minimum_distinct_clients
    points = F.least(F.lit(20.0), 10 + 10 * F.least(F.lit(1.0), hosts / minimum))
    metrics = {
        "distinct_hosts": hosts,
        "connections": F.col("n"),
        "distinct_sensors": F.size("sensors"),
        "duration_seconds": _seconds(),
        "connections_per_host": ratio(F.col("n"), hosts),
        "dominant_port_ratio": share("anyport_max", "n"),
        "fingerprint_ratio": _zero(share("hash_max", "n")),
        "sample_count": F.col("n"),
        "public_dns_ntp": trusted & ~F.col("any_non_udp"),
        "service_ports": F.col("service_ports"),
        "cdn_cloud": suffix.isNotNull() | _in(set(p.trusted_infrastructure_ips)),
        "distinct_domains": F.col("dnorm_distinct"),
        "trusted_cdn_suffix": suffix,
    }
    return F.when(
        hosts >= minimum,
        evidence(
            "COMMON_DESTINATION",
            "common_destination",
            points,
            metrics,
            "many internal hosts talk to one external destination",
        ),
    )


def non_well_known_port(p: Params) -> Column:
    part = share("odd_n", "with_port_n")
    fires = (F.col("odd_n") >= max(1, p.non_well_known_port_min_observations)) & (
        part >= max(0.0, min(1.0, p.non_well_known_port_min_ratio))
    )
    metrics = {
        "well_known_port_max": max(0, min(65535, p.well_known_port_max)),
        "non_well_known_ratio": F.round(part, 4),
        "observed_flow_count": F.col("with_port_n"),
        "sample_count": F.col("odd_n"),
        "service_ports": F.col("odd_ports"),
        "dominant_port": F.col("oddport_mode").cast("int"),
        "dominant_port_ratio": share("oddport_max", "odd_n"),
    }
    return F.when(
        fires,
        evidence(
            "NON_WELL_KNOWN_PORT",
            "non_well_known_port",
            F.least(F.lit(25.0), 15 + 10 * part),
            metrics,
            "the external endpoint keeps using a service port outside the well-known range",
            first="odd_first",
            last="odd_last",
            min_host="odd_min_host",
            max_host="odd_max_host",
            sensors="odd_sensors",
            confidence=0.6,
            warnings=("port_heuristic_only",),
        ),
    )


def single_host_beacon(p: Params) -> Column:
    cv, stable = F.col("lone_cv"), _zero(share("hash_max", "n"))
    spread = size_cv()
    fires = (
        (F.col("hosts") == 1)
        & (F.col("n") >= p.periodicity_min_samples)
        & (F.col("lone_mean") > 0)
        & (cv <= p.maximum_beacon_cv)
        & ((stable >= 0.60) | (F.coalesce(spread, F.lit(float("inf"))) <= 0.20))
        & (_average_packets() <= 10)
    )
    metrics = {
        "sample_count": F.col("n"),
        "period_seconds": F.round("lone_mean", 6),
        "coefficient_of_variation": cv,
        "payload_stability": stable,
        "size_coefficient_of_variation": spread,
        "average_packets": _average_packets(),
        "distinct_sensors": F.size("sensors"),
    }
    return F.when(
        fires,
        evidence(
            "SINGLE_HOST_BEACON",
            "single_host_composite_beacon",
            35,
            metrics,
            "one internal host shows periodic low-volume contact with stable payload or size",
            confidence=0.7,
        ),
    )


def persistence_rarity(p: Params) -> Column:
    fires = (
        (F.col("hosts") >= p.minimum_distinct_clients)
        & (_seconds() >= 300)
        & (_average_packets() <= 10)
    )
    metrics = {
        "duration_seconds": _seconds(),
        "average_packets": _average_packets(),
        "destination_stability": 1.0,
        "rarity": ratio(F.lit(1), F.greatest(F.lit(1), F.col("candidate_count"))),
        "sample_count": F.col("n"),
    }
    return F.when(
        fires,
        evidence(
            "LOW_VOLUME_PERSISTENCE_RARITY",
            "persistence_rarity",
            5,
            metrics,
            "low-volume contact stays stable over a long time",
        ),
    )


def protocol_similarity(p: Params) -> Column:
    part = share("shape_max", "n")
    fires = (
        (F.col("hosts") >= p.minimum_distinct_clients)
        & (part >= 0.6)
        & (F.col("draw_distinct") <= F.greatest(F.lit(3), F.col("hosts")))
    )
    metrics = {
        "dominant_feature_ratio": part,
        "domain_diversity": F.col("draw_distinct"),
        "sample_count": F.col("n"),
        "payload_hash": F.get_json_object("shape_mode", "$.payload_hash"),
    }
    return F.when(
        fires,
        evidence(
            "PROTOCOL_PAYLOAD_SIMILARITY",
            "protocol_similarity",
            10 * part,
            metrics,
            "the protocol and payload profile of several hosts is alike",
        ),
    )


def multi_sensor_context(p: Params) -> Column:
    metrics = {
        "distinct_sensors": F.col("strong_sensors"),
        "independent_hosts": F.col("independent_hosts"),
        "observation_count": F.col("n"),
        "timestamp_tolerance_seconds": 2,
        "sample_count": F.col("n"),
    }
    return F.when(
        F.col("strong_sensors") >= 2,
        evidence(
            "MULTI_SENSOR_CONTEXT",
            "multi_sensor_context",
            10,
            metrics,
            "several sensors reproduce the pattern with hosts of their own",
        ),
    )


PROFILE_DETECTORS = {
    "common_destination": common_destination,
    "non_well_known_port": non_well_known_port,
    "single_host_composite_beacon": single_host_beacon,
    "persistence_rarity": persistence_rarity,
    "protocol_similarity": protocol_similarity,
    "multi_sensor_context": multi_sensor_context,
}
