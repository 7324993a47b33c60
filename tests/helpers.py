"""Small flow sets and a plain-Python model of the rules."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from netsift.schema import as_flows

T0 = datetime(2026, 1, 1, tzinfo=UTC)
FIELDS = {
    "sensor_id": "s1",
    "source_ip": "10.0.0.1",
    "destination_ip": "203.0.113.5",
    "source_port": 40000,
    "destination_port": 443,
    "protocol": "UDP",
    "direction": "OUTBOUND",
    "packet_count": 1,
    "total_bytes": 100,
    "payload_hash": None,
    "last_payload_hash": None,
    "payload_prefix_hash": None,
    "payload_length": None,
    "payload_entropy": None,
    "payload_simhash": None,
    "payload_feature_version": None,
    "domain": None,
    "packet_sizes": None,
    "duration_seconds": 0.0,
    "tcp_flags_observed": False,
    "tcp_syn_count": 0,
    "tcp_ack_count": 0,
    "tcp_syn_only_count": 0,
    "tcp_syn_ack_count": 0,
    "tcp_ack_only_count": 0,
    "bidirectional": False,
}
DDL = (
    "sensor_id string, source_ip string, destination_ip string, source_port int, "
    "destination_port int, protocol string, direction string, packet_count bigint, "
    "total_bytes bigint, payload_hash string, last_payload_hash string, payload_prefix_hash string, "
    "payload_length int, payload_entropy double, payload_simhash string, "
    "payload_feature_version string, domain string, packet_sizes array<int>, "
    "duration_seconds double, tcp_flags_observed boolean, tcp_syn_count bigint, "
    "tcp_ack_count bigint, tcp_syn_only_count bigint, tcp_syn_ack_count bigint, "
    "tcp_ack_only_count bigint, bidirectional boolean, timestamp timestamp"
)


def flow(at: float = 0.0, **changes) -> dict:
    return {**FIELDS, **changes, "timestamp": T0 + timedelta(seconds=at)}


def frame(spark, rows: list[dict]):
    names = [*FIELDS, "timestamp"]
    return as_flows(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], DDL))
