"""Record layouts. Every operator takes and returns DataFrames with these columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,bigint>": T.MapType(T.StringType(), T.LongType()),
}


def layout(text: str) -> T.StructType:
    """A schema from ``name type, …``; unlike DDL parsing it needs no running session."""
    pairs = (column.split(" ") for column in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FLOW = layout(
    "sensor_id string, timestamp timestamp, source_ip string, destination_ip string, "
    "source_port int, destination_port int, protocol string, direction string, "
    "packet_count bigint, total_bytes bigint, payload_hash string, last_payload_hash string, "
    "payload_prefix_hash string, payload_length int, payload_entropy double, "
    "payload_printable_ratio double, payload_simhash string, payload_feature_version string, "
    "tls_fingerprint string, certificate_fingerprint string, domain string, "
    "packet_sizes array<int>, attack_target_ip string, duration_seconds double, "
    "tcp_flags map<string,bigint>, tcp_flags_observed boolean, tcp_syn_count bigint, "
    "tcp_ack_count bigint, tcp_rst_count bigint, tcp_syn_only_count bigint, "
    "tcp_syn_ack_count bigint, tcp_ack_only_count bigint, bidirectional boolean"
)

# Values used where a record leaves an optional field out.
FLOW_DEFAULTS = {
    "protocol": "",
    "direction": "UNKNOWN",
    "packet_count": 1,
    "total_bytes": 0,
    "duration_seconds": 0.0,
    "tcp_flags_observed": False,
    "tcp_syn_count": 0,
    "tcp_ack_count": 0,
    "tcp_rst_count": 0,
    "tcp_syn_only_count": 0,
    "tcp_syn_ack_count": 0,
    "tcp_ack_only_count": 0,
    "bidirectional": False,
}

EVIDENCE = layout(
    "candidate_ip string, type string, detector string, version string, evidence_key string, "
    "raw_score double, contribution double, description string, min_host string, "
    "max_host string, sensors array<string>, first_seen timestamp, last_seen timestamp, "
    "sample_count bigint, public_dns_ntp boolean, cdn_cloud boolean, match_mode string, "
    "metrics string, confidence double, warnings array<string>"
)

SENSITIVE_FIELDS = ("raw_packet_hex", "payload_sample_hex", "raw_packet_bytes")

SIGNATURE = layout(
    "id string, name string, version int, enabled boolean, protocol string, direction string, "
    "service_port int, payload_hash string, payload_prefix_hash string, payload_length int, "
    "payload_entropy double, payload_printable_ratio double, payload_simhash string, "
    "payload_feature_version string, length_tolerance_ratio double, entropy_tolerance double, "
    "simhash_max_distance int"
)

ALLOWLIST = layout(
    "type string, value string, description string, expires_at string, enabled boolean"
)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project onto ``schema``: cast what is there, fill what is not; other columns are kept."""
    defaults = defaults or {}
    have = set(df.columns)
    cols: list[Column] = []
    for f in schema:
        col = F.col(f.name) if f.name in have else F.lit(None)
        col = col.cast(f.dataType)
        if f.name in defaults:
            col = F.coalesce(col, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(col.alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in set(schema.names)]
    return df.select(*cols, *extra)


def as_flows(df: DataFrame) -> DataFrame:
    """Flow rows with defaults, an exact microsecond clock and never-null packet sizes."""
    out = conform(df, FLOW, FLOW_DEFAULTS)
    if "ts_us" not in out.columns:
        out = out.withColumn("ts_us", F.unix_micros("timestamp"))
    return out.withColumn(
        "packet_sizes", F.coalesce("packet_sizes", F.lit([]).cast("array<int>"))
    )


def strip_sensitive(df: DataFrame) -> DataFrame:
    """Drop raw packet bytes and payload samples before analysis or labelling."""
    return df.drop(*SENSITIVE_FIELDS)
