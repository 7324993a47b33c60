"""Flow review: filters, decoration, labels and the signatures made from them."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.net import all_of, any_of, ip_in_cidrs, ip_version
from netsift.operators.roles import role_columns
from netsift.params import PRIVATE_NETWORKS

# Fields of the flow identity, in the order of canonical JSON keys.
FLOW_ID_FIELDS = (
    "destination_ip",
    "destination_port",
    "direction",
    "job_id",
    "packet_count",
    "payload_hash",
    "protocol",
    "sensor_id",
    "source_ip",
    "source_port",
    "timestamp",
    "total_bytes",
)
DIRECTIONS = ("INBOUND", "OUTBOUND", "BIDIRECTIONAL", "UNKNOWN")
CONDITIONS = (
    "candidate_ip",
    "direction",
    "protocol",
    "port",
    "source_port",
    "destination_port",
    "has_payload",
)


def iso_timestamp(col: str = "timestamp") -> Column:
    """UTC ISO-8601 text; the fraction is left out when it is zero."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(col) % 1_000_000
    fraction = F.when(micros == 0, "").otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))


def flow_id(job_id: str) -> Column:
    """The first 24 hex digits of SHA-256 over the canonical JSON of a flow."""
    values = {"timestamp": iso_timestamp(), "job_id": F.lit(job_id)}
    fields = [values.get(f, F.col(f)).alias(f) for f in FLOW_ID_FIELDS]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.left(F.sha2(text, 256), F.lit(24))


def decorate(
    flows: DataFrame,
    job_id: str,
    cidrs: Iterable[str] = PRIVATE_NETWORKS,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Add identity, endpoint roles, how the role was found, payload flag and current label."""
    stated = F.upper("direction").isin("OUTBOUND", "INBOUND")
    out = (
        role_columns(flows, cidrs)
        .withColumns(
            {
                "flow_id": flow_id(job_id),
                "job_id": F.lit(job_id),
                "role_source": F.when(stated, "DIRECTION").when(
                    F.col("norm_direction").isNotNull(), "CIDR_FALLBACK"
                ),
                "has_payload": F.coalesce(F.col("payload_hash"), F.lit("")) != "",
            }
        )
        .withColumnsRenamed({"candidate_ip": "external_ip", "host_ip": "internal_ip"})
        .drop("norm_direction", "internal_port")
    )
    if labels is None:
        return out
    current = latest(labels, ["flow_id"]).select("flow_id", F.col("verdict").alias("current_label"))
    return out.join(current, "flow_id", "left")


def _condition(group: dict) -> Column:
    if not group or set(group) - set(CONDITIONS):
        raise ValueError("a flow filter needs supported conditions")
    text = {k: str(group.get(k) or "").strip() for k in ("candidate_ip", "direction", "protocol")}
    tests: list[Column] = []
    if text["candidate_ip"]:
        cidr = str(ipaddress.ip_network(text["candidate_ip"], strict=False))
        tests.append(ip_in_cidrs("source_ip", [cidr]) | ip_in_cidrs("destination_ip", [cidr]))
    if text["direction"]:
        if text["direction"].upper() not in DIRECTIONS:
            raise ValueError("unsupported flow direction")
        tests.append(F.upper("direction") == text["direction"].upper())
    if text["protocol"]:
        if len(text["protocol"]) > 32:
            raise ValueError("flow protocol is too long")
        tests.append(F.upper("protocol") == text["protocol"].upper())
    for key, col in (
        ("port", "service_port"),
        ("source_port", "source_port"),
        ("destination_port", "destination_port"),
    ):
        value = group.get(key)
        if value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= 65535:
            raise ValueError("a flow port lies between 0 and 65535")
        tests.append(F.col(col) == value)
    wanted = group.get("has_payload")
    if wanted is not None:
        if not isinstance(wanted, bool):
            raise ValueError("has_payload must be boolean")
        tests.append(F.col("has_payload") == wanted)
    if not tests:
        raise ValueError("a flow filter needs an active condition")
    return all_of(F.coalesce(t, F.lit(False)) for t in tests)


def group_predicate(includes: Iterable[dict] = (), excludes: Iterable[dict] = ()) -> Column:
    """(no includes or any include matches) and no exclude matches."""
    inc = [_condition(g) for g in includes or ()]
    exc = [_condition(g) for g in excludes or ()]
    return (any_of(inc) if inc else F.lit(True)) & ~any_of(exc)


def filter_flows(
    decorated: DataFrame,
    includes: Iterable[dict] = (),
    excludes: Iterable[dict] = (),
    exclude_matches: bool = False,
    **scalar: object,
) -> DataFrame:
    """Decorated flows passing the filter groups; scalar conditions form one more group.

    Rows come unordered; ``flow_page`` orders the page that is shown.
    """
    scalar = {
        k: v for k, v in scalar.items() if v is not None and not (isinstance(v, str) and not v.strip())
    }
    if exclude_matches and not scalar:
        raise ValueError("at least one exclusion condition is required")
    includes, excludes = list(includes or ()), list(excludes or ())
    if scalar:
        (excludes if exclude_matches else includes).append(scalar)
    return decorated.filter(group_predicate(includes, excludes))


def filter_packets(
    packets: DataFrame,
    includes: Iterable[dict] = (),
    excludes: Iterable[dict] = (),
    cidrs: Iterable[str] = ("0.0.0.0/0", "::/0"),
) -> DataFrame:
    """The same groups on packet rows, which come back as they were."""
    keep = packets.columns
    roles = role_columns(packets, cidrs).withColumn(
        "has_payload", F.coalesce(F.col("payload_hash"), F.lit("")) != ""
    )
    return roles.filter(group_predicate(includes, excludes)).select(*keep)


def filter_records(
    df: DataFrame,
    candidate_ip: str | None = None,
    internal_host_ip: str | None = None,
    start_time: str | None = None,
    end_time: str | None = None,
    port: int | None = None,
    protocol: str | None = None,
    direction: str | None = None,
    sensor_id: str | None = None,
) -> DataFrame:
    """Plain record filter. Direction and sensor are compared with their case."""
    for value in (candidate_ip, internal_host_ip):
        if value is not None:
            df = df.filter((F.col("source_ip") == value) | (F.col("destination_ip") == value))
    if start_time:
        df = df.filter(F.col("timestamp") >= F.lit(start_time).cast("timestamp"))
    if end_time:
        df = df.filter(F.col("timestamp") <= F.lit(end_time).cast("timestamp"))
    if port is not None:
        df = df.filter((F.col("source_port") == port) | (F.col("destination_port") == port))
    if protocol:
        df = df.filter(F.upper("protocol") == protocol.upper())
    if direction:
        df = df.filter(F.col("direction") == direction)
    return df.filter(F.col("sensor_id") == sensor_id) if sensor_id else df


def capture_filter(
    source_cidrs: Iterable[str] = (),
    destination_cidrs: Iterable[str] = (),
    source_ports: Iterable[int] = (),
    destination_ports: Iterable[int] = (),
    protocols: Iterable[str] = (),
    ip_versions: Iterable[int] = (),
    directions: Iterable[str] = (),
) -> Column:
    """All non-empty lists must match."""
    one_of = lambda col, values: F.coalesce(col.isin(*values), F.lit(False))
    tests = []
    if source_cidrs:
        tests.append(ip_in_cidrs("source_ip", source_cidrs))
    if destination_cidrs:
        tests.append(ip_in_cidrs("destination_ip", destination_cidrs))
    for col, values in (
        (F.col("source_port"), source_ports),
        (F.col("destination_port"), destination_ports),
        (F.col("protocol"), protocols),
        (ip_version(), ip_versions),
        (F.col("direction"), directions),
    ):
        if values:
            tests.append(one_of(col, list(values)))
    return all_of(tests)


def latest(df: DataFrame, keys: list[str], ts: str = "created_at") -> DataFrame:
    """The newest row per key, by time and then by id when there is one.

    ``max_by`` combines on the map side, so a key with a long history is not gathered.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, "id") if "id" in df.columns else F.struct(ts)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(
        *keys, "__v.*"
    )


def newest(df: DataFrame, keys: list[str], fields: list[str], ts: str = "created_at") -> DataFrame:
    """``fields`` of the newest row per key, by time and then by id.

    Time, id and fields are one maximum, so nothing else of a row is sorted or shuffled."""
    rest = [c for c in fields if c != "id"]
    return df.groupBy(*keys).agg(F.max(F.struct(ts, "id", *rest)).alias("__v")).select(
        *keys, *[F.col(f"__v.{c}") for c in fields]
    )


def history(df: DataFrame, key: str, fields: list[str], ts: str = "created_at") -> DataFrame:
    """Position of every entry in its history, as rows (newest last)."""
    order = Window.partitionBy(key).orderBy(ts, "id")
    return df.select(key, ts, *fields, F.row_number().over(order).alias("position"))


def label_page(decorated: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One page ordered by time and flow id."""
    if page < 1 or not 1 <= size <= 200:
        raise ValueError("a page holds 1 to 200 rows and pages start at 1")
    return decorated.orderBy("timestamp", "flow_id").offset((page - 1) * size).limit(size)


def signature_conflicts(labels: DataFrame, keys: tuple[str, str] = ("job_id", "flow_id")) -> DataFrame:
    """Payload hashes whose latest label somewhere is BENIGN."""
    newest = latest(labels, list(keys))
    return (
        newest.filter(F.col("verdict") == "BENIGN")
        .filter(F.col("payload_hash").isNotNull())
        .select("payload_hash")
        .distinct()
    )


def signatures_from_labels(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Signature rows for C2 labels: needs a payload hash and no BENIGN conflict.

    ``requests`` are labelled decorated flows (label ``id``, payload features, protocol, direction,
    service port). Returns one signature row per accepted request.
    """
    usable = requests.filter((F.col("verdict") == "C2") & F.col("payload_hash").isNotNull())
    accepted = usable.join(signature_conflicts(labels), "payload_hash", "left_anti")
    name = F.concat(F.coalesce("protocol", F.lit("payload")), F.lit(" "), F.left("payload_hash", F.lit(12)))
    return accepted.select(
        F.concat(F.lit("sig-"), F.col("id")).alias("id"),
        name.alias("name"),
        F.lit(1).alias("version"),
        F.lit(True).alias("enabled"),
        F.col("id").alias("source_label_id"),
        F.col("flow_id").alias("source_flow_id"),
        "protocol",
        "direction",
        "service_port",
        "payload_hash",
        "payload_prefix_hash",
        "payload_length",
        "payload_entropy",
        "payload_printable_ratio",
        "payload_simhash",
        "payload_feature_version",
        F.lit(0.15).alias("length_tolerance_ratio"),
        F.lit(0.75).alias("entropy_tolerance"),
        F.lit(8).alias("simhash_max_distance"),
    )


def parse_iso(col: Column | str) -> Column:
    """ISO-8601 text to TIMESTAMP: ``Z`` and offsets are read, text without one is UTC."""
    return F.try_to_timestamp(F.col(col) if isinstance(col, str) else col)


def validate_range(start: str, end: str) -> None:
    if datetime.fromisoformat(end) <= datetime.fromisoformat(start):
        raise ValueError("end must be after start")
