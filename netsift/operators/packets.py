"""Packets: duplicates across sensors, aggregation into flows, caps and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.ranking import with_position
from netsift.operators.timeline import sessions
from netsift.schema import FLOW, FLOW_DEFAULTS, conform

IDENTITY = [
    "source_ip",
    "destination_ip",
    "source_port",
    "destination_port",
    "protocol",
    "ip_id",
    "tcp_sequence",
    "payload_length",
    "payload_hash",
]
TCP_COUNTERS = (
    "tcp_syn_count",
    "tcp_ack_count",
    "tcp_rst_count",
    "tcp_syn_only_count",
    "tcp_syn_ack_count",
    "tcp_ack_only_count",
)
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")


def packet_fingerprint(bucket_ms: int = 10) -> Column:
    bucket = F.floor(F.floor(F.col("ts_us") / 1000) / bucket_ms)
    # A value starts with "=", so a missing one differs from an empty one.
    parts = [
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in IDENTITY
    ]
    return F.sha2(F.concat_ws("|", *parts, bucket.cast("string")), 256)


def fingerprinted(observations: DataFrame, bucket_ms: int = 10) -> DataFrame:
    """Every observation with the fingerprint of its logical packet; none is dropped."""
    return observations.withColumn("fingerprint", packet_fingerprint(bucket_ms))


def logical_packets(observations: DataFrame, bucket_ms: int = 10) -> DataFrame:
    """One row per logical packet with how often and by how many sensors it was seen.

    Observations stay in ``fingerprinted``; a list of them per packet would have no bound.
    """
    return (
        fingerprinted(observations, bucket_ms)
        .groupBy("fingerprint")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.count_distinct("sensor_id").alias("sensors"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
        )
        .withColumn("logical_count", F.lit(1))
    )


FLOW_KEY = [
    "sensor_id",
    "direction",
    "ip_version",
    "source_ip",
    "destination_ip",
    "source_port",
    "destination_port",
    "protocol",
]


def packets_to_flows(packets: DataFrame, idle_seconds: int = 60) -> DataFrame:
    """Aggregate packets into flows; a pause of ``idle_seconds`` or more starts a new flow.

    Sessions are built from pieces per time chunk (see ``sessions``), so a key with a large share of
    the packets is spread out.
    """
    null_port = {c: F.coalesce(c, F.lit(-1)) for c in ("source_port", "destination_port")}
    rows = packets.withColumns(null_port)
    has = F.coalesce(F.col("payload_hash"), F.lit("")) != ""
    features = [
        "payload_hash",
        "payload_prefix_hash",
        "payload_length",
        "payload_entropy",
        "payload_printable_ratio",
        "payload_simhash",
        "payload_feature_version",
    ]
    meta = ["domain", "tls_fingerprint", "certificate_fingerprint"]
    known_meta = F.coalesce(*meta).isNotNull()
    timed = lambda cond, cols: F.when(cond, F.struct("ts_us", "packet_index", *cols))
    flag = lambda f: F.coalesce(F.element_at("tcp_flags", F.lit(f)), F.lit(0))
    syn, ack, rst = flag("syn") > 0, flag("ack") > 0, flag("rst") > 0
    payload = F.coalesce("payload_length", F.lit(0))
    aggregates = {
        "packet_count": (F.count(F.lit(1)), "sum"),
        "total_bytes": (F.sum("total_bytes"), "sum"),
        "min_size": (F.min("total_bytes"), "min"),
        "max_size": (F.max("total_bytes"), "max"),
        "min_payload": (F.min(payload), "min"),
        "max_payload": (F.max(payload), "max"),
        "sum_payload": (F.sum(payload), "sum"),
        "first": (F.min(timed(has, features)), "min"),
        "last": (F.max(timed(has, ["payload_hash"])), "max"),
        "meta": (F.max(timed(known_meta, meta)), "max"),
        **{f"n_{f}": (F.sum(flag(f)), "sum") for f in FLAGS},
        "tcp_syn_only_count": (F.count_if(syn & ~ack & ~rst), "sum"),
        "tcp_syn_ack_count": (F.count_if(syn & ack & ~rst), "sum"),
        "tcp_ack_only_count": (F.count_if(ack & ~syn & ~rst), "sum"),
    }
    out = sessions(
        rows, FLOW_KEY, aggregates, idle_us=idle_seconds * 1_000_000, split_at_equal=True
    ).withColumnRenamed("first_us", "ts_us")
    sizes = F.when(F.col("min_size") == F.col("max_size"), F.array("min_size")).otherwise(
        F.array("min_size", "max_size")
    )
    real_port = lambda c: F.nullif(F.col(c), F.lit(-1))
    return out.select(
        *[c for c in FLOW_KEY if not c.endswith("_port")],
        real_port("source_port").alias("source_port"),
        real_port("destination_port").alias("destination_port"),
        F.timestamp_micros("ts_us").alias("timestamp"),
        "ts_us",
        "end_us",
        ((F.col("end_us") - F.col("ts_us")) / 1e6).alias("duration_seconds"),
        "packet_count",
        "total_bytes",
        sizes.cast("array<int>").alias("packet_sizes"),
        (F.col("total_bytes") / F.col("packet_count")).alias("avg_packet_size"),
        "min_payload",
        "max_payload",
        (F.col("sum_payload") / F.col("packet_count")).alias("avg_payload"),
        *[F.col(f"first.{c}") for c in features],
        F.col("last.payload_hash").alias("last_payload_hash"),
        *[F.col(f"meta.{c}") for c in meta],
        F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.col(f"n_{f}"))]).alias("tcp_flags"),
        (F.col("protocol") == "TCP").alias("tcp_flags_observed"),
        F.col("n_syn").alias("tcp_syn_count"),
        F.col("n_ack").alias("tcp_ack_count"),
        F.col("n_rst").alias("tcp_rst_count"),
        "tcp_syn_only_count",
        "tcp_syn_ack_count",
        "tcp_ack_only_count",
        F.when(F.col("n_ack") > 0, F.nullif(F.col("n_syn"), F.lit(0)) / F.col("n_ack")).alias(
            "syn_ack_ratio"
        ),
        (F.col("n_rst") / F.col("packet_count")).alias("rst_ratio"),
        F.nullif(F.col("n_syn"), F.lit(0)).alias("connection_count"),
    )


def mark_bidirectional(flows: DataFrame, idle_seconds: int = 60) -> DataFrame:
    """Flag flows that have a reverse flow active at the same time at the same sensor.

    A flow stays active for the idle time after its last packet. Starts and ends of the two
    directions of one conversation meet in an equi join on the conversation and an hour slot.
    """
    slot_us = 3600 * 1_000_000
    idle = idle_seconds * 1_000_000
    flip = (
        F.when(F.col("direction") == "INBOUND", "OUTBOUND")
        .when(F.col("direction") == "OUTBOUND", "INBOUND")
        .otherwise(F.col("direction"))
    )
    port = lambda c: F.coalesce(F.col(c), F.lit(-1))
    key = ["sensor_id", "ip_version", "protocol", "d", "a", "ap", "b", "bp", "slot"]
    slots = F.explode(
        F.sequence(F.floor(F.col("ts_us") / slot_us), F.floor((F.col("end_us") + idle) / slot_us))
    )
    mine = flows.select(
        "sensor_id", "ip_version", "protocol", F.col("direction").alias("d"),
        F.col("source_ip").alias("a"), port("source_port").alias("ap"),
        F.col("destination_ip").alias("b"), port("destination_port").alias("bp"),
        F.col("ts_us").alias("t0"), F.col("end_us").alias("t1"), slots.alias("slot"),
    )
    other = flows.select(
        "sensor_id", "ip_version", "protocol", flip.alias("d"),
        F.col("destination_ip").alias("a"), port("destination_port").alias("ap"),
        F.col("source_ip").alias("b"), port("source_port").alias("bp"),
        F.col("ts_us").alias("u0"), F.col("end_us").alias("u1"), slots.alias("slot"),
    )
    # A packet of either flow arrives while the other is active.
    meets = (F.col("u0") < F.col("t1") + idle) & (F.col("t0") < F.col("u1") + idle)
    # A flow is known by its whole key and start; a hash of them could flag another flow.
    whole = ["sensor_id", "ip_version", "protocol", "d", "a", "ap", "b", "bp", "t0"]
    paired = mine.join(other, key).filter(meets).select(*[F.col(c).alias(f"__{c}") for c in whole])
    named = {"d": F.col("direction"), "a": F.col("source_ip"), "ap": port("source_port"),
             "b": F.col("destination_ip"), "bp": port("destination_port"), "t0": F.col("ts_us")}
    same = [named.get(c, F.col(c)) == F.col(f"__{c}") for c in whole]
    marked = flows.drop("bidirectional").join(
        paired.distinct().withColumn("__both", F.lit(True)), same, "left"
    )
    return marked.withColumn("bidirectional", F.coalesce("__both", F.lit(False))).drop(
        "__both", *[f"__{c}" for c in whole]
    )


def minute_flows(records: DataFrame) -> DataFrame:
    """Coalesce records per host, destination, port and minute."""
    return records.groupBy(
        "source_ip", "destination_ip", "destination_port", F.window("timestamp", "60 seconds").alias("w")
    ).agg(
        F.min("timestamp").alias("timestamp"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.min_by("total_bytes", "timestamp").alias("first_size"),
    ).drop("w")


LEVELS = (12, 24, 44)


def running_total(df: DataFrame, value: Column, position: str, out: str) -> DataFrame:
    """Running sum along a unique BIGINT position without a single-task window.

    Positions are cut into nested ranges of 2^12, 2^24 and 2^44. Sums of ranges are cumulated
    inside the next larger range, so a window sees at most 4,096 rows on the lower levels and one
    row per 2^44 positions at the top.
    """
    names = [f"__r{bits}" for bits in LEVELS]
    at = {n: F.shiftright(F.col(position).cast("bigint"), bits) for n, bits in zip(names, LEVELS)}
    rows = df.withColumn("__v", value).withColumns(at)
    inside = lambda keys, order: (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: rows.groupBy(*names[i:]).agg(F.sum("__v").alias("__s")) for i, n in enumerate(names)}
    base = None
    for i in reversed(range(len(names))):
        upper = names[i + 1 :]
        own = F.coalesce(F.sum("__s").over(before(inside(upper, names[i]))), F.lit(0))
        level = sums[names[i]].withColumn("__own", own).drop("__s")
        if base is not None:
            level = level.join(base, upper).withColumn("__own", F.col("__own") + F.col("__base"))
            level = level.drop("__base")
        base = level.withColumnRenamed("__own", "__base")
    running = F.sum("__v").over(
        inside(names, position).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(base, names)
        .withColumn(out, running + F.col("__base"))
        .drop("__v", "__base", *names)
    )


def limit_packets(flows: DataFrame, limit: int | None, position: str) -> DataFrame:
    """Keep rows in order until ``limit`` packets; the row on the border is cut in proportion.

    Counters of a cut row are cleared because its packets are no longer known.
    """
    if limit is None or limit <= 0:
        return flows
    packets = F.when(F.coalesce("packet_count", F.lit(0)) > 0, F.col("packet_count")).otherwise(1)
    rows = running_total(flows, packets.cast("bigint"), position, "__cum")
    before = F.col("__cum") - packets
    cut = F.col("__cum") > limit
    left = F.lit(limit) - before
    size = F.greatest(F.coalesce("total_bytes", F.lit(0)), F.lit(0))
    share = F.floor(size * left / packets)
    observed = cut & F.coalesce("tcp_flags_observed", F.lit(False))
    changes = {
        "packet_count": F.when(cut, left).otherwise(F.col("packet_count")),
        "total_bytes": F.when(cut, share).otherwise(F.col("total_bytes")).cast("bigint"),
        "bidirectional": F.when(observed, F.lit(False)).otherwise(F.col("bidirectional")),
        **{c: F.when(observed, 0).otherwise(F.col(c)) for c in TCP_COUNTERS},
    }
    if "tcp_flags" in flows.columns:
        emptied = F.map_filter("tcp_flags", lambda k, v: ~k.isin(*FLAGS))
        changes["tcp_flags"] = F.when(cut, emptied).otherwise(F.col("tcp_flags"))
    return rows.filter(before < limit).withColumns(changes).drop("__cum")


def limit_summary(flows: DataFrame, limit: int | None) -> DataFrame:
    packets = F.when(F.coalesce("packet_count", F.lit(0)) > 0, F.col("packet_count")).otherwise(1)
    seen = F.col("observed_packets")
    kept = F.least(seen, F.lit(limit)) if limit and limit > 0 else seen
    return flows.agg(F.coalesce(F.sum(packets), F.lit(0)).alias("observed_packets")).select(
        F.lit(limit or 0).alias("configured_max_packets"),
        "observed_packets",
        kept.alias("retained_packets"),
        (seen - kept).alias("discarded_packets"),
    )


def quota_allocation(sensors: DataFrame, limit: int) -> DataFrame:
    """Split a packet limit over the sensors of a run; the first ones by name get the remainder."""
    names = with_position(sensors.select("sensor_id").distinct(), ["sensor_id"], "__i")
    count = names.agg(F.count(F.lit(1)).alias("c")).scalar()
    share = F.floor(F.lit(limit) / F.col("__n"))
    more = F.when(F.col("__i") <= F.lit(limit) % F.col("__n"), 1).otherwise(0)
    return names.withColumn("__n", count).select("sensor_id", (share + more).alias("quota"))


PACKET_HEADER = 16
FILE_HEADER = 24


def export_packets(packets: DataFrame, max_bytes: int | None) -> DataFrame:
    """The longest prefix in (source_order, packet_index) whose serialized size fits."""
    if max_bytes is None:
        return packets
    if max_bytes < FILE_HEADER:
        raise ValueError("the output limit is too small for the file header")
    size = (F.lit(PACKET_HEADER) + F.col("captured_length")).cast("bigint")
    place = F.shiftleft(F.col("source_order").cast("bigint"), 32) + F.col("packet_index")
    sized = running_total(packets.withColumn("__pos", place), size, "__pos", "serialized_bytes")
    return sized.filter(F.col("serialized_bytes") + FILE_HEADER <= max_bytes).drop("__pos")


def export_stats(packets: DataFrame, exported: DataFrame) -> DataFrame:
    one = lambda df: df.agg(F.count(F.lit(1)).alias("c")).scalar()
    done = F.col("exported_packet_count")
    return (
        packets.agg(F.count(F.lit(1)).alias("matched_packet_count"))
        .withColumn("exported_packet_count", one(exported))
        .withColumn("omitted_packet_count", F.col("matched_packet_count") - done)
        .withColumn("truncated", F.col("omitted_packet_count") > 0)
        .withColumn(
            "truncation_reasons",
            F.when(F.col("truncated"), F.array(F.lit("OUTPUT_BYTE_LIMIT"))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )


def validate_flows(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split flow records into valid rows and rejected rows with their ``problems``."""
    rows = flagged_flows(flows)
    return rows.filter(F.size("problems") == 0).drop("problems"), rows.filter(F.size("problems") > 0)


def flagged_flows(flows: DataFrame) -> DataFrame:
    rows = conform(flows, FLOW, FLOW_DEFAULTS)
    hex_of = lambda c, n: F.col(c).rlike(f"^[0-9a-f]{{{n}}}$")
    counters = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in TCP_COUNTERS])
    observed = F.col("tcp_flags_observed")
    checks = {
        "sensor_id": F.col("sensor_id").isNotNull(),
        "timestamp": F.col("timestamp").isNotNull(),
        "source_port": F.col("source_port").isNull() | F.col("source_port").between(0, 65535),
        "destination_port": F.col("destination_port").isNull()
        | F.col("destination_port").between(0, 65535),
        "direction": F.col("direction").isin("INBOUND", "OUTBOUND", "BIDIRECTIONAL", "UNKNOWN"),
        "packet_count": F.col("packet_count") >= 1,
        "total_bytes": F.col("total_bytes") >= 0,
        "negative_counter": F.least(*[F.col(c) for c in TCP_COUNTERS]) >= 0,
        "last_payload_hash": F.col("last_payload_hash").isNull() | hex_of("last_payload_hash", 64),
        "payload_prefix_hash": F.col("payload_prefix_hash").isNull()
        | hex_of("payload_prefix_hash", 64),
        "payload_simhash": F.col("payload_simhash").isNull() | hex_of("payload_simhash", 16),
        "payload_feature_version": F.col("payload_feature_version").isNull()
        | F.col("payload_feature_version").rlike("^[0-9]{1,8}$"),
        "payload_length": F.col("payload_length").isNull() | (F.col("payload_length") >= 0),
        "payload_entropy": F.col("payload_entropy").isNull() | F.col("payload_entropy").between(0, 8),
        "payload_printable_ratio": F.col("payload_printable_ratio").isNull()
        | F.col("payload_printable_ratio").between(0, 1),
        "tcp_flags": F.col("tcp_flags").isNull()
        | ~F.exists(F.map_values("tcp_flags"), lambda v: v.isNull() | (v < 0)),
        "counters_without_observation": observed | (counters == 0),
        "observed_not_tcp": ~observed | (F.upper("protocol") == "TCP"),
        "syn_counters": F.col("tcp_syn_only_count") + F.col("tcp_syn_ack_count")
        <= F.col("tcp_syn_count"),
        "ack_counters": F.col("tcp_syn_ack_count") + F.col("tcp_ack_only_count")
        <= F.col("tcp_ack_count"),
    }
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return rows.withColumn("problems", F.array_compact(F.array(*bad)))
