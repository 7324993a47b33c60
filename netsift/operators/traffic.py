"""Traffic volumes of candidates and their TCP sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.timeline import sessions
from netsift.params import Params

SESSION_KEY = ["sensor_id", "host_ip", "internal_key", "candidate_ip", "service_key"]


def tcp_sessions(oriented: DataFrame, p: Params = Params()) -> DataFrame:
    """Sessions of each connection: a gap above the idle time after the latest end splits."""
    end = F.col("ts_us") + F.greatest(F.col("duration_seconds"), F.lit(0.0)) * 1e6
    rows = (
        oriented.filter(F.upper("protocol") == "TCP")
        .withColumns(
            {
                "internal_key": F.coalesce("internal_port", F.lit(-1)),
                "service_key": F.coalesce("service_port", F.lit(-1)),
                "end_us": end.cast("bigint"),
            }
        )
        .select(*SESSION_KEY, "ts_us", "end_us", "packet_count", "total_bytes")
    )
    volume = lambda c: (F.sum(F.greatest(F.col(c), F.lit(0))), "sum")
    return sessions(
        rows,
        SESSION_KEY,
        {"packets": volume("packet_count"), "bytes": volume("total_bytes")},
        idle_us=max(1, int(p.tcp_session_idle_timeout_seconds)) * 1_000_000,
        end="end_us",
    )


def traffic_profile(oriented: DataFrame, p: Params = Params()) -> DataFrame:
    """Per candidate: flows, packets, bytes, TCP sessions and the largest session.

    Works on all scoped traffic, not only on gated rows. An empty last session is not counted.
    """
    volume = oriented.groupBy("candidate_ip").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum(F.greatest(F.col("packet_count"), F.lit(0))).alias("total_packets"),
        F.sum(F.greatest(F.col("total_bytes"), F.lit(0))).alias("total_bytes"),
    )
    last = F.max(F.struct("session_no", (F.col("packets") + F.col("bytes")).alias("load")))
    connections = (
        tcp_sessions(oriented, p)
        .groupBy(*SESSION_KEY)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.max("packets").alias("packets"),
            F.max("bytes").alias("bytes"),
            last.alias("last"),
        )
        .groupBy("candidate_ip")
        .agg(
            F.sum(F.col("sessions") - F.when(F.col("last.load") == 0, 1).otherwise(0)).alias("s"),
            F.max("packets").alias("mp"),
            F.max("bytes").alias("mb"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return volume.join(connections, "candidate_ip", "left").select(
        "candidate_ip",
        "flow_count",
        "total_packets",
        "total_bytes",
        zero("s").alias("tcp_session_count"),
        zero("mp").alias("max_tcp_session_packets"),
        zero("mb").alias("max_tcp_session_bytes"),
    )


def by_endpoint(flows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flows touching a candidate on either side, each once per candidate.

    The endpoints are exploded, so the match is an equi join and not an OR of two conditions.
    """
    ends = F.array_distinct(F.array("source_ip", "destination_ip"))
    return flows.withColumn("candidate_ip", F.explode(ends)).join(
        candidates.select("candidate_ip").distinct(), "candidate_ip"
    )


def candidate_ports(touching: DataFrame) -> DataFrame:
    own = F.when(
        F.col("destination_ip") == F.col("candidate_ip"), F.col("destination_port")
    ).otherwise(F.col("source_port"))
    return touching.withColumn("port", own)


def traffic_buckets(touching: DataFrame) -> DataFrame:
    """At most 24 equal-width time buckets per candidate; only buckets with flows are returned."""
    spans = touching.groupBy("candidate_ip").agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("rows"),
    )
    span = (F.col("last_us") - F.col("first_us")) / 1e6
    count = F.when(span == 0, 1).otherwise(F.least(F.lit(24), F.col("rows")))
    spans = spans.withColumn("n_buckets", count).withColumn(
        "width", F.greatest(F.lit(1.0), span / F.col("n_buckets"))
    )
    offset = (F.col("ts_us") - F.col("first_us")) / 1e6
    index = F.least(F.col("n_buckets") - 1, F.floor(offset / F.col("width")))
    start = F.col("first_us") + F.round(F.col("bucket") * F.col("width") * 1e6).cast("bigint")
    return (
        touching.select("candidate_ip", "ts_us", "packet_count", "total_bytes")
        .join(spans, "candidate_ip")
        .withColumn("bucket", index.cast("int"))
        .groupBy("candidate_ip", "bucket", "first_us", "width")
        .agg(
            F.sum(F.coalesce("packet_count", F.lit(0))).alias("packets"),
            F.sum(F.coalesce("total_bytes", F.lit(0))).alias("bytes"),
            F.count(F.lit(1)).alias("flows"),
        )
        .select(
            "candidate_ip",
            "bucket",
            F.timestamp_micros(start).alias("start"),
            "packets",
            "bytes",
            "flows",
        )
    )


def traffic_summary(touching: DataFrame) -> DataFrame:
    """Counts, protocols and ports per candidate (both value sets are bounded by their domain)."""
    return (
        candidate_ports(touching)
        .groupBy("candidate_ip")
        .agg(
            F.sort_array(F.collect_set(F.upper(F.nullif("protocol", F.lit(""))))).alias(
                "protocols"
            ),
            F.sort_array(F.collect_set("port")).alias("ports"),
            F.count(F.lit(1)).alias("flow_count"),
            F.sum(F.coalesce("packet_count", F.lit(0))).alias("packet_count"),
            F.sum(F.coalesce("total_bytes", F.lit(0))).alias("byte_count"),
        )
    )


def traffic_values(touching: DataFrame) -> DataFrame:
    """Domains and attack targets seen with a candidate, as rows (their number has no bound)."""
    pairs = F.array(
        F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")),
        F.struct(F.lit("attack_target").alias("kind"), F.col("attack_target_ip").alias("value")),
    )
    return (
        touching.select("candidate_ip", F.inline(pairs))
        .filter(F.coalesce("value", F.lit("")) != "")
        .distinct()
    )


def traffic_series(buckets: DataFrame) -> DataFrame:
    """Packets of the (at most 24) buckets of each candidate in order."""
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "packets")))
    return buckets.groupBy("candidate_ip").agg(ordered.getField("packets").alias("traffic_series"))


def rolling_sample(flows: DataFrame, keys: list[str], per_key: int, ts: str = "ts_us") -> DataFrame:
    """The latest ``per_key`` rows of every key (a sampling operator, ties by endpoints)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), "source_ip", "destination_ip")
    return (
        flows.withColumn("__rn", F.row_number().over(order))
        .filter(F.col("__rn") <= per_key)
        .drop("__rn")
    )
