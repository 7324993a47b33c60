"""Per-candidate features shared by the detectors.

Gated rows are reduced three times, each with map-side combine and on keys finer than the
candidate, so that one candidate with a large share of the traffic stays spread out:
``shapes`` (what was sent), ``contacts`` (who talked where) and ``host_intervals`` (when).
Everything per candidate is then derived from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.stats import ratio
from netsift.operators.timeline import interval_moments
from netsift.params import Params

SHAPE = [
    "protocol",
    "service_port",
    "payload_hash",
    "tls_fingerprint",
    "certificate_fingerprint",
    "domain",
    "packet_sizes",
]


def filled(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) != ""


def domain_norm() -> Column:
    return F.rtrim(F.lower("domain"), F.lit("."))


def shapes(gated: DataFrame) -> DataFrame:
    """Rows per (candidate, sensor, traffic shape)."""
    return gated.groupBy("candidate_ip", "sensor_id", *SHAPE).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min("host_ip").alias("min_host"),
        F.max("host_ip").alias("max_host"),
    )


def contacts(gated: DataFrame) -> DataFrame:
    """Rows, packets and size moments per (candidate, host, sensor)."""
    size, exact = F.col("packet_sizes"), "decimal(38,0)"
    squared = lambda c: (c.cast(exact) * c.cast("decimal(19,0)")).cast(exact)
    fold = lambda f: F.aggregate(size, F.lit(0).cast("bigint"), f)
    return gated.groupBy("candidate_ip", "host_ip", "sensor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.sum("packet_count").alias("packets"),
        F.sum("total_bytes").alias("b_sum"),
        F.sum(squared(F.col("total_bytes"))).alias("b_sq"),
        F.count_if(F.col("total_bytes") > 0).alias("b_pos"),
        F.sum(F.size(size).cast("bigint")).alias("s_n"),
        F.sum(fold(lambda a, x: a + x)).alias("s_sum"),
        F.sum(fold(lambda a, x: a + x.cast("bigint") * x).cast(exact)).alias("s_sq"),
        F.sum(fold(lambda a, x: a + F.when(x > 0, 1).otherwise(0).cast("bigint"))).alias("s_pos"),
    )


MOMENTS = ["n", "packets", "b_sum", "b_sq", "b_pos", "s_n", "s_sum", "s_sq", "s_pos"]


def contact_features(contact_rows: DataFrame) -> DataFrame:
    """Candidate totals. ``sensors`` is bounded by the sensor fleet."""
    return contact_rows.groupBy("candidate_ip").agg(
        *[F.sum(m).alias(m) for m in MOMENTS],
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.count_distinct("host_ip").alias("hosts"),
        F.min("host_ip").alias("min_host"),
        F.max("host_ip").alias("max_host"),
        F.sort_array(F.collect_set("sensor_id")).alias("sensors"),
    )


def sensor_features(contact_rows: DataFrame, p: Params) -> DataFrame:
    """How many sensors saw enough hosts on their own."""
    enough = F.col("h") >= p.minimum_distinct_clients
    return (
        contact_rows.groupBy("candidate_ip", "sensor_id")
        .agg(F.count(F.lit(1)).alias("h"))
        .groupBy("candidate_ip")
        .agg(
            F.count_if(enough).alias("strong_sensors"),
            F.min(F.when(enough, F.col("h"))).alias("independent_hosts"),
        )
    )


def odd_port(p: Params) -> Column:
    """The service port lies outside the well-known range and is not excluded."""
    limit = max(0, min(65535, p.well_known_port_max))
    odd = F.col("service_port") > limit
    excluded = [x for x in p.non_well_known_port_exclusions if 0 <= x <= 65535]
    if excluded:
        odd = odd & ~F.col("service_port").isin(*excluded)
    return F.coalesce(odd, F.lit(False))


def shape_features(shape_rows: DataFrame, p: Params) -> DataFrame:
    """Candidate totals over shapes: port sets (≤65,536 values), odd ports, UDP-only, suffixes."""
    odd = odd_port(p)
    when_odd = lambda c: F.when(odd, F.col(c))
    suffixes = sorted({s.lower().lstrip(".").rstrip(".") for s in p.cdn_domain_suffixes})
    return shape_rows.groupBy("candidate_ip").agg(
        F.max(F.upper("protocol") != "UDP").alias("any_non_udp"),
        F.sum(F.when(F.col("service_port").isNotNull(), F.col("n"))).alias("with_port_n"),
        F.sort_array(F.collect_set("service_port")).alias("service_ports"),
        F.sum(when_odd("n")).alias("odd_n"),
        F.min(when_odd("first_us")).alias("odd_first"),
        F.max(when_odd("last_us")).alias("odd_last"),
        F.min(when_odd("min_host")).alias("odd_min_host"),
        F.max(when_odd("max_host")).alias("odd_max_host"),
        F.sort_array(F.collect_set(when_odd("sensor_id"))).alias("odd_sensors"),
        F.sort_array(F.collect_set(when_odd("service_port"))).alias("odd_ports"),
        *[
            F.min(F.when(filled("domain"), domain_norm().endswith(s))).alias(f"suffix_{i}")
            for i, s in enumerate(suffixes)
        ],
    )


def value_features(shape_rows: DataFrame, p: Params) -> DataFrame:
    """Most frequent value, its rows, all rows and distinct values, per kind of value.

    Every kind is counted in one shuffle. Ties go to the lowest value.
    """
    fingerprint = F.concat_ws(
        "|",
        F.coalesce("tls_fingerprint", F.lit("")),
        F.coalesce("certificate_fingerprint", F.lit("")),
    )
    kinds: dict[str, Column] = {
        "anyport": F.coalesce(F.col("service_port").cast("string"), F.lit("")),
        "port": F.lpad(F.col("service_port").cast("string"), 5, "0"),
        "oddport": F.when(odd_port(p), F.lpad(F.col("service_port").cast("string"), 5, "0")),
        "hash": F.when(filled("payload_hash"), F.col("payload_hash")),
        "print": F.when(filled("tls_fingerprint") | filled("certificate_fingerprint"), fingerprint),
        "dnorm": F.when(filled("domain"), domain_norm()),
        "draw": F.when(filled("domain"), F.col("domain")),
        "shape": F.to_json(F.struct(*SHAPE), {"ignoreNullFields": "false"}),
    }
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]
    )
    counts = (
        shape_rows.select("candidate_ip", "n", F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("candidate_ip", "kind", "value")
        .agg(F.sum("n").alias("n"))
    )
    aggs = []
    for k in kinds:
        mine = F.col("kind") == k
        aggs += [
            F.max(F.when(mine, F.col("n"))).alias(f"{k}_max"),
            F.sum(F.when(mine, F.col("n"))).alias(f"{k}_n"),
            F.count_if(mine).alias(f"{k}_distinct"),
        ]
        if k in ("oddport", "shape"):
            best = F.struct((-F.col("n")).alias("n"), F.col("value"))
            aggs.append(F.min(F.when(mine, best)).getField("value").alias(f"{k}_mode"))
    return counts.groupBy("candidate_ip").agg(*aggs)


def host_intervals(gated: DataFrame) -> DataFrame:
    return interval_moments(gated, ["candidate_ip", "host_ip"])


def interval_features(intervals: DataFrame) -> DataFrame:
    """Mean interval CV over hosts with at least four rows, and the values of a lone host."""
    usable = (F.col("n") >= 4) & (F.col("mean_interval") > 0)
    return intervals.groupBy("candidate_ip").agg(
        F.avg(F.when(usable, F.col("interval_cv"))).alias("mean_host_cv"),
        F.max("mean_interval").alias("lone_mean"),
        F.max("interval_cv").alias("lone_cv"),
    )


def size_cv(f: Column | None = None, positive: bool = False) -> Column:
    """CV of packet sizes, or of row bytes where no packet size is known; null when undefined."""
    from netsift.functions.stats import cv_from_sums

    s_n, b_n = ("s_pos", "b_pos") if positive else ("s_n", "n")
    sizes = cv_from_sums(F.col(s_n), F.col("s_sum"), F.col("s_sq"))
    rows = cv_from_sums(F.col(b_n), F.col("b_sum"), F.col("b_sq"))
    return F.when(F.col(s_n) > 0, sizes).otherwise(rows)


def share(part: str, whole: str) -> Column:
    return ratio(F.col(part), F.col(whole))
