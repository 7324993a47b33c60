"""Detectors on timing: periodic beacons, synchronized contact, command followed by attack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.stats import cv_from_sums, exact_quantile
from netsift.operators.evidence import evidence
from netsift.operators.features import MOMENTS
from netsift.params import Params


def offset_us(p: Params) -> Column:
    """Clock offset of the row's sensor in µs (zero when not known)."""
    if not p.clock_offsets_ms:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in sorted(p.clock_offsets_ms.items()) for x in (k, float(v))]
    return F.coalesce(F.create_map(*pairs)[F.col("sensor_id")], F.lit(0.0)) * 1000


def regular_hosts(intervals: DataFrame, p: Params) -> DataFrame:
    """Hosts with enough contacts at a steady interval."""
    return intervals.filter(
        (F.col("n") >= p.periodicity_min_samples)
        & (F.col("mean_interval") > 0)
        & (F.col("interval_cv") <= p.maximum_beacon_cv)
    )


def beacon_hosts(intervals: DataFrame, p: Params) -> DataFrame:
    """Regular hosts that agree with the common period of their candidate."""
    regular = regular_hosts(intervals, p)
    middle = exact_quantile(regular, ["candidate_ip"], "mean_interval", 0.5, "middle")
    overall = regular.groupBy("candidate_ip").agg(F.avg("interval_cv").alias("cv"))
    coarse = F.when(F.col("middle") >= 5, F.rint(F.col("middle") / 5) * 5)
    joined = (
        regular.select("candidate_ip", "host_ip", "mean_interval", F.col("n").alias("host_n"))
        .join(middle, "candidate_ip")
        .join(overall, "candidate_ip")
        .withColumn("period", F.coalesce(coarse, F.col("middle")))
    )
    near = F.abs(F.col("mean_interval") - F.col("period")) / F.col("period") <= 0.30
    return joined.filter(near)


def periodic_beacon(intervals: DataFrame, contact_rows: DataFrame, p: Params) -> DataFrame:
    matching = beacon_hosts(intervals, p)
    totals = (
        matching.join(contact_rows, ["candidate_ip", "host_ip"])
        .groupBy("candidate_ip")
        .agg(
            *[F.sum(m).alias(m) for m in MOMENTS],
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.min("host_ip").alias("min_host"),
            F.max("host_ip").alias("max_host"),
            F.sort_array(F.collect_set("sensor_id")).alias("sensors"),
            F.count_distinct("host_ip").alias("matching_hosts"),
            F.first("period").alias("period"),
            F.first("cv").alias("cv"),
        )
    )
    sizes = cv_from_sums(F.col("s_n"), F.col("s_sum"), F.col("s_sq"))
    rows = cv_from_sums(F.col("n"), F.col("b_sum"), F.col("b_sq"))
    spread = F.coalesce(F.when(F.col("s_n") > 0, sizes).otherwise(rows), F.lit(0.0))
    cv = F.col("cv")
    metrics = {
        "sample_count": F.col("n"),
        "period_seconds": F.round("period", 6),
        "coefficient_of_variation": cv,
        "jitter_ratio": cv,
        "autocorrelation": F.greatest(F.lit(0.0), 1 - cv),
        "size_similarity": F.greatest(F.lit(0.0), 1 - spread),
        "matching_hosts": F.col("matching_hosts"),
        "distinct_sensors": F.size("sensors"),
    }
    row = evidence(
        "PERIODIC_BEACON",
        "periodic_beacon",
        15,
        metrics,
        "periodic contact within the accepted jitter",
    )
    return totals.select(F.inline(F.array(row)))


def synchronized_buckets(gated: DataFrame, p: Params) -> DataFrame:
    """Time buckets in which enough hosts contact one candidate together."""
    window = float(p.synchronization_window_seconds) * 1e6
    bucket = F.floor((F.col("ts_us") - offset_us(p)) / window)
    return (
        gated.withColumn("bucket", bucket)
        .groupBy("candidate_ip", "bucket")
        .agg(
            F.count_distinct("host_ip").alias("hosts"),
            F.count(F.lit(1)).alias("n"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.min("host_ip").alias("min_host"),
            F.max("host_ip").alias("max_host"),
            F.collect_set("sensor_id").alias("sensors"),
            F.max(F.abs(offset_us(p)) > 2_000_000).alias("skewed"),
        )
        .filter(F.col("hosts") >= p.minimum_distinct_clients)
    )


def synchronized_communication(gated: DataFrame, p: Params) -> DataFrame:
    buckets = synchronized_buckets(gated, p)
    # Sensor sets repeat between buckets, so the set of sets is bounded by the fleet.
    sensors = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort("sensors")))))
    totals = (
        buckets.groupBy("candidate_ip")
        .agg(
            F.count(F.lit(1)).alias("repeats"),
            F.max("hosts").alias("max_hosts"),
            F.sum("n").alias("n"),
            F.max((F.col("last_us") - F.col("first_us")) / 1e6).alias("spread"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.min("min_host").alias("min_host"),
            F.max("max_host").alias("max_host"),
            sensors.alias("sensors"),
            F.max("skewed").alias("skewed"),
        )
        .filter(F.col("repeats") >= 2)
    )
    metrics = {
        "window_seconds": float(p.synchronization_window_seconds),
        "synchronized_hosts": F.col("max_hosts"),
        "event_count": F.col("n"),
        "repetition_count": F.col("repeats"),
        "distinct_sensors": F.size("sensors"),
        "observed_spread": F.col("spread"),
        "sample_count": F.col("n"),
    }
    row = evidence(
        "SYNCHRONIZED_COMMUNICATION",
        "synchronized_communication",
        15,
        metrics,
        "several hosts repeatedly make contact at the same moment",
        confidence=F.when(F.col("skewed"), 0.7).otherwise(1.0),
        warnings=F.when(F.col("skewed"), F.array(F.lit("clock_skew"))).otherwise(F.array()),
    )
    return totals.select(F.inline(F.array(row)))


def _inbound(gated: DataFrame) -> DataFrame:
    return gated.filter(F.upper("direction") == "INBOUND")


def commands(gated: DataFrame, p: Params) -> DataFrame:
    """Candidates that sent inbound traffic to enough hosts, with the earliest such moment."""
    return (
        _inbound(gated)
        .groupBy("candidate_ip", "host_ip", "sensor_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("total_bytes").alias("bytes"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
        )
        .groupBy("candidate_ip")
        .agg(
            F.count_distinct("host_ip").alias("hosts"),
            F.sum("n").alias("commands"),
            F.sum("bytes").alias("bytes"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.min("host_ip").alias("min_host"),
            F.max("host_ip").alias("max_host"),
            F.sort_array(F.collect_set("sensor_id")).alias("sensors"),
        )
        .filter(F.col("hosts") >= p.minimum_distinct_clients)
    )


#: Length of the spans before and after a command, and the delay after which traffic counts as an attack.
SPAN_US, DELAY_US = 30_000_000, 1_000_000
#: Seconds are dealt into blocks of this many; an interval between two bounds is shorter than a block.
BLOCK_SECONDS = 32
TARGET = ["target", "target_port", "target_protocol"]


def _sums_before(data: DataFrame, asked: DataFrame, part: list[str], at: str) -> DataFrame:
    """``asked`` with ``n`` and ``packets``, the sums of ``data`` in the same ``part`` strictly before ``at``.

    Data and questions are sorted together and summed once on the way, so no question meets a row."""
    empty = {"n": F.lit(0).cast("bigint"), "packets": F.lit(0).cast("bigint")}
    both = data.withColumn("late", F.lit(1)).unionByName(
        asked.withColumns({**empty, "late": F.lit(0)}), allowMissingColumns=True
    )
    so_far = (
        Window.partitionBy(*part)
        .orderBy(at, "late")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = {c: F.sum(c).over(so_far) for c in ("n", "packets")}
    return both.withColumns(sums).filter("late = 0").select(*asked.columns, "n", "packets")


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def sums_around(flows: DataFrame, asked: DataFrame, table: Callable = _lazy) -> DataFrame:
    """What hosts sent to each target before and after given moments, without pairing flows and moments.

    ``asked`` holds distinct (host_ip, seed_us). Per asked row and (target, port, protocol) the result has
    ``attacks`` and ``attack_packets`` of 1 to 30 s after the moment and ``baseline_packets`` of the 30 s
    before it. ``table`` may store what is read more than once. Each sum is the difference of two prefix sums: over the seconds of a block, and inside the two
    seconds that the interval begins and ends in. Each second lies in two overlapping blocks, so an
    interval never leaves its block. No sort sees more than the distinct µs of one second of one host and
    target, or the seconds of one block, and the moments asked there."""
    second = lambda us: F.floor(F.col(us) / 1_000_000)
    block = lambda s: F.floor(s / BLOCK_SECONDS)
    seed = F.col("seed_us")
    spans = F.sequence(
        block(F.floor((seed - SPAN_US) / 1_000_000)), block(F.floor((seed + SPAN_US) / 1_000_000))
    )
    near = asked.withColumn("block", F.explode(spans))
    sent = flows.filter(F.col("direction") == "OUTBOUND").select(
        F.col("source_ip").alias("host_ip"),
        F.col("destination_ip").alias("target"),
        F.col("destination_port").alias("target_port"),
        F.col("protocol").alias("target_protocol"),
        "packet_count",
        F.col("ts_us").alias("at"),
        block(second("ts_us")).alias("block"),
    )
    key = ["host_ip", *TARGET]
    moments = (
        sent.join(near.select("host_ip", "block").distinct(), ["host_ip", "block"], "left_semi")
        .groupBy(*key, "at")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets"),
        )
        .withColumn("second", second("at"))
    )
    moments = table(moments, "reactions")
    seconds = moments.groupBy(*key, "second").agg(
        F.sum("n").alias("n"), F.sum("packets").alias("packets")
    )
    active = (
        seconds.select(*key, block(F.col("second")).alias("block"))
        .distinct()
        .join(near, ["host_ip", "block"])
        .select(*key, "seed_us")
        .distinct()
    )
    bound = lambda what, sign, low, at: F.struct(
        F.lit(what).alias("what"), F.lit(sign).alias("sign"), (seed + low).alias("low"), (seed + at).alias("at")
    )
    bounds = active.select(
        "*",
        F.inline(
            F.array(
                bound("attack", -1, DELAY_US, DELAY_US),
                bound("attack", 1, DELAY_US, SPAN_US + 1),  # the end is included
                bound("baseline", -1, -SPAN_US, -SPAN_US),
                bound("baseline", 1, -SPAN_US, 0),
            )
        ),
    ).withColumn("second", second("at"))
    inside = _sums_before(moments, bounds, [*key, "second"], "at")
    this = block(F.col("second"))
    dealt = seconds.withColumn("block", F.explode(F.array(this - 1, this)))
    across = _sums_before(
        dealt, bounds.withColumn("block", block(second("low"))), [*key, "block"], "second"
    )
    total = lambda what, c: F.sum(
        F.when(F.col("what") == what, F.col("sign") * F.col(c)).otherwise(0)
    )
    return (
        inside.unionByName(across.drop("block"))
        .groupBy(*key, "seed_us")
        .agg(
            total("attack", "n").alias("attacks"),
            total("attack", "packets").alias("attack_packets"),
            total("baseline", "n").alias("baselines"),
            total("baseline", "packets").alias("baseline_packets"),
        )
        .filter("attacks > 0 or baselines > 0")
        .drop("baselines")
    )


def command_reactions(
    flows: DataFrame, gated: DataFrame, seeds: DataFrame, table: Callable = _lazy
) -> DataFrame:
    """Per candidate, commanded host and target: traffic within 30 s around the first command.

    Traffic to the candidate itself is no attack. Rows without attack and without earlier packets are left out."""
    hosts = (
        _inbound(gated)
        .select("candidate_ip", "host_ip")
        .distinct()
        .join(seeds.select("candidate_ip", F.col("first_us").alias("seed_us")), "candidate_ip")
    )
    hosts = table(hosts, "commanded")
    sums = sums_around(flows, hosts.select("host_ip", "seed_us").distinct(), table)
    own = F.col("target") == F.col("candidate_ip")
    unless_own = {c: F.when(own, 0).otherwise(F.col(c)) for c in ("attacks", "attack_packets")}
    return (
        hosts.join(sums, ["host_ip", "seed_us"])
        .withColumns(unless_own)
        .filter("attacks > 0 or baseline_packets > 0")
        .drop("seed_us")
    )


def command_attack(
    flows: DataFrame, gated: DataFrame, p: Params, table: Callable = _lazy
) -> DataFrame:
    seeds = table(commands(gated, p), "commands")
    per_host = table(command_reactions(flows, gated, seeds, table), "per-target")
    per_flow = per_host.groupBy("candidate_ip", "target", "target_port", "target_protocol").agg(
        F.sum("attacks").alias("attacks"), F.sum("attack_packets").alias("attack_packets")
    )
    order = F.struct(
        (-F.col("attacks")).alias("n"), F.col("target"), F.col("target_port"), F.col("target_protocol")
    )
    best = F.min_by(
        F.struct("target", "target_port", "target_protocol", "attack_packets"), order
    )
    top = (
        per_flow.filter(F.col("attacks") > 0)
        .groupBy("candidate_ip")
        .agg(best.alias("top"), F.sum("attacks").alias("attacks"))
        .select("candidate_ip", "attacks", "top.*")
    )
    per_target = per_host.groupBy("candidate_ip", "target").agg(
        F.count_distinct(F.when(F.col("attacks") > 0, F.col("host_ip"))).alias("affected"),
        F.sum("baseline_packets").alias("baseline_packets"),
    )
    increase = F.col("attack_packets") / F.greatest(F.lit(1), F.col("baseline_packets"))
    hits = (
        top.join(per_target, ["candidate_ip", "target"])
        .withColumn("increase", increase)
        .filter(
            (F.col("affected") >= p.minimum_distinct_clients) & (F.col("increase") >= 3)
        )
        .join(seeds, "candidate_ip")
    )
    metrics = {
        "command_size": F.col("bytes"),
        "affected_hosts": F.col("affected"),
        "increase_ratio": F.col("increase"),
        "attack_target": F.col("target"),
        "target_port": F.col("target_port"),
        "target_protocol": F.col("target_protocol"),
        "sample_count": F.col("commands") + F.col("attacks"),
    }
    row = evidence(
        "COMMAND_ATTACK_CORRELATION",
        "command_attack_correlation",
        25,
        metrics,
        "attack traffic on one target rises right after small inbound commands",
    )
    return hits.select(F.inline(F.array(row)))
