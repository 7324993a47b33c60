"""High-recall ranking of every external peer, before any detector threshold applies."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.stats import exact_quantile
from netsift.operators.detectors.population import MAD_TO_SIGMA
from netsift.operators.timeline import distinct_gaps
from netsift.params import PREFILTER_VERSION
from netsift.session import materialize

# How an intermediate result is stored; the plans that follow read it several times.
Stage = Callable[[DataFrame, str], DataFrame]

# Ports that only speak for common services, and the high-volume limits.
COMMON_SERVICE_PORTS = (53, 123)
HIGH_VOLUME_BYTES = 50 * 1024 * 1024
HIGH_VOLUME_PACKETS = 100_000
SYNC_WINDOW_US = 2_000_000


def peer_totals(oriented: DataFrame) -> DataFrame:
    """Volumes per peer; ports and protocols are bounded sets."""
    return oriented.groupBy("candidate_ip").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum(F.greatest(F.col("packet_count"), F.lit(0))).alias("packet_count"),
        F.sum(F.greatest(F.col("total_bytes"), F.lit(0))).alias("total_bytes"),
        F.sort_array(F.collect_set("service_port")).alias("ports"),
        F.sort_array(F.collect_set("protocol")).alias("protocols"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )


def steady_hosts(oriented: DataFrame, table: Stage) -> DataFrame:
    """Hosts with at least three intervals whose normalized MAD is at most 0.2."""
    keys = ["candidate_ip", "host_ip"]
    gaps = distinct_gaps(oriented, keys).select(*keys, (F.col("gap_us") / 1e6).alias("gap"))
    gaps = table(gaps, "gaps")
    samples = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).filter("samples >= 3")
    period = exact_quantile(gaps.join(samples, keys, "left_semi"), keys, "gap", 0.5, "period")
    period = table(period.join(samples, keys), "periods")
    off = gaps.join(period, keys).withColumn("dev", F.abs(F.col("gap") - F.col("period")))
    mad = exact_quantile(table(off.select(*keys, "dev"), "deviations"), keys, "dev", 0.5, "mad")
    first = oriented.groupBy(*keys).agg(F.min("ts_us").alias("first_us"))
    return (
        period.filter(F.col("period") > 0)
        .join(mad, keys)
        .withColumn("deviation", F.col("mad") / F.col("period"))
        .filter(F.col("deviation") <= 0.2)
        .join(first, keys)
    )


FIRST_CONTACT_US = 10_000_000


def steadiest_host(steady: DataFrame) -> DataFrame:
    """Per peer, the host whose interval the ranking reports.

    Hosts are visited by first contact, and a later host replaces the best one when it has more
    intervals or a smaller deviation. The walk ends at the first host that no later host beats in
    either measure: any earlier best that this host could not replace would itself be unbeaten.
    So the maximum and minimum over later hosts decide; they are taken inside slots of first
    contact and over slot summaries, and no peer is gathered in one place.
    """
    slot = F.floor(F.col("first_us") / FIRST_CONTACT_US)
    rows = steady.withColumn("slot", slot)
    later = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    between = later(Window.partitionBy("candidate_ip").orderBy("slot"))
    inside = later(Window.partitionBy("candidate_ip", "slot").orderBy("first_us", "host_ip"))
    slots = (
        rows.groupBy("candidate_ip", "slot")
        .agg(F.max("samples").alias("ms"), F.min("deviation").alias("md"))
        .select(
            "candidate_ip",
            "slot",
            F.max("ms").over(between).alias("ms"),
            F.min("md").over(between).alias("md"),
        )
    )
    most = F.greatest(F.max("samples").over(inside), F.col("ms"))
    least = F.least(F.min("deviation").over(inside), F.col("md"))
    unbeaten = (F.col("most").isNull() | (F.col("samples") >= F.col("most"))) & (
        F.col("least").isNull() | (F.col("deviation") <= F.col("least"))
    )
    return (
        rows.join(slots, ["candidate_ip", "slot"])
        .withColumns({"most": most, "least": least})
        .filter(unbeaten)
        .groupBy("candidate_ip")
        .agg(
            F.min_by(
                F.struct("samples", "deviation", "period"), F.struct("first_us", "host_ip")
            ).alias("best")
        )
        .select("candidate_ip", "best.*")
    )


def payload_cluster(oriented: DataFrame) -> DataFrame:
    """The most frequent payload feature of a peer (SimHash, else hash, else prefix hash)."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    feature = F.coalesce(
        text("payload_simhash"), text("payload_hash"), text("payload_prefix_hash")
    )
    order = F.struct((-F.col("n")).alias("n"), F.col("feature"))
    return (
        oriented.select("candidate_ip", feature.alias("feature"))
        .filter(F.col("feature").isNotNull())
        .groupBy("candidate_ip", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("candidate_ip")
        .agg(
            F.sum("n").alias("signatures"),
            F.max("n").alias("dominant"),
            F.min_by("feature", order).alias("feature"),
        )
        .filter((F.col("dominant") >= 3) & (F.col("dominant") / F.col("signatures") >= 0.6))
    )


def synchronized_peak(oriented: DataFrame) -> DataFrame:
    return (
        oriented.withColumn("bucket", F.floor(F.col("ts_us") / SYNC_WINDOW_US))
        .groupBy("candidate_ip", "bucket")
        .agg(F.count_distinct("host_ip").alias("h"))
        .groupBy("candidate_ip")
        .agg(F.max("h").alias("sync_hosts"))
        .filter(F.col("sync_hosts") >= 3)
    )


def _robust(totals: DataFrame) -> DataFrame:
    """One row with median and MAD of flows and bytes over all peers."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in ("flow_count", "total_bytes")
        ]
    )
    values = totals.select(F.inline(pairs))
    center = exact_quantile(values, ["feature"], "value", 0.5, "center")
    off = values.join(center, "feature").withColumn("dev", F.abs(F.col("value") - F.col("center")))
    both = exact_quantile(off, ["feature"], "dev", 0.5, "mad").join(center, "feature")
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    return both.agg(
        pick("flow_count", "center").alias("flow_median"),
        pick("flow_count", "mad").alias("flow_mad"),
        pick("total_bytes", "center").alias("byte_median"),
        pick("total_bytes", "mad").alias("byte_mad"),
    )


def _factor(name: str, points: Column, metrics: dict[str, Column], when: Column) -> Column:
    row = F.struct(
        F.lit(name).alias("name"),
        points.cast("double").alias("points"),
        F.to_json(F.struct(*[c.alias(k) for k, c in metrics.items()])).alias("metrics"),
    )
    return F.when(when, row)


def prefilter(
    oriented: DataFrame,
    trusted: Iterable[str] = (),
    limit: int | None = None,
    table: Stage = materialize,
) -> DataFrame:
    """Every peer with its score (0–100) and the factors that make it up, ranked."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")

    def volumes() -> tuple[DataFrame, DataFrame]:
        totals = table(peer_totals(oriented), "peers")
        return totals, table(_robust(totals), "robust")

    # The four parts read the same rows but not each other, so their jobs run side by side.
    with ThreadPoolExecutor(4) as pool:
        volume_job = pool.submit(volumes)
        parts = [
            pool.submit(lambda: table(steadiest_host(table(steady_hosts(oriented, table), "steady")), "best")),
            pool.submit(lambda: table(payload_cluster(oriented), "clusters")),
            pool.submit(lambda: table(synchronized_peak(oriented), "peaks")),
        ]
        totals, robust = volume_job.result()
        best, clusters, peaks = (job.result() for job in parts)
    limits = {c: robust.select(c).scalar() for c in robust.columns}
    z = lambda v, m, d: (F.col(v) - F.col(m)) / F.greatest(
        F.lit(1.0), MAD_TO_SIGMA * F.col(d)
    )
    table_rows = (
        totals.join(best, "candidate_ip", "left")
        .join(clusters, "candidate_ip", "left")
        .join(peaks, "candidate_ip", "left")
        .withColumns(limits)
        .withColumn(
            "robust_z",
            F.greatest(
                z("flow_count", "flow_median", "flow_mad"),
                z("total_bytes", "byte_median", "byte_mad"),
            ),
        )
    )
    names = sorted(set(trusted))
    is_trusted = F.col("candidate_ip").isin(*names) if names else F.lit(False)
    common = F.lit(list(COMMON_SERVICE_PORTS))
    part = F.col("dominant") / F.col("signatures")
    factors = F.array_compact(
        F.array(
            _factor(
                "PEER_BASELINE",
                F.least(F.lit(10.0), 2 + 2 * F.log2(F.col("flow_count") + 1)),
                {c: F.col(c) for c in ("flow_count", "packet_count", "total_bytes")},
                F.lit(True),
            ),
            _factor(
                "SINGLE_HOST_BEACON",
                F.round(35 * (1 - F.least(F.lit(1.0), F.col("deviation"))), 2),
                {
                    "interval_samples": F.col("samples"),
                    "median_period_seconds": F.round("period", 3),
                    "normalized_mad": F.round("deviation", 4),
                },
                F.col("samples") >= 3,
            ),
            _factor(
                "PAYLOAD_CLUSTER",
                F.round(20 * part, 2),
                {
                    "sample_count": F.col("signatures"),
                    "dominant_count": F.col("dominant"),
                    "dominant_ratio": F.round(part, 4),
                    "feature_prefix": F.substring("feature", 1, 12),
                },
                F.col("dominant").isNotNull(),
            ),
            _factor(
                "SYNCHRONIZED_CLUSTER",
                F.least(F.lit(20.0), 5.0 * F.col("sync_hosts")),
                {"synchronized_hosts": F.col("sync_hosts"), "window_seconds": F.lit(2)},
                F.col("sync_hosts").isNotNull(),
            ),
            _factor(
                "ROBUST_ANOMALY",
                F.least(F.lit(20.0), 5 + F.col("robust_z")),
                {
                    "robust_z": F.round("robust_z", 3),
                    "flow_count": F.col("flow_count"),
                    "median_flow_count": F.round("flow_median", 3),
                    "total_bytes": F.col("total_bytes"),
                    "median_total_bytes": F.round("byte_median", 3),
                },
                F.col("robust_z") >= 3,
            ),
            _factor(
                "COMMON_SERVICE_PENALTY",
                F.lit(-15),
                {"ports": F.array_join(F.transform("ports", lambda x: x.cast("string")), ",")},
                (F.size("ports") > 0) & (F.size(F.array_except("ports", common)) == 0),
            ),
            _factor(
                "HIGH_VOLUME_PENALTY",
                F.lit(-20),
                {c: F.col(c) for c in ("packet_count", "total_bytes")},
                (F.col("total_bytes") >= HIGH_VOLUME_BYTES)
                | (F.col("packet_count") >= HIGH_VOLUME_PACKETS),
            ),
            _factor("TRUSTED_PEER_PENALTY", F.lit(-100), {"trusted": F.lit(1)}, is_trusted),
        )
    )
    total = F.aggregate("factors", F.lit(0.0), lambda a, x: a + x["points"])
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(total))).cast("int")
    ranked = table_rows.withColumn("factors", factors).select(
        "candidate_ip",
        score.alias("prefilter_score"),
        F.lit(PREFILTER_VERSION).alias("score_version"),
        "factors",
        "protocols",
        "ports",
        "flow_count",
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
    )
    if limit is None:
        return ranked
    return ranked.orderBy(F.desc("prefilter_score"), "candidate_ip").limit(limit)


def prefilter_severity(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def prefilter_id(job_id: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{job_id}:"), F.col("candidate_ip")), 256)
    return F.concat(F.lit("ai-prefilter-"), F.left(digest, F.lit(16)))


def merge_ranking(
    candidates: DataFrame, ranked: DataFrame, job_id: str, limit: int | None = None
) -> DataFrame:
    """Scored candidates full-outer prefiltered peers, ranked by 0.55 score + 0.25 prefilter."""
    merged = (
        candidates.select("candidate_ip", "score", F.col("severity").alias("__sev"))
        .join(
            ranked.select("candidate_ip", "prefilter_score", "score_version", "factors"),
            "candidate_ip",
            "full_outer",
        )
        .select(
            F.when(F.col("score").isNull(), prefilter_id(job_id)).alias("prefilter_id"),
            "candidate_ip",
            F.coalesce("score", F.lit(0)).alias("score"),
            F.coalesce("prefilter_score", F.lit(0)).alias("prefilter_score"),
            F.coalesce("__sev", prefilter_severity(F.col("prefilter_score"))).alias("severity"),
            F.when(F.col("score").isNull(), "AI_PREFILTER").alias("source"),
            "score_version",
            "factors",
        )
        .withColumn("rank_value", 0.55 * F.col("score") + 0.25 * F.col("prefilter_score"))
    )
    if limit is None:
        return merged
    return merged.orderBy(F.desc("rank_value"), "candidate_ip").limit(limit)


# How much a verdict counts in the review order.
VERDICT_WEIGHTS = {
    "LIKELY_C2": Decimal("1.0"),
    "SUSPICIOUS": Decimal("0.7"),
    "INCONCLUSIVE": Decimal("0.3"),
    "LIKELY_BENIGN": Decimal("0.0"),
}


def review_priority(df: DataFrame) -> DataFrame:
    """Add ``review_priority`` from score, prefilter_score, verdict and confidence.

    The weights are decimal numbers and so are the sums: halves stay halves and round to even."""
    pairs = [x for k, v in VERDICT_WEIGHTS.items() for x in (F.lit(k), F.lit(v).cast("decimal(2,1)"))]
    weight = F.create_map(*pairs)[F.col("verdict")]
    clamp = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), c.cast("double")))
    exact = lambda c, hi, digits: clamp(c, hi).cast(f"decimal({digits + 3},{digits})")
    share = lambda text: F.lit(Decimal(text))
    existing, pre = exact(F.col("score"), 100.0, 9), exact(F.col("prefilter_score"), 100.0, 9)
    model = exact(F.col("confidence"), 1.0, 15) * weight
    known = weight.isNotNull() & F.col("confidence").isNotNull()
    judged = share("0.55") * existing + share("0.25") * pre + share("20") * model
    unjudged = share("0.6875") * existing + share("0.3125") * pre
    rounded = F.when(known, F.bround(judged, 0)).otherwise(F.bround(unjudged, 0))
    return df.withColumn("review_priority", clamp(rounded, 100.0).cast("int"))
