"""From evidence to explainable 0–100 scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.net import ip_bits
from netsift.params import CAPS, MAX_DETECTOR_WEIGHT, Params


def severity(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL")
        .when(score >= 60, "HIGH")
        .when(score >= 40, "MEDIUM")
        .otherwise("LOW")
    )


def _number_map(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")


def cap_of(kind: Column) -> Column:
    return F.coalesce(_number_map(CAPS)[kind], F.lit(0.0))


def detector_weight(weights: dict[str, float]) -> Column:
    found = F.coalesce(_number_map(weights)[F.col("detector")], F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(MAX_DETECTOR_WEIGHT), found))


def active_allowlist(allowlist: DataFrame, now: str) -> DataFrame:
    """Enabled entries that have not expired.

    An expiry that cannot be read, or that carries no offset from UTC, counts as expired.
    """
    text = F.col("expires_at")
    stamp = F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    alive = text.isNull() | F.coalesce(stamp > F.lit(now).cast("timestamp"), F.lit(False))
    return allowlist.filter(F.coalesce("enabled", F.lit(True)) & alive).select(
        F.upper("type").alias("type"), "value"
    )


def trusted_servers(allowlist: DataFrame, now: str) -> DataFrame:
    """(type, value) of the active trusted DNS and NTP servers, however many there are."""
    kinds = ("TRUSTED_DNS", "TRUSTED_NTP")
    return active_allowlist(allowlist, now).filter(F.col("type").isin(*kinds)).distinct()


def allowlisted(evidence: DataFrame, allowlist: DataFrame, now: str) -> DataFrame:
    """Candidates that an active entry suppresses.

    Every kind of entry is an equi join: addresses and networks meet on bit prefixes, domain
    suffixes on the suffixes of the domain, fingerprints on their text.
    """
    entries = active_allowlist(allowlist, now)
    bits = evidence.select("candidate_ip").distinct().withColumn("bits", ip_bits("candidate_ip"))
    width = F.length("bits") - 2
    prefixes = bits.filter(F.col("bits").isNotNull()).select(
        "candidate_ip",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), width), lambda i: F.substring(F.col("bits"), F.lit(1), i + 2)
            )
        ).alias("key"),
    )
    address = F.split_part(F.col("value"), F.lit("/"), F.lit(1))
    length = F.split_part(F.col("value"), F.lit("/"), F.lit(2))
    size = F.when(
        (F.col("type") == "CIDR") & (length != ""), F.expr("try_cast(split_part(value, '/', 2) AS INT)")
    ).otherwise(F.length(ip_bits(address)) - 2)
    networks = entries.filter(F.col("type").isin("IP", "CIDR")).select(
        F.substring(ip_bits(address), F.lit(1), size + 2).alias("key")
    )
    by_ip = prefixes.join(networks, "key", "left_semi").select("candidate_ip")

    metric = lambda k: F.get_json_object("metrics", f"$.{k}")
    domain = F.rtrim(F.lower(F.coalesce(metric("domain"), F.lit(""))), F.lit("."))
    suffixes = evidence.select("candidate_ip", domain.alias("domain")).distinct().select(
        "candidate_ip",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length("domain")), lambda i: F.right(F.col("domain"), i)
            )
        ).alias("key"),
    )
    wanted = entries.filter(F.col("type") == "DOMAIN_SUFFIX").select(
        F.ltrim(F.lower("value"), F.lit(".")).alias("key")
    )
    by_domain = suffixes.join(wanted, "key", "left_semi").select("candidate_ip")

    prints = F.array(
        F.struct(F.lit("TLS_FINGERPRINT").alias("type"), metric("tls_fingerprint").alias("value")),
        F.struct(
            F.lit("CERT_FINGERPRINT").alias("type"),
            metric("certificate_fingerprint").alias("value"),
        ),
    )
    by_print = (
        evidence.select("candidate_ip", F.inline(prints))
        .filter(F.col("value").isNotNull())
        .join(entries, ["type", "value"], "left_semi")
        .select("candidate_ip")
    )
    return by_ip.unionByName(by_domain).unionByName(by_print).distinct()


def suppress(evidence: DataFrame, allowlist: DataFrame, now: str) -> DataFrame:
    return evidence.join(allowlisted(evidence, allowlist, now), "candidate_ip", "left_anti")


def score_candidates(
    evidence: DataFrame,
    profiles: DataFrame | None,
    p: Params = Params(),
    *,
    minimum_samples: int | None = None,
    weight: Column | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Score every candidate. ``by`` adds scenario columns; ``weight`` may depend on them."""
    minimum = p.periodicity_min_samples if minimum_samples is None else minimum_samples
    keys = [*by, "candidate_ip"]
    plain = F.greatest(F.lit(0.0), F.col("contribution"))
    shown = F.format_string("%s x%s", "detector", F.col("__w").cast("string"))
    per_type = (
        evidence.withColumn("__w", detector_weight(p.detector_weights) if weight is None else weight)
        .groupBy(*keys, "type")
        .agg(
            F.sum(plain).alias("points"),
            F.sum(plain * F.col("__w")).alias("weighted"),
            F.sort_array(F.collect_set(shown)).alias("weights"),
            F.count(F.lit(1)).alias("items"),
            F.min("min_host").alias("min_host"),
            F.max("max_host").alias("max_host"),
            F.collect_set("sensors").alias("sensor_sets"),
            F.min(F.least("first_seen", "last_seen")).alias("first_seen"),
            F.max(F.greatest("first_seen", "last_seen")).alias("last_seen"),
            F.max(F.coalesce("sample_count", F.lit(minimum))).alias("samples"),
            F.max(F.coalesce("public_dns_ntp", F.lit(False))).alias("dns"),
            F.max(F.coalesce("cdn_cloud", F.lit(False))).alias("cdn"),
            F.max(
                (F.col("type") == "ANALYST_PAYLOAD_SIGNATURE")
                & F.coalesce(F.col("match_mode") == "EXACT", F.lit(False))
            ).alias("exact"),
        )
    )
    cap = cap_of(F.col("type"))
    base = F.least(cap, F.col("points"))
    share = F.coalesce(F.try_divide(F.col("weighted"), F.col("points")), F.lit(1.0))
    extra = F.least(cap * MAX_DETECTOR_WEIGHT, base * share) - base
    item = lambda kind, points, text: F.struct(
        kind.alias("kind"), points.cast("double").alias("points"), text.alias("explanation")
    )
    weighting = item(
        F.concat(F.lit("DETECTOR_WEIGHT_"), F.col("type")),
        extra,
        F.concat(F.lit("detector weights of this run: "), F.array_join("weights", ", ")),
    )
    totals = per_type.groupBy(*keys).agg(
        F.sum(base).alias("base_score"),
        F.sum("items").alias("evidence_count"),
        F.sort_array(F.collect_list(F.when(extra != 0, weighting))).alias("weight_adjustments"),
        F.sort_array(F.collect_set("type")).alias("types"),
        F.min("min_host").alias("min_host"),
        F.max("max_host").alias("max_host"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("sensor_sets"))))).alias(
            "sensors"
        ),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("samples").alias("samples"),
        F.max("dns").alias("dns"),
        F.max("cdn").alias("cdn"),
        F.max("exact").alias("exact"),
    )
    volumes = ["total_bytes", "total_packets", "max_tcp_session_bytes", "max_tcp_session_packets"]
    if profiles is not None:
        totals = totals.join(profiles.select("candidate_ip", *volumes), "candidate_ip", "left")
    else:
        totals = totals.withColumns({v: F.lit(0).cast("bigint") for v in volumes})
    at_least = lambda c, limit: (
        F.coalesce(F.col(c), F.lit(0)) >= limit if limit > 0 else F.lit(False)
    )
    inexact = ~F.col("exact")
    lone = F.col("min_host") == F.col("max_host")
    lone_points = F.when(F.array_contains("types", "SINGLE_HOST_BEACON"), -10).otherwise(-20)
    heavy = at_least("total_bytes", p.high_volume_bytes_threshold) | at_least(
        "total_packets", p.high_volume_packet_threshold
    )
    fixed = F.array_compact(
        F.array(
            F.when(
                lone & inexact,
                item(F.lit("SINGLE_HOST"), lone_points, F.lit("only one internal host was seen")),
            ),
            F.when(
                (F.col("samples") < minimum) & inexact,
                item(F.lit("LOW_SAMPLE"), F.lit(-20), F.lit("too few samples")),
            ),
            F.when(
                F.col("dns"),
                item(F.lit("PUBLIC_DNS_NTP"), F.lit(-30), F.lit("trusted DNS or NTP server")),
            ),
            F.when(
                F.col("cdn"), item(F.lit("CDN_CLOUD"), F.lit(-20), F.lit("CDN or cloud policy"))
            ),
            F.when(
                heavy & inexact & F.lit(p.high_volume_penalty > 0),
                item(
                    F.lit("HIGH_VOLUME"),
                    F.lit(-abs(int(p.high_volume_penalty))),
                    F.format_string(
                        "high volume: %s bytes, %s packets",
                        F.col("total_bytes").cast("string"),
                        F.col("total_packets").cast("string"),
                    ),
                ),
            ),
        )
    )
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["points"])
    long_session = at_least(
        "max_tcp_session_bytes", p.high_volume_tcp_session_bytes_threshold
    ) | at_least("max_tcp_session_packets", p.high_volume_tcp_session_packet_threshold)
    limit = F.lit(float(p.high_volume_tcp_session_score_cap))
    capped = long_session & inexact & (F.col("adjusted") > limit)
    capping = F.when(
        capped,
        F.array(
            item(
                F.lit("HIGH_VOLUME_TCP_SESSION"),
                limit - F.col("adjusted"),
                F.lit("a high-volume TCP session points to a proxy or relay"),
            )
        ),
    ).otherwise(F.array())
    final = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.col("raw")))).cast("int")
    return (
        totals.withColumn("adjustments", F.concat("weight_adjustments", fixed))
        .withColumn("adjusted", F.col("base_score") + add("adjustments"))
        .withColumn("adjustments", F.concat("adjustments", capping))
        .withColumn("raw", F.when(capped, limit).otherwise(F.col("adjusted")))
        .withColumn("score", final)
        .select(
            *keys,
            "score",
            severity(F.col("score")).alias("severity"),
            "base_score",
            "evidence_count",
            "types",
            "adjustments",
            "min_host",
            "max_host",
            "sensors",
            "first_seen",
            "last_seen",
        )
    )


def scored_filter(candidates: DataFrame, minimum_score: int) -> DataFrame:
    return candidates.filter(F.col("score") >= minimum_score)


def override_score(
    candidates: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Analyst overrides (candidate_ip, score_adjustment, exclude_reason) applied to scores."""
    changed = candidates.join(overrides, "candidate_ip", "left")
    score = F.col("score") + F.coalesce("score_adjustment", F.lit(0))
    return changed.withColumns(
        {
            "score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"),
            "excluded": F.col("exclude_reason").isNotNull(),
        }
    ).drop("score_adjustment")
