"""Matching flows against analyst payload signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.payload import simhash_bands, simhash_distance, simhash_valid
from netsift.operators.evidence import evidence
from netsift.schema import SIGNATURE, conform

PAYLOAD = [
    "protocol",
    "direction",
    "service_port",
    "payload_hash",
    "last_payload_hash",
    "payload_prefix_hash",
    "payload_length",
    "payload_entropy",
    "payload_printable_ratio",
    "payload_simhash",
    "payload_feature_version",
]
PAYLOAD_GROUP = ["candidate_ip", "sensor_id", *PAYLOAD]
SIGNATURE_DEFAULTS = {
    "version": 1,
    "length_tolerance_ratio": 0.15,
    "entropy_tolerance": 0.75,
    "simhash_max_distance": 8,
}


def _blank_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def active_signatures(signatures: DataFrame) -> DataFrame:
    """Enabled signatures with an id, defaults filled, columns prefixed with ``sig_``."""
    df = conform(signatures, SIGNATURE, SIGNATURE_DEFAULTS).select(*SIGNATURE.names)
    df = _blank_to_null(
        df, ["id", "protocol", "direction", "payload_hash", "payload_prefix_hash", "payload_simhash",
             "payload_feature_version"]
    ).filter(F.col("enabled") & F.col("id").isNotNull())
    return df.select(*[F.col(c).alias(f"sig_{c}") for c in df.columns])


def payload_rows(oriented: DataFrame) -> DataFrame:
    """Rows with a payload description; empty hashes count as none."""
    return _blank_to_null(
        oriented,
        [
            "payload_hash",
            "last_payload_hash",
            "payload_prefix_hash",
            "payload_simhash",
        ],
    ).filter(
        F.coalesce(
            "payload_hash", "last_payload_hash", "payload_prefix_hash", "payload_simhash"
        ).isNotNull()
    )


def payload_groups(oriented: DataFrame) -> DataFrame:
    """Rows reduced to distinct payload descriptions per candidate before any matching."""
    return payload_rows(oriented).groupBy(*PAYLOAD_GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min("host_ip").alias("min_host"),
        F.max("host_ip").alias("max_host"),
    )


def _guards() -> Column:
    sig = lambda c: F.col(f"sig_{c}")
    agree = lambda c: sig(c).isNull() | (F.upper(sig(c)) == F.upper(c))
    port = sig("service_port").isNull() | (sig("service_port") == F.col("service_port"))
    return agree("protocol") & agree("direction") & F.coalesce(port, F.lit(False))


def _similar_pairs(groups: DataFrame, sigs: DataFrame) -> DataFrame:
    """(flow SimHash, signature) pairs within the allowed distance, found by equal bit runs.

    With d allowed differences among d+1 runs at least one run is equal, so the join on runs loses
    nothing and no all-pairs comparison is made.
    """
    wanted = sigs.filter(simhash_valid("sig_payload_simhash"))
    bands = (F.col("sig_simhash_max_distance") + 1).cast("int")
    widths = wanted.select(bands.alias("__b")).distinct()
    keyed = wanted.select(
        "sig_id",
        "sig_payload_simhash",
        "sig_simhash_max_distance",
        F.explode(simhash_bands("sig_payload_simhash", bands)).alias("band"),
    )
    hashes = groups.select("payload_simhash").distinct().filter(simhash_valid("payload_simhash"))
    # One array of runs per number of runs in use; the range of that number is 1 to 33.
    in_use = widths.agg(F.collect_set("__b").alias("__all")).scalar()
    per_width = hashes.withColumn("__all", in_use).withColumn("__b", F.explode("__all"))
    flows = per_width.select(
        "payload_simhash", F.explode(simhash_bands("payload_simhash", F.col("__b"))).alias("band")
    )
    near = simhash_distance("payload_simhash", "sig_payload_simhash")
    return (
        flows.join(keyed, "band")
        .filter(near <= F.col("sig_simhash_max_distance"))
        .select("sig_id", "payload_simhash")
        .distinct()
    )


def signature_matches(
    oriented: DataFrame, signatures: DataFrame, table=lambda df, name: df
) -> DataFrame:
    """Every (payload group, signature) match with its mode and comparison metrics.

    ``table`` may store the payload groups and signatures, which three joins read.
    """
    sigs = table(active_signatures(signatures), "signatures")
    groups = table(payload_groups(oriented), "payloads")
    either = F.array_compact(F.array_distinct(F.array("payload_hash", "last_payload_hash")))
    exact = (
        groups.withColumn("sig_payload_hash", F.explode(either))
        .join(sigs, "sig_payload_hash")
        .filter(_guards())
    )
    position = F.when(F.col("payload_hash") == F.col("sig_payload_hash"), "FIRST").otherwise("LAST")
    exact = exact.withColumn(
        "comparison",
        F.to_json(
            F.struct(
                F.col("sig_payload_hash").alias("matched_payload_hash"),
                F.coalesce(position, F.lit("LAST")).alias("matched_payload_position"),
                F.sort_array(either).alias("flow_payload_hashes"),
                "service_port",
            )
        ),
    ).withColumn("mode", F.lit("EXACT"))

    by_prefix = groups.join(
        sigs, F.col("payload_prefix_hash") == F.col("sig_payload_prefix_hash")
    )
    pairs = _similar_pairs(groups, sigs)
    prefix_equal = F.coalesce(
        F.col("payload_prefix_hash") == F.col("sig_payload_prefix_hash"), F.lit(False)
    )
    by_simhash = (
        groups.join(pairs, "payload_simhash").join(sigs, "sig_id").filter(~prefix_equal)
    )
    both = by_prefix.unionByName(by_simhash.select(*by_prefix.columns))
    bad_hash = (
        F.col("sig_payload_simhash").isNotNull()
        & F.col("payload_simhash").isNotNull()
        & ~(simhash_valid("sig_payload_simhash") & simhash_valid("payload_simhash"))
    )
    version_ok = F.col("sig_payload_feature_version").isNull() | (
        F.col("sig_payload_feature_version") == F.col("payload_feature_version")
    )
    same_hash = F.array_contains(either, F.col("sig_payload_hash"))
    distance = simhash_distance("payload_simhash", "sig_payload_simhash")
    d_len = F.abs(F.col("payload_length") - F.col("sig_payload_length"))
    t_len = F.greatest(
        F.lit(16.0), F.rint(F.col("sig_payload_length") * F.col("sig_length_tolerance_ratio"))
    )
    d_ent = F.abs(F.col("payload_entropy") - F.col("sig_payload_entropy"))
    near = (d_len <= t_len) & (d_ent <= F.col("sig_entropy_tolerance"))
    printable = (
        F.col("payload_printable_ratio").isNotNull()
        & F.col("sig_payload_printable_ratio").isNotNull()
    )
    structural = both.filter(
        _guards()
        & ~F.coalesce(same_hash, F.lit(False))
        & F.coalesce(version_ok, F.lit(False))
        & ~bad_hash
        & near
    ).withColumn(
        "comparison",
        F.to_json(
            F.struct(
                prefix_equal.alias("prefix_match"),
                distance.alias("simhash_distance"),
                F.col("sig_simhash_max_distance").alias("simhash_max_distance"),
                d_len.alias("length_difference"),
                t_len.cast("int").alias("length_tolerance"),
                F.round(d_ent, 4).alias("entropy_difference"),
                F.col("sig_entropy_tolerance").alias("entropy_tolerance"),
                (3 + distance.isNotNull().cast("int") + printable.cast("int")).alias(
                    "comparable_features"
                ),
                "service_port",
            ),
            {"ignoreNullFields": "false"},
        ),
    ).withColumn("mode", F.lit("STRUCTURAL"))
    return exact.unionByName(structural.select(*exact.columns))


def comparison_rows(matches: DataFrame) -> DataFrame:
    """Every distinct comparison behind the evidence with its flows and their first moment.

    Exact matches displace structural ones, as in the evidence. The list is a relation because
    its length has no bound; a short report takes the earliest.
    """
    key = ["candidate_ip", "sig_id"]
    exact = matches.filter("mode = 'EXACT'").select(*key).distinct()
    structural = matches.filter("mode <> 'EXACT'").join(exact, key, "left_anti")
    chosen = matches.filter("mode = 'EXACT'").unionByName(structural.select(*matches.columns))
    return chosen.groupBy(*key, "mode", "comparison").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us")
    )


def analyst_payload_signature(matches: DataFrame) -> DataFrame:
    """One evidence row per (candidate, signature); exact matches displace structural ones.

    ``matches`` come from all scoped rows, not only gated ones.
    """
    key = ["candidate_ip", "sig_id", "mode"]
    totals = matches.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min("min_host").alias("min_host"),
        F.max("max_host").alias("max_host"),
        F.sort_array(F.collect_set("sensor_id")).alias("sensors"),
        F.first("sig_name").alias("sig_name"),
        F.first("sig_version").alias("sig_version"),
        F.count_distinct("comparison").alias("comparisons"),
    )
    best = Window.partitionBy("candidate_ip", "sig_id").orderBy("mode")
    chosen = (
        totals.withColumn("__best", F.row_number().over(best)).filter(F.col("__best") == 1)
    )
    is_exact = F.col("mode") == "EXACT"
    pick = lambda a, b: F.when(is_exact, F.lit(a)).otherwise(F.lit(b))
    metrics = {
        "signature_id": F.col("sig_id"),
        "signature_name": F.coalesce("sig_name", "sig_id"),
        "signature_version": F.col("sig_version"),
        "match_mode": F.col("mode"),
        "matched_flow_count": F.col("n"),
        "sample_count": F.col("n"),
        "action": pick("alert", "monitor"),
        "comparison_count": F.col("comparisons"),
        "analyst_confirmed": is_exact,
    }
    row = evidence(
        "ANALYST_PAYLOAD_SIGNATURE",
        "analyst_payload_signature",
        pick(80, 60),
        metrics,
        pick(
            "equals a payload signature approved by an analyst",
            "resembles a payload signature approved by an analyst",
        ),
        confidence=pick(1.0, 0.7),
        warnings=F.when(is_exact, F.array()).otherwise(F.array(F.lit("structural_match_review"))),
        key=F.col("sig_id"),
        match_mode=F.col("mode"),
    )
    return chosen.select(F.inline(F.array(row)))
