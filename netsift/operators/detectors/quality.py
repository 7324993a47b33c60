"""TCP session quality, an enrichment of candidates that another detector supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators.evidence import evidence
from netsift.params import Params


def tcp_session_quality(judged: DataFrame, p: Params) -> DataFrame:
    good = (
        ~F.col("suppressed") & ~F.col("unanswered") & F.col("metadata_available") & F.col("qualified")
    )
    of_good = lambda c: F.when(good, F.col(c))
    totals = judged.groupBy("candidate_ip").agg(
        F.count_if(good).alias("qualified"),
        F.count_if(good & F.col("internally_initiated")).alias("initiated"),
        F.count_if(good & F.col("established")).alias("established"),
        F.count_if("unanswered").alias("unanswered"),
        F.count_if(F.col("scan_like") | F.col("suppressed")).alias("scans"),
        F.sum(of_good("row_count")).alias("n"),
        F.min(of_good("first_us")).alias("first_us"),
        F.max(of_good("last_us")).alias("last_us"),
        F.min(of_good("host_ip")).alias("min_host"),
        F.max(of_good("host_ip")).alias("max_host"),
        F.sort_array(F.collect_set(of_good("sensor_id"))).alias("sensors"),
    )
    clamp = lambda x: max(0.0, min(15.0, float(x)))
    points = F.least(
        F.lit(15.0),
        F.when(F.col("initiated") > 0, clamp(p.tcp_outbound_initiated_contribution)).otherwise(0.0)
        + F.when(F.col("established") > 0, clamp(p.tcp_established_contribution)).otherwise(0.0),
    )
    metrics = {
        "outbound_initiated_connections": F.col("initiated"),
        "established_connections": F.col("established"),
        "qualified_tcp_connections": F.col("qualified"),
        "syn_unanswered_connections": F.col("unanswered"),
        "scan_suppressed_connections": F.col("scans"),
        "sample_count": F.col("n"),
    }
    row = evidence(
        "TCP_SESSION_QUALITY",
        "tcp_session_quality",
        points,
        metrics,
        "TCP sessions were opened from inside or answered in both directions",
    )
    return totals.filter((F.col("qualified") > 0) & (points > 0)).select(F.inline(F.array(row)))
