"""Overview tables: fleet, jobs, candidates, trend, priorities and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.plans.triage import OPEN_STATUSES, workflow_counts

# Fixed values.
ACTIVE_JOBS = ("WAITING_FOR_SENSOR", "CAPTURING", "UPLOADING", "INGESTING", "ANALYZING")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def derived_status(heartbeats: DataFrame, skew_seconds: float) -> DataFrame:
    """DEGRADED when the clock of the sensor is off by more than the tolerance."""
    off = F.abs("clock_offset_ms") > skew_seconds * 1000
    return heartbeats.withColumn(
        "derived_status", F.when(off, "DEGRADED").otherwise(F.col("reported_status"))
    )


def live_status(sensors: DataFrame, now: str, timeout_seconds: int = 30) -> DataFrame:
    silent = F.unix_micros(_at(now)) - F.unix_micros("last_heartbeat_at") > timeout_seconds * 10**6
    stated = F.upper(F.coalesce("derived_status", "status", F.lit("UNKNOWN")))
    return sensors.withColumn(
        "live_status", F.when(F.coalesce(silent, F.lit(False)), "OFFLINE").otherwise(stated)
    )


def fleet(live: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("live_status") == s)
    return live.agg(
        F.count(F.lit(1)).alias("total"),
        n("ONLINE").alias("online"),
        n("OFFLINE").alias("offline"),
        n("DEGRADED").alias("degraded"),
        F.sum(F.coalesce("dropped_packets", F.lit(0))).alias("dropped_packets"),
    )


def sensor_quality(live: DataFrame) -> DataFrame:
    """Drop rate per sensor with the keys that order the report."""
    got = F.coalesce("received_packets", F.lit(0))
    lost = F.coalesce("dropped_packets", F.lit(0))
    rate = F.coalesce(F.round(F.try_divide(lost, got + lost) * 100, 2), F.lit(0.0))
    urgency = (
        F.when(F.col("live_status") == "OFFLINE", 0)
        .when(F.col("live_status") == "DEGRADED", 1)
        .otherwise(2)
    )
    return live.select(
        "sensor_id",
        F.coalesce("name", "sensor_id").alias("name"),
        F.col("live_status").alias("status"),
        got.alias("received_packets"),
        lost.alias("dropped_packets"),
        rate.alias("drop_rate_percent"),
        urgency.alias("urgency"),
    )


def ordered_quality(quality: DataFrame) -> DataFrame:
    return quality.orderBy("urgency", F.desc("drop_rate_percent"), "name")


def job_counts(jobs: DataFrame, now: str) -> DataFrame:
    recent = F.unix_micros("completed_at") >= F.unix_micros(_at(now)) - 24 * 3600 * 10**6
    done = lambda s: F.count_if((F.col("status") == s) & recent)
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(*ACTIVE_JOBS)).alias("active"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ACTIVE_JOBS],
        done("COMPLETED").alias("completed_24h"),
        done("FAILED").alias("failed_24h"),
        done("PARTIALLY_COMPLETED").alias("partially_completed_24h"),
    )


def severity_counts(candidates: DataFrame, now: str) -> DataFrame:
    n = lambda s: F.count_if(F.upper("severity") == s)
    recent = F.unix_micros("first_seen") >= F.unix_micros(_at(now)) - 24 * 3600 * 10**6
    return candidates.agg(
        F.count(F.lit(1)).alias("total"),
        *[n(s).alias(s.lower()) for s in SEVERITIES],
        F.count_if(recent).alias("new_24h"),
    )


def hourly_trend(candidates: DataFrame, now: str) -> DataFrame:
    """Candidates first seen in each of the 24 hours up to now, empty hours included."""
    spark = candidates.sparkSession
    this_hour = F.date_trunc("hour", _at(now))
    hours = spark.range(24).select(
        (this_hour - F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour")
    )
    inside = F.col("first_seen").between(
        this_hour - F.expr("INTERVAL 23 HOURS"), _at(now)
    )
    counts = (
        candidates.filter(inside)
        .groupBy(F.date_trunc("hour", "first_seen").alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return hours.join(counts, "hour", "left").select(
        "hour", F.coalesce("count", F.lit(0)).alias("count")
    )


def priority_candidates(with_status: DataFrame, n: int = 5) -> DataFrame:
    return (
        with_status.filter(F.col("workflow_status").isin(*OPEN_STATUSES))
        .orderBy(F.desc("last_seen"), "candidate_id")
        .limit(n)
    )


def recent_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id").limit(n)


def attention(live: DataFrame, jobs: DataFrame, with_status: DataFrame) -> DataFrame:
    """At most eight items: three sensors, three jobs, two candidates, then the rest in turn."""
    item = lambda src, kind, sev, title, order: (
        F.lit(src).alias("source"), kind.alias("kind"), sev.alias("severity"),
        title.alias("title"), order.alias("ordering"),
    )
    offline = F.col("live_status") == "OFFLINE"
    sensors = (
        live.filter(F.col("live_status").isin("OFFLINE", "DEGRADED"))
        .orderBy("sensor_id")
        .limit(8)
        .select(
            *item(
                0,
                F.concat("live_status", F.lit("_SENSOR")),
                F.when(offline, "HIGH").otherwise("MEDIUM"),
                F.coalesce("name", "sensor_id"),
                F.col("sensor_id"),
            )
        )
    )
    partial = F.col("status") == "PARTIALLY_COMPLETED"
    analyses = (
        recent_jobs(jobs)
        .filter(F.col("status").isin("FAILED", "PARTIALLY_COMPLETED"))
        .select(
            *item(
                1,
                F.when(partial, "PARTIALLY_COMPLETED_ANALYSIS").otherwise("FAILED_ANALYSIS"),
                F.when(partial, "MEDIUM").otherwise("HIGH"),
                F.coalesce("name", "id"),
                F.lpad((F.lit(2**60) - F.unix_micros("created_at")).cast("string"), 20, "0"),
            )
        )
    )
    critical = (
        priority_candidates(with_status)
        .filter(F.col("severity") == "CRITICAL")
        .select(
            *item(
                2,
                F.lit("CRITICAL_CANDIDATE"),
                F.lit("CRITICAL"),
                F.col("candidate_ip"),
                F.lpad((F.lit(2**60) - F.unix_micros("last_seen")).cast("string"), 20, "0"),
            )
        )
    )
    # At most 8 + 5 + 5 rows reach this window.
    rows = sensors.unionByName(analyses).unionByName(critical)
    place = F.row_number().over(Window.partitionBy("source").orderBy("ordering", "title"))
    quota = F.when(F.col("source") == 2, 2).otherwise(3)
    later = F.when(F.col("place") > quota, 1).otherwise(0)
    return (
        rows.withColumn("place", place)
        .withColumn("later", later)
        .withColumn(
            "position", F.row_number().over(Window.orderBy("later", "source", "place"))
        )
        .filter(F.col("position") <= 8)
        .select("position", "kind", "severity", "title")
    )


def dashboard(
    sensors: DataFrame, jobs: DataFrame, with_status: DataFrame, now: str
) -> dict[str, DataFrame]:
    """All dashboard tables; ``with_status`` are candidates with workflow status."""
    shown = with_status.filter(~F.coalesce("excluded", F.lit(False)))
    live = live_status(sensors, now)
    return {
        "fleet": fleet(live),
        "analyses": job_counts(jobs, now),
        "candidates": severity_counts(shown, now),
        "workflow": workflow_counts(shown),
        "candidate_trend": hourly_trend(shown, now),
        "priority_candidates": priority_candidates(shown),
        "recent_analyses": recent_jobs(jobs),
        "sensor_quality": ordered_quality(sensor_quality(live)),
        "attention": attention(live, jobs, shown),
    }
