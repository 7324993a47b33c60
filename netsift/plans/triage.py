"""Analyst workflow: decisions, actions, reputation, lists and bulk verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators.review import latest, newest

# Fixed values.
VERDICTS = ("CONFIRMED_C2", "FALSE_POSITIVE", "UNDER_REVIEW")
CONFIDENCES = ("CONFIRMED", "HIGH", "MEDIUM", "LOW")
OPEN_STATUSES = ("NEEDS_REVIEW", "IN_REVIEW", "ACTION_REQUIRED", "ACTION_IN_PROGRESS")
CANDIDATE_SORTS = ("score", "candidate_ip", "first_seen", "last_seen", "severity", "ti_priority")
JOB_SORTS = ("created_at", "updated_at", "name", "status", "source_type")
SENSOR_SORTS = ("sensor_id", "name", "last_heartbeat_at", "derived_status")
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([zZ]|[+-]\d{2}:?\d{2})$"


def valid_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with all texts filled, known values and a time that names its offset."""
    texts = ("id", "candidate_id", "verdict", "confidence", "note", "created_by", "created_at")
    ok = F.col("verdict").isin(*VERDICTS) & F.col("confidence").isin(*CONFIDENCES)
    ok = ok & F.col("created_at").rlike(ISO_WITH_OFFSET)
    for c in texts:
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return decisions.filter(ok & F.try_to_timestamp("created_at").isNotNull())


def workflow(
    candidates: DataFrame,
    decisions: DataFrame,
    actions: DataFrame,
    lookups: DataFrame | None = None,
) -> DataFrame:
    """Candidates with current verdict, current action, status and newest reputation lookup.

    An action counts only when it belongs to the current verdict. Actions are reduced to the newest of
    each verdict first, where they lie, and only those meet the current verdicts.
    """
    verdict = newest(valid_decisions(decisions), ["candidate_id"], ["id", "verdict"]).withColumnRenamed(
        "id", "verdict_id"
    )
    of_verdict = ["candidate_id", "verdict_id"]
    action = newest(actions, of_verdict, ["status"]).withColumnRenamed("status", "action_status")
    judged = candidates.join(verdict, "candidate_id", "left")
    out = judged.join(action, of_verdict, "left").select(*judged.columns, "action_status")
    if lookups is not None:
        lookup = latest(lookups, ["candidate_id"], "fetched_at").drop("id")
        out = out.join(lookup, "candidate_id", "left")
    status = F.col("action_status")
    confirmed = F.col("verdict") == "CONFIRMED_C2"
    return out.withColumns(
        {
            "verdict": F.coalesce("verdict", F.lit("UNREVIEWED")),
            "action_status": F.coalesce(
                status, F.when(confirmed, "PENDING").otherwise("NOT_REQUIRED")
            ),
            "workflow_status": F.when(
                confirmed,
                F.when(status == "IN_PROGRESS", "ACTION_IN_PROGRESS")
                .when(status == "COMPLETED", "ACTION_COMPLETED")
                .otherwise("ACTION_REQUIRED"),
            )
            .when(F.col("verdict") == "UNDER_REVIEW", "IN_REVIEW")
            .when(F.col("verdict") == "FALSE_POSITIVE", "FALSE_POSITIVE")
            .otherwise("NEEDS_REVIEW"),
        }
    )


def workflow_counts(with_status: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("workflow_status").isin(*s))
    return with_status.agg(
        n("NEEDS_REVIEW").alias("needs_review"),
        n("IN_REVIEW").alias("in_review"),
        n("ACTION_REQUIRED").alias("action_required"),
        n("ACTION_IN_PROGRESS").alias("action_in_progress"),
        n("ACTION_COMPLETED").alias("action_completed"),
        n("FALSE_POSITIVE").alias("false_positive"),
        n("ACTION_COMPLETED", "FALSE_POSITIVE").alias("done"),
    )


def ti_lookups(candidates: DataFrame, feed: DataFrame) -> DataFrame:
    """Join candidates with a reputation feed (ip, provider, status, counters) and fold providers.

    PARTIAL when any provider failed. Providers are a fixed, small set of columns.
    """
    mine = lambda p: F.col("provider") == p
    pick = lambda p, c: F.max(F.when(mine(p), F.col(c)))
    failed = F.col("status").isin("ERROR", "AUTH_ERROR", "RATE_LIMITED")
    configured = F.upper("status") != "NOT_CONFIGURED"
    folded = feed.groupBy(F.col("ip").alias("candidate_ip")).agg(
        F.count_if(configured).alias("configured_providers"),
        F.count_if(configured & (F.upper("status") == "OK")).alias("successful_providers"),
        F.max(failed).alias("__failed"),
        pick("virustotal", "malicious").alias("virustotal_malicious"),
        pick("virustotal", "suspicious").alias("virustotal_suspicious"),
        pick("abuseipdb", "abuse_confidence_score").alias("abuse_confidence_score"),
        pick("misp", "event_count").alias("misp_event_count"),
        F.max("fetched_at").alias("fetched_at"),
    )
    status = F.when(F.col("__failed"), "PARTIAL").when(F.col("__failed").isNotNull(), "COMPLETED")
    return (
        candidates.join(folded, "candidate_ip", "left")
        .withColumn("ti_status", status)
        .drop("__failed")
    )


def ti_assessment(df: DataFrame) -> DataFrame:
    """Add positive providers and the signal of the newest lookup."""
    counters = (
        "configured_providers",
        "successful_providers",
        "virustotal_malicious",
        "virustotal_suspicious",
        "abuse_confidence_score",
        "misp_event_count",
    )
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counters})
    yes = lambda c: F.when(c, 1).otherwise(0)
    positive = (
        yes(F.col("virustotal_malicious") + F.col("virustotal_suspicious") > 0)
        + yes(F.col("abuse_confidence_score") > 0)
        + yes(F.col("misp_event_count") > 0)
    )
    unfinished = F.upper("ti_status").isin("PENDING", "PARTIAL", "FAILED")
    return df.withColumn("positive_providers", positive).withColumns(
        {
            "ti_signal": F.when(F.col("configured_providers") == 0, "UNKNOWN")
            .when(unfinished, "INCOMPLETE")
            .when(F.col("positive_providers") > 0, "POSITIVE")
            .otherwise("NO_SIGNAL"),
            "ti_status": F.coalesce(F.upper("ti_status"), F.lit("NOT_CHECKED")),
        }
    )


def ti_filter(df: DataFrame, wanted: str | None) -> DataFrame:
    tests = {
        "POSITIVE": F.col("positive_providers") > 0,
        "MISP_MATCH": F.col("misp_event_count") > 0,
        "INCOMPLETE": F.col("ti_signal") == "INCOMPLETE",
    }
    return df.filter(tests[wanted]) if wanted in tests else df


def immediate_action(
    feed: DataFrame, managed_events: tuple[str, ...] = (), threshold: int = 1, minimum: int = 2
) -> DataFrame:
    """Addresses with enough providers that agree; matches in managed events do not count."""
    ok = F.upper("status") == "OK"
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    foreign = F.size(F.array_except("event_ids", F.lit(list(managed_events) or [""]))) > 0
    positive = ok & (
        ((F.col("provider") == "virustotal") & (num("malicious") + num("suspicious") > 0))
        | ((F.col("provider") == "abuseipdb") & (num("abuse_confidence_score") >= threshold))
        | ((F.col("provider") == "misp") & foreign)
    )
    return (
        feed.filter(positive)
        .groupBy(F.col("ip").alias("candidate_ip"))
        .agg(F.sort_array(F.collect_set("provider")).alias("providers"))  # at most three
        .filter(F.size("providers") >= minimum)
    )


def candidate_filter(
    df: DataFrame,
    minimum_score: int = 0,
    severity: str | None = None,
    include_suppressed: bool = False,
    verdict: str | None = None,
    workflow_status: str | None = None,
) -> DataFrame:
    df = df.filter(F.col("score") >= minimum_score)
    if severity:
        df = df.filter(F.col("severity") == severity)
    if not include_suppressed and verdict != "FALSE_POSITIVE":
        df = df.filter(~F.coalesce("excluded", F.lit(False)))
    if verdict:
        df = df.filter(F.col("verdict") == verdict)
    return df.filter(F.col("workflow_status") == workflow_status) if workflow_status else df


def _sort(sort: str, allowed: tuple[str, ...]) -> tuple[str, bool]:
    field = sort.removeprefix("-")
    if field not in allowed:
        raise ValueError(f"cannot sort by {field}")
    return field, sort.startswith("-")


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    if page < 1 or not 1 <= size <= 200:
        raise ValueError("a page holds 1 to 200 rows and pages start at 1")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def candidate_page(
    df: DataFrame, sort: str = "-score", page: int = 1, size: int = 50, tie: str = "candidate_id"
) -> DataFrame:
    """One page of candidates; a page is a top-k query, so nothing is sorted in full."""
    field, down = _sort(sort, CANDIDATE_SORTS)
    cols = [F.col(field)]
    if field == "ti_priority":
        cols = [
            F.col("misp_event_count") > 0,
            F.col("positive_providers"),
            F.col("virustotal_malicious") + F.col("virustotal_suspicious"),
            F.col("abuse_confidence_score"),
            F.col("score"),
            F.col("last_seen"),
        ]
    order = [c.desc() if down else c.asc() for c in cols]
    return page_of(df, [*order, F.col(tie).asc()], page, size)


def job_page(
    jobs: DataFrame,
    status: str | None = None,
    source_type: str | None = None,
    search: str | None = None,
    sort: str = "-created_at",
    page: int = 1,
    size: int = 50,
) -> DataFrame:
    field, down = _sort(sort, JOB_SORTS)
    if status:
        jobs = jobs.filter(F.col("status") == status)
    if source_type:
        jobs = jobs.filter(F.col("source_type") == source_type)
    if search:
        hit = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(search.casefold())
        jobs = jobs.filter(hit("name") | hit("description"))
    order = F.col(field).desc() if down else F.col(field).asc()
    return page_of(jobs, [order, F.col("id").asc()], page, size)


def sensor_page(
    sensors: DataFrame,
    status: str | None = None,
    enabled: bool | None = None,
    sort: str = "sensor_id",
    page: int = 1,
    size: int = 50,
) -> DataFrame:
    field, down = _sort(sort, SENSOR_SORTS)
    if status:
        sensors = sensors.filter(F.col("derived_status") == status)
    if enabled is not None:
        sensors = sensors.filter(F.col("enabled") == enabled)
    order = F.col(field).desc() if down else F.col(field).asc()
    return page_of(sensors, [order, F.col("sensor_id").asc()], page, size)


def segment_page(
    segments: DataFrame,
    sensor_id: str | None = None,
    job_id: str | None = None,
    page: int = 1,
    size: int = 50,
) -> DataFrame:
    if sensor_id is not None:
        segments = segments.filter(F.col("sensor_id") == sensor_id)
    if job_id is not None:
        segments = segments.filter(F.col("analysis_job_id") == job_id)
    return page_of(segments, [F.desc("uploaded_at"), F.col("id").asc()], page, size)


def enrichment_selection(candidates: DataFrame, limit: int, everything: bool = False) -> DataFrame:
    """Candidates to look up: the best ``limit``, or all when immediate action is on."""
    if everything:
        return candidates
    return candidates.orderBy(F.desc("score"), "candidate_ip").limit(limit)


def bulk_verdict(
    ids: DataFrame, candidates: DataFrame, verdict: str, confidence: str, note: str, actor: str,
    now: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Result per requested id, the decisions to append and the actions to append."""
    if verdict not in VERDICTS or confidence not in CONFIDENCES or not note:
        raise ValueError("unknown verdict or confidence, or an empty note")
    known = candidates.select("candidate_id", "candidate_ip", F.lit(True).alias("__known"))
    found = ids.select("candidate_id").join(known, "candidate_id", "left")
    hit = F.coalesce("__known", F.lit(False))
    results = found.select(
        "candidate_id",
        F.when(hit, "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(~hit, "NOT_FOUND").alias("code"),
    )
    decision_id = F.sha2(F.concat_ws("|", "candidate_id", F.lit(verdict), F.lit(now)), 256)
    decisions = found.filter(hit).select(
        decision_id.alias("id"),
        "candidate_id",
        "candidate_ip",
        F.lit(verdict).alias("verdict"),
        F.lit(confidence).alias("confidence"),
        F.lit(note).alias("note"),
        F.lit("BULK_MANUAL").alias("origin"),
        F.lit(actor).alias("created_by"),
        F.lit(now).alias("created_at"),
    )
    actions = decisions.filter(F.col("verdict") == "CONFIRMED_C2").select(
        F.concat(F.lit("action-"), "id").alias("id"),
        "candidate_id",
        F.col("id").alias("verdict_id"),
        "candidate_ip",
        F.lit("PENDING").alias("status"),
        "created_by",
        "created_at",
    )
    return results, decisions, actions


def bulk_summary(results: DataFrame) -> DataFrame:
    ok, bad = F.count_if(F.col("status") == "SUCCEEDED"), F.count_if(F.col("status") == "FAILED")
    return results.agg(
        F.when(bad == 0, "COMPLETED").otherwise("PARTIAL").alias("status"),
        F.count(F.lit(1)).alias("total"),
        ok.alias("succeeded"),
        bad.alias("failed"),
    )


def candidates_of_jobs(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates whose job still exists, with the job's name."""
    named = jobs.select(F.col("id").alias("job_id"), F.col("name").alias("job_name"))
    return candidates.join(named, "job_id")
