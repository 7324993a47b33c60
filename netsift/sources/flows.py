"""Flow tables: reading, idempotent ingest, snapshots, retention and layout."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import UTC, date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.operators.ranking import with_position
from netsift.params import RETENTION_DAYS
from netsift.schema import FLOW, FLOW_DEFAULTS, SENSITIVE_FIELDS, as_flows, conform

BATCH_KEY = ["sensor_id", "batch_id"]
ROW_KEY = [*BATCH_KEY, "record_index"]
DAY_KEYS = ("event_date", "last_date")
LEDGER = (
    "sensor_id string, batch_id string, record_count bigint, ingested_at timestamp, "
    "load_id string, last_date date"
)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows when it does not exist yet; other failures are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_flow_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one flow per line. Missing fields get defaults; bad lines keep their text."""
    schema = T.StructType([*FLOW.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return conform(rows, FLOW, FLOW_DEFAULTS)


def new_batches(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of batches not yet in the ledger, one for each index of a batch.

    ``records`` carry sensor_id, batch_id, record_index.
    """
    known = ledger.select(*BATCH_KEY).distinct()
    return records.dropDuplicates(ROW_KEY).join(known, BATCH_KEY, "left_anti")


def batch_results(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per delivered batch: accepted or not, and the count (the stored one when repeated)."""
    sent = (
        records.dropDuplicates(ROW_KEY)
        .groupBy(*BATCH_KEY)
        .agg(F.count(F.lit(1)).alias("sent"))
    )
    stored = ledger.groupBy(*BATCH_KEY).agg(
        F.max_by("record_count", "ingested_at").alias("stored")
    )
    return sent.join(stored, BATCH_KEY, "left").select(
        *BATCH_KEY,
        F.col("stored").isNull().alias("accepted"),
        F.coalesce("stored", "sent").alias("record_count"),
    )


def mixed_batches(records: DataFrame, by: str = "batch_id") -> DataFrame:
    """Values of ``by`` whose records name more than one sensor; they are rejected as a whole."""
    return (
        records.groupBy(by)
        .agg(F.min("sensor_id").alias("a"), F.max("sensor_id").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select(by)
    )


def ingest_batches(
    spark: SparkSession, records: DataFrame, table: str, ledger_path: str, request: str | None = None
) -> str:
    """Append new batches to the day-partitioned flow table, then publish them in the ledger.

    Rows go to folders of this load. The ledger names the load of each batch and is written last,
    from the rows that are stored, so a failure in between leaves rows no ``snapshot`` with the
    ledger shows, and the batch may be sent again. Where two loads bring a batch at the same time
    the first in the ledger counts. ``request`` names the column of the delivery a record came in;
    deliveries that mix sensors are refused. Returns the id of the load.
    """
    load = uuid.uuid4().hex
    if request:
        records = records.join(mixed_batches(records, request), request, "left_anti")
    rows = new_batches(records, read_or_empty(spark, ledger_path, LEDGER))
    write_flows(rows.withColumn("load_id", F.lit(load)), table)
    publish(spark, table, ledger_path, load)
    return load


def publish(spark: SparkSession, table: str, ledger_path: str, load: str) -> None:
    """Enter the batches of a stored load in the ledger, in a folder by the last day of their rows.

    Entries are few but their folders grow with the days, so folders are dealt over the tasks by number;
    by size they would all be written one after the other in one task.
    """
    stored = read_or_empty(
        spark, table, "sensor_id string, batch_id string, event_date date, load_id string"
    )
    (
        stored.filter(F.col("load_id") == load)
        .groupBy(*BATCH_KEY)
        .agg(F.count(F.lit(1)).alias("record_count"), F.max("event_date").alias("last_date"))
        .withColumns({"ingested_at": F.current_timestamp(), "load_id": F.lit(load)})
        .repartition(spark.sparkContext.defaultParallelism, "last_date")
        .write.partitionBy("last_date")
        .mode("append")
        .parquet(ledger_path)
    )


def published(ledger: DataFrame) -> DataFrame:
    """The load that counts for each batch: the first one entered."""
    first = F.min_by("load_id", F.struct("ingested_at", "load_id"))
    return ledger.groupBy(*BATCH_KEY).agg(first.alias("load_id"))


def write_flows(rows: DataFrame, table: str, mode: str = "append") -> None:
    """One folder per day (and load, if rows carry one); sorted inside files so that sensor and
    time filters skip row groups.

    Rebalancing lets AQE split the partition of a busy sensor and merge those of quiet ones.
    """
    folders = ["event_date", *(["load_id"] if "load_id" in rows.columns else [])]
    (
        rows.withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "event_date", "sensor_id")
        .sortWithinPartitions(*folders, "sensor_id", "timestamp")
        .write.partitionBy(*folders)
        .mode(mode)
        .parquet(table)
    )


def snapshot(
    spark: SparkSession,
    table: str,
    sensors: Iterable[str],
    start: str,
    end: str,
    ledger_path: str | None = None,
) -> DataFrame:
    """Flows of the named sensors in an inclusive time range (none named: no rows).

    With the ledger only published loads are read; without it every stored row of a batch index
    counts once.
    """
    df = spark.read.parquet(table)
    names = sorted(set(sensors))
    if not names:
        return df.limit(0)
    lo, hi = (F.lit(x).cast("timestamp") for x in (start, end))
    rows = df.filter(
        F.col("event_date").between(F.to_date(lo), F.to_date(hi))
        & F.col("timestamp").between(lo, hi)
        & F.col("sensor_id").isin(names)
    )
    if ledger_path:
        ledger = read_or_empty(spark, ledger_path, LEDGER).filter(F.col("sensor_id").isin(names))
        return rows.join(published(ledger), [*BATCH_KEY, "load_id"], "left_semi")
    if "batch_id" in df.columns:
        rows = rows.dropDuplicates(ROW_KEY)
    return rows


def dataset_counts(flows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    return flows.groupBy(*by).agg(
        F.sum(F.coalesce("packet_count", F.lit(1))).alias("packet_count"),
        F.count(F.lit(1)).alias("flow_count"),
    )


def unexpired(df: DataFrame, kind: str, now: str, time_column: str = "timestamp") -> DataFrame:
    """Rows still inside their retention time; on a day-partitioned table also prunes folders."""
    days = RETENTION_DAYS[kind]
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    kept = df.filter(F.col(time_column) >= cutoff)
    if "event_date" in df.columns:
        kept = kept.filter(F.col("event_date") >= F.to_date(cutoff))
    return kept


def drop_expired(spark: SparkSession, path: str, kind: str, now: str) -> list[str]:
    """Delete the day folders of a partitioned table that lie wholly before the retention time.

    For a flow table these are days of flows, for the ledger the last day of a batch, so a batch
    stays entered as long as one of its days is stored. Rows of the day on which the limit falls
    stay; readers filter them by ``unexpired``. Returns the names of the deleted folders.
    """
    limit = datetime.fromisoformat(now).astimezone(UTC) - timedelta(days=RETENTION_DAYS[kind])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    dropped = []
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        key, _, day = name.partition("=")
        if key in DAY_KEYS and _is_day(day) and day < limit.date().isoformat():
            files.delete(entry.getPath(), True)
            dropped.append(name)
    return sorted(dropped)


def _is_day(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def relayout(spark: SparkSession, source: str, target: str, cutoff: str) -> int:
    """Copy rows from ``cutoff`` on into a month-partitioned, sorted table; checks the row count.

    The caller switches readers to ``target`` afterwards; the source stays untouched.
    """
    rows = spark.read.parquet(source).filter(F.col("timestamp") >= F.lit(cutoff).cast("timestamp"))
    order = [c for c in ("sensor_id", "timestamp", "batch_id", "record_index") if c in rows.columns]
    (
        rows.withColumn("event_month", F.date_format("timestamp", "yyyy-MM"))
        .repartitionByRange("event_month", *order)
        .sortWithinPartitions("event_month", *order)
        .write.partitionBy("event_month")
        .parquet(target)
    )
    before, after = rows.count(), spark.read.parquet(target).count()
    if before != after:
        raise RuntimeError(f"row counts differ: {before} read, {after} written")
    return after


def write_candidates(candidates: DataFrame, path: str, job_id: str) -> None:
    """Candidates of a job with their ``position`` by score, then address, replacing those of an earlier run of
    the same job only."""
    (
        with_position(candidates.drop("position"), [F.desc("score"), "candidate_ip"])
        .withColumn("job_id", F.lit(job_id))
        .write.partitionBy("job_id")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def ready_for_analysis(flows: DataFrame) -> DataFrame:
    return as_flows(flows.drop(*SENSITIVE_FIELDS))
