"""Structured Streaming versions of ingest, sessionization, liveness and rolling profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netsift.operators.roles import orient
from netsift.sources.flows import BATCH_KEY, ROW_KEY, read_or_empty, write_flows

LATE = "65 seconds"
SESSION_KEY = ["sensor_id", "direction", "source_ip", "destination_ip", "source_port",
               "destination_port", "protocol"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_stream(records: DataFrame, delay: str = LATE) -> DataFrame:
    """Each (sensor, batch, index) once within the allowed lateness."""
    return records.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        [*BATCH_KEY, "record_index"]
    )


def start_ingest(records: DataFrame, table: str, ledger: str, checkpoint: str):
    """Append every record once to the flow table, however often its batch is delivered.

    Each micro-batch drops rows that the table already holds (same sensor, batch and index, looked
    up only in the day folders the micro-batch touches). So a repeated delivery, a replayed
    micro-batch and a batch spread over several files all end with each record stored once.
    """

    def append(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        unique = batch.dropDuplicates(ROW_KEY)
        day = F.to_date("timestamp")
        span = batch.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
        layout = "sensor_id string, batch_id string, record_index bigint, event_date date"
        near = F.col("event_date").between(span.lo, span.hi)
        stored = lambda: read_or_empty(spark, table, layout).filter(near)
        fresh = unique.withColumn("record_index", F.col("record_index").cast("bigint")).join(
            stored().select(*ROW_KEY), ROW_KEY, "left_anti"
        )
        write_flows(fresh, table)
        # The ledger states what the table holds by now, so a replay states the same again.
        entries = (
            stored()
            .join(unique.select(*BATCH_KEY).distinct(), BATCH_KEY, "left_semi")
            .groupBy(*BATCH_KEY)
            .agg(F.count(F.lit(1)).alias("record_count"), F.current_timestamp().alias("ingested_at"))
        )
        entries.write.mode("append").parquet(ledger)

    return (
        records.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sessions_stream(packets: DataFrame, idle_seconds: int = 60, delay: str = LATE) -> DataFrame:
    """Flows of packets per key; a pause of the idle time or more closes a flow.

    The built-in session window merges at an equal gap, so its gap is one microsecond shorter.
    State is one partial aggregate per open flow.
    """
    gap = f"{idle_seconds * 1_000_000 - 1} microseconds"
    return (
        packets.withWatermark("timestamp", delay)
        .groupBy(*SESSION_KEY, F.session_window("timestamp", gap).alias("session"))
        .agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("total_bytes").alias("total_bytes"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.min("total_bytes").alias("min_size"),
            F.max("total_bytes").alias("max_size"),
        )
        .drop("session")
    )


def sync_windows_stream(
    flows: DataFrame, offsets: DataFrame | None = None, window: str = "2 seconds", delay: str = LATE
) -> DataFrame:
    """Exact distinct hosts per candidate and tumbling window, on times corrected by sensor offsets.

    Hosts are states of their own first, so a window with very many hosts is spread out; a second
    aggregation counts them. The rule of at least three hosts is the reader's filter on ``hosts``.
    """
    rows = orient(flows)
    if offsets is not None:
        rows = corrected_stream(rows, offsets)
    per_host = rows.withWatermark("timestamp", delay).groupBy(
        "candidate_ip", "host_ip", F.window("timestamp", window).alias("w")
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_host.groupBy("candidate_ip", F.window("w", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("flows"))
        .select("candidate_ip", F.col("w.start").alias("start"), "hosts", "flows")
    )


def write_closing_row(rows: DataFrame, folder: str) -> None:
    """One row a year after the others, as a file of its own.

    Event-time operators emit what the watermark has passed. A finished source that ends with such
    a row gives its last windows and sessions too; the row's own window stays open.
    """
    last = rows.agg(F.max("timestamp")).scalar()
    one = rows.filter(F.col("direction").isin("INBOUND", "OUTBOUND")).limit(1)
    closing = one.withColumn("timestamp", last + F.make_dt_interval(F.lit(365)))
    if "ts_us" in rows.columns:
        closing = closing.withColumn("ts_us", F.unix_micros("timestamp"))
    closing.select(*rows.columns).coalesce(1).write.parquet(folder)


def corrected_stream(flows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Subtract the clock offset of each sensor (stream–static join on the sensor table)."""
    shift = F.coalesce(F.col("clock_offset_ms"), F.lit(0.0)) * 1000
    micros = (F.unix_micros("timestamp") - shift).cast("bigint")
    joined = flows.join(offsets.select("sensor_id", "clock_offset_ms"), "sensor_id", "left")
    return joined.withColumn("timestamp", F.timestamp_micros(micros)).drop("clock_offset_ms")


def profile_stream(flows: DataFrame) -> DataFrame:
    """Running totals per candidate (update mode)."""
    return orient(flows).groupBy("candidate_ip").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum("packet_count").alias("total_packets"),
        F.sum("total_bytes").alias("total_bytes"),
        F.max("timestamp").alias("last_seen"),
    )


class Liveness(StatefulProcessor):
    """Latest heartbeat per sensor; a timer reports OFFLINE after the silence limit."""

    def __init__(self, timeout_seconds: int) -> None:
        self.timeout_ms = timeout_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator:
        seen = [f[["ms", "status"]] for f in rows]
        newest = pd.concat(seen).sort_values("ms").iloc[-1]
        before = self.last.get()
        if before is None or newest["ms"] >= before[0]:
            if before is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            self.last.update((int(newest["ms"]), str(newest["status"])))
            self.handle.registerTimer(int(newest["ms"]) + self.timeout_ms + 1)
            yield pd.DataFrame(
                {"sensor_id": [key[0]], "status": [newest["status"]], "at_ms": [int(newest["ms"])]}
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        last = self.last.get()
        if last is not None and last[1] != "OFFLINE":
            self.last.update((last[0], "OFFLINE"))
            yield pd.DataFrame(
                {"sensor_id": [key[0]], "status": ["OFFLINE"],
                 "at_ms": [int(expiredTimerInfo.getExpiryTimeInMs())]}
            )

    def close(self) -> None:
        pass


def liveness_stream(heartbeats: DataFrame, timeout_seconds: int = 30, delay: str = "0 seconds"):
    """Status changes per sensor from (sensor_id, timestamp, status)."""
    rows = heartbeats.withWatermark("timestamp", delay).select(
        "sensor_id", "timestamp", F.unix_millis("timestamp").alias("ms"), "status"
    )
    return rows.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=Liveness(timeout_seconds),
        outputStructType="sensor_id string, status string, at_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


class CaptureBudget(StatefulProcessor):
    """Counts packets and bytes of a (job, sensor) share and passes rows while it lasts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "packets bigint, bytes bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator:
        packets, size = self.used.get() or (0, 0)
        for frame in rows:
            frame = frame.sort_values("packet_index")
            n = packets + pd.Series(range(1, len(frame) + 1), index=frame.index)
            total = size + frame["total_bytes"].cumsum()
            ok = (n <= frame["max_packets"]) & (total <= frame["max_bytes"])
            keep = frame[ok.cummin()]
            packets, size = packets + len(keep), size + int(keep["total_bytes"].sum())
            if len(keep) < len(frame):
                packets, size = max(packets, 2**62), max(size, 2**62)
            yield keep[["job_id", "sensor_id", "packet_index", "total_bytes"]]
        self.used.update((int(packets), int(size)))

    def close(self) -> None:
        pass


def budget_stream(packets: DataFrame) -> DataFrame:
    """Packets inside the capture budget of their (job, sensor); the shares of the sensors of a
    job come from ``quota_allocation``, so no state is shared between sensors."""
    cols = ("job_id", "sensor_id", "packet_index", "total_bytes", "max_packets", "max_bytes")
    return packets.select(*cols).groupBy("job_id", "sensor_id").transformWithStateInPandas(
        statefulProcessor=CaptureBudget(),
        outputStructType="job_id string, sensor_id string, packet_index bigint, total_bytes bigint",
        outputMode="Append",
        timeMode="None",
    )
