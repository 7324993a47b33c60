"""The driver tables as engine inputs, in SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.schema import as_flows
from netsift.session import materialize

#: The flow view begins at START; times grow with the table, so ``time_span`` may reach beyond both.
START, END = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dialect(engine: str) -> dict:
    if engine == "spark":
        return {
            "us": "unix_micros(CAST(ts AS TIMESTAMP))",
            "sha": lambda e: f"sha2({e}, 256)",
            "arr": lambda *x: f"array({', '.join(x)})",
            "none": "CAST(array() AS array<int>)",
        }
    return {
        "us": "epoch_us(ts)",
        "sha": lambda e: f"sha256({e})",
        "arr": lambda *x: f"[{', '.join(f'CAST({v} AS INTEGER)' for v in x)}]",
        "none": "CAST([] AS INTEGER[])",
    }


def flow_sql(engine: str, source: str = "events") -> str:
    """Every event as one flow; each tenth of the events plays one part (k)."""
    d = _dialect(engine)
    sha, arr, none = d["sha"], d["arr"], d["none"]
    out = "NOT (k IN (2, 7) OR (k IN (8, 9) AND slot % 2 = 1))"
    return f"""
WITH e AS (
  SELECT event_id, user_id, {d['us']} AS real_us, event_id % 10 AS k,
         CAST(floor(event_id / 10) AS BIGINT) AS slot
  FROM {source}),
b AS (
  SELECT *, CAST(1704067200000000 AS BIGINT) AS base, CAST(floor(slot / 12) AS BIGINT) AS s12,
         slot % 12 AS h12, CAST(floor(slot / 5) AS BIGINT) AS s5, slot % 5 AS h5,
         CASE WHEN {out} THEN 1 ELSE 0 END AS is_out
  FROM e),
r AS (
  SELECT *,
    CASE WHEN k = 0 THEN concat('10.0.0.', h12 + 1) WHEN k = 1 THEN '10.0.1.1'
         WHEN k IN (2, 3) THEN concat('10.0.2.', h5 + 1) WHEN k = 7 THEN concat('10.0.4.', slot % 20 + 1)
         WHEN k = 9 AND slot % 7 = 0 THEN '192.0.2.250'
         ELSE concat('10.0.', k, '.', user_id % 200 + 1) END AS inner_ip,
    CASE WHEN k = 0 THEN '203.0.113.10' WHEN k = 1 THEN '203.0.113.20' WHEN k = 2 THEN '203.0.113.30'
         WHEN k = 3 THEN '198.51.100.20' WHEN k = 4 THEN '192.0.2.53' WHEN k = 5 THEN '192.0.2.80'
         WHEN k = 6 THEN '192.0.2.200' WHEN k = 7 THEN '198.51.100.99'
         ELSE concat('192.0.2.', 100 + user_id % 60) END AS outer_ip,
    CASE WHEN k IN (0, 5, 6, 8) THEN 443 WHEN k = 1 THEN 8443 WHEN k = 2 THEN 4444 WHEN k = 3 THEN 80
         WHEN k = 4 THEN 53 WHEN k = 7 THEN 50000 + slot % 1000
         WHEN slot % 3 = 0 THEN 123 ELSE NULL END AS outer_port,
    CASE WHEN k = 0 THEN 40000 + h12 WHEN k = 1 THEN 41000 + slot % 3 WHEN k = 2 THEN 5000
         WHEN k = 3 THEN 42000 + h5 WHEN k = 4 THEN 43000 + user_id % 7 WHEN k = 5 THEN NULL
         WHEN k = 6 THEN 44000 + user_id % 5 WHEN k = 7 THEN 22 WHEN k = 8 THEN 45000 + user_id % 7
         ELSE 46000 END AS inner_port,
    CASE WHEN k = 0 THEN {sha("'beacon'")} WHEN k = 1 AND slot % 8 = 7 THEN {sha("concat('r', slot)")}
         WHEN k = 1 THEN {sha("'ping'")} WHEN k = 2 THEN {sha("'cmd'")}
         WHEN k = 8 THEN {sha("concat('u', user_id % 5)")}
         WHEN k = 9 AND slot % 5 = 0 THEN {sha("concat('z', slot % 40)")} ELSE NULL END AS first_hash,
    CASE WHEN k = 1 OR (k = 8 AND user_id % 4 <> 0) OR k IN (6, 7) THEN 1 ELSE 0 END AS obs
  FROM b),
c AS (
  SELECT *,
    CASE WHEN obs = 0 THEN 0 WHEN k IN (1, 7) THEN 1 WHEN k = 6 AND slot % 10 = 0 THEN 1
         WHEN k = 8 AND is_out = 1 AND user_id % 3 <> 0 THEN 1 ELSE 0 END AS syn_only,
    CASE WHEN obs = 1 AND k = 8 AND is_out = 0 AND user_id % 3 <> 0 THEN 1 ELSE 0 END AS syn_ack,
    CASE WHEN obs = 0 THEN 0 WHEN k = 1 THEN 2 WHEN k = 6 THEN 1990
         WHEN k = 8 AND is_out = 1 AND user_id % 3 = 1 THEN 1 ELSE 0 END AS ack_only
  FROM r)
SELECT event_id AS flow_no,
  CASE WHEN k = 0 THEN (CASE WHEN h12 % 2 = 0 THEN 'sensor-a' ELSE 'sensor-b' END)
       WHEN event_id % 3 = 0 THEN 'sensor-a' ELSE 'sensor-b' END AS sensor_id,
  CASE WHEN k = 0 THEN base + s12 * 30000000 + h12 * 1000 + ((event_id * 7919) % 7 - 3) * 100000
       WHEN k = 1 THEN base + slot * 60000000
       WHEN k = 2 THEN base + 3600000000 + s5 * 600000000 + h5 * 1000
       WHEN k = 3 THEN base + 3605000000 + (slot % 20) * 100000
       ELSE real_us END AS ts_us,
  CASE WHEN is_out = 1 THEN inner_ip ELSE outer_ip END AS source_ip,
  CASE WHEN is_out = 1 THEN outer_ip ELSE inner_ip END AS destination_ip,
  CAST(CASE WHEN is_out = 1 THEN inner_port ELSE outer_port END AS INT) AS source_port,
  CAST(CASE WHEN is_out = 1 THEN outer_port ELSE inner_port END AS INT) AS destination_port,
  CASE WHEN k IN (1, 6, 7, 8) THEN 'TCP' ELSE 'UDP' END AS protocol,
  CASE WHEN k = 9 THEN 'UNKNOWN' WHEN is_out = 1 THEN 'OUTBOUND' ELSE 'INBOUND' END AS direction,
  CAST(CASE WHEN k = 3 THEN 50 WHEN k = 6 THEN 2000 WHEN k = 1 THEN 3 ELSE 1 END AS BIGINT) AS packet_count,
  CAST(CASE WHEN k = 6 THEN 2000000 + (event_id % 100) * 1000 WHEN k = 3 THEN 5000 WHEN k = 0 THEN 64
       WHEN k = 1 THEN 360 ELSE 60 + (event_id * 31) % 400 END AS BIGINT) AS total_bytes,
  first_hash AS payload_hash,
  CASE WHEN k = 1 AND slot % 2 = 0 THEN {sha("'ping-tail'")} ELSE first_hash END AS last_payload_hash,
  CASE WHEN k = 1 THEN {sha("'pre'")} WHEN k = 0 THEN {sha("'beacon'")}
       WHEN k = 8 THEN {sha("concat('p', user_id % 5)")} ELSE NULL END AS payload_prefix_hash,
  CAST(CASE WHEN first_hash IS NULL THEN NULL WHEN k = 0 THEN 6 WHEN k = 1 THEN 100 + slot % 40
       WHEN k = 2 THEN 3 WHEN k = 8 THEN 200 + user_id % 90 ELSE 10 END AS INT) AS payload_length,
  CAST(CASE WHEN first_hash IS NULL THEN NULL WHEN k = 0 THEN 2.5 WHEN k = 1 THEN 3 + (slot % 16) * 0.125
       WHEN k = 2 THEN 1.5 WHEN k = 8 THEN 5 + (user_id % 8) * 0.125 ELSE 4 END AS DOUBLE) AS payload_entropy,
  CAST(CASE WHEN first_hash IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE 0.5 END AS DOUBLE) AS payload_printable_ratio,
  CASE WHEN first_hash IS NULL THEN NULL
       WHEN k = 1 THEN concat('e627bf19152d67b', substr('0123456789abcdef', CAST(slot % 16 + 1 AS INT), 1))
       WHEN k = 0 THEN 'e627bf19152d67b3' WHEN k = 2 THEN '08f14f07b58deb1a'
       ELSE substr({sha("concat('s', user_id % 5)")}, 1, 16) END AS payload_simhash,
  CASE WHEN first_hash IS NULL THEN NULL ELSE '1' END AS payload_feature_version,
  CASE WHEN k = 8 THEN {sha("concat('t', user_id % 3)")} WHEN k = 5 THEN {sha("'cdn'")}
       ELSE NULL END AS tls_fingerprint,
  CASE WHEN k = 8 AND user_id % 2 = 0 THEN {sha("'cert'")} ELSE NULL END AS certificate_fingerprint,
  CASE WHEN k = 1 THEN 'c.example.org.' WHEN k = 4 THEN concat('Q', slot % 30, '.Example.NET')
       WHEN k = 5 THEN concat('h', slot % 50, '.cdn.example.com')
       WHEN k = 8 THEN concat('site', user_id % 10, '.example.com') ELSE NULL END AS domain,
  CASE WHEN k = 0 THEN {arr('64')} WHEN k = 1 THEN {arr('120', '240')}
       WHEN k = 8 THEN {arr('60', 'CAST(60 + (user_id % 7) * 10 AS INT)')} ELSE {none} END AS packet_sizes,
  CASE WHEN k = 3 THEN '198.51.100.20' ELSE NULL END AS attack_target_ip,
  CAST(CASE WHEN k = 6 THEN 30 WHEN k = 8 THEN (event_id % 4) * 0.5 ELSE 0 END AS DOUBLE) AS duration_seconds,
  obs = 1 AS tcp_flags_observed,
  CAST(syn_only + syn_ack AS BIGINT) AS tcp_syn_count,
  CAST(syn_ack + ack_only AS BIGINT) AS tcp_ack_count,
  CAST(0 AS BIGINT) AS tcp_rst_count,
  CAST(syn_only AS BIGINT) AS tcp_syn_only_count,
  CAST(syn_ack AS BIGINT) AS tcp_syn_ack_count,
  CAST(ack_only AS BIGINT) AS tcp_ack_only_count,
  (k = 1 OR (k = 6 AND slot % 2 = 0)) AS bidirectional
FROM c"""


_TABLES: dict[tuple[str, str], DataFrame] = {}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table, derived from ``events`` once per session and stored as Parquet.

    The engine reads flows from a table that ingest wrote; storing the view gives every query the
    same plain columnar scan, with pruned columns and pushed filters.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        # The narrow source rows are spread before the wide projection, which then runs everywhere.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        events = table(spark, sf_dir, "events").repartition(parts, "event_id")
        laid_out = flow_view(spark, events).sortWithinPartitions("sensor_id", "ts_us")
        _TABLES[key] = materialize(laid_out, "flows")
    return _TABLES[key]


def time_span(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Start and end of the analysis: START and END, or the times of the first and the last flow beyond them."""
    first, last = flows(spark, sf_dir).agg(F.min("ts_us"), F.max("ts_us")).first()
    told = [
        (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        for us in (first, last)
        if us is not None
    ]
    return min([START, *told]), max([END, *told])


def flow_view(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The flow view as an engine input."""
    df = spark.sql(flow_sql("spark", "{events}"), events=events)
    flags = F.create_map(
        F.lit("ack"), F.col("tcp_ack_count"), F.lit("rst"), F.col("tcp_rst_count"),
        F.lit("syn"), F.col("tcp_syn_count"),
    )
    return as_flows(
        df.withColumn("timestamp", F.timestamp_micros("ts_us")).withColumn(
            "tcp_flags", F.when(F.col("tcp_flags_observed"), flags)
        )
    )


# Further inputs in SQL text for both engines; ``{name}`` stands for a driver table.
CANDIDATES = """
SELECT concat('cand-', c_custkey) AS candidate_id,
  concat('203.', c_custkey % 4, '.', CAST(floor(c_custkey / 256) AS BIGINT) % 256, '.', c_custkey % 256) AS candidate_ip,
  CAST((c_custkey * 7919) % 101 AS INT) AS score,
  CASE WHEN (c_custkey * 7919) % 101 >= 80 THEN 'CRITICAL' WHEN (c_custkey * 7919) % 101 >= 60 THEN 'HIGH'
       WHEN (c_custkey * 7919) % 101 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  c_custkey % 13 = 0 AS excluded, concat('job-', c_custkey % 50) AS job_id,
  concat('2024-01-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR(2)), 2, '0'), 'T00:00:00Z') AS last_seen
FROM {customer}"""
DAY = "substr(CAST({0} AS VARCHAR(30)), 1, 10)"
DECISIONS = f"""
SELECT concat('d-', o_orderkey) AS id, concat('cand-', o_custkey) AS candidate_id,
  CASE WHEN o_orderstatus = 'F' THEN 'CONFIRMED_C2' WHEN o_orderstatus = 'O' THEN 'UNDER_REVIEW' ELSE 'FALSE_POSITIVE' END AS verdict,
  CASE WHEN o_orderkey % 23 = 0 THEN 'SURE' WHEN o_orderkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE o_orderpriority END AS note, 'analyst' AS created_by,
  concat({DAY.format('o_orderdate')}, 'T', lpad(CAST(o_orderkey % 24 AS VARCHAR(2)), 2, '0'), ':00:00',
         CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Z' END) AS created_at
FROM {{orders}}"""
ACTIONS = f"""
SELECT concat('a-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, concat('cand-', o_custkey) AS candidate_id,
  concat('d-', l_orderkey) AS verdict_id,
  CASE WHEN l_returnflag = 'N' THEN 'PENDING' WHEN l_linestatus = 'O' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status,
  concat({DAY.format('l_shipdate')}, 'T00:00:00Z') AS created_at
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""
JOBS = f"""
SELECT concat('job-', o_orderkey) AS id, concat('Run ', o_orderpriority, ' ', o_orderkey % 1000) AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'FAILED'
       WHEN o_orderstatus = 'P' THEN 'PARTIALLY_COMPLETED' WHEN o_orderkey % 3 = 0 THEN 'ANALYZING' ELSE 'CAPTURING' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PCAP' ELSE 'LIVE' END AS source_type, '' AS description,
  o_orderdate AS created_at, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS completed_at
FROM {{orders}}"""
FEED = """
SELECT concat('203.', o_custkey % 4, '.', CAST(floor(o_custkey / 256) AS BIGINT) % 256, '.', o_custkey % 256) AS ip,
  CASE WHEN o_orderkey % 3 = 0 THEN 'virustotal' WHEN o_orderkey % 3 = 1 THEN 'abuseipdb' ELSE 'misp' END AS provider,
  CASE WHEN o_orderkey % 41 = 0 THEN 'ERROR' WHEN o_orderkey % 5 = 0 THEN 'NOT_CONFIGURED' ELSE 'OK' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS malicious,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END AS suspicious,
  CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 100 END AS abuse_confidence_score,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 3 END AS event_count, o_orderdate AS fetched_at
FROM {orders}"""
SENSORS = """
SELECT concat('sensor-', user_id) AS sensor_id, concat('site ', user_id % 40) AS name, max(ts) AS last_heartbeat_at,
  CAST(max(event_id) % 5000 AS DOUBLE) - 2500 AS clock_offset_ms, 'ONLINE' AS reported_status, 'ONLINE' AS status,
  CAST(count(*) * 1000 AS BIGINT) AS received_packets, CAST(sum(event_id % 40) AS BIGINT) AS dropped_packets
FROM {events} GROUP BY user_id"""
SIGHTINGS = """
SELECT concat('c-', user_id, '-', event_type) AS candidate_id, min(ts) AS first_seen,
  CASE WHEN user_id % 10 = 0 THEN 'CRITICAL' WHEN user_id % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity
FROM {events} GROUP BY user_id, event_type"""
CASES = """
SELECT lang AS model_profile, toxic = 1 AS expected_malicious,
  CASE WHEN d.doc_id % 4 = 0 THEN 'LIKELY_C2' WHEN d.doc_id % 4 = 1 THEN 'SUSPICIOUS'
       WHEN quality = 1 THEN 'LIKELY_BENIGN' ELSE 'INCONCLUSIVE' END AS predicted_verdict,
  CAST((d.doc_id % 101) / 100.0 AS DOUBLE) AS confidence, d.doc_id % 9 <> 0 AS evidence_valid,
  d.doc_id % 31 = 0 AS unsafe_recommendation, CAST(n_chars AS DOUBLE) AS latency_ms, n_chars AS input_tokens,
  d.doc_id % 500 AS output_tokens, CAST((d.doc_id % 7) * 0.125 AS DOUBLE) AS estimated_cost_usd
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
POLICY_CASES = """
SELECT o_orderkey AS id, CAST(o_orderkey % 101 AS INT) AS raw_score, o_totalprice > 100000 AS high_volume,
  o_orderstatus = 'F' AS strong_evidence, o_orderkey % 10 = 0 AS analyst_exact_match,
  CASE WHEN o_custkey % 3 = 0 THEN 'C2' ELSE 'BENIGN' END AS label
FROM {orders}"""
# Up to three labels per flow, one branch for each.
FLOW_LABELS = " UNION ALL ".join(
    f"""
SELECT concat('l-', doc_id, '-{n}') AS id, 'job-1' AS job_id, doc_id AS flow_id,
  CASE WHEN (toxic + {n}) % 2 = 1 THEN 'C2' ELSE 'BENIGN' END AS verdict, 'HIGH' AS confidence,
  concat('2024-02-', lpad(CAST({n} + doc_id % 9 + 1 AS VARCHAR(2)), 2, '0'), 'T00:00:00Z') AS created_at
FROM {{labels}} WHERE {n} <= quality + toxic"""
    for n in range(3)
)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the inputs above as a DataFrame."""
    names = {n for n in ("customer", "orders", "lineitem", "events", "documents", "labels")
             if "{" + n + "}" in sql}
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    for n in ("customer", "orders", "lineitem", "events", "documents", "labels"):
        sql = sql.replace("{" + n + "}", n)
    return sql
