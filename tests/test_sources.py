import hashlib

import pytest
from pyspark.sql import functions as F

from netsift.operators import packets as pk
from netsift.operators import review as rv
from netsift.plans import bundle, evaluation, triage
from netsift.plans.scoring import active_allowlist, allowlisted
from netsift.sources import captures as cap
from netsift.sources import flows as src
from netsift.streaming import jobs as st
from tests.helpers import T0, flow, frame
from tests.test_detection import evidence

INTERNAL = ["10.0.0.0/8"]


def packet(index, protocol="TCP", src_ip="10.0.0.1", dst_ip="192.0.2.9", payload=b"", flags=None, decoded=True):
    return {"path": "a", "capture_format": "PCAP", "packet_index": index, "link_type": 1, "ts_us": int(T0.timestamp()) * 10**6 + index,
            "captured_length": 40 + len(payload), "decoded": decoded, "ip_version": 4, "source_ip": src_ip,
            "destination_ip": dst_ip, "source_port": 40000, "destination_port": 443, "protocol": protocol,
            "payload": payload, "flag_bits": flags}


def test_packet_rows(spark):
    rows = [packet(0, "UDP", payload=b"abcdef"), packet(1, src_ip="192.0.2.9", dst_ip="10.0.0.1", flags=0x12),
            packet(2, flags=0x10, payload=b"GET /"), packet(3, decoded=False),
            packet(4, "ICMP", src_ip="192.0.2.1", dst_ip="192.0.2.2")]
    full = [{name: r.get(name) for name in cap.PACKET.names} for r in rows]
    packets = spark.createDataFrame(full, cap.PACKET)
    out = cap.flow_rows(packets, "s1", INTERNAL, 4).orderBy("packet_index").collect()
    assert [(r.protocol, r.direction) for r in out] == [
        ("UDP", "OUTBOUND"), ("TCP", "INBOUND"), ("TCP", "OUTBOUND"), ("ICMP", "UNKNOWN")]
    assert (out[1].tcp_syn_ack_count, out[1].tcp_syn_only_count, out[1].payload_hash) == (1, 0, None)
    assert (out[2].tcp_ack_only_count, out[2].payload_sample_hex) == (1, b"GET ".hex())
    assert out[0].payload_hash == hashlib.sha256(b"abcdef").hexdigest() and out[0].tcp_flags is None
    s = cap.capture_summary(packets).first()
    assert (s.captured_packet_count, s.parsed_packet_count, s.skipped_packet_count) == (5, 4, 1)
    cut = cap.capture_summary(packets, 3).first()
    assert (cut.captured_packet_count, cut.truncated) == (3, True)
    assert cap.find_packet(packets, F.col("protocol") == "TCP").first().packet_index == 1
    assert cap.find_packet(packets, F.col("protocol") == "SCTP").count() == 0
    none = cap.capture_summary(packets.filter("packet_index = 3")).first()
    assert none.error == "NO_SUPPORTED_IP_PACKETS"


def test_scan_budget_takes_equal_times_in_id_order(spark):
    at = "timestamp_micros(1000000 * (n div 3000))"
    files = spark.range(9_000).selectExpr("id AS n").selectExpr(
        "lpad(string(n), 6, '0') AS id", f"{at} AS uploaded_at", "1L AS byte_count", "2L AS packet_count",
        "encode(string(n), 'UTF-8') AS content", "sha2(string(n), 256) AS sha256")
    got = cap.scan_budget(files, 8_000, None).orderBy("id").collect()
    assert [r.bytes_read for r in got] == list(range(1, 9_001)) and all(r.verified for r in got)
    assert [r.id for r in got if r.reason][0] == "008000"


def test_ingest_is_idempotent(spark, tmp_path):
    table, ledger = str(tmp_path / "flows"), str(tmp_path / "ledger")
    rows = frame(spark, [flow(i) for i in range(4)]).withColumns({"batch_id": F.lit("b1"), "record_index": (F.col("ts_us") / 1_000_000).cast("bigint")})
    src.ingest_batches(spark, rows, table, ledger)
    src.ingest_batches(spark, rows.unionByName(rows.withColumn("batch_id", F.lit("b2"))), table, ledger)
    assert spark.read.parquet(table).count() == 8
    assert spark.read.parquet(ledger).orderBy("batch_id").select("record_count").collect() == [(4,), (4,)]
    snap = src.snapshot(spark, table, ["s1"], "2026-01-01T00:00:01Z", "2026-01-01T00:00:02Z")
    assert snap.count() == 4
    assert src.snapshot(spark, table, [], "2026-01-01T00:00:01Z", "2026-01-01T00:00:02Z").count() == 0
    assert src.relayout(spark, table, str(tmp_path / "monthly"), "2026-01-01T00:00:02Z") == 4
    assert src.mixed_batches(rows.unionByName(rows.withColumn("sensor_id", F.lit("s2")))).count() == 1


def test_unpublished_loads_stay_out_and_days_expire(spark, tmp_path):
    table, ledger = str(tmp_path / "flows"), str(tmp_path / "ledger")
    one = frame(spark, [flow(i) for i in range(4)]).withColumns({"batch_id": F.lit("b1"), "record_index": F.monotonically_increasing_id()})
    whole = ["s1"], "2026-01-01T00:00:00Z", "2027-01-01T00:00:00Z", ledger
    assert src.drop_expired(spark, table, "flow", "2026-02-01T00:00:00Z") == []
    src.write_flows(one.withColumn("load_id", F.lit("torn")), table)  # the ledger was never written
    assert src.snapshot(spark, table, *whole).count() == 0
    load = src.ingest_batches(spark, one, table, ledger)
    assert [r.load_id for r in src.snapshot(spark, table, *whole).select("load_id").distinct().collect()] == [load]
    src.publish(spark, table, ledger, "torn")  # a second load of the same batch: the first entry counts
    assert src.snapshot(spark, table, *whole).count() == 4
    mixed = one.withColumns({"batch_id": F.lit("b2"), "request": F.lit("r")})
    mixed = mixed.unionByName(mixed.withColumn("sensor_id", F.lit("s2")))
    pure = one.withColumns({"batch_id": F.lit("b3"), "request": F.lit("q"), "timestamp": F.col("timestamp") + F.expr("INTERVAL 3 DAYS")})
    src.ingest_batches(spark, mixed.unionByName(pure), table, ledger, "request")
    entered = src.read_or_empty(spark, ledger, src.LEDGER)
    assert {r.batch_id for r in entered.collect()} == {"b1", "b3"}
    assert src.drop_expired(spark, table, "flow", "2026-01-31T12:00:00Z") == []
    assert src.drop_expired(spark, table, "flow", "2026-02-01T00:00:00Z") == ["event_date=2026-01-01"]
    assert src.drop_expired(spark, ledger, "flow", "2026-02-01T00:00:00Z") == ["last_date=2026-01-01"]
    assert {r.batch_id for r in src.snapshot(spark, table, *whole).collect()} == {"b3"}
    assert [r.batch_id for r in src.read_or_empty(spark, ledger, src.LEDGER).collect()] == ["b3"]


def test_ledger_folders_are_written_by_many_tasks(spark, tmp_path):
    table, ledger = str(tmp_path / "flows"), str(tmp_path / "ledger")
    rows = frame(spark, [flow(86_400 * i) for i in range(40)]).withColumns(
        {"batch_id": F.concat(F.lit("b"), F.unix_date(F.to_date("timestamp"))), "record_index": F.lit(0)})
    src.ingest_batches(spark, rows, table, ledger)
    files = [f for f in (tmp_path / "ledger").glob("last_date=*/part-*.parquet")]
    assert len(files) == 40 and len({f.parent for f in files}) == 40
    assert len({f.name.split("-")[1] for f in files}) > 1
    assert src.snapshot(spark, table, ["s1"], "2025-01-01T00:00:00Z", "2027-01-01T00:00:00Z", ledger).count() == 40


def test_json_source_defaults(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"sensor_id":"s","timestamp":"2026-01-01T00:00:00Z","source_ip":"10.0.0.1"}\nbroken\n')
    rows = src.read_flow_json(spark, str(tmp_path)).collect()
    good = [r for r in rows if r.sensor_id == "s"][0]
    assert (good.packet_count, good.total_bytes, good.bidirectional, good.timestamp.year) == (1, 0, False, 2026)
    assert any(r._corrupt_record for r in rows)


def test_candidate_sink_replaces_one_job(spark, tmp_path):
    path = str(tmp_path / "c")
    one = spark.createDataFrame([("a", 1)], "candidate_ip string, score int")
    src.write_candidates(one, path, "j1")
    src.write_candidates(one, path, "j2")
    src.write_candidates(one.withColumn("score", F.lit(9)), path, "j1")
    assert sorted(map(tuple, spark.read.parquet(path).select("job_id", "score").collect())) == [("j1", 9), ("j2", 1)]


def test_allowlist_expiry_and_kinds(spark):
    entries = spark.createDataFrame(
        [("IP", "::ffff:1:2", None, True), ("CIDR", "203.0.113.128/25", "2026-02-01T00:00:00Z", True), ("DOMAIN_SUFFIX", ".bad.example", None, True),
         ("TLS_FINGERPRINT", "ff", None, True), ("IP", "203.0.113.1", "2026-02-01T00:00:00", True), ("IP", "203.0.113.2", "junk", True),
         ("IP", "203.0.113.3", None, False), ("IP", "203.0.113.4", "2026-01-01T00:00:00Z", True)],
        "type string, value string, expires_at string, enabled boolean",
    )
    now = "2026-01-01T00:00:00Z"
    assert active_allowlist(entries, now).count() == 4
    base = {"type": "COMMON_DESTINATION", "detector": "d", "contribution": 1.0}
    ips = ["203.0.113.1", "203.0.113.2", "203.0.113.3", "203.0.113.4", "203.0.113.127", "203.0.113.200", "::ffff:0001:0002", "198.51.100.1", "198.51.100.2"]
    rows = [{**base, "candidate_ip": ip} for ip in ips]
    rows[-2]["metrics"] = '{"domain": "very.BAD.example."}'
    rows[-1]["metrics"] = '{"tls_fingerprint": "ff"}'
    got = {r.candidate_ip for r in allowlisted(evidence(spark, *rows), entries, now).collect()}
    assert got == {"203.0.113.200", "::ffff:0001:0002", "198.51.100.1", "198.51.100.2"}


def test_review_filters_validate(spark):
    df = rv.decorate(frame(spark, [flow(0), flow(1, direction="UNKNOWN"), flow(2, direction="UNKNOWN", source_ip="192.0.2.1")]), "j")
    assert [r.role_source for r in df.orderBy("timestamp").collect()] == ["DIRECTION", "CIDR_FALLBACK", None]
    for bad in ({}, {"nope": 1}, {"port": 70000}, {"port": True}, {"direction": "UP"}, {"has_payload": 1}, {"candidate_ip": " "}):
        with pytest.raises(ValueError):
            rv.filter_flows(df, [bad])
    with pytest.raises(ValueError):
        rv.filter_flows(df, exclude_matches=True)
    assert rv.filter_flows(df, exclude_matches=True, direction="outbound").count() == 2
    with pytest.raises(ValueError):
        triage.candidate_page(df, "nope")


def test_policy_backtest_published_shape(spark):
    cases = spark.createDataFrame([(1, 90, True, True, False, "C2"), (2, 90, True, False, False, "C2"), (3, 70, True, False, False, "BENIGN"), (4, 90, True, True, True, "C2")],
                                  "id int, raw_score int, high_volume boolean, strong_evidence boolean, analyst_exact_match boolean, label string")
    got = {r.policy: (r.recall, r.false_positive_rate, r.analyst_queue_visible, r.exempt_case_count) for r in evaluation.backtest(cases).collect()}
    assert got == {"cap-20": (0.0, 0.0, 0, 1), "strong-evidence-cap-40": (0.5, 0.0, 1, 1), "fixed-penalty-25": (1.0, 1.0, 3, 1)}


def test_bundle_reduction_and_checks(spark):
    ev = evidence(spark, *[{"type": "COMMON_DESTINATION", "detector": f"d{i:02}", "contribution": 1.0, "description": "x" * 200} for i in range(60)])
    cands = spark.createDataFrame([("203.0.113.5", 50, "MEDIUM")], "candidate_ip string, score int, severity string")
    sums = spark.createDataFrame([("203.0.113.5", 1, 2, 3)], "candidate_ip string, flow_count bigint, packet_count bigint, total_bytes bigint")
    full = bundle.evidence_bundle(cands, ev, sums).first()
    assert len(full.evidence_ids) == 60 and full.evidence_ids[0] == "E-001" and not full.reduced
    small = bundle.evidence_bundle(cands, ev, sums, 1000)
    row = small.first()
    assert row.reduced and row.estimated_tokens <= 1000 and len(row.evidence_ids) < 20
    asked = spark.createDataFrame([("203.0.113.5", "LIKELY_C2", ["E-001"], ["E-001"]), ("203.0.113.5", "LIKELY_C2", ["E-050"], ["E-050"]), ("203.0.113.5", "INCONCLUSIVE", [], [])],
                                  "candidate_ip string, verdict string, cited_ids array<string>, supporting_ids array<string>")
    assert sorted(r.valid for r in bundle.check_assessments(asked, small).collect()) == [False, True, True]


def test_sensor_report(spark):
    states = spark.createDataFrame([("a", "OK", 3000.0, None, False), ("b", "LOST", 0.0, None, True)], "sensor_id string, status string, clock_offset_ms double, loss_reason string, failed boolean")
    r = bundle.sensor_report(states).first()
    assert (r.completion_status, r.warnings, r.confidence) == ("PARTIALLY_COMPLETED", ["CLOCK_SKEW"], 0.7)
    assert bundle.loss_report(states).first().loss_reason == "sensor data unavailable"
    assert bundle.check_sensor_lists(spark.createDataFrame([("z",)], "sensor_id string"), states).count() == 1


def test_validation_splits_rows(spark):
    good, bad = pk.validate_flows(frame(spark, [flow(0), flow(1, packet_count=0), flow(2, tcp_flags_observed=True), flow(3, payload_simhash="XY")]))
    assert good.count() == 1
    assert sorted(p for r in bad.collect() for p in r.problems) == ["observed_not_tcp", "packet_count", "payload_simhash"]


def drain(df, tmp_path, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_liveness_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    beats = [("a", 0), ("b", 0), ("b", 100)]
    rows = spark.createDataFrame([(s, T0.timestamp() + t) for s, t in beats], "sensor_id string, t double").select("sensor_id", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("timestamp"), F.lit("ONLINE").alias("status"))
    for i in range(3):
        rows.filter(F.col("timestamp") == F.timestamp_micros(F.lit(int((T0.timestamp() + (0, 50, 100)[i]) * 1e6)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.sensor_id, r.status) for r in drain(st.liveness_stream(stream), tmp_path).collect()}
    assert ("a", "OFFLINE") in got and ("b", "ONLINE") in got


def test_budget_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    rows = spark.range(20).selectExpr("'j' job_id", "concat('s', id % 2) sensor_id", "id packet_index", "10L total_bytes", "5L max_packets", "30L * (id % 2) + 1000L max_bytes")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(st.budget_stream(stream), tmp_path)
    assert sorted(map(tuple, got.groupBy("sensor_id").count().collect())) == [("s0", 5), ("s1", 5)]


def test_stream_ingest(spark, tmp_path):
    rows = frame(spark, [flow(i) for i in range(6)]).withColumns({"batch_id": F.lit("b1"), "record_index": (F.col("ts_us") / 1_000_000).cast("bigint")})
    first, second = rows.filter("record_index % 2 = 0"), rows.filter("record_index % 2 = 1")
    for part in (first, second, rows):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.start_ingest(stream, str(tmp_path / "flows"), str(tmp_path / "ledger"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "flows")).count() == 6
    assert spark.read.parquet(str(tmp_path / "ledger")).agg(F.max_by("record_count", "ingested_at")).first()[0] == 6


def test_scan_budget(spark):
    data = [(f"f{i}", i // 2, 10, 3, bytes([i]), hashlib.sha256(bytes([i if i != 2 else 9])).hexdigest()) for i in range(6)]
    files = spark.createDataFrame(data, "id string, t long, byte_count long, packet_count long, content binary, sha256 string").withColumn("uploaded_at", F.timestamp_seconds("t"))
    rows = cap.scan_budget(files, 35, 8).orderBy("id").collect()
    assert [r.reason for r in rows] == [None, None, "SOURCE_PACKET_LIMIT", "SOURCE_BYTE_LIMIT", "SOURCE_BYTE_LIMIT", "SOURCE_BYTE_LIMIT"]
    assert [r.verified for r in rows] == [True, True, False, True, True, True]
