"""Queries on review, triage, dashboards, packets, evaluation, payloads and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.ranking import with_position
from netsift.functions import net
from netsift.functions.payload import simhash_distance, with_payload_features
from netsift.operators import packets as pk
from netsift.operators import review as rv
from netsift.operators import traffic as tr
from netsift.operators.roles import classify_direction
from netsift.operators.detectors.signature import comparison_rows
from netsift.operators.detectors.timing import command_reactions, commands
from netsift.plans import bundle, dashboard, evaluation, guidance, prefilter, triage
from netsift.plans.detection import evidence_hosts
from netsift.plans.registry import DetectorRegistry, evidence_problems
from netsift.plans.scoring import allowlisted, override_score, score_candidates
from netsift.session import shared_dir
from netsift.sources import captures as cap
from netsift.sources import flows as src
from netsift.streaming import jobs as st
from workload import tables as tb
from workload.queries import context, evidence_table, scored_table, us
from workload.tables import flows, view

NOW_DASHBOARD = "2024-01-02T12:30:00Z"
NOW_JOBS = "2001-08-01T12:00:00Z"
NOW_FLOWS = "2024-02-20T00:00:00Z"
#: Thirty days before lie a few hours into the flows, so that the first day expires.
RETAINED_AT = "2024-02-01T06:00:00Z"
NOW_SENSORS = "2024-01-30T23:59:59Z"
ALLOWLIST = [
    ("IP", "192.0.2.80", "a", None, True),
    ("CIDR", "192.0.2.130/27", "b", "2030-01-01T00:00:00+00:00", True),
    ("CIDR", "203.0.113.0/24", "expired", "2020-01-01T00:00:00Z", True),
    ("IP", "198.51.100.20", "no offset", "2030-01-01T00:00:00", True),
    ("CIDR", "0.0.0.0/0", "disabled", None, False),
    ("CIDR", "2001:db8::/32", "other family", None, True),
]
INCLUDES = [{"candidate_ip": "192.0.2.128/26", "protocol": "tcp"}, {"port": 53}, {"has_payload": True, "direction": "inbound"}]
EXCLUDES = [{"candidate_ip": "10.0.8.7"}, {"source_port": 443, "direction": "INBOUND"}]


def allowlist(spark: SparkSession) -> DataFrame:
    schema = "type string, value string, description string, expires_at string, enabled boolean"
    return spark.createDataFrame(ALLOWLIST, schema)


def peers(spark, sf) -> DataFrame:
    ctx = context(spark, sf)
    if "prefilter" not in ctx.__dict__:
        ranked = prefilter.prefilter(ctx.oriented, trusted=("192.0.2.53",))
        ctx.__dict__["prefilter"] = ctx._table(ranked, "prefilter")
    return ctx.__dict__["prefilter"]


def q_command_reactions(spark, sf) -> DataFrame:
    ctx = context(spark, sf)
    return command_reactions(ctx.scoped, ctx.gated, commands(ctx.gated, ctx.params), ctx._table)


def known_bad(spark, sf) -> DataFrame:
    """Peers with an upheld detector hit of the strongest kinds, as ground truth."""
    strong = ("COMMAND_ATTACK_CORRELATION", "SYNCHRONIZED_COMMUNICATION", "SINGLE_HOST_BEACON")
    ev = evidence_table(context(spark, sf))
    return ev.filter(F.col("type").isin(*strong)).select("candidate_ip").distinct()


def q_prefilter(spark, sf):
    factors = lambda n: F.round(
        F.coalesce(
            F.get(F.filter("factors", lambda x: x["name"] == n), F.lit(0)).getField("points"),
            F.lit(0.0),
        ),
        2,
    )
    names = {
        "PEER_BASELINE": "baseline", "SINGLE_HOST_BEACON": "beacon", "PAYLOAD_CLUSTER": "cluster",
        "SYNCHRONIZED_CLUSTER": "sync", "ROBUST_ANOMALY": "anomaly",
    }
    return peers(spark, sf).select(
        "candidate_ip", "prefilter_score", "flow_count",
        *[factors(n).alias(a) for n, a in names.items()],
    )


def q_prefilter_topk(spark, sf):
    top = peers(spark, sf).orderBy(F.desc("prefilter_score"), "candidate_ip").limit(20)
    return top.select("candidate_ip", "prefilter_score")


def q_merge_ranking(spark, sf):
    merged = prefilter.merge_ranking(scored_table(context(spark, sf)), peers(spark, sf), "job-1")
    return merged.select(
        "candidate_ip", "score", "prefilter_score", "severity",
        F.round("rank_value", 6).alias("rank_value"), "prefilter_id",
    )


def q_review_priority(spark, sf):
    c = view(spark, sf, tb.CASES).select(
        F.col("input_tokens").alias("n"), "predicted_verdict", "confidence",
        (F.col("input_tokens") % 101).alias("score"), (F.col("output_tokens") % 101).alias("prefilter_score"),
    ).withColumn("verdict", F.when(F.col("n") % 3 != 0, F.col("predicted_verdict")))
    return prefilter.review_priority(c).groupBy("review_priority").agg(F.count(F.lit(1)).alias("n"))


def q_allowlist(spark, sf):
    ev = evidence_table(context(spark, sf))
    return allowlisted(ev, allowlist(spark), "2024-03-01T00:00:00Z").select("candidate_ip")


def touching(spark, sf):
    ctx = context(spark, sf)
    return tr.by_endpoint(ctx.scoped, scored_table(ctx))


def q_traffic_buckets(spark, sf):
    return tr.traffic_buckets(touching(spark, sf)).select(
        "candidate_ip", "bucket", "packets", "bytes", "flows"
    )


def q_traffic_summary(spark, sf):
    return tr.traffic_summary(touching(spark, sf)).select(
        "candidate_ip", F.array_join("protocols", ",").alias("protocols"),
        F.size("ports").alias("n_ports"), "flow_count", "packet_count", "byte_count",
    )


def q_traffic_values(spark, sf):
    return tr.traffic_values(touching(spark, sf))


def decorated(spark, sf, labels=None):
    return rv.decorate(flows(spark, sf), "job-1", labels=labels)


def q_flow_filter(spark, sf):
    rows = rv.filter_flows(decorated(spark, sf), INCLUDES, EXCLUDES)
    return rows.select("flow_no", "external_ip", "internal_ip", "service_port", "role_source", "has_payload")


def q_flow_page(spark, sf):
    rows = rv.label_page(rv.filter_flows(decorated(spark, sf), protocol="udp").withColumn("flow_id", F.col("flow_no")), 3, 50)
    return rows.select("flow_no", us("timestamp", "ts_us"))


def q_flow_ids(spark, sf):
    return decorated(spark, sf).select("flow_no", "flow_id")


def q_record_filter(spark, sf):
    rows = rv.filter_records(flows(spark, sf), candidate_ip="192.0.2.200", protocol="tcp", direction="OUTBOUND",
                             start_time="2024-01-03T00:00:00Z", end_time="2024-01-20T00:00:00Z", port=443)
    return rows.select("flow_no", "sensor_id")


def q_packet_predicates(spark, sf):
    keep = (
        (net.host("192.0.2.53") | net.net("192.0.2.64/27", "dst") | net.portrange(8000, 9000, "dst"))
        & ~net.port(123)
        & rv.capture_filter(source_cidrs=["10.0.0.0/8"], protocols=["TCP", "UDP"], ip_versions=[4])
    )
    return flows(spark, sf).filter(keep).select("flow_no")


def q_direction(spark, sf):
    rows = flows(spark, sf).drop("direction").withColumns(
        {"interface": F.concat(F.lit("eth"), F.col("flow_no") % 4), "vlan": (F.col("flow_no") % 5).cast("int")}
    )
    out = classify_direction(rows, {"eth0": "INBOUND", "eth1": "UNKNOWN"}, {2: "OUTBOUND"})
    return out.groupBy("direction", "direction_source").agg(F.count(F.lit(1)).alias("n"))


def labels(spark, sf):
    return view(spark, sf, tb.FLOW_LABELS)


def q_latest_labels(spark, sf):
    return rv.latest(labels(spark, sf), ["flow_id"]).select("flow_id", "verdict", "created_at")


def labelled(spark, sf):
    f = flows(spark, sf).select(
        F.col("flow_no").alias("flow_id"), "protocol", "direction", "payload_hash", "payload_prefix_hash",
        "payload_length", "payload_entropy", "payload_printable_ratio", "payload_simhash", "payload_feature_version",
        F.col("destination_port").alias("service_port"),
    )
    return labels(spark, sf).join(f, "flow_id")


def q_signature_conflict(spark, sf):
    return rv.signature_conflicts(labelled(spark, sf))


def q_signatures_from_labels(spark, sf):
    rows = labelled(spark, sf)
    return rv.signatures_from_labels(rows, rows).select("id", "name", "payload_hash", "protocol", "direction")


def workflow(spark, sf):
    return triage.workflow(
        view(spark, sf, tb.CANDIDATES), view(spark, sf, tb.DECISIONS), view(spark, sf, tb.ACTIONS)
    )


def q_workflow(spark, sf):
    return workflow(spark, sf).select("candidate_id", "verdict", "verdict_id", "action_status", "workflow_status")


def q_workflow_counts(spark, sf):
    return triage.workflow_counts(triage.candidate_filter(workflow(spark, sf), minimum_score=20))


def q_candidate_page(spark, sf):
    rows = triage.candidate_filter(workflow(spark, sf), 10, severity="HIGH")
    return triage.candidate_page(rows, "-score", 2, 25).select("candidate_id", "score", "verdict")


def reputed(spark, sf):
    return triage.ti_assessment(triage.ti_lookups(view(spark, sf, tb.CANDIDATES), view(spark, sf, tb.FEED)))


def q_ti_assessment(spark, sf):
    return reputed(spark, sf).select(
        "candidate_id", "ti_status", "ti_signal", "positive_providers", "configured_providers",
        "successful_providers", "virustotal_malicious", "abuse_confidence_score", "misp_event_count",
    )


def q_ti_priority(spark, sf):
    rows = triage.ti_filter(reputed(spark, sf), "POSITIVE")
    return triage.candidate_page(rows, "-ti_priority", 1, 100).select("candidate_id", "positive_providers")


def q_immediate(spark, sf):
    feed = view(spark, sf, tb.FEED).withColumn("event_ids", F.array((F.col("abuse_confidence_score").isNull()).cast("string")))
    feed = feed.withColumn("event_ids", F.when(F.coalesce("event_count", F.lit(0)) > 1, F.array(F.lit("e1"))).otherwise(F.array()))
    out = triage.immediate_action(feed, ("m1",), 50, 2)
    return out.select("candidate_ip", F.array_join("providers", ",").alias("providers"))


def q_jobs_of_candidates(spark, sf):
    named = view(spark, sf, tb.JOBS).select("id", "name")
    return triage.candidates_of_jobs(view(spark, sf, tb.CANDIDATES), named).select("candidate_id", "job_id", "job_name")


def q_bulk(spark, sf):
    ids = view(spark, sf, tb.DECISIONS).select(
        F.when(F.col("id").endswith("7"), F.concat("candidate_id", F.lit("x"))).otherwise(F.col("candidate_id")).alias("candidate_id")
    ).distinct()
    results, _, _ = triage.bulk_verdict(ids, view(spark, sf, tb.CANDIDATES), "CONFIRMED_C2", "HIGH", "bulk", "analyst", "2024-03-01T00:00:00Z")
    return triage.bulk_summary(results)


def q_override(spark, sf):
    o = view(spark, sf, tb.DECISIONS).groupBy("candidate_id").agg(
        (F.count(F.lit(1)) * 7 - 60).cast("int").alias("score_adjustment"),
        F.max(F.when(F.col("verdict") == "FALSE_POSITIVE", F.col("verdict"))).alias("exclude_reason"),
    )
    c = view(spark, sf, tb.CANDIDATES).drop("excluded", "candidate_ip").withColumnRenamed("candidate_id", "candidate_ip")
    return override_score(c, o.withColumnRenamed("candidate_id", "candidate_ip")).select("candidate_ip", "score", "excluded")


def sensors(spark, sf):
    s = view(spark, sf, tb.SENSORS).withColumn("last_heartbeat_at", F.col("last_heartbeat_at").cast("timestamp"))
    return dashboard.live_status(dashboard.derived_status(s, 2.0), NOW_SENSORS, 6 * 3600)


def q_sensor_quality(spark, sf):
    return dashboard.sensor_quality(sensors(spark, sf)).select(
        "sensor_id", "name", "status", "received_packets", "dropped_packets", "drop_rate_percent"
    )


def jobs(spark, sf):
    j = view(spark, sf, tb.JOBS)
    return j.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "completed_at")})


def q_job_page(spark, sf):
    return triage.job_page(jobs(spark, sf), status="FAILED", search="URGENT", sort="-created_at", page=1, size=50).select("id", "name")


def sightings(spark, sf):
    return view(spark, sf, tb.SIGHTINGS).withColumn("first_seen", F.col("first_seen").cast("timestamp"))


def q_trend(spark, sf):
    t = dashboard.hourly_trend(sightings(spark, sf), NOW_DASHBOARD)
    return t.select(us("hour", "hour_us"), F.col("count").alias("n"))


def q_attention(spark, sf):
    w = workflow(spark, sf).withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    return dashboard.attention(sensors(spark, sf), jobs(spark, sf), w)


def observations(spark, sf):
    """Every flow as a packet, seen again by another sensor a few milliseconds later."""
    f = flows(spark, sf).withColumns(
        {"ip_id": (F.col("flow_no") % 65536).cast("int"), "tcp_sequence": F.col("flow_no"), "payload_length": F.coalesce("payload_length", F.lit(0))}
    )
    again = F.explode(F.array(
        F.struct(F.lit("sensor-a").alias("sensor_id"), F.lit(0).alias("shift")),
        F.struct(F.lit("sensor-b").alias("sensor_id"), (F.col("flow_no") % 8 * 1000).alias("shift")),
    ))
    return f.drop("sensor_id").withColumn("__o", again).select(
        *[c for c in f.columns if c not in ("sensor_id", "ts_us")], F.col("__o.sensor_id"),
        (F.col("ts_us") + F.col("__o.shift")).alias("ts_us"),
    )


def q_packet_dedup(spark, sf):
    packets = pk.logical_packets(observations(spark, sf))
    return packets.groupBy("observations", "sensors").agg(F.count(F.lit(1)).alias("packets"))


def packet_rows(spark, sf):
    return flows(spark, sf).withColumns({"ip_version": F.lit(4), "packet_index": F.col("flow_no")})


def q_packets_to_flows(spark, sf):
    return pk.packets_to_flows(packet_rows(spark, sf)).select(
        "sensor_id", "direction", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
        "ts_us", "end_us", "packet_count", "total_bytes", F.array_join("packet_sizes", ",").alias("sizes"),
        "payload_hash", "last_payload_hash", "tcp_syn_count", "tcp_syn_only_count",
    )


def q_bidirectional(spark, sf):
    f = pk.mark_bidirectional(pk.packets_to_flows(packet_rows(spark, sf)))
    return f.groupBy("protocol", "bidirectional").agg(F.count(F.lit(1)).alias("n"))


def q_minute_flows(spark, sf):
    return pk.minute_flows(flows(spark, sf)).groupBy("source_ip", "destination_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"), F.sum("total_bytes").alias("bytes")
    )


def _half(spark, sf) -> int:
    return 1_000 * flows(spark, sf).count() // 10


def q_packet_cap(spark, sf):
    kept = pk.limit_packets(flows(spark, sf), _half(spark, sf), "flow_no")
    return kept.select("flow_no", "packet_count", "total_bytes", "tcp_ack_count", "bidirectional")


def q_packet_cap_summary(spark, sf):
    return pk.limit_summary(flows(spark, sf), _half(spark, sf))


def q_quota(spark, sf):
    return pk.quota_allocation(view(spark, sf, tb.SENSORS), 1_000_003)


def q_export(spark, sf):
    p = flows(spark, sf).withColumns({
        "source_order": F.when(F.col("sensor_id") == "sensor-b", 1).otherwise(0), "packet_index": F.col("flow_no"),
        "captured_length": (F.col("total_bytes") % 1500).cast("int"),
    })
    limit = 300 * flows(spark, sf).count()
    return pk.export_packets(p, limit).select("source_order", "packet_index", "serialized_bytes")


def q_validation(spark, sf):
    broken = flows(spark, sf).withColumns({
        "packet_count": F.when(F.col("flow_no") % 11 == 0, 0).otherwise(F.col("packet_count")),
        "payload_entropy": F.col("payload_entropy") * 1.6,
        "tcp_syn_count": F.when(F.col("flow_no") % 7 == 0, 0).otherwise(F.col("tcp_syn_count")),
        "direction": F.when(F.col("flow_no") % 13 == 0, "SIDEWAYS").otherwise(F.col("direction")),
    })
    bad = pk.flagged_flows(broken).select(F.explode("problems").alias("problem"))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def q_evaluate(spark, sf):
    return evaluation.evaluate(view(spark, sf, tb.CASES))


def q_rank_models(spark, sf):
    return evaluation.rank_models(q_evaluate(spark, sf)).select("position", "model_profile", "recommended")


def q_backtest(spark, sf):
    return evaluation.backtest(view(spark, sf, tb.POLICY_CASES))


def q_recall(spark, sf):
    return evaluation.recall_at_k(peers(spark, sf), known_bad(spark, sf), 20)


def q_candidate_positions(spark, sf):
    scored = scored_table(context(spark, sf)).select("candidate_ip", "score")
    return with_position(scored, [F.desc("score"), "candidate_ip"])


def q_known_ranks(spark, sf):
    return evaluation.known_ranks(peers(spark, sf), known_bad(spark, sf))


def q_guidance_weights(spark, sf):
    ctx = context(spark, sf)
    return guidance.weight_search(evidence_table(ctx), ctx.profile, ctx.params, 60)


def q_guidance(spark, sf):
    ctx = context(spark, sf)
    ev = evidence_table(ctx)
    found = guidance.guidance(
        decorated(spark, sf).withColumn("flow_id", F.col("flow_no")), scored_table(ctx),
        allowlisted(ev, allowlist(spark), "2024-03-01T00:00:00Z"), q_guidance_weights(spark, sf), 60,
    )
    return found.groupBy("candidate_ip", "recommendation", "detector", "current_score", "initially_detected").agg(
        F.count(F.lit(1)).alias("flows"))


def q_conditions(spark, sf):
    weights = {"common_destination": 1.5, "tcp_session_quality": 0.5}
    c = guidance.conditions(evidence_table(context(spark, sf)), weights)
    return c.select("candidate_ip", "evidence_type", "detector", "current_weight", "weighted_contribution")


def q_weighted(spark, sf):
    ctx = context(spark, sf)
    p = ctx.params.override(detector_weights={"common_destination": 1.5, "tcp_session_quality": 0.5, "periodic_beacon": 0.0})
    s = score_candidates(evidence_table(ctx), ctx.profile, p)
    return s.select("candidate_ip", "score")


def q_evidence_hosts(spark, sf):
    ctx = context(spark, sf)
    hosts = evidence_hosts(ctx, evidence_table(ctx))
    return hosts.select("candidate_ip", "type", F.coalesce("evidence_key", F.lit("")).alias("evidence_key"), "host_ip")


def q_comparison_rows(spark, sf):
    rows = comparison_rows(context(spark, sf).signature_matches)
    return rows.groupBy("candidate_ip", F.col("sig_id").alias("evidence_key"), "mode").agg(
        F.sum("n").alias("flows"), F.min("first_us").alias("first_us"))


def q_flow_summary(spark, sf):
    s = bundle.flow_summary(touching(spark, sf), ["candidate_ip"])
    return s.select(
        "candidate_ip", "flow_count", "packet_count", "total_bytes", us("first_seen", "first_us"), us("last_seen", "last_us"),
        F.coalesce(F.element_at("directions", F.lit("INBOUND")), F.lit(0)).alias("inbound"),
        F.coalesce(F.element_at("protocols", F.lit("TCP")), F.lit(0)).alias("tcp"),
    )


def q_protocol_values(spark, sf):
    return bundle.protocol_values(touching(spark, sf))


def q_tcp_flags(spark, sf):
    return bundle.tcp_flag_totals(touching(spark, sf))


def q_data_quality(spark, sf):
    return bundle.data_quality(flows(spark, sf))


def q_bundles(spark, sf):
    ctx = context(spark, sf)
    return bundle.evidence_bundle(
        scored_table(ctx), evidence_table(ctx), bundle.flow_summary(ctx.oriented, ["candidate_ip"])
    ).select("candidate_ip", F.size("evidence_ids").alias("evidence"), "canonical_sha256", "byte_size", "reduced")


def q_evidence_check(spark, sf):
    checked = evidence_problems(evidence_table(context(spark, sf)))
    return checked.select(F.size("problems").alias("problems"), "type").groupBy("type", "problems").agg(F.count(F.lit(1)).alias("n"))


def q_custom(spark, sf):
    """A user detector: destinations that one host reaches on many ports."""
    def many_ports(ctx):
        rows = ctx.gated.groupBy("candidate_ip").agg(F.count_distinct("service_port").alias("p"), F.count(F.lit(1)).alias("sample_count"))
        return rows.filter("p >= 2").select("candidate_ip", F.lit("NON_WELL_KNOWN_PORT").alias("type"), F.lit("many ports").alias("description"),
            F.lit(7.0).alias("contribution"), F.lit(7.0).alias("raw_score"), F.lit(0.5).alias("confidence"), "sample_count")
    registry = DetectorRegistry()
    detector = registry.register("many_ports", many_ports)
    return detector.run(context(spark, sf)).select("candidate_ip", "detector", "contribution", "sample_count")


def q_retention(spark, sf):
    return src.unexpired(flows(spark, sf), "flow", NOW_FLOWS).select("flow_no")


def q_dataset_counts(spark, sf):
    return src.dataset_counts(flows(spark, sf), ["sensor_id"])


def batches(spark, sf):
    return flows(spark, sf).withColumns({
        "batch_id": F.concat(F.lit("b"), F.floor(F.col("flow_no") / 100)), "record_index": (F.col("flow_no") % 100).cast("int")})


def q_ingest(spark, sf):
    sent = batches(spark, sf)
    ledger = sent.groupBy("sensor_id", "batch_id").agg(
        (F.count(F.lit(1)) + 1).alias("record_count"), F.max("timestamp").alias("ingested_at")).filter(F.col("record_count") >= 50)
    return src.batch_results(sent.unionByName(sent), ledger)


def _loaded(spark, sf):
    """Flow table and ledger after two deliveries that overlap and a load that was never published."""
    folder = f"{shared_dir(spark)}/netsift/ingest-{uuid.uuid4().hex}"
    table, ledger = f"{folder}/flows", f"{folder}/ledger"
    sent = batches(spark, sf)
    number = F.floor(F.col("flow_no") / 100)
    src.ingest_batches(spark, sent.filter(number % 3 == 0), table, ledger)
    src.ingest_batches(spark, sent.filter(number % 3 < 2).unionByName(sent.filter(number % 3 == 1)), table, ledger)
    lost = sent.filter(number % 3 == 2).withColumn("load_id", F.lit("unpublished"))
    src.write_flows(lost, table)
    return table, ledger


def q_snapshot_rows(spark, sf):
    table, ledger = _loaded(spark, sf)
    sensors = [r.sensor_id for r in spark.read.parquet(table).select("sensor_id").distinct().orderBy("sensor_id").limit(2).collect()]
    rows = src.snapshot(spark, table, sensors, "2024-01-01T00:00:00Z", "2034-01-01T00:00:00Z", ledger)
    return rows.select("sensor_id", "batch_id", "record_index", "flow_no")


def q_retained_ledger(spark, sf):
    table, ledger = _loaded(spark, sf)
    for path in (table, ledger):
        src.drop_expired(spark, path, "flow", RETAINED_AT)
    entries = src.read_or_empty(spark, ledger, src.LEDGER)
    stored = src.read_or_empty(spark, table, "sensor_id string, batch_id string, load_id string, event_date date")
    left = stored.groupBy("sensor_id", "batch_id", "load_id").agg(F.count(F.lit(1)).alias("stored_rows"))
    return entries.join(left, ["sensor_id", "batch_id", "load_id"], "left").select(
        "sensor_id", "batch_id", "record_count", "stored_rows")


def q_rolling(spark, sf):
    ctx = context(spark, sf)
    keep = tr.rolling_sample(ctx.oriented, ["candidate_ip", "host_ip"], 3)
    return keep.groupBy("candidate_ip", "host_ip").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("oldest"))


def documents(spark, sf):
    return tb.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))


def q_payload_hashes(spark, sf):
    return with_payload_features(documents(spark, sf)).select(
        "doc_id", "payload_hash", "payload_prefix_hash", "payload_length")


def q_payload_features(spark, sf):
    return with_payload_features(documents(spark, sf)).select(
        "doc_id", "payload_entropy", "payload_printable_ratio", "payload_simhash")


def packet_table(spark, sf) -> DataFrame:
    """Every document as one captured IPv6/UDP packet that carries the whole text."""
    text = F.encode("text", "UTF-8")
    size = F.length(text) + 48
    address = lambda head, n: F.concat(F.lit(head), F.lower(F.hex(n)))
    return tb.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("path"), F.lit("PCAP").alias("capture_format"),
        F.lit(0).cast("bigint").alias("packet_index"), F.lit(101).alias("link_type"),
        (F.col("doc_id") * 1_000_000).alias("ts_us"), size.alias("captured_length"), F.lit(True).alias("decoded"),
        F.lit(6).alias("ip_version"), address("fd00::", F.col("doc_id") % 65536).alias("source_ip"),
        address("2001:db8::", F.col("doc_id") % 1000).alias("destination_ip"), F.lit(40000).alias("source_port"),
        F.lit(9000).alias("destination_port"), F.lit("UDP").alias("protocol"), text.alias("payload"),
        F.lit(None).cast("int").alias("flag_bits"), F.lit(None).cast("string").alias("error"))


def q_capture_decode(spark, sf):
    rows = cap.flow_rows(packet_table(spark, sf), "sensor-a", ["fd00::/8"])
    return rows.select("path", "ts_us", "protocol", "direction", "source_port", "destination_port", "total_bytes",
                       "payload_hash", "payload_length", "ip_version")


def q_capture_summary(spark, sf):
    s = cap.capture_summary(packet_table(spark, sf))
    return s.select("path", "capture_format", "captured_packet_count", "parsed_packet_count", us("start_time", "start_us"))


def event_packets(spark, sf) -> DataFrame:
    """Every flow as a packet of its sensor's capture; each seventh is not IP, TCP ones carry flags."""
    return flows(spark, sf).withColumns({
        "path": F.col("sensor_id"), "capture_format": F.lit("PCAPNG"), "packet_index": F.col("flow_no"),
        "link_type": (F.col("flow_no") % 3).cast("int"), "captured_length": (F.col("total_bytes") % 1500).cast("int"),
        "decoded": F.col("flow_no") % 7 != 0, "error": F.lit(None).cast("string")})


def q_packet_summary(spark, sf):
    s = cap.capture_summary(event_packets(spark, sf))
    return s.select("path", "captured_packet_count", "parsed_packet_count", "skipped_packet_count",
                    F.array_join("link_types", ",").alias("link_types"), us("start_time", "start_us"), us("end_time", "end_us"), "error")


def q_first_packet(spark, sf):
    found = cap.find_packet(event_packets(spark, sf), "protocol = 'UDP' AND decoded AND total_bytes > 700")
    return found.select("path", "packet_index", "ts_us")


def q_scan_budget(spark, sf):
    docs = tb.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.timestamp_micros(F.floor(F.col("doc_id") / 5) * 1_000_000).alias("uploaded_at"),
        F.octet_length("text").cast("bigint").alias("byte_count"), (F.col("doc_id") % 97).alias("packet_count"),
        F.encode("text", "UTF-8").alias("content"),
        F.sha2(F.when(F.col("doc_id") % 10 == 0, F.lit("other")).otherwise(F.col("text")), 256).alias("sha256"))
    return cap.scan_budget(docs, 100_000, 2_000).select("id", "bytes_read", "packets_read", "verified", "reason")


def q_sensor_page(spark, sf):
    s = sensors(spark, sf).withColumn("enabled", F.col("dropped_packets") % 2 == 0)
    return triage.sensor_page(s, status="ONLINE", enabled=True, sort="-last_heartbeat_at", page=1, size=40).select("sensor_id", us("last_heartbeat_at", "beat_us"))


def q_segment_page(spark, sf):
    seg = jobs(spark, sf).select("id", F.concat(F.lit("sensor-"), F.length("name")).alias("sensor_id"), F.col("name").alias("analysis_job_id"), F.col("created_at").alias("uploaded_at"))
    return triage.segment_page(seg, sensor_id="sensor-16", page=2, size=50).select("id", us("uploaded_at", "at_us"))


def q_enrichment(spark, sf):
    return triage.enrichment_selection(scored_table(context(spark, sf)), 15).select("candidate_ip", "score")


def q_history(spark, sf):
    d = triage.valid_decisions(view(spark, sf, tb.DECISIONS))
    return rv.history(d, "candidate_id", ["id", "verdict"]).select("candidate_id", "id", "verdict", "position")


def q_stream_windows(spark, sf):
    out = _run_stream(spark, st.sync_windows_stream(closed_stream(spark, sf), window="2 seconds", delay="1 second"), "append")
    return out.select("candidate_ip", us("start", "start_us"), "hosts", "flows")


def q_simhash_distance(spark, sf):
    f = context(spark, sf).scoped.filter(F.col("payload_simhash").isNotNull())
    d = simhash_distance("payload_simhash", F.lit("e627bf19152d67b3"))
    return f.groupBy(d.alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def _run_stream(spark, out: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read its Parquet result."""
    base = f"{shared_dir(spark)}/netsift/stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def flow_stream(spark, sf):
    batch = flows(spark, sf)
    path = batch.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(batch.schema).parquet(path)


def closed_stream(spark, sf):
    """The flows and a closing row, so that the last windows and sessions come out."""
    batch = flows(spark, sf)
    path = batch.inputFiles()[0].rsplit("/", 1)[0]
    end = f"{shared_dir(spark)}/netsift/end-{uuid.uuid4().hex}"
    st.write_closing_row(batch, end)
    base, rest = path.rsplit("/", 1)
    return spark.readStream.schema(batch.schema).parquet(f"{base}/{{{rest},{end.rsplit('/', 1)[1]}}}")


def q_stream_sessions(spark, sf):
    out = _run_stream(spark, st.sessions_stream(closed_stream(spark, sf), 60, "1 second"), "append")
    return out.select(*st.SESSION_KEY, us("first_seen", "first_us"), us("last_seen", "last_us"), "packet_count", "total_bytes", "min_size", "max_size")


def q_stream_dedup(spark, sf):
    rows = flow_stream(spark, sf).withColumns({
        "batch_id": F.concat(F.lit("b"), F.floor(F.col("flow_no") / 100)), "record_index": (F.col("flow_no") % 50).cast("int")})
    out = _run_stream(spark, st.dedup_stream(rows, "60 days").select("sensor_id", "batch_id", "record_index"), "append")
    return out.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


def more_queries() -> dict:
    names = {
        "command_reactions": q_command_reactions,
        "prefilter": q_prefilter, "prefilter_topk": q_prefilter_topk, "merge_ranking": q_merge_ranking,
        "review_priority": q_review_priority, "allowlist_suppression": q_allowlist, "traffic_buckets": q_traffic_buckets,
        "traffic_summary": q_traffic_summary, "traffic_values": q_traffic_values, "flow_filter_groups": q_flow_filter,
        "flow_page": q_flow_page, "flow_ids": q_flow_ids, "record_filter": q_record_filter,
        "packet_predicates": q_packet_predicates, "direction_classes": q_direction, "latest_labels": q_latest_labels,
        "signature_conflict": q_signature_conflict, "signatures_from_labels": q_signatures_from_labels,
        "workflow": q_workflow, "workflow_counts": q_workflow_counts, "candidate_page": q_candidate_page,
        "ti_assessment": q_ti_assessment, "ti_priority": q_ti_priority, "immediate_action": q_immediate,
        "candidates_of_jobs": q_jobs_of_candidates, "bulk_verdict": q_bulk, "score_override": q_override,
        "sensor_quality": q_sensor_quality, "fleet": lambda s, d: dashboard.fleet(sensors(s, d)),
        "job_counts": lambda s, d: dashboard.job_counts(jobs(s, d), NOW_JOBS), "job_page": q_job_page,
        "dashboard_severity": lambda s, d: dashboard.severity_counts(sightings(s, d), NOW_DASHBOARD),
        "hourly_trend": q_trend, "attention": q_attention, "packet_dedup": q_packet_dedup,
        "packets_to_flows": q_packets_to_flows, "bidirectional": q_bidirectional, "minute_flows": q_minute_flows,
        "packet_cap": q_packet_cap, "packet_cap_summary": q_packet_cap_summary, "quota_allocation": q_quota,
        "packet_export": q_export, "flow_validation": q_validation, "confusion_matrix": q_evaluate,
        "model_ranking": q_rank_models, "policy_backtest": q_backtest, "recall_at_k": q_recall,
        "known_ranks": q_known_ranks, "candidate_positions": q_candidate_positions, "guidance_weights": q_guidance_weights, "guidance": q_guidance,
        "condition_breakdown": q_conditions, "weighted_scores": q_weighted, "evidence_hosts": q_evidence_hosts, "comparison_rows": q_comparison_rows,
        "flow_summary": q_flow_summary, "protocol_values": q_protocol_values, "tcp_flag_totals": q_tcp_flags,
        "data_quality": q_data_quality, "evidence_bundles": q_bundles, "evidence_check": q_evidence_check,
        "custom_detector": q_custom, "retention_filter": q_retention, "dataset_counts": q_dataset_counts,
        "batch_ingest": q_ingest, "snapshot_rows": q_snapshot_rows, "retained_ledger": q_retained_ledger, "rolling_sample": q_rolling, "payload_hashes": q_payload_hashes,
        "payload_features": q_payload_features, "simhash_distance": q_simhash_distance,
        "capture_decode": q_capture_decode, "capture_summary": q_capture_summary, "sensor_page": q_sensor_page,
        "packet_summary": q_packet_summary, "first_packet": q_first_packet, "scan_budget": q_scan_budget,
        "segment_page": q_segment_page, "enrichment_selection": q_enrichment, "verdict_history": q_history,
        "stream_sync_windows": q_stream_windows, "stream_sessionize": q_stream_sessions, "stream_dedup": q_stream_dedup,
    }
    return names
