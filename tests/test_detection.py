"""The end-to-end scenarios, edge cases of single rules and the scoring rules."""

import ipaddress
import json
import random

import pytest

from netsift.operators.roles import orient, role_columns
from netsift.operators.traffic import traffic_profile
from netsift.params import Params
from netsift.plans.analysis import analyze, reanalyze
from netsift.plans.context import AnalysisContext
from netsift.plans.detection import detect, run_detectors
from netsift.plans.registry import DetectorError, DetectorRegistry, pandas_detector, validate_evidence
from netsift.plans.scoring import score_candidates
from netsift.schema import EVIDENCE
from tests.helpers import T0, flow, frame


def by_ip(df):
    return {r.candidate_ip: r for r in df.collect()}


def ctx(spark, rows, **kw):
    params = kw.pop("params", Params())
    return AnalysisContext(frame(spark, rows), params, **kw)


def test_scenario_periodic_beacon(spark):
    rng = random.Random(1)
    rows = [
        flow(i * 30 + rng.uniform(-3, 3) + 10, source_ip=f"10.0.0.{h + 1}", payload_hash="a" * 64)
        for h in range(50) for i in range(6)
    ]
    c = AnalysisContext(frame(spark, rows))
    found = by_ip(analyze(c))["203.0.113.5"]
    assert found.score >= 60 and "PERIODIC_BEACON" in found.types
    beacon = detect(c, "periodic_beacon").first()
    assert json.loads(beacon.metrics)["matching_hosts"] == 50


def test_scenario_command_then_attack(spark):
    rows = []
    for h in range(100):
        ip, sensor = f"10.0.1.{h + 1}", f"s{h % 2}"
        for t in (100.0, 115.0):
            rows.append(flow(t + h / 1000, sensor_id=sensor, source_ip="203.0.113.9", destination_ip=ip,
                             source_port=4444, destination_port=5000, direction="INBOUND"))
        rows.append(flow(102.0, sensor_id=sensor, source_ip=ip, destination_ip="198.51.100.7", packet_count=10))
    found = by_ip(analyze(ctx(spark, rows)))["203.0.113.9"]
    assert found.score >= 80
    assert {"COMMAND_ATTACK_CORRELATION", "MULTI_SENSOR_CONTEXT"} <= set(found.types)


def test_scenario_dns_and_cdn_stay_low(spark):
    rows = [
        flow(i * 7, source_ip=f"10.0.0.{h + 1}", destination_ip="192.0.2.53", destination_port=53)
        for h in range(50) for i in range(3)
    ] + [
        flow(i * 11 + h, source_ip=f"10.0.0.{h + 1}", destination_ip="192.0.2.80", domain=f"h{h}.cdn.example.com", protocol="TCP")
        for h in range(50) for i in range(3)
    ]
    p = Params(trusted_dns_servers=("192.0.2.53",), cdn_domain_suffixes=("cdn.example.com",))
    found = by_ip(analyze(ctx(spark, rows, params=p)))
    assert found["192.0.2.53"].score <= 39 and found["192.0.2.80"].score <= 39
    kinds = {a.kind for a in found["192.0.2.53"].adjustments}
    assert "PUBLIC_DNS_NTP" in kinds


def test_far_apart_periods_give_no_evidence(spark):
    rows = [flow(i * 5, source_ip="10.0.0.1") for i in range(8)] + [
        flow(i * 500, source_ip="10.0.0.2") for i in range(8)
    ]
    assert detect(ctx(spark, rows), "periodic_beacon").count() == 0


def test_scan_suppression_and_legacy_rows(spark):
    probe = dict(protocol="TCP", direction="INBOUND", source_ip="198.51.100.9", tcp_flags_observed=True,
                 tcp_syn_count=1, tcp_syn_only_count=1)
    rows = [flow(i, destination_ip=f"10.0.3.{i}", source_port=50000 + i, destination_port=22, **probe) for i in range(1, 10)]
    legacy = [flow(i, protocol="TCP", destination_ip="203.0.113.77") for i in range(4)]
    c = ctx(spark, rows + legacy)
    assert {r.candidate_ip for r in c.gated.select("candidate_ip").distinct().collect()} == {"203.0.113.77"}
    judged = c.judged.filter("candidate_ip = '198.51.100.9'").collect()
    assert len(judged) == 9 and all(r.suppressed and not r.kept for r in judged)
    strict = reanalyze(c, tcp_allow_legacy_without_flags=False)
    assert strict.gated.count() == 0
    assert reanalyze(c, tcp_session_gating_enabled=False).gated.count() == 13


def test_require_established(spark):
    rows = [flow(i, protocol="TCP", tcp_flags_observed=True, tcp_syn_count=1, tcp_syn_only_count=1) for i in range(4)]
    assert ctx(spark, rows).gated.count() == 4
    assert ctx(spark, rows, params=Params(tcp_require_established_outbound=True)).gated.count() == 0


def test_clock_skew_lowers_confidence(spark):
    rows = [
        flow(t + h / 10, source_ip=f"10.0.0.{h + 1}", sensor_id=f"s{h % 2}")
        for t in (0, 20, 40) for h in range(4)
    ]
    p = Params(clock_offsets_ms={"s1": 3000.0})
    row = detect(ctx(spark, rows, params=p), "synchronized_communication").collect()
    plain = detect(ctx(spark, rows), "synchronized_communication").first()
    assert plain.confidence == 1.0 and plain.warnings == []
    assert all(r.confidence == 0.7 and r.warnings == ["clock_skew"] for r in row)


def test_signature_exact_displaces_structural(spark):
    h1, h2, pre = "a" * 64, "b" * 64, "c" * 64
    base = dict(payload_prefix_hash=pre, payload_length=100, payload_entropy=4.0, payload_simhash="00000000000000ff")
    rows = [
        flow(1, payload_hash=h1, **base),
        flow(2, payload_hash=h2, **base),
        flow(3, payload_hash=h2, destination_ip="203.0.113.6", **base),
        flow(4, payload_hash=h2, destination_ip="203.0.113.7", **{**base, "payload_prefix_hash": None, "payload_simhash": "0000000000000000"}),
        flow(5, payload_hash=h2, destination_ip="203.0.113.8", **{**base, "payload_prefix_hash": None, "payload_simhash": "00000000000fffff"}),
        flow(6, payload_hash=h2, destination_ip="203.0.113.9", **{**base, "payload_length": 300}),
    ]
    sig = spark.createDataFrame(
        [("s1", True, "udp", h1, pre, 100, 4.0, "00000000000000ff"), ("off", False, None, h2, None, None, None, None)],
        "id string, enabled boolean, protocol string, payload_hash string, payload_prefix_hash string, payload_length int, payload_entropy double, payload_simhash string",
    )
    found = by_ip(detect(ctx(spark, rows, signatures=sig), "analyst_payload_signature"))
    assert {k: (v.match_mode, v.contribution, v.sample_count) for k, v in found.items()} == {
        "203.0.113.5": ("EXACT", 80.0, 1),
        "203.0.113.6": ("STRUCTURAL", 60.0, 1),
        "203.0.113.7": ("STRUCTURAL", 60.0, 1),
    }
    assert found["203.0.113.6"].warnings == ["structural_match_review"]


def test_traffic_profile_sessions(spark):
    tcp = dict(protocol="TCP", packet_count=5, total_bytes=50)
    rows = [flow(0, duration_seconds=30.0, **tcp), flow(10, **tcp), flow(90, **tcp), flow(150.5, **tcp), flow(300, protocol="TCP", packet_count=0, total_bytes=0)]
    got = traffic_profile(orient(frame(spark, rows))).first()
    assert (got.flow_count, got.tcp_session_count) == (5, 2)
    assert (got.max_tcp_session_packets, got.max_tcp_session_bytes) == (15, 150)


def evidence(spark, *rows):
    base = dict.fromkeys(EVIDENCE.names)
    data = []
    for r in rows:
        item = {**base, "candidate_ip": "203.0.113.5", "version": "1", "evidence_key": "", "min_host": "a", "max_host": "b",
                "sensors": ["s"], "first_seen": T0, "last_seen": T0, "sample_count": 9, "metrics": "{}", "confidence": 1.0, "warnings": [],
                "description": "", **r}
        item["raw_score"] = item["contribution"]
        data.append(tuple(item[n] for n in EVIDENCE.names))
    return spark.createDataFrame(data, EVIDENCE)


def scored(spark, ev, profile=None, p=Params(), **kw):
    if profile is not None:
        profile = spark.createDataFrame([("203.0.113.5", *profile)], "candidate_ip string, total_bytes bigint, total_packets bigint, max_tcp_session_bytes bigint, max_tcp_session_packets bigint")
    r = score_candidates(ev, profile, p, **kw).first()
    return r.score, {a.kind: a.points for a in r.adjustments}


def test_caps_weights_and_penalties(spark):
    two = evidence(spark, {"type": "NON_WELL_KNOWN_PORT", "detector": "x", "contribution": 20.0}, {"type": "NON_WELL_KNOWN_PORT", "detector": "y", "contribution": 20.0})
    assert scored(spark, two) == (25, {})
    port = evidence(spark, {"type": "NON_WELL_KNOWN_PORT", "detector": "non_well_known_port", "contribution": 20.0})
    assert scored(spark, port, p=Params(detector_weights={"non_well_known_port": 2.0})) == (40, {"DETECTOR_WEIGHT_NON_WELL_KNOWN_PORT": 20.0})
    assert scored(spark, port, (60 << 20, 0, 0, 0)) == (0, {"HIGH_VOLUME": -30.0})
    lone = evidence(spark, {"type": "SINGLE_HOST_BEACON", "detector": "d", "contribution": 35.0, "max_host": "a", "sample_count": 2})
    assert scored(spark, lone) == (5, {"SINGLE_HOST": -10.0, "LOW_SAMPLE": -20.0})
    exact = evidence(spark, {"type": "ANALYST_PAYLOAD_SIGNATURE", "detector": "d", "contribution": 80.0, "max_host": "a", "match_mode": "EXACT", "sample_count": 1})
    assert scored(spark, exact, (60 << 20, 0, 60 << 20, 0)) == (80, {})
    unknown = evidence(spark, {"type": "SOMETHING", "detector": "d", "contribution": 50.0})
    assert scored(spark, unknown) == (0, {})


def test_long_session_caps_the_score(spark):
    ev = evidence(spark, {"type": "ANALYST_PAYLOAD_SIGNATURE", "detector": "d", "contribution": 60.0, "match_mode": "STRUCTURAL"})
    score, adjustments = scored(spark, ev, (1, 1, 60 << 20, 0))
    assert score == 20 and adjustments == {"HIGH_VOLUME_TCP_SESSION": -40.0}
    off = Params(high_volume_tcp_session_bytes_threshold=0, high_volume_tcp_session_packet_threshold=0)
    assert scored(spark, ev, (1, 1, 60 << 20, 0), off)[0] == 60


def test_enrichment_needs_primary_evidence(spark):
    rows = [flow(i, protocol="TCP", tcp_flags_observed=True, tcp_syn_count=1, tcp_ack_count=1, tcp_syn_only_count=1, destination_port=80) for i in range(2)]
    c = ctx(spark, rows)
    assert detect(c, "tcp_session_quality").count() == 1
    assert run_detectors(c).count() == 0


def test_custom_detectors(spark):
    registry = DetectorRegistry()
    with pytest.raises(DetectorError):
        registry.register("common_destination", lambda c: None)
    with pytest.raises(DetectorError):
        registry.register("two", lambda a, b: None)
    with pytest.raises(DetectorError):
        registry.register(" ", lambda c: None)

    def half(c):
        return c.gated.groupBy("candidate_ip").count().selectExpr(
            "candidate_ip", "'COMMON_DESTINATION' type", "'mine' description", "5D contribution", "5D raw_score", "0.5D confidence", "count sample_count")

    registry.register("mine", half)
    with pytest.raises(DetectorError):
        registry.register("mine", half)
    c = ctx(spark, [flow(i) for i in range(3)])
    rows = [r for r in run_detectors(c, registry).collect() if r.detector == "mine"]
    assert len(rows) == 1 and rows[0].sample_count == 3
    bad = half(c).selectExpr("'nowhere' candidate_ip", "type", "description", "500D contribution", "raw_score", "confidence")
    with pytest.raises(Exception, match="candidate_ip, contribution"):
        validate_evidence(bad, "bad", "1").collect()


def test_pandas_detector(spark):
    import pandas as pd

    def per_host(pdf):
        row = dict.fromkeys(EVIDENCE.names)
        row |= {"candidate_ip": pdf.candidate_ip.iloc[0], "type": "COMMON_DESTINATION", "description": "x", "raw_score": 1.0,
                "contribution": 1.0, "confidence": 1.0, "sample_count": len(pdf), "evidence_key": "", "sensors": [], "warnings": []}
        return pd.DataFrame([row])

    with pytest.raises(DetectorError):
        pandas_detector(per_host, ("candidate_ip",))
    registry = DetectorRegistry()
    d = registry.register("hosts", pandas_detector(per_host, ("candidate_ip", "host_ip")))
    c = ctx(spark, [flow(i, source_ip=f"10.0.0.{i % 2}") for i in range(6)])
    assert sorted(r.sample_count for r in d.run(c).collect()) == [3, 3]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        Params(detector_weights={"nope": 1.0})
    with pytest.raises(ValueError):
        Params(detector_weights={"periodic_beacon": 3.0})


def test_trusted_servers_of_a_long_allowlist_all_count(spark):
    from netsift.plans.analysis import with_trusted

    rows = [flow(i, source_ip=f"10.0.0.{i + 1}", destination_ip="203.0.113.77", destination_port=53) for i in range(12)]
    listed = [("TRUSTED_DNS", f"198.18.{i // 250}.{i % 250}", True, None) for i in range(12_000)]
    listed.append(("TRUSTED_DNS", "203.0.113.77", True, None))
    allowlist = spark.createDataFrame(listed, "type string, value string, enabled boolean, expires_at string")
    for with_list in (False, True):
        ctx = AnalysisContext(frame(spark, rows), Params())
        if with_list:
            ctx = with_trusted(ctx, allowlist, "2026-01-01T00:00:00Z")
        got = [r.metrics for r in run_detectors(ctx).filter("type = 'COMMON_DESTINATION'").collect()]
        assert len(got) == 1 and ('"public_dns_ntp":true' in got[0]) == with_list


@pytest.mark.parametrize("cidrs", [("10.0.0.0/8", "192.168.0.0/16"), ("10.0.0.0/8", "fd00::/8")])
def test_roles_parse_each_address_once_and_only_without_direction(spark, cidrs):
    ends = ["10.0.0.1", "10.0.0.2", "203.0.113.5", "192.168.1.1", "fd00::1", "2001:db8::1", "10.0.0.256", "", None]
    stated = ["OUTBOUND", "inbound", "UNKNOWN", "", None]
    rows = [(a, b, d, 1, 2) for a in ends for b in ends for d in stated]
    columns = "source_ip string, destination_ip string, direction string, source_port int, destination_port int"
    nets = [ipaddress.ip_network(c) for c in cidrs]

    def inside(text):
        try:
            return any(ipaddress.ip_address(text) in n for n in nets)
        except ValueError:
            return False

    def role(a, b, d):
        if d is None or d.upper() in ("OUTBOUND", "INBOUND"):
            return d and d.upper()
        return None if inside(a) == inside(b) else "OUTBOUND" if inside(a) else "INBOUND"

    got = role_columns(spark.createDataFrame(rows, columns), cidrs).collect()
    assert [r.norm_direction for r in got] == [role(a, b, d) for a, b, d, _, _ in rows]
    for r in got:
        out = {"OUTBOUND": (r.destination_ip, r.source_ip, 2, 1), "INBOUND": (r.source_ip, r.destination_ip, 1, 2)}
        want = out.get(r.norm_direction, (None,) * 4)
        assert (r.candidate_ip, r.host_ip, r.service_port, r.internal_port) == want
    plan = orient(frame(spark, [flow()]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 4  # two addresses, in the filter and in the projection
