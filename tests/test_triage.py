"""Workflow and dashboard rules on small hand-made tables."""

from pyspark.sql import functions as F

from netsift.plans import dashboard, prefilter, triage
from netsift.plans.context import AnalysisContext
from tests.helpers import flow, frame


def test_action_counts_only_for_the_current_verdict(spark):
    cands = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "candidate_id string")
    decisions = spark.createDataFrame(
        [("d1", "c1", "CONFIRMED_C2", "HIGH", "n", "a", "2026-01-01T00:00:00Z"), ("d2", "c1", "CONFIRMED_C2", "HIGH", "n", "a", "2026-01-02T00:00:00+00:00"),
         ("d3", "c2", "FALSE_POSITIVE", "HIGH", "n", "a", "2026-01-01T00:00:00Z"), ("d4", "c2", "CONFIRMED_C2", "SURE", "n", "a", "2026-01-03T00:00:00Z"),
         ("d5", "c3", "CONFIRMED_C2", "HIGH", "n", "a", "2026-01-03T00:00:00")],
        "id string, candidate_id string, verdict string, confidence string, note string, created_by string, created_at string")
    actions = spark.createDataFrame([("a1", "c1", "d1", "COMPLETED", "2026-01-05T00:00:00Z"), ("a2", "c1", "d2", "IN_PROGRESS", "2026-01-03T00:00:00Z")],
                                    "id string, candidate_id string, verdict_id string, status string, created_at string")
    got = {r.candidate_id: r.workflow_status for r in triage.workflow(cands, decisions, actions).collect()}
    assert got == {"c1": "ACTION_IN_PROGRESS", "c2": "FALSE_POSITIVE", "c3": "NEEDS_REVIEW"}


def test_workflow_moves_only_what_it_needs_of_actions_and_decisions(spark):
    cands = spark.createDataFrame([("c1",), ("c2",)], "candidate_id string")
    at = lambda day: f"2026-01-{day:02}T00:00:00Z"
    decisions = spark.createDataFrame(
        [("d1", "c1", "CONFIRMED_C2", "HIGH", "n", "a", at(1)), ("d2", "c1", "CONFIRMED_C2", "HIGH", "n", "a", at(1)),
         ("d3", "c2", "CONFIRMED_C2", "HIGH", "n", "a", at(1))],
        "id string, candidate_id string, verdict string, confidence string, note string, created_by string, created_at string")
    actions = spark.createDataFrame(
        [("a1", "c1", "d1", "COMPLETED", at(9), "x"), ("a2", "c1", "d2", "PENDING", at(3), "x"),
         ("a3", "c1", "d2", "COMPLETED", at(3), "x"), ("a4", "c1", None, "PENDING", at(9), "x"),
         ("a5", "c2", "d2", "COMPLETED", at(9), "x"), ("a6", "c2", "d3", "IN_PROGRESS", at(2), "x")],
        "id string, candidate_id string, verdict_id string, status string, created_at string, long_remark string")
    out = triage.workflow(cands, decisions, actions)
    got = {r.candidate_id: (r.verdict_id, r.action_status) for r in out.collect()}
    assert got == {"c1": ("d2", "COMPLETED"), "c2": ("d3", "IN_PROGRESS")}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    moved = [line for line in plan if "Aggregate" in line]
    assert len(moved) == 2 and not any("long_remark" in line or "created_by" in line for line in moved)


def test_bulk_verdict_appends(spark):
    ids = spark.createDataFrame([("c1",), ("nope",)], "candidate_id string")
    cands = spark.createDataFrame([("c1", "203.0.113.1")], "candidate_id string, candidate_ip string")
    results, decisions, actions = triage.bulk_verdict(ids, cands, "CONFIRMED_C2", "HIGH", "n", "me", "2026-01-01T00:00:00Z")
    assert {(r.candidate_id, r.status, r.code) for r in results.collect()} == {("c1", "SUCCEEDED", None), ("nope", "FAILED", "NOT_FOUND")}
    assert actions.join(decisions, actions.verdict_id == decisions.id).count() == 1
    assert triage.bulk_summary(results).first().status == "PARTIAL"
    _, _, none = triage.bulk_verdict(ids, cands, "UNDER_REVIEW", "HIGH", "n", "me", "2026-01-01T00:00:00Z")
    assert none.count() == 0


def test_attention_mix(spark):
    live = spark.createDataFrame([(f"s{i}", f"s{i}", "OFFLINE") for i in range(5)], "sensor_id string, name string, live_status string")
    jobs = spark.createDataFrame([(f"j{i}", f"j{i}", "FAILED", f"2026-01-0{i + 1} 00:00:00") for i in range(4)], "id string, name string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    cands = spark.createDataFrame([(f"c{i}", f"203.0.113.{i}", "CRITICAL", "NEEDS_REVIEW", f"2026-01-0{i + 1} 00:00:00") for i in range(3)], "candidate_id string, candidate_ip string, severity string, workflow_status string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    rows = dashboard.attention(live, jobs, cands).orderBy("position").collect()
    assert [r.title for r in rows] == ["s0", "s1", "s2", "j3", "j2", "j1", "203.0.113.2", "203.0.113.1"]


def test_prefilter_walk_matches_a_sequential_one(spark):
    """The best host by the visiting rule, on random hosts of two peers."""
    import random

    rng = random.Random(9)
    hosts = []
    for peer in ("p1", "p2", "p3"):
        for h in range(40):
            hosts.append((peer, f"h{h:02}", rng.randint(0, 90_000_000), rng.randint(3, 9), rng.choice([0.0, 0.05, 0.1, 0.15, 0.2]), float(h)))
    df = spark.createDataFrame(hosts, "candidate_ip string, host_ip string, first_us bigint, samples bigint, deviation double, period double")
    got = {r.candidate_ip: (r.samples, r.deviation, r.period) for r in prefilter.steadiest_host(df).collect()}
    for peer in ("p1", "p2", "p3"):
        best = (0, 1.0, 0.0)
        for _, _, _, n, d, period in sorted((x for x in hosts if x[0] == peer), key=lambda x: (x[2], x[1])):
            if n > best[0] or d < best[1]:
                best = (n, d, period)
        assert got[peer] == best


def test_prefilter_limit_and_trust(spark):
    rows = [flow(i * 30, source_ip=f"10.0.0.{i % 3}", destination_ip=f"203.0.113.{k}") for k in range(4) for i in range(12)]
    oriented = AnalysisContext(frame(spark, rows)).oriented
    top = prefilter.prefilter(oriented, trusted=("203.0.113.0",), limit=3).collect()
    assert len(top) == 3 and "203.0.113.0" not in {r.candidate_ip for r in top}
    assert {f.name for f in top[0].factors} >= {"PEER_BASELINE", "SINGLE_HOST_BEACON"}
