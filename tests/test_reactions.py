"""Traffic around commands: prefix sums against a walk over all pairs."""

import random
from collections import defaultdict

import pytest

from netsift.operators.detectors.timing import command_reactions, commands, sums_around
from netsift.params import Params
from tests.helpers import flow, frame

S = 1_000_000


def walked(rows, asked):
    out = defaultdict(lambda: [0, 0, 0])
    for host, seed in asked:
        for r in rows:
            if r["direction"] != "OUTBOUND" or r["source_ip"] != host:
                continue
            delta = r["us"] - seed
            key = (host, r["destination_ip"], r["destination_port"], r["protocol"], seed)
            if S <= delta <= 30 * S:
                out[key][0] += 1
                out[key][1] += r["packet_count"] or 0
            elif -30 * S <= delta < 0:
                out[key][2] += r["packet_count"] or 0
                out[key][0] += 0
    return dict(out)


def table(spark, rows):
    ddl = "source_ip string, destination_ip string, destination_port int, protocol string, direction string, packet_count bigint, ts_us bigint"
    names = ["source_ip", "destination_ip", "destination_port", "protocol", "direction", "packet_count", "us"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


def sent(us, host="10.0.0.1", target="198.51.100.7", port=80, protocol="TCP", packets=1, direction="OUTBOUND"):
    return {"source_ip": host, "destination_ip": target, "destination_port": port, "protocol": protocol,
            "direction": direction, "packet_count": packets, "us": us}


def got(df):
    return {(r.host_ip, r.target, r.target_port, r.target_protocol, r.seed_us): [r.attacks, r.attack_packets, r.baseline_packets]
            for r in df.collect()}


def ask(spark, asked):
    return spark.createDataFrame(asked, "host_ip string, seed_us bigint")


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_walk_over_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = 1_704_067_200 * S + rng.randrange(64) * S
    asked = sorted({(f"10.0.0.{rng.randrange(3)}", base + rng.choice([0, 1, 999_999, rng.randrange(90 * S)])) for _ in range(12)})
    edges = [0, 1, S - 1, S, S + 1, 30 * S, 30 * S + 1, 30 * S - 1, -1, -S, -30 * S, -30 * S - 1, -30 * S + 1]
    rows = [sent(at + rng.choice(edges), host, f"198.51.100.{rng.randrange(2)}", rng.choice([None, 80]), rng.choice(["TCP", "UDP"]),
                 rng.choice([None, 0, 1, 7])) for host, at in asked for _ in range(20)]
    rows += [sent(base + rng.randrange(-40 * S, 130 * S), f"10.0.0.{rng.randrange(4)}", packets=rng.randrange(5)) for _ in range(200)]
    rows += [sent(base + 2 * S, direction="INBOUND"), sent(base + 2 * S, host=None), sent(base + 2 * S, target=None)]
    rows += rows[:10]  # repeated rows count again
    assert got(sums_around(table(spark, rows), ask(spark, asked))) == walked(rows, asked)


def test_times_before_the_epoch_and_empty_tables(spark):
    rows = [sent(-5 * S - 1), sent(-3 * S), sent(20 * S)]
    asked = [("10.0.0.1", -5 * S)]
    assert got(sums_around(table(spark, rows), ask(spark, asked))) == walked(rows, asked)
    assert sums_around(table(spark, []), ask(spark, asked)).count() == 0
    assert sums_around(table(spark, rows), ask(spark, [])).count() == 0


def test_a_flood_meets_many_commanders_once(spark):
    """One host sends nearly all flows to one target while 300 candidates command it and two others."""
    n, candidates = 20_000, 300
    flood = spark.range(n).selectExpr(
        "'10.0.0.1' AS source_ip", "'198.51.100.7' AS destination_ip", "80 AS destination_port", "'TCP' AS protocol",
        "'OUTBOUND' AS direction", "2L AS packet_count", "1704067200000000 + id * 1000 AS ts_us")
    base = 1_704_067_200 * S
    asked = ask(spark, [("10.0.0.1", base + 7 * i) for i in range(candidates)])
    found = got(sums_around(flood, asked))
    assert len(found) == candidates
    for i in range(candidates):
        attacks = sum(1 for at in range(0, 20 * S, 1000) if S <= at - 7 * i)
        before = sum(1 for at in range(0, 7 * i, 1000))
        assert found["10.0.0.1", "198.51.100.7", 80, "TCP", base + 7 * i] == [attacks, 2 * attacks, 2 * before]


def test_traffic_to_the_candidate_is_no_attack(spark):
    rows = []
    for h in range(3):
        ip = f"10.0.1.{h + 1}"
        rows.append(flow(100, source_ip="203.0.113.9", destination_ip=ip, source_port=4444, destination_port=5000, direction="INBOUND"))
        rows.append(flow(98, source_ip=ip, destination_ip="203.0.113.9", packet_count=4))
        rows.append(flow(102, source_ip=ip, destination_ip="203.0.113.9", packet_count=4))
        rows.append(flow(102, source_ip=ip, destination_ip="198.51.100.7", packet_count=10))
    scoped = frame(spark, rows)
    gated = scoped.selectExpr("*", "CASE WHEN direction = 'INBOUND' THEN source_ip ELSE destination_ip END AS candidate_ip",
                              "CASE WHEN direction = 'INBOUND' THEN destination_ip ELSE source_ip END AS host_ip")
    seeds = commands(gated, Params())
    found = {(r.host_ip, r.target): (r.attacks, r.attack_packets, r.baseline_packets) for r in command_reactions(scoped, gated, seeds).collect()}
    assert found == {k: v for h in range(3) for k, v in {
        (f"10.0.1.{h + 1}", "203.0.113.9"): (0, 0, 4), (f"10.0.1.{h + 1}", "198.51.100.7"): (1, 10, 0)}.items()}
