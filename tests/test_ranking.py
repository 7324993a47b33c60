"""Positions in a global order against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from netsift.operators.ranking import with_position
from netsift.plans.evaluation import known_ranks
from netsift.plans.prefilter import review_priority


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_positions_match_sorting(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice([None, 1, 5, 5, 5, 9]), f"name {rng.randrange(10**9)}") for i in range(700)]
    df = spark.createDataFrame(rows, "id int, score int, name string").repartition(5)
    got = with_position(df, [F.desc("score"), "name"], ranges=ranges).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [r[0] for r in want]
    assert sorted(r["position"] for r in got) == list(range(1, 701))
    spread = {r["position"] for r in got}
    assert len(spread) == 700


def test_equal_rows_and_empty_tables(spark):
    same = spark.createDataFrame([("a", 1)] * 50, "name string, n int")
    assert sorted(r["place"] for r in with_position(same, ["name"], "place").collect()) == list(range(1, 51))
    assert with_position(same.limit(0), ["name"]).collect() == []


def test_ranks_of_ipv6_peers_of_one_score(spark):
    peers = [(f"2001:db8::{i:x}", 50) for i in range(1, 400)] + [("203.0.113.9", 70)]
    ranked = spark.createDataFrame(peers, "candidate_ip string, prefilter_score int")
    known = spark.createDataFrame([("2001:db8::10",), ("203.0.113.9",), ("192.0.2.1",)], "candidate_ip string")
    order = [ip for ip, _ in sorted(peers, key=lambda p: (-p[1], p[0]))]
    got = {r["candidate_ip"]: r["rank"] for r in known_ranks(ranked, known).collect()}
    assert got == {ip: order.index(ip) + 1 for ip in ("2001:db8::10", "203.0.113.9")}


def test_review_priority_rounds_decimal_halves_to_even(spark):
    rows = [
        (91, 85, "SUSPICIOUS", 0.8, 82), (28, 78, "LIKELY_C2", 0.68, 48), (45, 7, "LIKELY_BENIGN", 0.23, 26),  # halves
        (82, 40, "SUSPICIOUS", 0.72, 65), (200, 200, "LIKELY_C2", 1.0, 100), (8, 0, None, 0.5, 6),
        (24, 0, "LIKELY_C2", None, 16), (-5, 0, "UNKNOWN", 0.9, 0), (60, 0, "LIKELY_C2", float("nan"), 53),
    ]
    columns = "score int, prefilter_score int, verdict string, confidence double, want int"
    got = review_priority(spark.createDataFrame(rows, columns)).collect()
    assert [r["review_priority"] for r in got] == [r["want"] for r in got]
