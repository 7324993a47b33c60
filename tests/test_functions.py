import ipaddress
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from netsift.functions import net
from netsift.functions.payload import (
    FNV_OFFSET, FNV_PRIME, batch_stats, byte_stats, payload_ascii, simhash, simhash_bands, simhash_distance, with_payload_features,
)
from netsift.functions.stats import exact_quantile
from netsift.operators.packets import running_total
from netsift.operators.timeline import distinct_gaps, interval_moments, sessions


def test_payload_golden_values(spark):
    row = with_payload_features(spark.createDataFrame([(b"beacon",)], "payload binary")).first()
    assert row.payload_hash.startswith("8a62e967") and row.payload_hash.endswith("3887")
    assert row.payload_prefix_hash == row.payload_hash
    assert (row.payload_length, row.payload_entropy) == (6, 2.585)
    assert (row.payload_printable_ratio, row.payload_simhash) == (1.0, "e627bf19152d67b3")
    assert simhash(b"xy") == "08f14f07b58deb1a"
    assert byte_stats(bytes(range(16))) == (4.0, 0.1875, "fe226a187f2bc1af")
    empty = with_payload_features(spark.createDataFrame([(b"",)], "payload binary")).first()
    assert empty.payload_hash is None and empty.payload_simhash is None


def test_ascii(spark):
    df = spark.createDataFrame([(b"A\r\n\t\x00".hex(),)], "h string")
    assert df.select(payload_ascii("h")).first()[0] == "A\\r\\n\\t."


def test_simhash_distance_and_bands(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 12)):
            b ^= 1 << bit
        pairs.append((f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()))
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    shared = F.arrays_overlap(simhash_bands("a", 9), simhash_bands("b", 9))
    for r in df.select("d", simhash_distance("a", "b").alias("x"), shared.alias("s")).collect():
        assert r.x == r.d
        assert r.s or r.d > 8
    assert df.limit(1).select(simhash_distance("a", F.lit("zz"))).first()[0] is None


ADDRESSES = [
    "10.0.0.1", "172.31.255.255", "172.32.0.0", "192.168.1.1", "8.8.8.8", "256.1.1.1", "1.2.3",
    "01.2.3.4", "::1", "fd00::1", "fe80::1:2", "2001:db8::ff", "::ffff:10.0.0.1", "::ffff:a00:1",
    "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "::", "1::", "junk", "", None,
]
NETS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.1.77/16", "fd00::/8", "2001:db8::/32", "::/128"]


def test_addresses_match_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    got = df.select("ip", net.ip_in_cidrs("ip", NETS).alias("x"), net.ip_bits("ip").alias("b")).collect()
    for r in got:
        try:
            ip = ipaddress.ip_address(r.ip)
        except ValueError:
            assert r.x is False and r.b is None, r.ip
            continue
        nets = [ipaddress.ip_network(n, strict=False) for n in NETS]
        assert r.x == any(ip in n for n in nets), r.ip
        bits = 32 if ip.version == 4 else 128
        assert r.b == f"{ip.version}:{int(ip):0{bits}b}", r.ip


def test_canonical_and_predicates(spark):
    df = spark.createDataFrame(
        [("2001:DB8::0:1", "10.1.2.3/8"), ("x", "y")], "ip string, cidr string"
    )
    rows = df.select(net.canonical_ip("ip"), net.canonical_cidr("cidr")).collect()
    assert [tuple(r) for r in rows] == [("2001:db8::1", "10.0.0.0/8"), (None, None)]
    with pytest.raises(ValueError):
        net.net("10.0.0.0")
    with pytest.raises(ValueError):
        net.portrange(9, 8)
    with pytest.raises(ValueError):
        net.host("nowhere")


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, p):
    rng = random.Random(3)
    rows = []
    for key, make in {
        "ties": lambda: float(rng.randint(0, 3)),
        "wide": lambda: rng.lognormvariate(0, 6),
        "signed": lambda: rng.uniform(-5, 5),
        "close": lambda: 1000 + rng.random() * 1e-6,
    }.items():
        rows += [(key, make()) for _ in range(rng.randint(100, 301))]
    rows += [("one", 4.0), ("zero", 0.0), ("zero", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in exact_quantile(df, ["k"], "v", p, "q").collect()}
    for k in got:
        values = sorted(v for kk, v in rows if kk == k)
        at = (len(values) - 1) * p
        lo, hi = values[int(at)], values[min(len(values) - 1, int(at) + (at % 1 > 0))]
        assert got[k] == pytest.approx(lo + (hi - lo) * (at % 1), rel=1e-12, abs=1e-15)
    assert set(got) == {k for k, _ in rows}
    whole = exact_quantile(df, [], "v", 0.5, "q").first().q
    assert whole == pytest.approx(statistics.median(v for _, v in rows))


def random_times(seed: int, n: int = 400):
    rng = random.Random(seed)
    spans = {"a": 3_000_000, "b": 900_000_000, "c": 60_000_000}
    return [(k, rng.randint(0, s) // 1000 * 1000) for k, s in spans.items() for _ in range(n)]


def test_intervals_across_chunks(spark):
    rows = random_times(5)
    df = spark.createDataFrame(rows, "k string, ts_us bigint")
    got = {r.k: r for r in interval_moments(df, ["k"], chunk_us=7_000_000).collect()}
    gaps = distinct_gaps(df, ["k"], chunk_us=7_000_000).collect()
    for k in "abc":
        times = sorted(t / 1e6 for kk, t in rows if kk == k)
        steps = [b - a for a, b in zip(times, times[1:])]
        mean = statistics.fmean(steps)
        assert got[k].n == len(times)
        assert got[k].mean_interval == pytest.approx(mean)
        assert got[k].interval_cv == pytest.approx(statistics.pstdev(steps) / mean, rel=1e-6)
        distinct = sorted({t for kk, t in rows if kk == k})
        assert sorted(g.gap_us for g in gaps if g.k == k) == sorted(
            b - a for a, b in zip(distinct, distinct[1:])
        )


@pytest.mark.parametrize("equal", [False, True])
def test_sessions_match_a_sequential_walk(spark, equal):
    rng = random.Random(11)
    rows = []
    for k in ("a", "b", "c"):
        t = 0
        for _ in range(300):
            t += rng.choice([0, 1_000_000, 5_000_000, 10_000_000, 10_000_001, 40_000_000])
            rows.append((k, t, t if equal else t + rng.choice([0, 0, 30_000_000]), 1))
    df = spark.createDataFrame(rows, "k string, ts_us bigint, e bigint, n int")
    got = sessions(
        df, ["k"], {"n": (F.sum("n"), "sum")}, idle_us=10_000_000, end="e", split_at_equal=equal,
        chunk_us=60_000_000,
    )
    expected = []
    for k in ("a", "b", "c"):
        number, count, latest = 0, 0, None
        for _, t, e, _ in sorted(r for r in rows if r[0] == k):
            if latest is not None and (t - latest >= 10_000_000 if equal else t - latest > 10_000_000):
                expected.append((k, number, count))
                number, count = number + 1, 0
            count, latest = count + 1, e if latest is None else max(latest, e)
        expected.append((k, number, count))
    assert sorted((r.k, r.session_no, r.n) for r in got.collect()) == sorted(expected)


def test_running_total(spark):
    rng = random.Random(2)
    places = sorted(rng.sample(range(2**46), 500)) + list(range(5000))
    places = sorted(set(places))
    values = [rng.randint(0, 9) for _ in places]
    df = spark.createDataFrame(list(zip(places, values)), "p bigint, v bigint")
    got = [r.t for r in running_total(df, F.col("v"), "p", "t").orderBy("p").collect()]
    total, expected = 0, []
    for v in values:
        total += v
        expected.append(total)
    assert got == expected


def test_canonical_text_equals_the_standard_library(spark):
    rng = random.Random(11)

    def word():
        return rng.choice(["0", "0", "0", "00", "0000", "1", "0a", "DB8", "ffff", f"{rng.getrandbits(16):x}", "12345", "g"][: rng.choice([10, 10, 12])])

    ips = [a for a in ADDRESSES if a is not None] + [
        ":::", "1::2::3", "1:2:3:4:5:6:7::8", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "::1.2.3.4", "::1.2.3.256", "1.2.3.4::",
        "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1.2.3.4\n", "::1\n", "0:0:1:0:0:1:0:0", "::ffff:0:0", "1.2.3.4%x", "1:2:3:4:5:6:1.2.3.4", "1::3:4:5:6:7:8"]
    for _ in range(600):
        words = [word() for _ in range(rng.choice([8, 8, 8, 7, 5]))]
        text = ":".join(words)
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            text = ":".join(words[:at]) + "::" + ":".join(words[at + rng.randint(1, 4):])
        ips.append(text)
    sizes = ["", "/", "/0", "/7", "/08", "/31", "/32", "/33", "/64", "/77", "/128", "/129", "/-1", "/ 8", "/255.255.240.0", "/0.0.0.255", "/255.0.255.0", "/0.0.0.0", "/8/8", "/9999999999"]
    pairs = [(ip, (ip if "%" not in ip else "::") + rng.choice(sizes)) for ip in ips]
    pairs += [(f"{rng.randrange(300)}.{rng.randrange(256)}.0.{rng.randrange(256)}", f"10.{rng.randrange(256)}.3.4{size}") for size in sizes]

    def told(make, value):
        try:
            return str(make(value))
        except ValueError:
            return None

    df = spark.createDataFrame([*pairs, (None, None)], "ip string, cidr string")
    for r in df.select("*", net.canonical_ip("ip").alias("a"), net.canonical_cidr("cidr").alias("n"), net.ip_bits("ip").alias("b")).collect():
        address = told(ipaddress.ip_address, r.ip) if r.ip is not None else None
        assert r.a == address, r.ip
        assert r.n == (told(lambda v: ipaddress.ip_network(v, strict=False), r.cidr) if r.cidr is not None else None), r.cidr
        assert (r.b is not None) == (address is not None and "%" not in r.ip), r.ip


def test_payload_batches_equal_single_payloads(spark):
    """One payload at a time, byte by byte and bit by bit, against the batch kernels."""
    rng = random.Random(5)
    payloads = [b"", None, b"a", b"ab", b"abc", bytes(70_000), b"\x00\xff" * 40_000, rng.randbytes(66_000), *[rng.randbytes(rng.randint(1, 60)) for _ in range(5_000)]]

    def slow(data):
        if not data:
            return (None, None, None)
        width = min(3, len(data))
        votes, spans = [0] * 64, len(data) - width + 1
        cache = {}
        for i in range(spans):
            shingle = data[i : i + width]
            cache[shingle] = cache.get(shingle, 0) + 1
        for shingle, times in cache.items():
            h = FNV_OFFSET
            for byte in shingle:
                h = ((h ^ byte) * FNV_PRIME) % 2**64
            for bit in range(64):
                votes[bit] += times * (h >> bit & 1)
        counts = [data.count(bytes([v])) for v in set(data)]
        entropy = -sum(c / len(data) * math.log2(c / len(data)) for c in counts)
        shown = sum(32 <= b < 127 or b in (9, 10, 13) for b in data) / len(data)
        return (round(entropy, 4), round(shown, 4), f"{sum(1 << i for i in range(64) if 2 * votes[i] >= spans):016x}")

    for got, payload in zip(batch_stats(payloads), payloads, strict=True):
        want = slow(payload)
        assert got[2] == want[2]
        assert got[:2] == pytest.approx(want[:2], abs=1.01e-4) if payload else got == want
