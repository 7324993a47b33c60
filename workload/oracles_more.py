"""DuckDB SQL for the queries of ``queries_more``."""

from __future__ import annotations

from workload import tables as tb
from workload.oracles import (
    EV_CTE, F_CTE, G, GAP_CTE, O, S_CTE, SCORED, SEVERITY, SIG_CTES, ctes, score_ctes,
)
from workload.tables import duck

IP4 = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"


# Every flow that meets a signature in the stronger of its two ways.
SIG_MATCHES = SIG_CTES + """,
sm AS MATERIALIZED (SELECT * FROM (SELECT *, max(ex) OVER (PARTITION BY cand, id) AS best FROM (
  SELECT o.cand, sg.id, o.host, o.ts_us, coalesce(o.payload_hash = sg.payload_hash, false) OR coalesce(o.last_payload_hash = sg.payload_hash, false) AS ex
  FROM o JOIN sg ON o.protocol = sg.protocol AND o.direction = sg.direction
  WHERE coalesce(o.payload_hash = sg.payload_hash, false) OR coalesce(o.last_payload_hash = sg.payload_hash, false)
    OR ((coalesce(o.payload_prefix_hash = sg.payload_prefix_hash, false) OR coalesce(bit_count(xor(
          ('0x' || o.payload_simhash)::UBIGINT, ('0x' || sg.payload_simhash)::UBIGINT)) <= 8, false))
      AND abs(o.payload_length - sg.payload_length) <= greatest(16, round_even(sg.payload_length * 0.15, 0))
      AND abs(o.payload_entropy - sg.payload_entropy) <= 0.75))) WHERE ex = best)"""
EVIDENCE_HOSTS = f"""{ctes(*G, GAP_CTE, EV_CTE, SIG_MATCHES)},
bq AS (SELECT cand, CASE WHEN median(mean) >= 5 THEN round_even(median(mean) / 5, 0) * 5 ELSE median(mean) END AS period
  FROM iv WHERE n >= 5 AND mean > 0 AND cv <= 0.30 GROUP BY cand),
own AS (
  SELECT cand, host, 'NON_WELL_KNOWN_PORT' AS type FROM g WHERE sport > 1023
  UNION ALL SELECT iv.cand, iv.host, 'PERIODIC_BEACON' FROM iv JOIN bq USING (cand)
    WHERE n >= 5 AND mean > 0 AND cv <= 0.30 AND abs(mean - period) / period <= 0.30
  UNION ALL SELECT cand, host, 'COMMAND_ATTACK_CORRELATION' FROM g WHERE direction = 'INBOUND'
  UNION ALL SELECT cand, host, 'TCP_SESSION_QUALITY' FROM conn WHERE NOT supp AND meta AND qual
  UNION ALL SELECT cand, host, 'SYNCHRONIZED_COMMUNICATION' FROM (
    SELECT cand, unnest(hs) AS host FROM (SELECT cand, floor(ts_us / 2e6) AS b, list(DISTINCT host) AS hs FROM g GROUP BY ALL) WHERE len(hs) >= 3))
SELECT DISTINCT ev.candidate_ip, ev.type, '' AS evidence_key, own.host AS host_ip FROM ev JOIN own ON own.cand = ev.candidate_ip AND own.type = ev.type
UNION ALL SELECT DISTINCT ev.candidate_ip, ev.type, '', g.host FROM ev JOIN g ON g.cand = ev.candidate_ip
  WHERE ev.type <> 'ANALYST_PAYLOAD_SIGNATURE' AND ev.type NOT IN ('NON_WELL_KNOWN_PORT', 'PERIODIC_BEACON', 'COMMAND_ATTACK_CORRELATION', 'TCP_SESSION_QUALITY', 'SYNCHRONIZED_COMMUNICATION')
UNION ALL SELECT DISTINCT cand, 'ANALYST_PAYLOAD_SIGNATURE', id, host FROM sm"""

#: Every flow of a commanded host within 30 s of its candidate's first command, per target.
COMMAND_REACTIONS = f"""{ctes(*G)},
cmd AS (SELECT cand, min(ts_us) AS seed FROM g WHERE direction = 'INBOUND' GROUP BY cand HAVING count(DISTINCT host) >= 3),
hst AS (SELECT DISTINCT g.cand, g.host, seed FROM g JOIN cmd USING (cand) WHERE direction = 'INBOUND'),
rx AS (SELECT cand, host, s.destination_ip AS target, s.destination_port AS target_port, s.protocol AS target_protocol,
    s.packet_count AS pk, s.ts_us - seed BETWEEN 1000000 AND 30000000 AND s.destination_ip <> cand AS hit, s.ts_us < seed AS early
  FROM s JOIN hst ON s.source_ip = hst.host AND s.direction = 'OUTBOUND' AND s.ts_us BETWEEN seed - 30000000 AND seed + 30000000)
SELECT cand AS candidate_ip, host AS host_ip, target, target_port, target_protocol, count(*) FILTER (WHERE hit) AS attacks,
  CAST(coalesce(sum(pk) FILTER (WHERE hit), 0) AS BIGINT) AS attack_packets, CAST(coalesce(sum(pk) FILTER (WHERE early), 0) AS BIGINT) AS baseline_packets
FROM rx GROUP BY ALL HAVING count(*) FILTER (WHERE hit) > 0 OR coalesce(sum(pk) FILTER (WHERE early), 0) > 0"""

# Bytes as hex pairs; FNV-1a over three bytes modulo 2^64; a bit is set by half of the shingles or more.
_STEP = "(xor(({h})::UBIGINT, {b}::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616"
_H1 = _STEP.format(h="14695981039346656037", b="b1")
PAYLOAD_FEATURES = f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM documents),
y AS (SELECT doc_id, n, x, unnest(range(n)) AS i FROM d WHERE n > 0),
v AS (SELECT doc_id, n, i, ('0x' || substr(x, 2 * i + 1, 2))::INT AS b1, CASE WHEN i + 1 < n THEN ('0x' || substr(x, 2 * i + 3, 2))::INT END AS b2,
  CASE WHEN i + 2 < n THEN ('0x' || substr(x, 2 * i + 5, 2))::INT END AS b3 FROM y),
c AS (SELECT doc_id, n, b1, count(*) AS k FROM v GROUP BY ALL),
e AS (SELECT doc_id, round(-sum(k / n * log2(k / n)), 4) AS payload_entropy,
  round(coalesce(sum(k) FILTER (WHERE b1 BETWEEN 32 AND 126 OR b1 IN (9, 10, 13)), 0) / any_value(n), 4) AS payload_printable_ratio FROM c GROUP BY 1),
h1 AS (SELECT doc_id, b2, b3, {_H1} AS h FROM v WHERE i + least(3, n) <= n),
h2 AS (SELECT doc_id, b3, CASE WHEN b2 IS NULL THEN h ELSE {_STEP.format(h="h", b="coalesce(b2, 0)")} END AS h FROM h1),
h3 AS (SELECT doc_id, (CASE WHEN b3 IS NULL THEN h ELSE {_STEP.format(h="h", b="coalesce(b3, 0)")} END)::UBIGINT AS h FROM h2),
s AS (SELECT doc_id, {" + ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) >= count(*) THEN {1 << b}::HUGEINT ELSE 0 END)" for b in range(64))} AS m FROM h3 GROUP BY 1)
SELECT doc_id, payload_entropy, payload_printable_ratio, lpad(format('{{:x}}', m::UBIGINT), 16, '0') AS payload_simhash
FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)"""


def num(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def within(col: str, low: str, high: str) -> str:
    return f"{IP4.format(col)} BETWEEN {num(low)} AND {num(high)}"


PRE = f"""pt AS (SELECT cand, count(*) AS fc, sum(greatest(packet_count, 0)) AS pk, sum(greatest(total_bytes, 0)) AS tb,
    list_distinct(list(sport) FILTER (WHERE sport IS NOT NULL)) AS ports FROM o GROUP BY cand),
dt AS (SELECT DISTINCT cand, host, ts_us FROM o),
ga AS (SELECT cand, host, (ts_us - lag(ts_us) OVER (PARTITION BY cand, host ORDER BY ts_us)) / 1e6 AS gap FROM dt),
gm AS (SELECT cand, host, count(gap) AS n, median(gap) AS period FROM ga WHERE gap IS NOT NULL GROUP BY ALL),
gd AS (SELECT cand, host, any_value(n) AS n, any_value(period) AS period, median(abs(gap - period)) / any_value(period) AS dev
  FROM ga JOIN gm USING (cand, host) WHERE gap IS NOT NULL AND n >= 3 AND period > 0 GROUP BY ALL),
fs AS (SELECT cand, host, min(ts_us) AS t0 FROM o GROUP BY ALL),
fo AS (SELECT cand, list_reduce(list({{'n': n, 'd': dev, 'p': period}} ORDER BY t0, host),
      lambda a, x: CASE WHEN x.n > a.n OR x.d < a.d THEN x ELSE a END, {{'n': 0::BIGINT, 'd': 1.0::DOUBLE, 'p': 0.0::DOUBLE}}) AS v
  FROM gd JOIN fs USING (cand, host) WHERE dev <= 0.2 GROUP BY cand),
pc0 AS (SELECT cand, coalesce(payload_simhash, payload_hash, payload_prefix_hash) AS x, count(*) AS c FROM o
  WHERE coalesce(payload_simhash, payload_hash, payload_prefix_hash) IS NOT NULL GROUP BY ALL),
pc AS (SELECT cand, sum(c) AS tot, max(c) AS mx FROM pc0 GROUP BY cand HAVING max(c) >= 3 AND max(c) / sum(c) >= 0.6),
sy AS (SELECT cand, max(h) AS h FROM (SELECT cand, floor(ts_us / 2e6) AS b, count(DISTINCT host) AS h FROM o GROUP BY ALL)
  GROUP BY cand HAVING max(h) >= 3),
md AS (SELECT median(fc) AS fm, median(tb) AS bm FROM pt),
mm AS (SELECT median(abs(fc - fm)) AS fd, median(abs(tb - bm)) AS bd FROM pt, md),
pr0 AS (SELECT pt.cand, fc, least(10.0, 2 + 2 * log2(fc + 1)) AS base,
    CASE WHEN v.n >= 3 THEN round(35 * (1 - least(1.0, v.d)), 2) ELSE 0 END AS beacon,
    coalesce(round(20 * (mx / tot), 2), 0) AS cluster, CASE WHEN h IS NULL THEN 0 ELSE least(20.0, 5.0 * h) END AS sync,
    CASE WHEN greatest((fc - fm) / greatest(1, 1.4826 * fd), (tb - bm) / greatest(1, 1.4826 * bd)) >= 3
      THEN least(20.0, 5 + greatest((fc - fm) / greatest(1, 1.4826 * fd), (tb - bm) / greatest(1, 1.4826 * bd))) ELSE 0 END AS anomaly,
    CASE WHEN len(ports) > 0 AND len(list_filter(ports, lambda p: p NOT IN (53, 123))) = 0 THEN -15 ELSE 0 END
    + CASE WHEN tb >= 52428800 OR pk >= 100000 THEN -20 ELSE 0 END
    + CASE WHEN pt.cand = '192.0.2.53' THEN -100 ELSE 0 END AS pen
  FROM pt CROSS JOIN md CROSS JOIN mm LEFT JOIN fo ON fo.cand = pt.cand LEFT JOIN pc ON pc.cand = pt.cand
   LEFT JOIN sy ON sy.cand = pt.cand),
pre AS MATERIALIZED (SELECT *, CAST(greatest(0, least(100, round_even(base + beacon + cluster + sync + anomaly + pen, 0))) AS INT) AS ps FROM pr0)"""

TOUCH = f"""cx AS (SELECT candidate_ip FROM scored),
tc AS MATERIALIZED (SELECT s.*, cx.candidate_ip FROM s JOIN cx ON s.source_ip = cx.candidate_ip
  UNION ALL SELECT s.*, cx.candidate_ip FROM s JOIN cx ON s.destination_ip = cx.candidate_ip AND s.source_ip <> s.destination_ip)"""
TOUCHED = (*SCORED, TOUCH)

ROLES = """dec AS MATERIALIZED (SELECT *, CASE WHEN nd = 'OUTBOUND' THEN destination_ip WHEN nd = 'INBOUND' THEN source_ip END AS external_ip,
    CASE WHEN nd = 'OUTBOUND' THEN source_ip WHEN nd = 'INBOUND' THEN destination_ip END AS internal_ip,
    CASE WHEN nd = 'OUTBOUND' THEN destination_port WHEN nd = 'INBOUND' THEN source_port END AS service_port,
    CASE WHEN direction <> 'UNKNOWN' THEN 'DIRECTION' WHEN nd IS NOT NULL THEN 'CIDR_FALLBACK' END AS role_source,
    payload_hash IS NOT NULL AS has_payload
  FROM (SELECT *, CASE WHEN direction IN ('OUTBOUND', 'INBOUND') THEN direction
      WHEN source_ip LIKE '10.%' AND destination_ip NOT LIKE '10.%' THEN 'OUTBOUND'
      WHEN destination_ip LIKE '10.%' AND source_ip NOT LIKE '10.%' THEN 'INBOUND' END AS nd FROM f))"""
ISO = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"
FLOW_JSON = (
    "'{\"destination_ip\":\"' || destination_ip || '\",\"destination_port\":' || coalesce(CAST(destination_port AS VARCHAR), 'null') || "
    "',\"direction\":\"' || direction || '\",\"job_id\":\"job-1\",\"packet_count\":' || packet_count || ',\"payload_hash\":' || "
    "coalesce('\"' || payload_hash || '\"', 'null') || ',\"protocol\":\"' || protocol || '\",\"sensor_id\":\"' || sensor_id || "
    "'\",\"source_ip\":\"' || source_ip || '\",\"source_port\":' || coalesce(CAST(source_port AS VARCHAR), 'null') || "
    f"',\"timestamp\":\"' || {ISO} || '\",\"total_bytes\":' || total_bytes || '}}'"
)

CAND, DEC, ACT, FEED, JOBS = (
    f"{n} AS ({duck(s)})"
    for n, s in (("cd", tb.CANDIDATES), ("dd", tb.DECISIONS), ("aa", tb.ACTIONS), ("fd", tb.FEED), ("jj", tb.JOBS))
)
WORK = f"""{CAND}, {DEC}, {ACT},
vd AS (SELECT candidate_id, id AS verdict_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, id DESC) AS rn
  FROM dd WHERE confidence IN ('CONFIRMED', 'HIGH', 'MEDIUM', 'LOW') AND note <> '' AND created_at LIKE '%Z') WHERE rn = 1),
va AS (SELECT candidate_id, status FROM (SELECT aa.candidate_id, aa.status, row_number() OVER (PARTITION BY aa.candidate_id ORDER BY created_at DESC, aa.id DESC) AS rn
  FROM aa JOIN vd ON aa.candidate_id = vd.candidate_id AND aa.verdict_id = vd.verdict_id) WHERE rn = 1),
wf AS MATERIALIZED (SELECT cd.*, coalesce(verdict, 'UNREVIEWED') AS verdict, verdict_id,
    coalesce(status, CASE WHEN verdict = 'CONFIRMED_C2' THEN 'PENDING' ELSE 'NOT_REQUIRED' END) AS action_status,
    CASE WHEN verdict = 'CONFIRMED_C2' THEN CASE status WHEN 'IN_PROGRESS' THEN 'ACTION_IN_PROGRESS' WHEN 'COMPLETED' THEN 'ACTION_COMPLETED' ELSE 'ACTION_REQUIRED' END
         WHEN verdict = 'UNDER_REVIEW' THEN 'IN_REVIEW' WHEN verdict = 'FALSE_POSITIVE' THEN 'FALSE_POSITIVE' ELSE 'NEEDS_REVIEW' END AS workflow_status
  FROM cd LEFT JOIN vd USING (candidate_id) LEFT JOIN va USING (candidate_id))"""
TI = f"""{CAND}, {FEED},
ff AS (SELECT ip, count(*) FILTER (WHERE status <> 'NOT_CONFIGURED') AS cp, count(*) FILTER (WHERE status = 'OK') AS sp,
    bool_or(status = 'ERROR') AS failed, max(malicious) AS vm, max(suspicious) AS vs, max(abuse_confidence_score) AS ab, max(event_count) AS me
  FROM fd GROUP BY ip),
ti AS MATERIALIZED (SELECT cd.*, coalesce(cp, 0) AS cp, coalesce(sp, 0) AS sp, coalesce(vm, 0) AS vm, coalesce(vs, 0) AS vs, coalesce(ab, 0) AS ab,
    coalesce(me, 0) AS me, CASE WHEN failed THEN 'PARTIAL' WHEN failed IS NOT NULL THEN 'COMPLETED' ELSE 'NOT_CHECKED' END AS st,
    CAST(coalesce(vm, 0) + coalesce(vs, 0) > 0 AS INT) + CAST(coalesce(ab, 0) > 0 AS INT) + CAST(coalesce(me, 0) > 0 AS INT) AS pp
  FROM cd LEFT JOIN ff ON ff.ip = cd.candidate_ip)"""
SENS = f"""ss AS MATERIALIZED (SELECT *, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 23:59:59') - epoch_us(last_heartbeat_at) > 21600000000 THEN 'OFFLINE'
    WHEN abs(clock_offset_ms) > 2000 THEN 'DEGRADED' ELSE 'ONLINE' END AS live FROM ({duck(tb.SENSORS)}))"""
SIGHT = f"si AS ({duck(tb.SIGHTINGS)})"
CASES = f"ca AS ({duck(tb.CASES)})"
EVALUATED = f"""{CASES},
e0 AS (SELECT model_profile, count(*) AS case_count,
    count(*) FILTER (WHERE expected_malicious AND p) AS true_positive, count(*) FILTER (WHERE NOT expected_malicious AND p) AS false_positive,
    count(*) FILTER (WHERE NOT expected_malicious AND NOT p) AS true_negative, count(*) FILTER (WHERE expected_malicious AND NOT p) AS false_negative,
    round(avg(pow(CASE WHEN predicted_verdict = 'LIKELY_BENIGN' THEN 1 - confidence ELSE confidence END - CAST(expected_malicious AS INT), 2)), 4) AS brier_score,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens_total, CAST(sum(output_tokens) AS BIGINT) AS output_tokens_total, round(sum(estimated_cost_usd), 6) AS estimated_cost_usd,
    round(quantile_cont(latency_ms, 0.5), 2) AS latency_ms_p50, round(quantile_cont(latency_ms, 0.95), 2) AS latency_ms_p95,
    round(count(*) FILTER (WHERE evidence_valid) / count(*), 4) AS evidence_valid_rate,
    round(count(*) FILTER (WHERE unsafe_recommendation) / count(*), 4) AS unsafe_recommendation_rate
  FROM (SELECT *, predicted_verdict IN ('LIKELY_C2', 'SUSPICIOUS') AS p FROM ca) GROUP BY model_profile),
e1 AS (SELECT *, coalesce(round(true_positive / nullif(true_positive + false_positive, 0), 4), 0) AS "precision",
    coalesce(round(true_positive / nullif(true_positive + false_negative, 0), 4), 0) AS recall FROM e0),
e2 AS (SELECT *, coalesce(round(2 * "precision" * recall / nullif("precision" + recall, 0), 4), 0) AS f1 FROM e1)"""
LABELS = f"fl AS ({duck(tb.FLOW_LABELS)})"
LATEST = "la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY created_at DESC, id DESC) AS rn FROM fl) WHERE rn = 1)"
LF = "lf AS (SELECT la.*, f.payload_hash FROM la JOIN f ON f.flow_no = la.flow_id WHERE verdict = 'BENIGN' AND payload_hash IS NOT NULL)"
KNOWN = "kb AS (SELECT DISTINCT candidate_ip FROM ev WHERE type IN ('COMMAND_ATTACK_CORRELATION', 'SYNCHRONIZED_COMMUNICATION', 'SINGLE_HOST_BEACON'))"
STEPS = f"""cw AS (SELECT DISTINCT candidate_ip, detector AS changed FROM ev),
sc0 AS (SELECT ev.*, cw.changed, st.step FROM ev JOIN cw USING (candidate_ip) CROSS JOIN (VALUES (1.25), (1.5), (1.75), (2.0)) st(step)),
{score_ctes("sc0", "changed, step", "CASE WHEN detector = changed THEN step ELSE 1.0 END", "whatif")},
gw AS MATERIALIZED (SELECT w.candidate_ip, changed AS detector, CAST(min(step) AS DOUBLE) AS recommended_value, min_by(w.score, step) AS projected_score
  FROM whatif w WHERE w.score >= 60 GROUP BY ALL)"""
CUSTOM_W = "CASE detector WHEN 'common_destination' THEN 1.5 WHEN 'tcp_session_quality' THEN 0.5 WHEN 'periodic_beacon' THEN 0.0 ELSE 1.0 END"
COND_W = "CASE detector WHEN 'common_destination' THEN 1.5 WHEN 'tcp_session_quality' THEN 0.5 ELSE 1.0 END"
PKF = """pk0 AS (SELECT *, coalesce(source_port, -1) AS sp, coalesce(destination_port, -1) AS dp FROM f),
pk1 AS (SELECT *, ts_us - lag(ts_us) OVER w AS gap FROM pk0 WINDOW w AS (PARTITION BY sensor_id, direction, source_ip, destination_ip, sp, dp, protocol ORDER BY ts_us)),
pk2 AS (SELECT *, sum(CASE WHEN gap >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, direction, source_ip, destination_ip, sp, dp, protocol
    ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS sno FROM pk1),
pkf AS MATERIALIZED (SELECT sensor_id, direction, source_ip, destination_ip, nullif(sp, -1) AS source_port, nullif(dp, -1) AS destination_port, protocol, sno,
    min(ts_us) AS ts_us, max(ts_us) AS end_us, count(*) AS packet_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
    min(total_bytes) AS b0, max(total_bytes) AS b1,
    arg_min(payload_hash, (ts_us, flow_no)) FILTER (WHERE payload_hash IS NOT NULL) AS payload_hash,
    arg_max(payload_hash, (ts_us, flow_no)) FILTER (WHERE payload_hash IS NOT NULL) AS last_payload_hash,
    CAST(sum(CASE WHEN tcp_flags_observed THEN tcp_syn_count ELSE 0 END) AS BIGINT) AS tcp_syn_count,
    count(*) FILTER (WHERE tcp_flags_observed AND tcp_syn_count > 0 AND NOT tcp_ack_count > 0) AS tcp_syn_only_count
  FROM pk2 GROUP BY sensor_id, direction, source_ip, destination_ip, sp, dp, protocol, sno)"""


def more_oracles() -> dict[str, str]:
    p = {
        "prefilter": f"""{ctes(*O, PRE)} SELECT cand AS candidate_ip, ps AS prefilter_score, fc AS flow_count, round(base, 2) AS baseline,
  round(beacon, 2) AS beacon, round(cluster, 2) AS cluster, CAST(round(sync, 2) AS DOUBLE) AS sync, round(anomaly, 2) AS anomaly FROM pre""",
        "prefilter_topk": f"""{ctes(*O, PRE)} SELECT cand AS candidate_ip, ps AS prefilter_score FROM pre ORDER BY ps DESC, cand LIMIT 20""",
        "merge_ranking": f"""{ctes(*SCORED, PRE)} SELECT coalesce(candidate_ip, pre.cand) AS candidate_ip, coalesce(score, 0) AS score,
  coalesce(ps, 0) AS prefilter_score, CASE WHEN score IS NOT NULL THEN {SEVERITY} WHEN ps >= 70 THEN 'HIGH' WHEN ps >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CAST(round(0.55 * coalesce(score, 0) + 0.25 * coalesce(ps, 0), 6) AS DOUBLE) AS rank_value,
  CASE WHEN score IS NULL THEN 'ai-prefilter-' || left(sha256('job-1:' || pre.cand), 16) END AS prefilter_id
FROM scored FULL JOIN pre ON pre.cand = candidate_ip""",
        "review_priority": f"""{ctes(CASES)}, x AS (SELECT input_tokens % 101 AS s, output_tokens % 101 AS q, confidence,
    CASE WHEN input_tokens % 3 <> 0 THEN predicted_verdict END AS v FROM ca)
SELECT CAST(round_even(CASE WHEN v IS NULL THEN 0.6875 * s + 0.3125 * q ELSE 0.55 * s + 0.25 * q + 0.20 * (100 * confidence *
  CASE v WHEN 'LIKELY_C2' THEN 1.0 WHEN 'SUSPICIOUS' THEN 0.7 WHEN 'INCONCLUSIVE' THEN 0.3 ELSE 0.0 END) END, 0) AS INT) AS review_priority, count(*) AS n
FROM x GROUP BY 1""",
        "allowlist_suppression": f"""{ctes(*O, EV_CTE)} SELECT DISTINCT candidate_ip FROM ev
WHERE candidate_ip = '192.0.2.80' OR {within('candidate_ip', '192.0.2.128', '192.0.2.159')}""",
        "traffic_buckets": f"""{ctes(*TOUCHED)}, sp AS (SELECT candidate_ip, min(ts_us) AS t0, (max(ts_us) - min(ts_us)) / 1e6 AS span, count(*) AS n FROM tc GROUP BY candidate_ip),
sq AS (SELECT *, CASE WHEN span = 0 THEN 1 ELSE least(24, n) END AS nb FROM sp),
sr AS (SELECT *, greatest(1.0, span / nb) AS w FROM sq)
SELECT candidate_ip, CAST(least(nb - 1, floor(((ts_us - t0) / 1e6) / w)) AS INT) AS bucket, CAST(sum(packet_count) AS BIGINT) AS packets,
  CAST(sum(total_bytes) AS BIGINT) AS bytes, count(*) AS flows FROM tc JOIN sr USING (candidate_ip) GROUP BY 1, 2""",
        "traffic_summary": f"""{ctes(*TOUCHED)} SELECT candidate_ip, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols,
  CAST(count(DISTINCT CASE WHEN destination_ip = candidate_ip THEN destination_port ELSE source_port END) AS INT) AS n_ports, count(*) AS flow_count,
  CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(total_bytes) AS BIGINT) AS byte_count FROM tc GROUP BY candidate_ip""",
        "traffic_values": f"""{ctes(*TOUCHED)} SELECT DISTINCT candidate_ip, 'domain' AS kind, domain AS value FROM tc WHERE domain <> ''
UNION ALL SELECT DISTINCT candidate_ip, 'attack_target', attack_target_ip FROM tc WHERE attack_target_ip <> ''""",
        "flow_filter_groups": f"""{ctes(F_CTE, ROLES)} SELECT flow_no, external_ip, internal_ip, service_port, role_source, has_payload FROM dec
WHERE ((({within('source_ip', '192.0.2.128', '192.0.2.191')} OR {within('destination_ip', '192.0.2.128', '192.0.2.191')}) AND protocol = 'TCP')
   OR coalesce(service_port = 53, false) OR (has_payload AND direction = 'INBOUND'))
  AND NOT (source_ip = '10.0.8.7' OR destination_ip = '10.0.8.7')
  AND NOT coalesce(source_port = 443 AND direction = 'INBOUND', false)""",
        "flow_page": f"""{ctes(F_CTE)} SELECT flow_no, ts_us FROM f WHERE protocol = 'UDP' ORDER BY ts_us, flow_no LIMIT 50 OFFSET 100""",
        "flow_ids": f"""{ctes(F_CTE)} SELECT flow_no, left(sha256({FLOW_JSON}), 24) AS flow_id FROM f""",
        "record_filter": f"""{ctes(F_CTE)} SELECT flow_no, sensor_id FROM f WHERE (source_ip = '192.0.2.200' OR destination_ip = '192.0.2.200')
  AND protocol = 'TCP' AND direction = 'OUTBOUND' AND (source_port = 443 OR destination_port = 443)
  AND make_timestamp(ts_us) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""",
        "packet_predicates": f"""{ctes(F_CTE)} SELECT flow_no FROM f WHERE (source_ip = '192.0.2.53' OR destination_ip = '192.0.2.53'
   OR {within('destination_ip', '192.0.2.64', '192.0.2.95')} OR coalesce(destination_port BETWEEN 8000 AND 9000, false))
  AND NOT (coalesce(source_port = 123, false) OR coalesce(destination_port = 123, false)) AND source_ip LIKE '10.%'""",
        "direction_classes": f"""{ctes(F_CTE)}, x AS (SELECT CASE WHEN flow_no % 4 = 0 THEN 'INBOUND' WHEN flow_no % 5 = 2 THEN 'OUTBOUND'
    WHEN source_ip LIKE '10.%' AND destination_ip NOT LIKE '10.%' THEN 'OUTBOUND' WHEN destination_ip LIKE '10.%' AND source_ip NOT LIKE '10.%' THEN 'INBOUND'
    ELSE 'UNKNOWN' END AS direction, CASE WHEN flow_no % 4 = 0 THEN 'INTERFACE' WHEN flow_no % 5 = 2 THEN 'VLAN'
    WHEN (source_ip LIKE '10.%') <> (destination_ip LIKE '10.%') THEN 'CIDR' ELSE 'NONE' END AS direction_source FROM f)
SELECT direction, direction_source, count(*) AS n FROM x GROUP BY ALL""",
        "latest_labels": f"{ctes(LABELS, LATEST)} SELECT flow_id, verdict, created_at FROM la",
        "signature_conflict": f"{ctes(F_CTE, LABELS, LATEST, LF)} SELECT DISTINCT payload_hash FROM lf",
        "signatures_from_labels": f"""{ctes(F_CTE, LABELS, LATEST, LF)} SELECT 'sig-' || fl.id AS id, protocol || ' ' || left(f.payload_hash, 12) AS name,
  f.payload_hash, protocol, direction FROM fl JOIN f ON f.flow_no = fl.flow_id
WHERE fl.verdict = 'C2' AND f.payload_hash IS NOT NULL AND f.payload_hash NOT IN (SELECT payload_hash FROM lf)""",
        "workflow": f"{ctes(WORK)} SELECT candidate_id, verdict, verdict_id, action_status, workflow_status FROM wf",
        "workflow_counts": f"""{ctes(WORK)} SELECT count(*) FILTER (WHERE workflow_status = 'NEEDS_REVIEW') AS needs_review,
  count(*) FILTER (WHERE workflow_status = 'IN_REVIEW') AS in_review, count(*) FILTER (WHERE workflow_status = 'ACTION_REQUIRED') AS action_required,
  count(*) FILTER (WHERE workflow_status = 'ACTION_IN_PROGRESS') AS action_in_progress, count(*) FILTER (WHERE workflow_status = 'ACTION_COMPLETED') AS action_completed,
  count(*) FILTER (WHERE workflow_status = 'FALSE_POSITIVE') AS false_positive,
  count(*) FILTER (WHERE workflow_status IN ('ACTION_COMPLETED', 'FALSE_POSITIVE')) AS done FROM wf WHERE score >= 20 AND NOT excluded""",
        "candidate_page": f"""{ctes(WORK)} SELECT candidate_id, score, verdict FROM wf WHERE score >= 10 AND severity = 'HIGH' AND NOT excluded
ORDER BY score DESC, candidate_id LIMIT 25 OFFSET 25""",
        "ti_assessment": f"""{ctes(TI)} SELECT candidate_id, st AS ti_status, CASE WHEN cp = 0 THEN 'UNKNOWN' WHEN st = 'PARTIAL' THEN 'INCOMPLETE' WHEN pp > 0 THEN 'POSITIVE' ELSE 'NO_SIGNAL' END AS ti_signal,
  pp AS positive_providers, cp AS configured_providers, sp AS successful_providers, vm AS virustotal_malicious, ab AS abuse_confidence_score, me AS misp_event_count FROM ti""",
        "ti_priority": f"""{ctes(TI)} SELECT candidate_id, pp AS positive_providers FROM ti WHERE pp > 0
ORDER BY me > 0 DESC, pp DESC, vm + vs DESC, ab DESC, score DESC, last_seen DESC, candidate_id LIMIT 100""",
        "immediate_action": f"""{ctes(FEED)} SELECT ip AS candidate_ip, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM fd
WHERE status = 'OK' AND ((provider = 'virustotal' AND malicious + suspicious > 0) OR (provider = 'abuseipdb' AND abuse_confidence_score >= 50)
  OR (provider = 'misp' AND event_count > 1)) GROUP BY ip HAVING count(DISTINCT provider) >= 2""",
        "candidates_of_jobs": f"{ctes(CAND, JOBS)} SELECT candidate_id, job_id, name AS job_name FROM cd JOIN jj ON jj.id = cd.job_id",
        "bulk_verdict": f"""{ctes(CAND, DEC)}, x AS (SELECT DISTINCT CASE WHEN id LIKE '%7' THEN candidate_id || 'x' ELSE candidate_id END AS candidate_id FROM dd)
SELECT CASE WHEN count(*) FILTER (WHERE cd.candidate_id IS NULL) = 0 THEN 'COMPLETED' ELSE 'PARTIAL' END AS status, count(*) AS total,
  count(cd.candidate_id) AS succeeded, count(*) FILTER (WHERE cd.candidate_id IS NULL) AS failed FROM x LEFT JOIN cd USING (candidate_id)""",
        "score_override": f"""{ctes(CAND, DEC)}, x AS (SELECT candidate_id, count(*) * 7 - 60 AS adj, bool_or(verdict = 'FALSE_POSITIVE') AS fp FROM dd GROUP BY 1)
SELECT candidate_id AS candidate_ip, CAST(greatest(0, least(100, score + coalesce(adj, 0))) AS INT) AS score, coalesce(fp, false) AS excluded FROM cd LEFT JOIN x USING (candidate_id)""",
        "sensor_quality": f"""{ctes(SENS)} SELECT sensor_id, name, live AS status, received_packets, dropped_packets,
  round(coalesce(dropped_packets / nullif(received_packets + dropped_packets, 0), 0) * 100, 2) AS drop_rate_percent FROM ss""",
        "fleet": f"""{ctes(SENS)} SELECT count(*) AS total, count(*) FILTER (WHERE live = 'ONLINE') AS online, count(*) FILTER (WHERE live = 'OFFLINE') AS offline,
  count(*) FILTER (WHERE live = 'DEGRADED') AS degraded, CAST(sum(dropped_packets) AS BIGINT) AS dropped_packets FROM ss""",
        "job_counts": f"""{ctes(JOBS)} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('CAPTURING', 'ANALYZING')) AS active,
  CAST(0 AS BIGINT) AS waiting_for_sensor, count(*) FILTER (WHERE status = 'CAPTURING') AS capturing, CAST(0 AS BIGINT) AS uploading, CAST(0 AS BIGINT) AS ingesting,
  count(*) FILTER (WHERE status = 'ANALYZING') AS analyzing,
  count(*) FILTER (WHERE status = 'COMPLETED' AND completed_at >= TIMESTAMP '2001-07-31 12:00:00') AS completed_24h,
  count(*) FILTER (WHERE status = 'FAILED' AND completed_at >= TIMESTAMP '2001-07-31 12:00:00') AS failed_24h,
  count(*) FILTER (WHERE status = 'PARTIALLY_COMPLETED' AND completed_at >= TIMESTAMP '2001-07-31 12:00:00') AS partially_completed_24h FROM jj""",
        "job_page": f"""{ctes(JOBS)} SELECT id, name FROM jj WHERE status = 'FAILED' AND lower(name) LIKE '%urgent%' ORDER BY created_at DESC, id LIMIT 50""",
        "dashboard_severity": f"""{ctes(SIGHT)} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
  count(*) FILTER (WHERE first_seen >= TIMESTAMP '2024-01-01 12:30:00') AS new_24h FROM si""",
        "hourly_trend": f"""{ctes(SIGHT)} SELECT epoch_us(h) AS hour_us, count(first_seen) AS n
FROM (SELECT TIMESTAMP '2024-01-02 12:00:00' - to_hours(CAST(i AS INTEGER)) AS h FROM range(24) r(i))
LEFT JOIN si ON date_trunc('hour', first_seen) = h AND first_seen <= TIMESTAMP '2024-01-02 12:30:00' GROUP BY h""",
        "attention": f"""{ctes(SENS, JOBS, WORK)},
a0 AS (SELECT 0 AS src, live || '_SENSOR' AS kind, CASE live WHEN 'OFFLINE' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, name AS title,
    row_number() OVER (ORDER BY sensor_id) AS place FROM ss WHERE live <> 'ONLINE'),
j5 AS (SELECT * FROM jj ORDER BY created_at DESC, id LIMIT 5),
a1 AS (SELECT 1, CASE status WHEN 'FAILED' THEN 'FAILED_ANALYSIS' ELSE 'PARTIALLY_COMPLETED_ANALYSIS' END, CASE status WHEN 'FAILED' THEN 'HIGH' ELSE 'MEDIUM' END,
    name, row_number() OVER (ORDER BY created_at DESC, name) FROM j5 WHERE status IN ('FAILED', 'PARTIALLY_COMPLETED')),
c5 AS (SELECT * FROM wf WHERE workflow_status IN ('NEEDS_REVIEW', 'IN_REVIEW', 'ACTION_REQUIRED', 'ACTION_IN_PROGRESS') ORDER BY last_seen DESC, candidate_id LIMIT 5),
a2 AS (SELECT 2, 'CRITICAL_CANDIDATE', 'CRITICAL', candidate_ip, row_number() OVER (ORDER BY last_seen DESC, candidate_ip) FROM c5 WHERE severity = 'CRITICAL'),
al AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2)
SELECT CAST(position AS INT) AS position, kind, severity, title FROM (SELECT *, row_number() OVER (ORDER BY
   CASE WHEN place > CASE WHEN src = 2 THEN 2 ELSE 3 END THEN 1 ELSE 0 END, src, place) AS position FROM al) WHERE position <= 8""",
        "packet_dedup": f"""{ctes(F_CTE)}, ob AS (SELECT flow_no, 'sensor-a' AS sid, ts_us FROM f UNION ALL SELECT flow_no, 'sensor-b', ts_us + flow_no % 8 * 1000 FROM f),
lp AS (SELECT flow_no, floor(floor(ts_us / 1000) / 10) AS b, count(*) AS observations, count(DISTINCT sid) AS sensors FROM ob GROUP BY 1, 2)
SELECT observations, sensors, count(*) AS packets FROM lp GROUP BY 1, 2""",
        "packets_to_flows": f"""{ctes(F_CTE, PKF)} SELECT sensor_id, direction, source_ip, destination_ip, source_port, destination_port, protocol, ts_us, end_us, packet_count,
  total_bytes, CASE WHEN b0 = b1 THEN CAST(b0 AS VARCHAR) ELSE b0 || ',' || b1 END AS sizes, payload_hash, last_payload_hash, tcp_syn_count, tcp_syn_only_count FROM pkf""",
        "bidirectional": f"""{ctes(F_CTE, PKF)}, fx AS (SELECT *, row_number() OVER () AS id,
    CASE direction WHEN 'INBOUND' THEN 'OUTBOUND' WHEN 'OUTBOUND' THEN 'INBOUND' ELSE direction END AS flip FROM pkf),
px AS (SELECT DISTINCT a.id FROM fx a JOIN fx b ON a.sensor_id = b.sensor_id AND a.protocol = b.protocol AND a.direction = b.flip AND a.source_ip = b.destination_ip
  AND a.destination_ip = b.source_ip AND coalesce(a.source_port, -1) = coalesce(b.destination_port, -1) AND coalesce(a.destination_port, -1) = coalesce(b.source_port, -1)
  AND b.ts_us < a.end_us + 60000000 AND a.ts_us < b.end_us + 60000000)
SELECT protocol, id IN (SELECT id FROM px) AS bidirectional, count(*) AS n FROM fx GROUP BY 1, 2""",
        "minute_flows": f"""{ctes(F_CTE)} SELECT source_ip, destination_ip, count(*) AS flows, CAST(sum(c) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes FROM (
  SELECT source_ip, destination_ip, destination_port, floor(ts_us / 6e7) AS m, count(*) AS c, sum(total_bytes) AS b FROM f GROUP BY ALL) GROUP BY 1, 2""",
        "packet_cap": f"""{ctes(F_CTE)}, lm AS (SELECT 1000 * count(*) // 10 AS lim FROM f),
cu AS (SELECT *, sum(packet_count) OVER (ORDER BY flow_no) AS cum FROM f)
SELECT flow_no, CAST(CASE WHEN cum > lim THEN lim - (cum - packet_count) ELSE packet_count END AS BIGINT) AS packet_count,
  CAST(CASE WHEN cum > lim THEN floor(total_bytes * (lim - (cum - packet_count)) / packet_count) ELSE total_bytes END AS BIGINT) AS total_bytes,
  CASE WHEN cum > lim AND tcp_flags_observed THEN 0 ELSE tcp_ack_count END AS tcp_ack_count,
  CASE WHEN cum > lim AND tcp_flags_observed THEN false ELSE bidirectional END AS bidirectional
FROM cu, lm WHERE cum - packet_count < lim""",
        "packet_cap_summary": f"""{ctes(F_CTE)}, x AS (SELECT CAST(sum(packet_count) AS BIGINT) AS s, CAST(1000 * count(*) // 10 AS BIGINT) AS lim FROM f)
SELECT lim AS configured_max_packets, s AS observed_packets, least(s, lim) AS retained_packets, s - least(s, lim) AS discarded_packets FROM x""",
        "quota_allocation": f"""{ctes(SENS)} SELECT sensor_id, CAST(1000003 // (SELECT count(*) FROM ss) + CASE WHEN rn <= 1000003 % (SELECT count(*) FROM ss) THEN 1 ELSE 0 END AS BIGINT) AS quota
FROM (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) AS rn FROM ss)""",
        "packet_export": f"""{ctes(F_CTE)}, x AS (SELECT CASE WHEN sensor_id = 'sensor-b' THEN 1 ELSE 0 END AS source_order, flow_no AS packet_index, total_bytes % 1500 + 16 AS sz FROM f),
y AS (SELECT source_order, packet_index, CAST(sum(sz) OVER (ORDER BY source_order, packet_index) AS BIGINT) AS serialized_bytes FROM x)
SELECT * FROM y WHERE serialized_bytes + 24 <= 300 * (SELECT count(*) FROM f)""",
        "flow_validation": f"""{ctes(F_CTE)}, x AS (SELECT *, CASE WHEN flow_no % 7 = 0 THEN 0 ELSE tcp_syn_count END AS sc FROM f)
SELECT 'packet_count' AS problem, count(*) AS n FROM x WHERE flow_no % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 'payload_entropy', count(*) FROM x WHERE payload_entropy * 1.6 > 8 HAVING count(*) > 0
UNION ALL SELECT 'syn_counters', count(*) FROM x WHERE tcp_syn_only_count + tcp_syn_ack_count > sc HAVING count(*) > 0
UNION ALL SELECT 'direction', count(*) FROM x WHERE flow_no % 13 = 0 HAVING count(*) > 0""",
        "confusion_matrix": f"{ctes(EVALUATED)} SELECT * FROM e2",
        "model_ranking": f"""{ctes(EVALUATED)}, r AS (SELECT row_number() OVER (ORDER BY recall DESC, unsafe_recommendation_rate, evidence_valid_rate DESC, f1 DESC, latency_ms_p95, model_profile) AS position, model_profile FROM e2)
SELECT CAST(position AS INT) AS position, model_profile, position = 1 AS recommended FROM r""",
        "policy_backtest": f"""WITH pc AS ({duck(tb.POLICY_CASES)}),
pp AS (SELECT *, high_volume AND NOT analyst_exact_match AS aff FROM pc),
ps AS (SELECT 'cap-20' AS policy, aff, label, least(raw_score, 20) AS sc FROM pp
  UNION ALL SELECT 'strong-evidence-cap-40', aff, label, least(raw_score, CASE WHEN strong_evidence THEN 40 ELSE 20 END) FROM pp
  UNION ALL SELECT 'fixed-penalty-25', aff, label, greatest(0, raw_score - 25) FROM pp)
SELECT policy, count(*) FILTER (WHERE aff) AS evaluated_case_count, count(*) FILTER (WHERE NOT aff) AS exempt_case_count,
  count(*) FILTER (WHERE aff AND sc >= 40 AND label = 'C2') AS true_positive, count(*) FILTER (WHERE aff AND sc >= 40 AND label <> 'C2') AS false_positive,
  count(*) FILTER (WHERE aff AND sc >= 40) AS analyst_queue_visible,
  round(count(*) FILTER (WHERE aff AND sc >= 40 AND label = 'C2') / count(*) FILTER (WHERE aff AND label = 'C2'), 4) AS recall,
  round(count(*) FILTER (WHERE aff AND sc >= 40 AND label <> 'C2') / count(*) FILTER (WHERE aff AND label <> 'C2'), 4) AS false_positive_rate,
  40 AS triage_threshold FROM ps GROUP BY policy""",
        "recall_at_k": f"""{ctes(*O, EV_CTE, PRE, KNOWN)}, top AS (SELECT cand FROM pre ORDER BY ps DESC, cand LIMIT 20),
hit AS (SELECT count(*) AS h FROM top WHERE cand IN (SELECT candidate_ip FROM kb)), n AS (SELECT count(*) AS n FROM pre), b AS (SELECT count(*) AS b FROM kb)
SELECT round(h / b, 4) AS recall_at_k, round(h / least(20, n), 4) AS precision_at_k, round(1 - least(20, n) / n, 4) AS candidate_reduction_ratio, n AS peer_count FROM hit, n, b""",
        "candidate_positions": f"""{ctes(*SCORED)} SELECT candidate_ip, score, row_number() OVER (ORDER BY score DESC, candidate_ip) AS position FROM scored""",
        "known_ranks": f"""{ctes(*O, EV_CTE, PRE, KNOWN)}, r AS (SELECT cand, ps, row_number() OVER (ORDER BY ps DESC, cand) AS rk FROM pre)
SELECT cand AS candidate_ip, ps AS prefilter_score, rk AS rank FROM r WHERE cand IN (SELECT candidate_ip FROM kb)""",
        "guidance_weights": f"""{ctes(*SCORED, STEPS)} SELECT gw.candidate_ip, gw.detector, CAST(1.0 AS DOUBLE) AS current_value, recommended_value, projected_score,
  projected_score - score AS score_gain, CASE WHEN recommended_value <= 1.5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM gw JOIN scored USING (candidate_ip)""",
        "guidance": f"""{ctes(*SCORED, STEPS, ROLES)},
bs AS (SELECT candidate_ip, detector FROM (SELECT *, row_number() OVER (PARTITION BY candidate_ip ORDER BY recommended_value, -projected_score, detector) AS rn FROM gw) WHERE rn = 1),
rv AS (SELECT dec.external_ip AS candidate_ip, payload_hash, score, bs.detector AS bd,
    (dec.external_ip = '192.0.2.80' OR {within('dec.external_ip', '192.0.2.128', '192.0.2.159')}) AS listed
  FROM dec LEFT JOIN scored ON scored.candidate_ip = dec.external_ip LEFT JOIN bs ON bs.candidate_ip = dec.external_ip WHERE dec.external_ip IS NOT NULL),
k AS (SELECT *, CASE WHEN score IS NOT NULL AND listed THEN 'POLICY_REVIEW' WHEN score < 60 AND bd IS NOT NULL THEN 'DETECTOR_WEIGHT'
    WHEN score < 60 AND score > 0 THEN 'MINIMUM_SCORE' WHEN score IS NOT NULL THEN NULL WHEN payload_hash IS NOT NULL THEN 'PAYLOAD_SIGNATURE' ELSE 'NEW_DETECTOR_CONDITION' END AS rec FROM rv)
SELECT candidate_ip, rec AS recommendation, CASE WHEN rec = 'DETECTOR_WEIGHT' THEN bd END AS detector, coalesce(score, 0) AS current_score,
  score IS NOT NULL AND NOT listed AND score >= 60 AS initially_detected, count(*) AS flows FROM k GROUP BY ALL""",
        "condition_breakdown": f"""{ctes(*O, EV_CTE)}, w AS (SELECT ev.*, cap, {COND_W} AS wt, sum(contribution) OVER x AS tot, sum(contribution * {COND_W}) OVER x AS wtot
  FROM ev JOIN caps USING (type) WINDOW x AS (PARTITION BY candidate_ip, type))
SELECT candidate_ip, type AS evidence_type, detector, CAST(wt AS DOUBLE) AS current_weight,
  round(least(cap * 2, least(cap, tot) * wtot / tot) * contribution / tot, 2) AS weighted_contribution FROM w""",
        "weighted_scores": f"{ctes(*SCORED, score_ctes('ev', '', CUSTOM_W, 'ws'))} SELECT candidate_ip, score FROM ws",
        "evidence_hosts": EVIDENCE_HOSTS, "command_reactions": COMMAND_REACTIONS,
        "comparison_rows": f"""{ctes(*O, SIG_MATCHES)} SELECT cand AS candidate_ip, id AS evidence_key, CASE WHEN ex THEN 'EXACT' ELSE 'STRUCTURAL' END AS mode,
  count(*) AS flows, min(ts_us) AS first_us FROM sm GROUP BY ALL""",
        "flow_summary": f"""{ctes(*TOUCHED)} SELECT candidate_ip, count(*) AS flow_count, CAST(sum(packet_count) AS BIGINT) AS packet_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
  min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) FILTER (WHERE direction = 'INBOUND') AS inbound, count(*) FILTER (WHERE protocol = 'TCP') AS tcp FROM tc GROUP BY 1""",
        "protocol_values": f"""{ctes(*TOUCHED)}, v AS (SELECT DISTINCT candidate_ip, kind, value FROM (SELECT candidate_ip, 'domain' AS kind, domain AS value FROM tc
   UNION ALL SELECT candidate_ip, 'tls_fingerprint', tls_fingerprint FROM tc UNION ALL SELECT candidate_ip, 'certificate_fingerprint', certificate_fingerprint FROM tc) WHERE value <> '')
SELECT candidate_ip, kind, CAST(position AS INT) AS position, value FROM (SELECT *, row_number() OVER (PARTITION BY candidate_ip, kind ORDER BY value) AS position FROM v)""",
        "tcp_flag_totals": f"""{ctes(*TOUCHED)} SELECT candidate_ip, flag, CAST(sum(n) AS BIGINT) AS total FROM (SELECT candidate_ip, 'syn' AS flag, tcp_syn_count AS n FROM tc WHERE tcp_flags_observed
  UNION ALL SELECT candidate_ip, 'ack', tcp_ack_count FROM tc WHERE tcp_flags_observed UNION ALL SELECT candidate_ip, 'rst', 0 FROM tc WHERE tcp_flags_observed) GROUP BY 1, 2""",
        "data_quality": f"""{ctes(F_CTE)} SELECT count(*) AS source_flow_count, CAST(0 AS BIGINT) AS flows_missing_timestamp,
  count(*) FILTER (WHERE direction = 'UNKNOWN') / count(*) AS unknown_direction_ratio, CAST(0 AS BIGINT) AS payload_fields_excluded FROM f""",
        "evidence_check": f"""{ctes(*O, EV_CTE)} SELECT type, CAST(0 AS INT) AS problems, count(*) AS n FROM ev GROUP BY type""",
        "custom_detector": f"""{ctes(*G)} SELECT cand AS candidate_ip, 'many_ports' AS detector, CAST(7.0 AS DOUBLE) AS contribution, count(*) AS sample_count FROM g GROUP BY cand HAVING count(DISTINCT sport) >= 2""",
        "retention_filter": f"""{ctes(F_CTE)} SELECT flow_no FROM f WHERE make_timestamp(ts_us) >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY""",
        "dataset_counts": f"""{ctes(F_CTE)} SELECT sensor_id, CAST(sum(packet_count) AS BIGINT) AS packet_count, count(*) AS flow_count FROM f GROUP BY 1""",
        "batch_ingest": f"""{ctes(F_CTE)}, b AS (SELECT sensor_id, concat('b', CAST(floor(flow_no / 100) AS BIGINT)) AS batch_id, count(*) AS n FROM f GROUP BY 1, 2)
SELECT sensor_id, batch_id, n + 1 < 50 AS accepted, CASE WHEN n + 1 < 50 THEN n ELSE n + 1 END AS record_count FROM b""",
        "snapshot_rows": f"""{ctes(F_CTE)} SELECT sensor_id, concat('b', CAST(floor(flow_no / 100) AS BIGINT)) AS batch_id, CAST(flow_no % 100 AS INT) AS record_index, flow_no FROM f
WHERE CAST(floor(flow_no / 100) AS BIGINT) % 3 < 2 AND sensor_id IN (SELECT DISTINCT sensor_id FROM f ORDER BY 1 LIMIT 2)
  AND ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-01') AND epoch_us(TIMESTAMP '2034-01-01')""",
        "retained_ledger": f"""{ctes(F_CTE)} SELECT sensor_id, concat('b', CAST(floor(flow_no / 100) AS BIGINT)) AS batch_id, count(*) AS record_count,
  count(*) FILTER (WHERE CAST(make_timestamp(ts_us) AS DATE) >= DATE '2024-01-02') AS stored_rows FROM f
WHERE CAST(floor(flow_no / 100) AS BIGINT) % 3 < 2 GROUP BY 1, 2 HAVING max(CAST(make_timestamp(ts_us) AS DATE)) >= DATE '2024-01-02'""",
        "rolling_sample": f"""{ctes(*O)}, r AS (SELECT cand, host, ts_us, row_number() OVER (PARTITION BY cand, host ORDER BY ts_us DESC) AS rn FROM o)
SELECT cand AS candidate_ip, host AS host_ip, count(*) AS n, min(ts_us) AS oldest FROM r WHERE rn <= 3 GROUP BY 1, 2""",
        "payload_hashes": """SELECT doc_id, sha256(text) AS payload_hash, sha256(CASE WHEN strlen(text) <= 32 THEN encode(text) ELSE encode(text)[1:32] END) AS payload_prefix_hash,
  CAST(strlen(text) AS INT) AS payload_length FROM documents""",
        "payload_features": PAYLOAD_FEATURES,
        "capture_decode": """SELECT 'doc-' || doc_id AS path, doc_id * 1000000 AS ts_us, 'UDP' AS protocol, 'OUTBOUND' AS direction, 40000 AS source_port,
  9000 AS destination_port, CAST(strlen(text) + 48 AS BIGINT) AS total_bytes, sha256(text) AS payload_hash, CAST(strlen(text) AS INT) AS payload_length, 6 AS ip_version FROM documents""",
        "capture_summary": """SELECT 'doc-' || doc_id AS path, 'PCAP' AS capture_format, CAST(1 AS BIGINT) AS captured_packet_count, CAST(1 AS BIGINT) AS parsed_packet_count,
  doc_id * 1000000 AS start_us FROM documents""",
        "packet_summary": f"""{ctes(F_CTE)} SELECT sensor_id AS path, count(*) AS captured_packet_count, count(*) FILTER (WHERE flow_no % 7 <> 0) AS parsed_packet_count,
  count(*) FILTER (WHERE flow_no % 7 = 0) AS skipped_packet_count, array_to_string(list_sort(list(DISTINCT flow_no % 3)), ',') AS link_types,
  min(ts_us) AS start_us, max(ts_us) AS end_us, CASE WHEN count(*) FILTER (WHERE flow_no % 7 <> 0) = 0 THEN 'NO_SUPPORTED_IP_PACKETS' END AS error FROM f GROUP BY 1""",
        "first_packet": f"""{ctes(F_CTE)} SELECT sensor_id AS path, flow_no AS packet_index, ts_us FROM f
WHERE protocol = 'UDP' AND flow_no % 7 <> 0 AND total_bytes > 700 ORDER BY sensor_id, flow_no LIMIT 1""",
        "scan_budget": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, floor(doc_id / 5) AS t, strlen(text) AS b, doc_id % 97 AS p, doc_id % 10 <> 0 AS verified FROM documents),
r AS (SELECT id, verified, CAST(sum(b) OVER w AS BIGINT) AS bytes_read, CAST(sum(p) OVER w AS BIGINT) AS packets_read FROM d WINDOW w AS (ORDER BY t, id ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN bytes_read > 100000 THEN 'SOURCE_BYTE_LIMIT' WHEN packets_read > 2000 THEN 'SOURCE_PACKET_LIMIT' END AS reason FROM r""",
        "sensor_page": f"""{ctes(SENS)} SELECT sensor_id, epoch_us(last_heartbeat_at) AS beat_us FROM ss WHERE abs(clock_offset_ms) <= 2000 AND dropped_packets % 2 = 0
ORDER BY last_heartbeat_at DESC, sensor_id LIMIT 40""",
        "segment_page": f"""{ctes(JOBS)} SELECT id, epoch_us(created_at) AS at_us FROM jj WHERE length(name) = 16 ORDER BY created_at DESC, id LIMIT 50 OFFSET 50""",
        "enrichment_selection": f"""{ctes(*SCORED)} SELECT candidate_ip, score FROM scored ORDER BY score DESC, candidate_ip LIMIT 15""",
        "verdict_history": f"""{ctes(DEC)} SELECT candidate_id, id, verdict, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY created_at, id) AS INT) AS position
FROM dd WHERE confidence IN ('CONFIRMED', 'HIGH', 'MEDIUM', 'LOW') AND note <> '' AND created_at LIKE '%Z'""",
        "stream_sync_windows": f"""{ctes(*O)} SELECT cand AS candidate_ip, CAST(floor(ts_us / 2e6) AS BIGINT) * 2000000 AS start_us,
  count(DISTINCT host) AS hosts, count(*) AS flows FROM o GROUP BY 1, 2""",
        "simhash_distance": f"""{ctes(F_CTE, S_CTE)} SELECT CAST(bit_count(xor(('0x' || payload_simhash)::UBIGINT, ('0x' || 'e627bf19152d67b3')::UBIGINT)) AS INT) AS distance, count(*) AS n
FROM s WHERE payload_simhash IS NOT NULL GROUP BY 1""",
        "stream_sessionize": f"""{ctes(F_CTE, PKF)} SELECT sensor_id, direction, source_ip, destination_ip, source_port, destination_port, protocol,
  ts_us AS first_us, end_us AS last_us, packet_count, total_bytes, b0 AS min_size, b1 AS max_size FROM pkf""",
        "stream_dedup": f"""{ctes(F_CTE)} SELECT sensor_id, count(DISTINCT (CAST(floor(flow_no / 100) AS BIGINT), flow_no % 50)) AS n FROM f GROUP BY 1""",
    }
    return p
