"""DuckDB SQL for every query that SQL can state, written from the rules and not from the plans."""

from __future__ import annotations

from workload.tables import flow_sql

FLOW = flow_sql("duckdb")

F_CTE = f"f AS MATERIALIZED ({FLOW})"
#: The registered analysis spans all flows.
S_CTE = "s AS MATERIALIZED (SELECT * FROM f WHERE ts_us IS NOT NULL)"
O_CTE = """o AS MATERIALIZED (
  SELECT *, CASE WHEN nd = 'OUTBOUND' THEN destination_ip ELSE source_ip END AS cand,
    CASE WHEN nd = 'OUTBOUND' THEN source_ip ELSE destination_ip END AS host,
    CASE WHEN nd = 'OUTBOUND' THEN destination_port ELSE source_port END AS sport,
    CASE WHEN nd = 'OUTBOUND' THEN source_port ELSE destination_port END AS iport
  FROM (SELECT *, CASE WHEN direction IN ('OUTBOUND', 'INBOUND') THEN direction
      WHEN source_ip LIKE '10.%' AND destination_ip NOT LIKE '10.%' THEN 'OUTBOUND'
      WHEN destination_ip LIKE '10.%' AND source_ip NOT LIKE '10.%' THEN 'INBOUND' END AS nd FROM s)
  WHERE nd IS NOT NULL)"""
CONN_CTE = """conn0 AS (
  SELECT sensor_id, cand, host, coalesce(iport, -1) AS ik, coalesce(sport, -1) AS sk,
    count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1,
    bool_or(tcp_flags_observed) AS meta, bool_or(bidirectional) AS bidi,
    sum(greatest(packet_count, 0)) AS pk,
    sum(CASE WHEN nd = 'OUTBOUND' THEN tcp_syn_only_count ELSE 0 END) AS oso,
    sum(CASE WHEN nd = 'INBOUND' THEN tcp_syn_only_count ELSE 0 END) AS iso,
    sum(CASE WHEN nd = 'OUTBOUND' THEN tcp_syn_ack_count ELSE 0 END) AS osa,
    sum(CASE WHEN nd = 'INBOUND' THEN tcp_syn_ack_count ELSE 0 END) AS isa,
    sum(CASE WHEN nd = 'OUTBOUND' THEN tcp_ack_only_count ELSE 0 END) AS oao,
    sum(CASE WHEN nd = 'INBOUND' THEN tcp_ack_only_count ELSE 0 END) AS iao,
    bool_or(nd = 'OUTBOUND' AND payload_hash IS NOT NULL) AS op,
    bool_or(nd = 'INBOUND' AND payload_hash IS NOT NULL) AS ip
  FROM o WHERE protocol = 'TCP' GROUP BY ALL),
conn1 AS (
  SELECT *, oso > 0 AS init,
    ((oso > 0 AND isa > 0 AND oao > 0) OR (iso > 0 AND osa > 0 AND iao > 0) OR (oao > 0 AND iao > 0)
     OR (bidi AND ((op AND iao > 0) OR (ip AND oao > 0) OR (op AND ip)))) AS est
  FROM conn0),
conn2 AS (
  SELECT *, init OR est AS qual, meta AND iso > 0 AND NOT init AND NOT est AS scan,
    meta AND iso > 0 AND NOT init AND pk <= 4 AND NOT op AND NOT ip AS probe
  FROM conn1),
scanner AS (
  SELECT cand FROM conn2 WHERE meta GROUP BY cand
  HAVING count(DISTINCT CASE WHEN probe THEN host END) >= 8
     AND count(*) FILTER (WHERE probe) / count(*) >= 0.8),
conn AS MATERIALIZED (
  SELECT *, probe AND cand IN (SELECT cand FROM scanner) AS supp,
    NOT (probe AND cand IN (SELECT cand FROM scanner)) AND (CASE WHEN meta THEN qual ELSE true END) AS kept
  FROM conn2)"""
G_CTE = """g AS MATERIALIZED (
  SELECT * FROM o WHERE protocol <> 'TCP'
  UNION ALL
  SELECT o.* FROM o SEMI JOIN (SELECT * FROM conn WHERE kept) c
    ON o.protocol = 'TCP' AND o.sensor_id = c.sensor_id AND o.cand = c.cand AND o.host = c.host
   AND coalesce(o.iport, -1) = c.ik AND coalesce(o.sport, -1) = c.sk)"""
GAP_CTE = """iv AS (
  SELECT cand, host, n, (t1 - t0) / 1e6 / nullif(n - 1, 0) AS mean,
    sd / nullif((t1 - t0) / 1e6 / nullif(n - 1, 0), 0) AS cv
  FROM (SELECT cand, host, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1,
          stddev_pop(gap) AS sd
        FROM (SELECT cand, host, ts_us,
                (ts_us - lag(ts_us) OVER (PARTITION BY cand, host ORDER BY ts_us)) / 1e6 AS gap FROM g)
        GROUP BY cand, host))"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


O = (F_CTE, S_CTE, O_CTE)
C = (*O, CONN_CTE)
G = (*C, G_CTE)

# Totals per candidate over gated rows.
T_CTE = """t AS MATERIALIZED (
  SELECT cand, count(*) AS n, count(DISTINCT host) AS hosts, min(host) AS h0, max(host) AS h1,
    count(DISTINCT sensor_id) AS sens, min(ts_us) AS t0, max(ts_us) AS t1,
    sum(packet_count) / count(*) AS avgp, bool_or(protocol <> 'UDP') AS nonudp,
    count(DISTINCT CASE WHEN domain <> '' THEN rtrim(lower(domain), '.') END) AS dnorm,
    count(DISTINCT domain) AS draw,
    coalesce(bool_and(rtrim(lower(domain), '.') LIKE '%cdn.example.com') FILTER (WHERE domain IS NOT NULL), false) AS cdn,
    list_sort(list_distinct(list(sport) FILTER (WHERE sport IS NOT NULL))) AS ports
  FROM g GROUP BY cand)"""


def best(name: str, value: str, where: str = "true") -> str:
    return (
        f"{name} AS (SELECT cand, max(c) AS mx, sum(c) AS tot FROM (SELECT cand, {value} AS v, "
        f"count(*) AS c FROM g WHERE {where} GROUP BY cand, v) GROUP BY cand)"
    )


HASHES = best("mh", "payload_hash", "payload_hash IS NOT NULL")
ANYPORT = best("mp", "sport")
SIZES = """sz AS (
  SELECT cand, CASE WHEN a.cn > 0 THEN a.csd / nullif(a.cm, 0) ELSE b.sd / nullif(b.m, 0) END AS size_cv
  FROM (SELECT cand, stddev_pop(total_bytes) AS sd, avg(total_bytes) AS m FROM g GROUP BY cand) b
  LEFT JOIN (SELECT cand, count(*) AS cn, stddev_pop(x) AS csd, avg(x) AS cm
    FROM (SELECT cand, unnest(packet_sizes) AS x FROM g) GROUP BY cand) a USING (cand))"""
HEAD = "cand AS candidate_ip, CAST({c} AS DOUBLE) AS contribution, CAST({n} AS BIGINT) AS sample_count, {t0} AS first_us, {t1} AS last_us, {h0} AS min_host, {h1} AS max_host, CAST({s} AS INT) AS n_sensors"


def head(c, n="n", t0="t0", t1="t1", h0="h0", h1="h1", s="sens") -> str:
    return HEAD.format(c=c, n=n, t0=t0, t1=t1, h0=h0, h1=h1, s=s)


def evidence_sql() -> dict[str, str]:
    """Evidence of each detector as CTE bodies over G."""
    return {
        "d_common_destination": f"""{ctes(*G, T_CTE, HASHES, ANYPORT)}
SELECT {head('20.0')}, CAST(hosts AS DOUBLE) AS distinct_hosts, round(n / hosts, 6) AS connections_per_host,
  round((t1 - t0) / 1e6, 6) AS duration_seconds, round(mp.mx / n, 6) AS dominant_port_ratio,
  round(coalesce(mh.mx / n, 0), 6) AS fingerprint_ratio, CAST(dnorm AS DOUBLE) AS distinct_domains,
  cand = '192.0.2.53' AND ports = [53] AND NOT nonudp AS public_dns_ntp, cdn AS cdn_cloud
FROM t JOIN mp USING (cand) LEFT JOIN mh USING (cand) WHERE hosts >= 3""",
        "d_non_well_known_port": f"""{ctes(*G)},
w AS (SELECT cand, count(*) AS tot, count(*) FILTER (WHERE sport > 1023) AS n,
    min(ts_us) FILTER (WHERE sport > 1023) AS t0, max(ts_us) FILTER (WHERE sport > 1023) AS t1,
    min(host) FILTER (WHERE sport > 1023) AS h0, max(host) FILTER (WHERE sport > 1023) AS h1,
    count(DISTINCT sensor_id) FILTER (WHERE sport > 1023) AS sens
  FROM g WHERE sport IS NOT NULL GROUP BY cand),
d AS (SELECT cand, min_by(sport, (-c, sport)) AS port, max(c) AS mx
  FROM (SELECT cand, sport, count(*) AS c FROM g WHERE sport > 1023 GROUP BY ALL) GROUP BY cand)
SELECT {head('round(least(25.0, 15 + 10 * (n / tot)), 6)')}, round(n / tot, 4) AS non_well_known_ratio,
  CAST(tot AS DOUBLE) AS observed_flow_count, CAST(port AS DOUBLE) AS dominant_port,
  round(mx / n, 6) AS dominant_port_ratio
FROM w JOIN d USING (cand) WHERE n >= 2 AND n / tot >= 0.75""",
        "d_periodic_beacon": f"""{ctes(*G, GAP_CTE)},
r AS (SELECT * FROM iv WHERE n >= 5 AND mean > 0 AND cv <= 0.30),
c AS (SELECT cand, median(mean) AS med, avg(cv) AS cv FROM r GROUP BY cand),
q AS (SELECT cand, cv, CASE WHEN med >= 5 THEN round_even(med / 5, 0) * 5 ELSE med END AS period FROM c),
m AS (SELECT r.cand, r.host, r.n, q.period, q.cv FROM r JOIN q USING (cand)
  WHERE abs(r.mean - q.period) / q.period <= 0.30),
x AS (SELECT g.*, m.period, m.cv FROM g JOIN m USING (cand, host)),
y AS (SELECT cand, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1, min(host) AS h0, max(host) AS h1,
    count(DISTINCT sensor_id) AS sens, count(DISTINCT host) AS mhosts, any_value(period) AS period,
    any_value(cv) AS cv, stddev_pop(total_bytes) / nullif(avg(total_bytes), 0) AS bcv FROM x GROUP BY cand),
z AS (SELECT cand, count(*) AS cn, stddev_pop(v) / nullif(avg(v), 0) AS scv
  FROM (SELECT cand, unnest(packet_sizes) AS v FROM x) GROUP BY cand)
SELECT {head('15.0')}, round(period, 6) AS period_seconds, round(cv, 6) AS coefficient_of_variation,
  CAST(mhosts AS DOUBLE) AS matching_hosts,
  round(greatest(0, 1 - coalesce(CASE WHEN cn > 0 THEN scv ELSE bcv END, 0)), 6) AS size_similarity
FROM y LEFT JOIN z USING (cand)""",
        "d_single_host_beacon": f"""{ctes(*G, T_CTE, HASHES, SIZES, GAP_CTE)}
SELECT {head('35.0')}, round(iv.mean, 6) AS period_seconds, round(iv.cv, 6) AS coefficient_of_variation,
  round(coalesce(mh.mx / t.n, 0), 6) AS payload_stability, round(avgp, 6) AS average_packets
FROM t JOIN iv ON iv.cand = t.cand AND iv.host = t.h0 LEFT JOIN mh ON mh.cand = t.cand
  JOIN sz ON sz.cand = t.cand
WHERE hosts = 1 AND t.n >= 5 AND iv.mean > 0 AND iv.cv <= 0.30
  AND (coalesce(mh.mx / t.n, 0) >= 0.6 OR size_cv <= 0.2) AND avgp <= 10""".replace(
            "cand AS candidate_ip", "t.cand AS candidate_ip"
        ).replace("CAST(n AS BIGINT)", "CAST(t.n AS BIGINT)"),
        "d_synchronized": f"""{ctes(*G)},
b AS (SELECT cand, floor(ts_us / 2e6) AS b, count(DISTINCT host) AS hs, count(*) AS n, min(ts_us) AS t0,
    max(ts_us) AS t1, min(host) AS h0, max(host) AS h1, list(DISTINCT sensor_id) AS sl
  FROM g GROUP BY ALL HAVING count(DISTINCT host) >= 3)
SELECT {head('15.0', n='sum(n)', t0='min(t0)', t1='max(t1)', h0='min(h0)', h1='max(h1)', s='len(list_distinct(flatten(list(sl))))')},
  CAST(max(hs) AS DOUBLE) AS synchronized_hosts, CAST(count(*) AS DOUBLE) AS repetition_count,
  round(max((t1 - t0) / 1e6), 6) AS observed_spread
FROM b GROUP BY cand HAVING count(*) >= 2""",
        "d_command_attack": f"""{ctes(*G)},
cmd AS (SELECT cand, count(DISTINCT host) AS hosts, count(*) AS n, sum(total_bytes) AS bytes,
    min(ts_us) AS t0, max(ts_us) AS t1, min(host) AS h0, max(host) AS h1, count(DISTINCT sensor_id) AS sens
  FROM g WHERE direction = 'INBOUND' GROUP BY cand HAVING count(DISTINCT host) >= 3),
hst AS (SELECT DISTINCT g.cand, g.host, cmd.t0 AS seed FROM g JOIN cmd USING (cand) WHERE direction = 'INBOUND'),
rx AS (SELECT hst.cand, hst.host, s.destination_ip AS tgt, s.destination_port AS tp, s.protocol AS pr,
    s.packet_count AS pk, s.ts_us - seed AS dt
  FROM s JOIN hst ON s.source_ip = hst.host AND s.direction = 'OUTBOUND'
   AND s.ts_us BETWEEN seed - 30000000 AND seed + 30000000),
atk AS (SELECT * FROM rx WHERE dt BETWEEN 1000000 AND 30000000 AND tgt <> cand),
pt AS (SELECT cand, tgt, tp, pr, count(*) AS c, sum(pk) AS pk FROM atk GROUP BY ALL),
top AS (SELECT cand, tgt, tp, pr, pk, total FROM (
    SELECT *, sum(c) OVER (PARTITION BY cand) AS total,
      row_number() OVER (PARTITION BY cand ORDER BY c DESC, tgt, tp NULLS FIRST, pr) AS rn FROM pt) WHERE rn = 1),
af AS (SELECT cand, tgt, count(DISTINCT host) AS aff FROM atk GROUP BY ALL),
bl AS (SELECT cand, tgt, sum(pk) AS base FROM rx WHERE dt >= -30000000 AND dt < 0 GROUP BY ALL)
SELECT {head('25.0', n='cmd.n + total')}, CAST(bytes AS DOUBLE) AS command_size, CAST(aff AS DOUBLE) AS affected_hosts,
  round(pk / greatest(1, coalesce(base, 0)), 6) AS increase_ratio, CAST(tp AS DOUBLE) AS target_port
FROM top JOIN af USING (cand, tgt) LEFT JOIN bl USING (cand, tgt) JOIN cmd USING (cand)
WHERE aff >= 3 AND pk / greatest(1, coalesce(base, 0)) >= 3""",
        "d_persistence": f"""{ctes(*G, T_CTE)}
SELECT {head('5.0')}, round((t1 - t0) / 1e6, 6) AS duration_seconds, round(avgp, 6) AS average_packets,
  round(1 / (SELECT count(*) FROM t), 6) AS rarity
FROM t WHERE hosts >= 3 AND (t1 - t0) / 1e6 >= 300 AND avgp <= 10""",
        "d_similarity": f"""{ctes(*G, T_CTE)},
fs AS (SELECT cand, max(c) AS mx FROM (SELECT cand, count(*) AS c FROM g GROUP BY cand, protocol, sport,
    payload_hash, tls_fingerprint, certificate_fingerprint, domain, packet_sizes) GROUP BY cand)
SELECT {head('round(10 * (mx / n), 6)')}, round(mx / n, 6) AS dominant_feature_ratio,
  CAST(draw AS DOUBLE) AS domain_diversity
FROM t JOIN fs USING (cand) WHERE hosts >= 3 AND mx / n >= 0.6 AND draw <= greatest(3, hosts)""",
        "d_multi_sensor": f"""{ctes(*G, T_CTE)},
sh AS (SELECT cand, count(*) FILTER (WHERE h >= 3) AS ss, min(h) FILTER (WHERE h >= 3) AS ih
  FROM (SELECT cand, sensor_id, count(DISTINCT host) AS h FROM g GROUP BY ALL) GROUP BY cand)
SELECT {head('10.0')}, CAST(ss AS DOUBLE) AS distinct_sensors, CAST(ih AS DOUBLE) AS independent_hosts
FROM t JOIN sh USING (cand) WHERE ss >= 2""",
        "d_tcp_quality": f"""{ctes(*C)},
q AS (SELECT cand, count(*) FILTER (WHERE ok) AS qn, count(*) FILTER (WHERE ok AND init) AS i,
    count(*) FILTER (WHERE ok AND est) AS e, count(*) FILTER (WHERE scan OR supp) AS sc,
    sum(n) FILTER (WHERE ok) AS n, min(t0) FILTER (WHERE ok) AS t0, max(t1) FILTER (WHERE ok) AS t1,
    min(host) FILTER (WHERE ok) AS h0, max(host) FILTER (WHERE ok) AS h1,
    count(DISTINCT sensor_id) FILTER (WHERE ok) AS sens
  FROM (SELECT *, NOT supp AND meta AND qual AS ok FROM conn) GROUP BY cand)
SELECT {head('least(15.0, CASE WHEN i > 0 THEN 5.0 ELSE 0.0 END + CASE WHEN e > 0 THEN 10.0 ELSE 0.0 END)')},
  CAST(i AS DOUBLE) AS outbound_initiated_connections, CAST(e AS DOUBLE) AS established_connections,
  CAST(qn AS DOUBLE) AS qualified_tcp_connections, CAST(sc AS DOUBLE) AS scan_suppressed_connections
FROM q WHERE qn > 0""",
        "d_payload_signature": f"""{ctes(*O)},
{SIG_CTES},
m AS (
  SELECT o.cand, sg.id, o.host, o.sensor_id, o.ts_us,
    (sg.payload_hash IS NOT NULL AND (o.payload_hash = sg.payload_hash OR o.last_payload_hash = sg.payload_hash)) AS ex
  FROM o JOIN sg ON o.protocol = sg.protocol AND o.direction = sg.direction
  WHERE coalesce(o.payload_hash = sg.payload_hash OR o.last_payload_hash = sg.payload_hash, false)
    OR ((coalesce(o.payload_prefix_hash = sg.payload_prefix_hash, false) OR coalesce(bit_count(xor(
          ('0x' || o.payload_simhash)::UBIGINT, ('0x' || sg.payload_simhash)::UBIGINT)) <= 8, false))
      AND abs(o.payload_length - sg.payload_length) <= greatest(16, round_even(sg.payload_length * 0.15, 0))
      AND abs(o.payload_entropy - sg.payload_entropy) <= 0.75)),
k AS (SELECT cand, id, coalesce(ex, false) AS ex, count(*) AS n, min(ts_us) AS t0, max(ts_us) AS t1, min(host) AS h0,
    max(host) AS h1, count(DISTINCT sensor_id) AS sens FROM m GROUP BY ALL)
SELECT {head('CASE WHEN ex THEN 80.0 ELSE 60.0 END')}, id AS evidence_key,
  CASE WHEN ex THEN 'EXACT' ELSE 'STRUCTURAL' END AS match_mode
FROM (SELECT *, row_number() OVER (PARTITION BY cand, id ORDER BY ex DESC) AS rn FROM k) WHERE rn = 1""",
        "d_anomaly": f"""{ctes(*G, T_CTE, GAP_CTE, HASHES)},
{best('mq', 'sport', 'sport IS NOT NULL')},
{best('mf', "(coalesce(tls_fingerprint, ''), coalesce(certificate_fingerprint, ''))", 'tls_fingerprint IS NOT NULL OR certificate_fingerprint IS NOT NULL')},
dm AS (SELECT cand, count(*) AS dn FROM g WHERE domain <> '' GROUP BY cand),
ic AS (SELECT cand, avg(cv) AS v FROM iv WHERE n >= 4 AND mean > 0 GROUP BY cand),
sp AS (SELECT cand, stddev_pop(x) / avg(x) AS v FROM (SELECT cand, unnest(packet_sizes) AS x FROM g) WHERE x > 0 GROUP BY cand),
bp AS (SELECT cand, stddev_pop(total_bytes) / avg(total_bytes) AS v FROM g WHERE total_bytes > 0 GROUP BY cand),
v AS (SELECT t.cand, ic.v AS a, coalesce(sp.v, bp.v) AS b, mh.mx / mh.tot AS c, mq.mx / mq.tot AS d,
    mf.mx / mf.tot AS e, dnorm / dn AS f
  FROM t LEFT JOIN ic USING (cand) LEFT JOIN sp USING (cand) LEFT JOIN bp USING (cand) LEFT JOIN mh USING (cand)
   LEFT JOIN mq USING (cand) LEFT JOIN mf USING (cand) LEFT JOIN dm USING (cand) WHERE t.n >= 5),
l AS (SELECT cand, feature, value FROM (UNPIVOT v ON a, b, c, d, e, f INTO NAME feature VALUE value)),
ce AS (SELECT feature, median(value) AS center, stddev_pop(value) AS sd, count(*) AS pop FROM l GROUP BY feature),
ma AS (SELECT feature, median(abs(value - center)) AS mad FROM l JOIN ce USING (feature) GROUP BY feature),
bs AS (SELECT feature, center, pop, CASE WHEN mad > 1e-9 THEN 1.4826 * mad ELSE sd END AS scale
  FROM ce JOIN ma USING (feature) WHERE pop >= 15 AND CASE WHEN mad > 1e-9 THEN 1.4826 * mad ELSE sd END > 1e-9),
sc AS (SELECT cand, count(*) FILTER (WHERE z >= 1) AS k, sqrt(sum(z * z) FILTER (WHERE z >= 1)) AS score
  FROM (SELECT cand, CASE WHEN feature IN ('a', 'b', 'f') THEN -1 ELSE 1 END * (value - center) / scale AS z
    FROM l JOIN bs USING (feature)) GROUP BY cand)
SELECT {head('round(least(5.0, greatest(0.0, 1 + 2 * (score - 3.5))), 6)')}, round(score, 4) AS anomaly_score,
  CAST(k AS DOUBLE) AS directional_feature_count, CAST((SELECT count(*) FROM v) AS DOUBLE) AS population_size
FROM sc JOIN t USING (cand)
WHERE k >= 2 AND score >= 3.5 AND (SELECT count(*) FROM v) >= 30 AND (SELECT count(*) FROM bs) >= 2""",
    }


# Signatures derived from the flows: the most frequent payload per protocol and direction, and the
# same without its hash, so that it can only match by structure.
SIG_CTES = """sg0 AS (
  SELECT protocol, direction, payload_hash, count(*) AS c, min(payload_prefix_hash) AS pp, min(payload_length) AS pl,
    min(payload_entropy) AS pe, min(payload_simhash) AS ps
  FROM s WHERE payload_hash IS NOT NULL GROUP BY ALL),
sg1 AS (SELECT *, row_number() OVER (PARTITION BY protocol, direction ORDER BY c DESC, payload_hash) AS rn FROM sg0),
sg AS (
  SELECT 'exact-' || protocol || '-' || direction AS id, protocol, direction, payload_hash, pp AS payload_prefix_hash,
    pl AS payload_length, pe AS payload_entropy, ps AS payload_simhash FROM sg1 WHERE rn = 1
  UNION ALL
  SELECT 'alike-' || protocol || '-' || direction, protocol, direction, NULL, pp, pl, pe, ps FROM sg1 WHERE rn = 1)"""

TRAFFIC = """sess0 AS (
  SELECT *, greatest(ts_us + CAST(greatest(duration_seconds, 0) * 1e6 AS BIGINT), ts_us) AS te,
    coalesce(iport, -1) AS ik, coalesce(sport, -1) AS sk FROM o WHERE protocol = 'TCP'),
sess1 AS (SELECT *, max(te) OVER (PARTITION BY sensor_id, host, ik, cand, sk ORDER BY ts_us
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sess0),
sess2 AS (SELECT *, sum(CASE WHEN ts_us - pe > 60000000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY sensor_id, host, ik, cand, sk ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS sno FROM sess1),
sess AS (SELECT sensor_id, host, ik, cand, sk, sno, sum(greatest(packet_count, 0)) AS pk, sum(greatest(total_bytes, 0)) AS byt
  FROM sess2 GROUP BY ALL),
sagg AS (SELECT cand, count(*) AS sc, max(pk) AS mp, max(byt) AS mb FROM sess GROUP BY cand),
prof AS MATERIALIZED (SELECT o.cand, count(*) AS fc, sum(greatest(packet_count, 0)) AS tp, sum(greatest(total_bytes, 0)) AS tb,
    any_value(coalesce(sc, 0)) AS sc, any_value(coalesce(mp, 0)) AS mp, any_value(coalesce(mb, 0)) AS mb
  FROM o LEFT JOIN sagg ON sagg.cand = o.cand GROUP BY o.cand)"""


def _strip_with(sql: str) -> str:
    """The part of a detector query after the shared CTEs."""
    return sql


def all_evidence(names: dict[str, tuple[str, str]]) -> str:
    """CTEs ``e_<name>`` with the evidence of each detector, nested as subqueries."""
    ev = evidence_sql()
    parts = []
    for key, (kind, detector) in names.items():
        body = ev[key]
        mode = "match_mode" if key == "d_payload_signature" else "CAST(NULL AS VARCHAR)"
        dns = "public_dns_ntp" if key == "d_common_destination" else "false"
        cdn = "cdn_cloud" if key == "d_common_destination" else "false"
        parts.append(
            f"SELECT candidate_ip, '{kind}' AS type, '{detector}' AS detector, contribution, sample_count, "
            f"first_us, last_us, min_host, max_host, {mode} AS match_mode, {dns} AS dns, {cdn} AS cdn FROM ({body})"
        )
    return " UNION ALL ".join(parts)


KINDS = {
    "d_common_destination": ("COMMON_DESTINATION", "common_destination"),
    "d_non_well_known_port": ("NON_WELL_KNOWN_PORT", "non_well_known_port"),
    "d_periodic_beacon": ("PERIODIC_BEACON", "periodic_beacon"),
    "d_single_host_beacon": ("SINGLE_HOST_BEACON", "single_host_composite_beacon"),
    "d_payload_signature": ("ANALYST_PAYLOAD_SIGNATURE", "analyst_payload_signature"),
    "d_synchronized": ("SYNCHRONIZED_COMMUNICATION", "synchronized_communication"),
    "d_command_attack": ("COMMAND_ATTACK_CORRELATION", "command_attack_correlation"),
    "d_persistence": ("LOW_VOLUME_PERSISTENCE_RARITY", "persistence_rarity"),
    "d_similarity": ("PROTOCOL_PAYLOAD_SIMILARITY", "protocol_similarity"),
    "d_multi_sensor": ("MULTI_SENSOR_CONTEXT", "multi_sensor_context"),
    "d_anomaly": ("ML_POPULATION_ANOMALY", "ml_population_anomaly"),
    "d_tcp_quality": ("TCP_SESSION_QUALITY", "tcp_session_quality"),
}
CAP_VALUES = (
    "('COMMON_DESTINATION', 20), ('PERIODIC_BEACON', 15), ('SYNCHRONIZED_COMMUNICATION', 15), "
    "('COMMAND_ATTACK_CORRELATION', 25), ('MULTI_SENSOR_CONTEXT', 10), ('PROTOCOL_PAYLOAD_SIMILARITY', 10), "
    "('LOW_VOLUME_PERSISTENCE_RARITY', 5), ('SINGLE_HOST_BEACON', 35), ('ANALYST_PAYLOAD_SIGNATURE', 80), "
    "('NON_WELL_KNOWN_PORT', 25), ('ML_POPULATION_ANOMALY', 5), ('TCP_SESSION_QUALITY', 15)"
)
EV_CTE = f"""ev0 AS MATERIALIZED ({all_evidence(KINDS)}),
sup AS (SELECT DISTINCT candidate_ip FROM ev0 WHERE type NOT IN ('TCP_SESSION_QUALITY', 'ML_POPULATION_ANOMALY')),
ev AS MATERIALIZED (SELECT * FROM ev0 WHERE candidate_ip IN (SELECT candidate_ip FROM sup)),
caps(type, cap) AS (VALUES {CAP_VALUES})"""


def score_ctes(source: str, keys: str = "", weight: str = "1.0", name: str = "scored") -> str:
    """Scores of the evidence in ``source``; ``keys`` are extra scenario columns."""
    k = f"{keys}, " if keys else ""
    return f"""{name}_ty AS (SELECT {k}candidate_ip, type, sum(contribution) AS p, sum(contribution * {weight}) AS w,
    count(*) AS items, min(min_host) AS h0, max(max_host) AS h1, min(first_us) AS t0, max(last_us) AS t1,
    max(coalesce(sample_count, 5)) AS n, bool_or(dns) AS dns, bool_or(cdn) AS cdn,
    bool_or(coalesce(match_mode = 'EXACT', false)) AS ex FROM {source} GROUP BY ALL),
{name}_c AS (SELECT {k}candidate_ip, sum(least(cap, p)) AS base,
    sum(least(cap * 2, least(cap, p) * coalesce(w / nullif(p, 0), 1)) - least(cap, p)) AS extra,
    sum(items) AS items, min(h0) AS h0, max(h1) AS h1, min(t0) AS t0, max(t1) AS t1, max(n) AS n,
    bool_or(dns) AS dns, bool_or(cdn) AS cdn, bool_or(ex) AS ex, bool_or(type = 'SINGLE_HOST_BEACON') AS shb
  FROM {name}_ty JOIN caps USING (type) GROUP BY ALL),
{name}_a AS (SELECT *, base + extra
    + CASE WHEN h0 = h1 AND NOT ex THEN CASE WHEN shb THEN -10 ELSE -20 END ELSE 0 END
    + CASE WHEN n < 5 AND NOT ex THEN -20 ELSE 0 END + CASE WHEN dns THEN -30 ELSE 0 END
    + CASE WHEN cdn THEN -20 ELSE 0 END
    + CASE WHEN (coalesce(tb, 0) >= 52428800 OR coalesce(tp, 0) >= 100000) AND NOT ex THEN -30 ELSE 0 END AS adj
  FROM {name}_c LEFT JOIN prof ON prof.cand = candidate_ip),
{name} AS (SELECT *, CAST(greatest(0, least(100, round_even(CASE WHEN (coalesce(mb, 0) >= 52428800 OR coalesce(mp, 0) >= 100000)
    AND NOT ex AND adj > 20 THEN 20 ELSE adj END, 0))) AS INT) AS score FROM {name}_a)"""


SEVERITY = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
SCORED = (*O, TRAFFIC, EV_CTE, score_ctes("ev"))


def oracle_sql() -> dict[str, str]:
    from workload.oracles_more import more_oracles

    out = {
        "candidate_orientation": f"""{ctes(*O)} SELECT flow_no, cand AS candidate_ip, host AS host_ip,
  sport AS service_port, iport AS internal_port, nd AS norm_direction FROM o""",
        "tcp_profiles": f"""{ctes(*C)} SELECT sensor_id, cand AS candidate_ip, host AS host_ip, ik AS internal_key,
  sk AS service_key, n AS row_count, CAST(pk AS BIGINT) AS total_packets, meta AS metadata_available, init AS internally_initiated,
  est AS established, qual AS qualified, supp AS suppressed, kept FROM conn""",
        "gated_rows": f"""{ctes(*G)} SELECT cand AS candidate_ip, protocol, count(*) AS n, CAST(sum(total_bytes) AS BIGINT) AS bytes,
  count(DISTINCT host) AS hosts FROM g GROUP BY ALL""",
        "traffic_profile": f"""{ctes(*O, TRAFFIC)} SELECT cand AS candidate_ip, fc AS flow_count, CAST(tp AS BIGINT) AS total_packets,
  CAST(tb AS BIGINT) AS total_bytes, CAST(sc AS BIGINT) AS tcp_session_count, CAST(mp AS BIGINT) AS max_tcp_session_packets,
  CAST(mb AS BIGINT) AS max_tcp_session_bytes FROM prof""",
        "evidence_union": f"""{ctes(*O, EV_CTE)} SELECT candidate_ip, type, detector, round(contribution, 6) AS contribution,
  sample_count, first_us, last_us FROM ev""",
        "candidate_scores": f"""{ctes(*SCORED)} SELECT candidate_ip, score, {SEVERITY} AS severity,
  round(base, 6) AS base_score, CAST(items AS BIGINT) AS evidence_count, h0 AS min_host, h1 AS max_host, t0 AS first_us, t1 AS last_us
FROM scored""",
        **evidence_sql(),
    }
    out.update(more_oracles())
    return out
