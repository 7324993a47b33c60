"""Running detectors: each one alone, or all of them as one plan."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.detectors.population import population_anomaly
from netsift.operators.detectors.profile import PROFILE_DETECTORS
from netsift.operators.detectors.quality import tcp_session_quality
from netsift.operators.detectors.signature import (
    PAYLOAD_GROUP,
    analyst_payload_signature,
    payload_rows,
)
from netsift.operators.detectors.timing import (
    command_attack,
    periodic_beacon,
    synchronized_communication,
)
from netsift.plans.context import AnalysisContext
from netsift.plans.registry import DetectorRegistry
from netsift.schema import EVIDENCE
from netsift.session import materialize

ENRICHMENTS = ("tcp_session_quality", "ml_population_anomaly")


def _nothing(ctx: AnalysisContext) -> DataFrame:
    return ctx.flows.sparkSession.createDataFrame([], EVIDENCE)


def _profile(ctx: AnalysisContext, names: list[str]) -> DataFrame:
    """Any number of profile detectors in one pass over one feature table."""
    rows = F.array_compact(F.array(*[PROFILE_DETECTORS[n](ctx.params) for n in names]))
    return ctx.features.select(F.inline(rows))


def _timing_and_signatures(ctx: AnalysisContext) -> dict:
    p = ctx.params
    return {
        "periodic_beacon": lambda: periodic_beacon(ctx.intervals, ctx.contacts, p),
        "synchronized_communication": lambda: synchronized_communication(ctx.gated, p),
        "command_attack_correlation": lambda: command_attack(ctx.scoped, ctx.gated, p, ctx._table),
        "analyst_payload_signature": lambda: (
            _nothing(ctx)
            if ctx.signatures is None
            else analyst_payload_signature(ctx.signature_matches)
        ),
        "tcp_session_quality": lambda: (
            tcp_session_quality(ctx.judged, p) if p.tcp_session_gating_enabled else _nothing(ctx)
        ),
        "ml_population_anomaly": lambda: (
            population_anomaly(ctx.features, p, ctx._table)
            if p.ml_anomaly_enabled
            else _nothing(ctx)
        ),
    }


def detect(ctx: AnalysisContext, name: str) -> DataFrame:
    """Evidence of one built-in detector."""
    if name in PROFILE_DETECTORS:
        return _profile(ctx, [name])
    return _timing_and_signatures(ctx)[name]()


def supported_only(evidence: DataFrame, allow_standalone_anomaly: bool) -> DataFrame:
    """Keep enrichments only for candidates with primary evidence.

    A window marks the candidates: evidence per candidate is bounded by the detectors and
    signatures, and the same partitioning serves the scoring that follows.
    """
    primary = F.max(~F.col("detector").isin(*ENRICHMENTS)).over(Window.partitionBy("candidate_ip"))
    standalone = (F.col("detector") == "ml_population_anomaly") & F.lit(allow_standalone_anomaly)
    return (
        evidence.withColumn("__primary", primary)
        .filter(F.col("__primary") | standalone)
        .drop("__primary")
    )


def run_detectors(ctx: AnalysisContext, registry: DetectorRegistry | None = None) -> DataFrame:
    """Evidence of all built-in and registered detectors, enrichments restricted."""
    others = _timing_and_signatures(ctx)
    if ctx.signatures is None:
        others.pop("analyst_payload_signature")
    if not ctx.params.ml_anomaly_enabled:
        others.pop("ml_population_anomaly")
    steps = [lambda: _profile(ctx, list(PROFILE_DETECTORS)), *others.values()]
    if registry is not None:
        steps += [lambda d=d: d.run(ctx) for d in registry]
    if ctx.tables:
        # Evidence is small: each detector writes its own, and Spark runs the jobs side by side.
        ctx.prepare()
        store = lambda step: materialize(step().select(*EVIDENCE.names), "evidence")
        with ThreadPoolExecutor(len(steps)) as pool:
            parts = list(pool.map(store, steps))
    else:
        parts = [step().select(*EVIDENCE.names) for step in steps]
    union = reduce(DataFrame.unionByName, parts)
    return supported_only(union, ctx.params.ml_anomaly_allow_standalone)


def evidence_hosts(ctx: AnalysisContext, evidence: DataFrame) -> DataFrame:
    """The internal hosts behind each piece of evidence, as rows.

    A candidate may have any number of hosts, so they are a relation and never an array. Evidence
    that rests on all rows of a candidate joins its contacts; the rest names its hosts itself.
    """
    from netsift.operators.detectors.timing import beacon_hosts, offset_us, synchronized_buckets
    from netsift.operators.features import odd_port

    p = ctx.params
    pairs = ctx.contacts.select("candidate_ip", "host_ip").distinct()
    own = {
        "NON_WELL_KNOWN_PORT": ctx.gated.filter(odd_port(p)).select("candidate_ip", "host_ip"),
        "PERIODIC_BEACON": beacon_hosts(ctx.intervals, p).select("candidate_ip", "host_ip"),
        "COMMAND_ATTACK_CORRELATION": ctx.gated.filter(F.upper("direction") == "INBOUND").select(
            "candidate_ip", "host_ip"
        ),
        "TCP_SESSION_QUALITY": ctx.judged.filter(
            "kept and metadata_available and qualified"
        ).select("candidate_ip", "host_ip"),
    }
    window = float(p.synchronization_window_seconds) * 1e6
    buckets = synchronized_buckets(ctx.gated, p).select("candidate_ip", "bucket")
    own["SYNCHRONIZED_COMMUNICATION"] = (
        ctx.gated.withColumn("bucket", F.floor((F.col("ts_us") - offset_us(p)) / window))
        .join(buckets, ["candidate_ip", "bucket"], "left_semi")
        .select("candidate_ip", "host_ip")
    )
    rows = [df.distinct().withColumn("type", F.lit(t)) for t, df in own.items()]
    named = reduce(DataFrame.unionByName, rows)
    signature = F.col("type") == "ANALYST_PAYLOAD_SIGNATURE"
    kinds = evidence.select("candidate_ip", "type", "evidence_key", "match_mode").distinct()
    whole = ~F.col("type").isin(*own) & ~signature
    out = (
        kinds.filter(whole)
        .join(pairs, "candidate_ip")
        .unionByName(kinds.filter(~whole & ~signature).join(named, ["candidate_ip", "type"]))
    )
    if ctx.signatures is not None:
        # The same rows and the same full key that the groups were made of.
        matched = ctx.signature_matches.select(
            *[F.col(c).alias(f"m_{c}") for c in PAYLOAD_GROUP],
            F.col("sig_id").alias("evidence_key"),
            F.col("mode").alias("match_mode"),
        )
        rows = payload_rows(ctx.oriented).select(*PAYLOAD_GROUP, "host_ip").distinct()
        same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in PAYLOAD_GROUP]
        hosts = rows.join(matched, same).select(
            "candidate_ip", "evidence_key", "match_mode", "host_ip"
        ).distinct()
        out = out.unionByName(
            kinds.filter(signature).join(hosts, ["candidate_ip", "evidence_key", "match_mode"])
            .select(*out.columns)
        )
    return out.select("candidate_ip", "type", "evidence_key", "host_ip").distinct()
