"""A whole analysis job as one plan: scope, detect, suppress, score, keep."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from netsift.plans.context import AnalysisContext
from netsift.plans.detection import run_detectors
from netsift.plans.registry import DetectorRegistry
from netsift.plans.scoring import score_candidates, scored_filter, suppress, trusted_servers


def with_trusted(ctx: AnalysisContext, allowlist: DataFrame, now: str) -> AnalysisContext:
    """The context with the active trusted DNS and NTP servers of the allowlist, which meet the
    candidates in a join."""
    return replace(ctx, trusted=trusted_servers(allowlist, now))


def analyze(
    ctx: AnalysisContext,
    allowlist: DataFrame | None = None,
    now: str = "2024-01-01T00:00:00Z",
    registry: DetectorRegistry | None = None,
) -> DataFrame:
    """Candidates of a job with at least the minimum score."""
    if allowlist is not None:
        ctx = with_trusted(ctx, allowlist, now)
    evidence = run_detectors(ctx, registry)
    if allowlist is not None:
        evidence = suppress(evidence, allowlist, now)
    scored = score_candidates(evidence, ctx.profile, ctx.params)
    return scored_filter(scored, ctx.params.minimum_candidate_score)


def reanalyze(ctx: AnalysisContext, **changes: object) -> AnalysisContext:
    """The same dataset with changed parameters."""
    return replace(ctx, params=ctx.params.override(**changes))
