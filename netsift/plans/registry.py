"""User detectors: registration, validation of what they return, and a pandas adapter."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.net import ip_bits
from netsift.params import CAPS, DETECTORS
from netsift.schema import EVIDENCE, conform

MAX_SCORE = 100
MAX_SAFE_INTEGER = 2**53 - 1


class DetectorError(ValueError):
    """A user detector broke its contract."""


def evidence_problems(df: DataFrame) -> DataFrame:
    """Add ``problems``, the contract breaches of every evidence row."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    within = lambda c, hi: number(c) & F.col(c).between(0, hi)
    metrics = F.coalesce("metrics", F.lit("{}"))
    checks = {
        "candidate_ip": ip_bits("candidate_ip").isNotNull(),
        "type": F.col("type").isin(*CAPS),
        "description": F.col("description").isNotNull(),
        "raw_score": within("raw_score", MAX_SCORE),
        "contribution": within("contribution", MAX_SCORE),
        "confidence": within("confidence", 1),
        "time_order": F.col("first_seen").isNull()
        | F.col("last_seen").isNull()
        | (F.col("first_seen") <= F.col("last_seen")),
        "sample_count": F.col("sample_count").isNull()
        | F.col("sample_count").between(0, MAX_SAFE_INTEGER),
        "metrics": F.try_parse_json(metrics).isNotNull() & metrics.rlike(r"^\s*\{"),
        "sensors": F.coalesce(~F.exists("sensors", lambda s: s.isNull()), F.lit(True)),
        "warnings": F.coalesce(~F.exists("warnings", lambda s: s.isNull()), F.lit(True)),
    }
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return df.withColumn("problems", F.array_compact(F.array(*bad)))


def validate_evidence(df: DataFrame, name: str, version: str) -> DataFrame:
    """Evidence with detector and version set; the job fails on a row that breaks the contract."""
    checked = evidence_problems(conform(df, EVIDENCE, {"evidence_key": ""}))
    message = F.concat(
        F.lit(f"detector {name}: bad "), F.array_join("problems", ", "), F.lit(" at "),
        F.coalesce("candidate_ip", F.lit("null")),
    )
    guarded = F.when(F.size("problems") == 0, F.col("type")).otherwise(
        F.raise_error(message).cast("string")
    )
    return checked.withColumns(
        {"type": guarded, "detector": F.lit(name), "version": F.lit(version)}
    ).select(*EVIDENCE.names)


@dataclass(frozen=True)
class CustomDetector:
    """``analyze(ctx) -> DataFrame`` with evidence columns (missing ones become null)."""

    name: str
    analyze: Callable
    version: str = "1.0.0"

    def __post_init__(self) -> None:
        for label, text in (("name", self.name), ("version", self.version)):
            if not isinstance(text, str) or not text.strip():
                raise DetectorError(f"detector {label} must be a non-empty string")
        if not callable(self.analyze) or inspect.iscoroutinefunction(self.analyze):
            raise DetectorError("analyze must be a plain function")
        params = list(inspect.signature(self.analyze).parameters.values())
        positional = (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD)
        if len(params) != 1 or params[0].kind not in positional:
            raise DetectorError("analyze must take exactly one context")

    def run(self, ctx) -> DataFrame:
        produced = self.analyze(ctx)
        if not isinstance(produced, DataFrame):
            raise DetectorError(f"detector {self.name} must return a DataFrame of evidence")
        return validate_evidence(produced, self.name, self.version)


class DetectorRegistry:
    """User detectors in name order; names are unique and never those of built-ins."""

    def __init__(self) -> None:
        self._items: dict[str, CustomDetector] = {}

    def register(self, name: str, analyze: Callable, version: str = "1.0.0") -> CustomDetector:
        if name in DETECTORS or name in self._items:
            raise DetectorError(f"detector name {name} is taken")
        self._items[name] = CustomDetector(name, analyze, version)
        return self._items[name]

    def __iter__(self) -> Iterator[CustomDetector]:
        return iter(self._items[k] for k in sorted(self._items))

    def __len__(self) -> int:
        return len(self._items)


def pandas_detector(fn: Callable[[pd.DataFrame], pd.DataFrame], keys: tuple[str, ...]) -> Callable:
    """Adapt a pandas function over groups of gated rows.

    A group must fit one task, so ``keys`` has to be finer than the candidate (the candidate and
    a host, or a time slot); evidence of several groups of a candidate is capped by the scoring.
    """
    if "candidate_ip" not in keys or len(keys) < 2:
        raise DetectorError("group by candidate_ip and at least one finer key")

    def analyze(ctx) -> DataFrame:
        return ctx.gated.groupBy(*keys).applyInPandas(fn, EVIDENCE)

    return analyze


def weights_of(presets: DataFrame, name: str | None = None) -> dict[str, float]:
    """Detector weights of a preset table (name, detector_weights MAP, is_default)."""
    wanted = F.col("name") == name if name else F.col("is_default")
    row = presets.filter(wanted).orderBy("name").select("detector_weights").first()
    return dict(row[0]) if row else {}
