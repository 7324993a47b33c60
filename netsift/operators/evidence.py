"""Evidence rows: one fixed layout, with free metrics as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift.params import DETECTOR_VERSION
from netsift.schema import EVIDENCE


def lit_or_col(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def evidence(
    kind: str,
    detector: str,
    contribution: object,
    metrics: dict[str, object],
    description: object,
    *,
    first: str = "first_us",
    last: str = "last_us",
    min_host: str = "min_host",
    max_host: str = "max_host",
    sensors: str = "sensors",
    confidence: object = 1.0,
    warnings: object = (),
    key: object = "",
    match_mode: object = None,
) -> Column:
    """A struct with the columns of ``EVIDENCE`` built from columns of the current frame."""
    metric_cols = {k: lit_or_col(v) for k, v in metrics.items()}
    flag = lambda k: metric_cols.get(k, F.lit(None))
    if not isinstance(warnings, Column):
        warnings = F.lit(list(warnings)) if warnings else F.array()
    values = {
        "candidate_ip": F.col("candidate_ip"),
        "type": F.lit(kind),
        "detector": F.lit(detector),
        "version": F.lit(DETECTOR_VERSION),
        "evidence_key": lit_or_col(key),
        "raw_score": lit_or_col(contribution),
        "contribution": lit_or_col(contribution),
        "description": lit_or_col(description),
        "min_host": F.col(min_host),
        "max_host": F.col(max_host),
        "sensors": F.col(sensors),
        "first_seen": F.timestamp_micros(F.col(first)),
        "last_seen": F.timestamp_micros(F.col(last)),
        "sample_count": flag("sample_count"),
        "public_dns_ntp": flag("public_dns_ntp"),
        "cdn_cloud": flag("cdn_cloud"),
        "match_mode": lit_or_col(match_mode),
        "metrics": F.to_json(
            F.struct(*[c.alias(k) for k, c in metric_cols.items()]), {"ignoreNullFields": "false"}
        ),
        "confidence": lit_or_col(confidence),
        "warnings": warnings,
    }
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in EVIDENCE])
