"""One analysis: scoped flows, parameters and the tables its detectors share."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import features as ft
from netsift.operators.detectors.signature import signature_matches
from netsift.operators.roles import orient, scoped
from netsift.operators.tcp import gate, judged_profiles, tcp_profiles
from netsift.operators.traffic import traffic_profile
from netsift.params import PRIVATE_NETWORKS, Params
from netsift.schema import as_flows
from netsift.session import materialize

# What the detectors read of a gated row; the TCP counters have served their purpose by then.
GATED = [
    "sensor_id",
    "ts_us",
    "direction",
    "candidate_ip",
    "host_ip",
    "service_port",
    "protocol",
    "packet_count",
    "total_bytes",
    "payload_hash",
    "tls_fingerprint",
    "certificate_fingerprint",
    "domain",
    "packet_sizes",
]


@dataclass
class AnalysisContext:
    """Immutable inputs of a run and its shared tables, each built on first use.

    With ``tables`` (the default) a shared table is written to the shared folder. Several
    detectors read each of them, so one write replaces repeated scans, joins and shuffles of the
    flows, a lost executor costs no recomputation of earlier steps, and the plans that follow stay
    small. Without it every result is a single lazy plan.
    """

    flows: DataFrame
    params: Params = field(default_factory=Params)
    start: str | None = None
    end: str | None = None
    sensors: tuple[str, ...] = ()
    internal_cidrs: tuple[str, ...] = PRIVATE_NETWORKS
    signatures: DataFrame | None = None
    trusted: DataFrame | None = None
    tables: bool = True

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.tables else df

    @cached_property
    def scoped(self) -> DataFrame:
        return scoped(as_flows(self.flows), self.start, self.end, self.sensors)

    @cached_property
    def oriented(self) -> DataFrame:
        return orient(self.scoped, self.internal_cidrs)

    @cached_property
    def judged(self) -> DataFrame:
        """TCP connections with their verdicts."""
        profiles = tcp_profiles(self.oriented, self.params)
        return self._table(judged_profiles(profiles, self.params), "connections")

    @cached_property
    def gated(self) -> DataFrame:
        judged = self.judged if self.params.tcp_session_gating_enabled else None
        rows = gate(self.oriented, judged, self.params).select(*GATED)
        return self._table(rows, "gated")

    @cached_property
    def contacts(self) -> DataFrame:
        return self._table(ft.contacts(self.gated), "contacts")

    @cached_property
    def shapes(self) -> DataFrame:
        return self._table(ft.shapes(self.gated), "shapes")

    @cached_property
    def intervals(self) -> DataFrame:
        return self._table(ft.host_intervals(self.gated), "intervals")

    @cached_property
    def profile(self) -> DataFrame:
        return self._table(traffic_profile(self.oriented, self.params), "profile")

    @cached_property
    def signature_matches(self) -> DataFrame:
        """Payload groups that match a signature, with the way they match."""
        found = signature_matches(self.oriented, self.signatures, self._table)
        return self._table(found, "matches")

    @cached_property
    def features(self) -> DataFrame:
        """One row per candidate with everything the profile detectors look at."""
        count = self.contacts.agg(F.count_distinct("candidate_ip").alias("c")).scalar()
        table = ft.contact_features(self.contacts).withColumn("candidate_count", count)
        for part in (
            ft.shape_features(self.shapes, self.params),
            ft.value_features(self.shapes, self.params),
            ft.interval_features(self.intervals),
            ft.sensor_features(self.contacts, self.params),
        ):
            table = table.join(part, "candidate_ip", "left")
        marks = {"TRUSTED_DNS": "trusted_dns", "TRUSTED_NTP": "trusted_ntp"}
        if self.trusted is not None:
            listed = self.trusted.groupBy(F.col("value").alias("candidate_ip")).agg(
                *[F.bool_or(F.col("type") == kind).alias(name) for kind, name in marks.items()]
            )
            table = table.join(listed, "candidate_ip", "left")
        else:
            table = table.withColumns({name: F.lit(False) for name in marks.values()})
        return self._table(table, "features")

    def prepare(self) -> AnalysisContext:
        """Write all shared tables; those that do not depend on each other run together."""
        early = ["profile"] + (["signature_matches"] if self.signatures is not None else [])
        _ = self.oriented
        with ThreadPoolExecutor(5) as pool:
            started = [pool.submit(getattr, self, name) for name in early]
            _ = self.gated
            started += [
                pool.submit(getattr, self, name) for name in ("contacts", "shapes", "intervals")
            ]
            for job in started:
                job.result()
        _ = self.features
        return self
