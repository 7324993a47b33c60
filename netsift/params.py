"""Analysis parameters and the fixed scoring tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The largest number of points one evidence type may add to a score.
CAPS = {
    "COMMON_DESTINATION": 20,
    "PERIODIC_BEACON": 15,
    "SYNCHRONIZED_COMMUNICATION": 15,
    "COMMAND_ATTACK_CORRELATION": 25,
    "MULTI_SENSOR_CONTEXT": 10,
    "PROTOCOL_PAYLOAD_SIMILARITY": 10,
    "LOW_VOLUME_PERSISTENCE_RARITY": 5,
    "SINGLE_HOST_BEACON": 35,
    "ANALYST_PAYLOAD_SIGNATURE": 80,
    "NON_WELL_KNOWN_PORT": 25,
    "ML_POPULATION_ANOMALY": 5,
    "TCP_SESSION_QUALITY": 15,
}

# Detector names, in the order evidence is produced.
DETECTORS = (
    "common_destination",
    "non_well_known_port",
    "periodic_beacon",
    "single_host_composite_beacon",
    "analyst_payload_signature",
    "synchronized_communication",
    "command_attack_correlation",
    "persistence_rarity",
    "protocol_similarity",
    "multi_sensor_context",
    "ml_population_anomaly",
    "tcp_session_quality",
)

MAX_DETECTOR_WEIGHT = 2.0
WEIGHT_STEPS = (1.25, 1.5, 1.75, 2.0)
DETECTOR_VERSION = "1.0.0"
PREFILTER_VERSION = "ai-prefilter-v1"
PRIVATE_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

# How long each kind of record is kept, in days.
RETENTION_DAYS = {"pcap": 7, "flow": 30, "result": 180, "audit": 365, "heartbeat": 30}


@dataclass(frozen=True)
class Params:
    """Knobs of one analysis run; defaults are the published ones."""

    minimum_distinct_clients: int = 3
    minimum_candidate_score: int = 0
    periodicity_min_samples: int = 5
    maximum_beacon_cv: float = 0.30
    synchronization_window_seconds: float = 2.0
    well_known_port_max: int = 1023
    non_well_known_port_min_ratio: float = 0.75
    non_well_known_port_min_observations: int = 2
    non_well_known_port_exclusions: tuple[int, ...] = ()
    high_volume_bytes_threshold: int = 50 * 1024 * 1024
    high_volume_packet_threshold: int = 100_000
    high_volume_penalty: int = 30
    high_volume_tcp_session_bytes_threshold: int = 50 * 1024 * 1024
    high_volume_tcp_session_packet_threshold: int = 100_000
    high_volume_tcp_session_score_cap: int = 20
    tcp_session_idle_timeout_seconds: int = 60
    tcp_session_gating_enabled: bool = True
    tcp_allow_legacy_without_flags: bool = True
    tcp_outbound_initiated_contribution: float = 5
    tcp_established_contribution: float = 10
    tcp_scan_suppression_enabled: bool = True
    tcp_scan_min_targets: int = 8
    tcp_scan_probe_max_packets: int = 4
    tcp_scan_probe_ratio: float = 0.8
    tcp_require_established_outbound: bool = False
    detector_weights: dict[str, float] = field(default_factory=dict)
    ml_anomaly_enabled: bool = False
    ml_anomaly_allow_standalone: bool = False
    ml_anomaly_min_population: int = 30
    ml_anomaly_min_candidate_samples: int = 5
    ml_anomaly_z_threshold: float = 3.5
    ml_anomaly_feature_z_floor: float = 1.0
    ml_anomaly_min_directional_features: int = 2
    ml_anomaly_contribution_cap: float = 5.0
    public_dns_ntp_servers: tuple[str, ...] = ()
    trusted_dns_servers: tuple[str, ...] = ()
    trusted_ntp_servers: tuple[str, ...] = ()
    cdn_domain_suffixes: tuple[str, ...] = ()
    trusted_infrastructure_ips: tuple[str, ...] = ()
    clock_offsets_ms: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.minimum_distinct_clients < 1 or self.periodicity_min_samples < 2:
            raise ValueError("minimum clients and samples are too small")
        unknown = set(self.detector_weights) - set(DETECTORS)
        if unknown:
            raise ValueError(f"unknown detector weights: {sorted(unknown)}")
        if any(not 0 <= w <= MAX_DETECTOR_WEIGHT for w in self.detector_weights.values()):
            raise ValueError("detector weights must lie in [0, 2]")

    def override(self, **changes: object) -> Params:
        return replace(self, **changes)
