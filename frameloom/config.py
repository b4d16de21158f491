"""Settings of the camera analytics, frozen; callers pass what they change with dataclasses.replace()."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DetectionConfig:
    allowlist: tuple[str, ...] = ("person", "backpack", "handbag", "suitcase", "knife", "cell phone", "laptop", "bottle")
    min_confidence: float = 0.25
    secondary_confidence: float = 0.35
    nms_iou: float = 0.45


@dataclass(frozen=True)
class IdentityConfig:
    t_accept: float = 0.80
    t_reject: float = 0.45
    enroll_t_accept: float = 0.85
    enroll_t_reject: float = 0.45
    min_sim_add: float = 0.68
    max_protos_per_person: int = 5
    keep_k: int = 4


@dataclass(frozen=True)
class ClusterConfig:
    eps: float = 0.5
    min_samples: int = 4


@dataclass(frozen=True)
class RuleConfig:
    intrusion_gap_frames: int = 2
    default_loiter_seconds: float = 30.0
    unenrolled_debounce_frames: int = 5


@dataclass(frozen=True)
class TrackerConfig:
    high: float = 0.5
    low: float = 0.1
    match: float = 0.8
    max_age: int = 30
    min_hits: int = 3


@dataclass(frozen=True)
class Config:
    detection: DetectionConfig = field(default_factory=DetectionConfig)
    identity: IdentityConfig = field(default_factory=IdentityConfig)
    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    rules: RuleConfig = field(default_factory=RuleConfig)
    tracker: TrackerConfig = field(default_factory=TrackerConfig)
