"""Parameters of the scan: thresholds, tier weights and limits."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default thresholds, tier weights and limits of the scan.
DEFAULT_THRESHOLDS = {"suspicious": 0.30, "dangerous": 0.60, "critical": 0.85}
DEFAULT_WEIGHTS = {"structural": 0.40, "contextual": 0.45, "threat-intel": 0.15}
FIELD_CHAR_LIMIT = 50_000
DETECTION_LIMIT = 50
RISK_LEVELS = ("safe", "suspicious", "dangerous", "critical")
LEVEL_ACTIONS = {"safe": "pass", "suspicious": "flag", "dangerous": "redact", "critical": "block"}


@dataclass(frozen=True)
class ScanConfig:
    """Everything a scan can be tuned with.

    ``max_chars`` is ``None`` by default: whole texts are scanned. Set it to
    ``FIELD_CHAR_LIMIT`` to get the bounded scan. ``max_detections`` bounds the
    list kept per tier and per field; ``None``, the default, keeps every
    detection. ``first_override_only`` looks at the first occurrence of each
    override verb instead of all of them.
    """

    thresholds: dict = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    weights: dict = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    max_chars: int | None = None
    max_detections: int | None = None
    trusted_npx_packages: tuple[str, ...] = ()
    first_override_only: bool = False

    def __post_init__(self) -> None:
        t = self.thresholds
        if set(t) != {"suspicious", "dangerous", "critical"}:
            raise ValueError("thresholds need suspicious, dangerous and critical")
        if not all(0.0 <= v <= 1.0 for v in t.values()):
            raise ValueError("thresholds must lie in [0, 1]")
        if not t["suspicious"] < t["dangerous"] < t["critical"]:
            raise ValueError("thresholds must ascend: suspicious < dangerous < critical")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("tier weights must not be negative")
        if abs(sum(self.weights.values()) - 1.0) > 1e-9:
            raise ValueError("tier weights must sum to 1")
        for limit in (self.max_chars, self.max_detections):
            if limit is not None and limit < 1:
                raise ValueError("limits must be positive or None")
