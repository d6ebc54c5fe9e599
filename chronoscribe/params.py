"""Operator parameters and the ranges in which they are accepted."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Inclusive ranges of the user-settable parameters.
RANGES = {
    "capture_interval": (1, 10),
    "max_keyframe_interval": (30, 300),
    "keyframe_threshold": (0.20, 0.80),
    "retention_days": (1, 90),
    "chunk_seconds": (60, 900),
    "poll_seconds": (10, 300),
    "minimum_age": (60, 600),
}


@dataclass(frozen=True)
class Params:
    capture_interval: float = 2.0
    max_keyframe_interval: float = 60.0
    keyframe_threshold: float = 0.50
    retention_days: int = 7
    chunk_seconds: float = 300.0
    min_chunk_seconds: float = 15.0
    poll_seconds: float = 60.0
    minimum_age: float = 300.0
    summary_batch_limit: int | None = None
    max_summaries: int = 30
    max_captures: int = 50
    resolve_limit: int | None = None
    summary_max_keyframes: int = 10
    summary_max_deltas: int = 3
    summary_keyframe_chars: int = 2000
    summary_delta_chars: int = 300
    enrich_max_keyframes: int = 10
    enrich_max_deltas: int = 5
    enrich_keyframe_chars: int = 3000
    enrich_delta_chars: int = 500

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in RANGES:
                lo, hi = RANGES[f.name]
                value = getattr(self, f.name)
                if not lo <= value <= hi:
                    raise ValueError(f"{f.name}={value} is outside {lo}..{hi}")
