"""Numeric constants of the engine, in one place, with start-up validation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults; a session may carry its own instance."""

    concurrency: int = 2
    strategy: str = "all"
    tag: str = "estimate"
    recheck_sources: bool = True
    match_ttl_days: int = 7
    miss_ttl_days: int = 1
    reply_ttl_hours: int = 12
    withhold_weight: float = 0.3
    estimated_share: float = 0.25
    low_confidence: float = 0.6
    high_mean: float = 0.75
    low_mean: float = 0.55
    dominant_share: float = 0.2
    accept_score: float = 30
    fuzzy_accept: float = 50
    band: float = 20
    shortlist: int = 12
    offer: int = 8

    def __post_init__(self):
        if not isinstance(self.concurrency, int) or self.concurrency < 1:
            raise ValueError("concurrency must be a positive integer")


DEFAULT = Config()
