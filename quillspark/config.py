"""Search settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchConfig:
    channels: dict[str, float] = field(default_factory=lambda: {"stem": 1.0, "char": 0.5})
    location: float = 8.0
    service: float = 1.0
    prior: float = 0.5
    alpha: float = 5.0
    beta: float = 0.0
    geo_strength: float = 128.0
    scope: str = "all"
    e5_weight: float = 0.5
    e5_geo: float = 0.05
    max_length: int = 80


#: The category of services, the rank offset of reciprocal fusion, the answer's length.
SERVICE_CATEGORY = 114
RRF_OFFSET = 60
ANSWER = 50
#: Scores are ranked after rounding to this many digits, so that the order of sums cannot decide.
DIGITS = 6
