"""Run configuration: thresholds, model settings and sources, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelSettings:
    """What a client outside the engine needs to know of one tier."""

    models: tuple[str, ...] = ()
    reviewer: str = ""
    batch: int = 30
    max_tokens: int = 16_000
    retries: int = 3
    delay_ms: int = 15_000
    longest_wait_ms: int = 120_000
    quota_after_s: int = 300


@dataclass(frozen=True)
class EngineConfig:
    # The thresholds of the daily run.
    per_feed: int = 8
    feed_min_chars: int = 10
    preferred_chars: int = 80
    relaxed_chars: int = 20
    secondary_chars: int = 40
    enough: int = 6
    most_articles: int = 12
    most_secondary: int = 4
    date: str = ""
    generated_at: str = ""
    source: str = ""
    secondary_url: str = ""
    secondary_name: str = ""
    query: str = ""
    tier1: ModelSettings = field(default_factory=ModelSettings)
    tier2: ModelSettings = field(default_factory=lambda: ModelSettings(batch=20, max_tokens=3_500))

    @property
    def searches(self) -> bool:
        """A search stands in for a secondary feed unless it is switched off."""
        return not self.secondary_url and bool(self.query) and self.query != "off"

    @classmethod
    def of(cls, settings: Mapping[str, str], query: str = "") -> EngineConfig:
        """From named settings; what is absent or empty keeps its default."""
        get = lambda name, other="": settings.get(name) or other
        distinct = lambda names: tuple(dict.fromkeys(n for n in names if n))
        return cls(
            date=get("BUILD_DATE"), generated_at=get("BUILD_TIME"), source=get("SOURCE_NAME"), secondary_url=get("SECONDARY_FEED_URL"),
            secondary_name=get("SECONDARY_SOURCE_NAME"), query=get("SECONDARY_QUERY", query),
            tier1=ModelSettings(models=distinct([get("TIER1_MODEL")])),
            tier2=ModelSettings(models=distinct([get("TIER2_MODEL"), get("TIER2_FALLBACK_MODEL")]), reviewer=get("TIER2_REVIEW_MODEL"), batch=20, max_tokens=3_500),
        )
