"""Manager settings with their defaults.

``cache_size`` and ``enable_conflict_detection`` are accepted and have no effect: tables are cached by Spark, and conflicts are
resolved by the operators, not on ingest. The intervals and background flags hold for ``Engine.maintain``, the others for requests.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    forgetting_threshold: float = 0.3
    consolidation_interval_s: int = 3600
    forgetting_interval_s: int = 1800
    cache_size: int = 10_000
    max_search_results: int = 100
    auto_hdc_encoding: bool = True
    enable_conflict_detection: bool = True
    background_consolidation: bool = False
    background_forgetting: bool = False

    def with_forgetting_threshold(self, value: float) -> Config:
        return replace(self, forgetting_threshold=min(1.0, max(0.0, value)))

    def with_(self, **changes) -> Config:
        return replace(self, **changes)
