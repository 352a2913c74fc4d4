"""Parameters of the pipeline, passed explicitly to the functions that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 768
    embed_max_chars: int = 1500
    ner_max_chars: int = 2000
    retention_days: int = 180
    simhash_window_hours: int = 48
    simhash_threshold: int = 3
    vector_dedup_threshold: float = 0.95
    min_cluster_size: int = 3
    cluster_window_hours: int = 24
    gdelt_enabled: bool = True
    rss_interval_seconds: int = 300
