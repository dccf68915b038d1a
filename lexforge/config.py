"""Settings that the operators' defaults come from."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    parent_size: int = 2000
    child_size: int = 400
    overlap: int = 60
    sparse_weight: float = 0.7
    dense_weight: float = 1.0
    top_retrieve: int = 16
    top_children: int = 5
    top_rerank: int = 2
    title_anchor: bool = False
    faq_threshold: float = 0.85
    cache_ttl: int = 3600
    child_fallback: bool = True
    answer_without_context: bool = False
    alert_level: int = 1
    embed_dim: int = 1024
    nlist: int = 256
    nprobe: int = 16
    k1: float = 1.2
    b: float = 0.75


DEFAULT = Settings()
