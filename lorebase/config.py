"""All thresholds, weights and limits of the engine."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    max_content: int = 524_288
    max_title: int = 500
    max_summary: int = 2_000
    max_tags: int = 20
    index_chars: int = 800
    embed_chars: int = 1_024
    dimensions: int = 384
    prune_threshold: float = 0.1
    weak_threshold: float = 0.3
    consolidate_threshold: float = 0.8
    duplicate: float = 0.95
    supersede: float = 0.8
    coexist: float = 0.6
    is_similar: float = 0.3
    #: rows of a batch this similar are stored one after another; with 0, all that find each other by text
    batch_order: float = 0.6
    recency_days: float = 365.0
    reinforcement: float = 0.1
    #: semantic, fuzzy, strength, recency with a query vector; fuzzy, strength, recency without
    semantic_weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)
    lexical_weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    #: cosine and Jaccard in the similarity of two memories
    pair_weights: tuple[float, float] = (0.6, 0.4)
    over_fetch: int = 3
    #: "trigram", or "substring_or_tag": what stage one takes as candidates
    candidate_mode: str = "trigram"
    #: drop the reinforcements of a duplicate whose content is replaced
    compat_lost_update: bool = False

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        """From a JSON object; unknown keys are an error."""
        raw = json.loads(text)
        if unknown := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


DEFAULT = EngineConfig()
