"""Tunables of recall, resolution and consolidation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults that results depend on.
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    rrf_k: int = 1
    hybrid_rrf_k: int = 60
    top_k: int = 10
    degree_weight: float = 0.05
    degree_saturation: int = 10
    proximity_weight: float = 0.0
    proximity_saturation: int = 20
    temporal_weight: float = 0.0
    temporal_lambda: float = 0.01
    floor: float = 0.0
    hops: int = 1
    fan_out_cap: int = 8
    neighbour_decay: float = 0.5
    content_weight: float = 1.0
    merge_cosine: float = 0.95
    alias_cosine: float = 0.70
    revoke_cosine: float = 0.50
    pair_cosine: float = 0.80
    token_overlap: float = 0.5
    confidence_floor: float = 0.7
    entropy_floor: float = 1.5
    entropy_length: int = 6
    entropy_tokens: int = 2
    minhash_permutations: int = 32
    minhash_shingle: int = 3
    minhash_band: int = 4
    minhash_jaccard: float = 0.9
    window_words: int = 300
    window_overlap: int = 50
    bulk_minimum: int = 20
    bulk_share: float = 0.25
    catch_all_type: int = 0


DEFAULT = Config()
