"""Every tunable of the engine, with its bounds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    child_tokens: int = 256
    child_overlap: int = 40
    parent_tokens: int = 1200
    top_k: int = 5
    dense_k: int = 20
    bm25_k: int = 20
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    rerank_candidates: int = 20
    rerank_threshold: float = 0.1
    rerank_weight: float = 1.0
    rerank_min_keep: int = 3
    context_tokens: int = 6000
    history_turns: int = 6
    history_chars: int = 1200
    self_correction: bool = True
    retrieval_retries: int = 2
    summary_tokens: int = 12_000
    summary_batch_tokens: int = 6000
    compare_documents: int = 4
    compare_top_k: int = 4
    query_variants: int = 3
    cache_threshold: float = 0.96
    cache_entries: int = 1000
    embedding_dim: int = 768
    questions_per_minute: int = 20
    ingests_per_hour: int = 30

    def __post_init__(self) -> None:
        if not 0 <= self.child_overlap < self.child_tokens <= self.parent_tokens:
            raise ValueError("overlap < child size <= parent size must hold")
        if not 0 <= self.rerank_threshold <= 1 or not 0 <= self.cache_threshold <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if not 128 <= self.embedding_dim <= 3072:
            raise ValueError("embeddings have 128 to 3072 dimensions")
        if min(self.top_k, self.dense_k, self.bm25_k, self.rrf_k, self.rerank_candidates) < 1:
            raise ValueError("counts are positive")

    @property
    def small_section(self) -> int:
        """Sections with fewer tokens join their neighbours."""
        return max(60, self.parent_tokens // 8)
