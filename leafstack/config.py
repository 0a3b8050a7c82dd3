"""Settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1100
    chunk_overlap: int = 220
    top_k: int = 6
    prefetch_k: int = 40
    bm25_avg_len: float = 140.0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    coarse: int = 4
    max_history_turns: int = 6
    rewrite_messages: int = 4
    message_chars: int = 1500
    max_queries: int = 4
    embedding_dim: int = 768
    embed_batch: int = 64
    embed_in_flight: int = 4
    ocr_mode: str = "auto"
    ocr_share: float = 0.3
    ocr_model: str = "ocr"
    ocr_attempts: int = 6
    held_chunks: int = 200_000
    answer_cache_size: int = 2048
    answer_cache_seconds: float = 3600.0
    embedding_cache_size: int = 8192
    rate_limit_per_minute: int = 30
    max_upload_bytes: int = 200 << 20
    first_token_seconds: float = 5.0
    attempts: int = 5
    max_wait_seconds: float = 30.0
    public_key: str = field(default="", repr=False)
    admin_key: str = field(default="", repr=False)


DEFAULTS = Settings()
