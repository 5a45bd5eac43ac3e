"""Default parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# Fixed values.
CHUNK_TARGET, CHUNK_MIN, CHUNK_HARD_SPLIT = 700, 180, 620
EMBEDDING_DIM = 256
BM25_K1, BM25_B = 1.5, 0.75
REFUSAL_MESSAGE = "제공된 공지에서 확인되지 않습니다. 입학처에 직접 문의해 주세요."
NO_MATCH_MESSAGE = "제공된 공지에서 확인되지 않습니다"
OFFLINE_REFUSAL_MESSAGE = "제공된 공지에서 확인되지 않습니다."
HARD_CUES = ["날씨", "학번", "삼성전자", "주가", "2030학년도", "존재하지", "개인 연락처"]


@dataclass(frozen=True)
class Settings:
    """Retrieval, refusal, answer, admission and cost settings."""

    index_name: str = "default"
    corpus_profile: str = "text_only"
    index_version: str = "v1"
    embedding_model: str = "hashed-256"
    embedding_dim: int = EMBEDDING_DIM
    chunk_size: int = CHUNK_TARGET
    chunk_overlap: int = 0
    tokenizer: str = "unicode-letter-number-v1"
    source_data_path: str = ""
    retrieval_top_k: int = 4
    hybrid_top_k: int = 5
    bm25_top_k: int = 50
    dense_top_k: int = 50
    rrf_k: int = 60
    fusion_method: str = "rrf"
    min_similarity: float = 0.18
    response_source_limit: int = 3
    refusal_min_dense_score: float = 0.22
    refusal_min_token_overlap: int = 1
    refusal_min_token_coverage: float = 0.3
    refusal_evidence_top_k: int = 40
    refusal_cues: tuple[str, ...] = field(default_factory=tuple)
    max_context_chars: int = 3600
    ip_minute_limit: int = 30
    ip_daily_limit: int = 200
    session_minute_limit: int = 12
    session_daily_limit: int = 80
    rate_window_seconds: int = 60
    input_rate: float = 0.25
    output_rate: float = 2.0
    important_input_rate: float = 1.25
    important_output_rate: float = 10.0
    max_output_tokens: int = 512

    @classmethod
    def of(cls, **values) -> Settings:
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return cls(**values)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


#: Bounds of limits, for each kind of search.
LIMITS = {"dense": {"limit": (1, 20)}, "bm25": {"limit": (1, 20)}, "hybrid": {"top_k": (1, 50), "bm25_top_k": (1, 500), "dense_top_k": (1, 500), "rrf_k": (1, 1000)}}


def clamp_limits(kind: str, **limits: int) -> dict[str, int]:
    """Limits of a search as its bounds allow: kind dense, bm25 or hybrid."""
    return {k: clamp(v, *LIMITS[kind][k]) for k, v in limits.items()}
