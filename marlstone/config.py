"""Settings of both flows. Defaults are fixed values; environment variables override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from collections.abc import Mapping

from marlstone.errors import FieldError

_TRUE = {"true", "1", "yes", "on"}
_FALSE = {"false", "0", "no", "off"}


def parse_bool(value: str | None, default: bool) -> bool:
    text = (value or "").strip().lower()
    return True if text in _TRUE else False if text in _FALSE else default


def parse_list(value: str | None) -> tuple[str, ...]:
    return tuple(part.strip() for part in (value or "").split(",") if part.strip())


class _FromEnv:
    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = ""):
        """Build settings from variables named like the upper-cased fields."""
        source = os.environ if env is None else env
        values = {}
        for item in fields(cls):
            raw = source.get(f"{prefix}{item.name}".upper())
            if raw is None or raw == "":
                continue
            if isinstance(item.default, bool):
                values[item.name] = parse_bool(raw, item.default)
            elif isinstance(item.default, tuple):
                values[item.name] = parse_list(raw)
            else:
                values[item.name] = type(item.default)(raw)
        return cls(**values)

    def require(self, *names: str) -> tuple:
        for name in names:
            if getattr(self, name, None) in (None, "", ()):
                raise FieldError(type(self).__name__, name, "set")
        return tuple(getattr(self, name) for name in names)


@dataclass(frozen=True)
class IngestSettings(_FromEnv):
    min_content_length: int = 500
    max_content_length: int = 2000
    title_cut: int = 80
    parent_summary_chars: int = 400
    img_content_length: int = 200
    theme_name_chunk_k: int = 3
    theme_name_chunk_size: int = 2500
    document_title_review_threshold: float = 0.65
    embedding_dim: int = 1024
    embedding_batch_size: int = 8
    formula_semantic_max_formulas: int = 10
    formula_semantic_context_chars: int = 600
    formula_semantic_batch_size: int = 20
    import_claim_lease_seconds: int = 14400
    debug_artifacts: bool = False


@dataclass(frozen=True)
class QuerySettings(_FromEnv):
    max_context_chars: int = 12000
    max_query_image_bytes: int = 10 * 1024 * 1024
    agentic_rag_enabled: bool = False
    agentic_rag_mode: str = "hybrid"
    agent_max_iterations: int = 2
    agent_max_subquestions: int = 4
    agent_max_tool_calls: int = 6
    agent_hyde_enabled: bool = False
    agent_timeout_seconds: float = 60.0
    agent_min_evidence_confidence: float = 0.75
    agent_evidence_max_chars: int = 8000
    agent_evidence_pool_max: int = 8
    agent_subquestion_top_k: int = 3
    agent_rerank_batch_size: int = 64
    evidence_eval_max_chars_per_doc: int = 1500
    answer_max_chars_per_evidence: int = 2500
    rerank_max_top_k: int = 5
    rerank_min_top_k: int = 3
    rerank_gap_abs: float = 0.08
    rerank_full_query_weight: float = 0.40
    rerank_retrieval_query_weight: float = 0.60
    rerank_coverage_enabled: bool = True
    rerank_coverage_candidate_top_k: int = 6
    rerank_coverage_query_rank_limit: int = 8
    rerank_coverage_min_score: float = 0.10
    conflict_judge_enabled: bool = True
    conflict_judge_rrf_rank_limit: int = 5
    conflict_judge_max_pairs: int = 2
    conflict_judge_min_confidence: float = 0.80
    conflict_judge_document_max_chars: int = 1800
    rrf_k: int = 60
    rrf_max_results: int = 16
    rrf_direct_weight: float = 0.50
    rrf_hyde_weight: float = 0.30
    rrf_bm25_weight: float = 0.20
    rrf_min_exclusive_per_branch: int = 0
    context_expansion_top_k: int = 3
    context_expansion_window: int = 1
    context_expansion_max_chars: int = 4000
    embedding_search_limit: int = 12
    hyde_search_limit: int = 12
    bm25_search_limit: int = 12
    hybrid_dense_weight: float = 0.5
    hybrid_sparse_weight: float = 0.5
    hyde_use_sparse: bool = False
    soft_route_weight: float = 0.35
    document_route_limit: int = 10
    document_route_max_options: int = 3
    bm25_enabled: bool = False
    active_version_filter_enabled: bool = True
