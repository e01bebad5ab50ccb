"""Options of the engine; each may be set by an environment variable of the same name."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _env(name: str, default):
    raw = os.environ.get(name)
    return default if raw is None else type(default)(raw)


@dataclass(frozen=True)
class EngineConfig:
    """Defaults, then the environment, then what is passed."""

    extensions: tuple[str, ...] = (".pdf", ".docx", ".doc", ".html", ".htm", ".txt", ".csv")
    CHUNK_SIZE: int = field(default_factory=lambda: _env("CHUNK_SIZE", 1000))
    CHUNK_OVERLAP: int = field(default_factory=lambda: _env("CHUNK_OVERLAP", 150))
    TOKEN_CHUNK_MIN: int = field(default_factory=lambda: _env("TOKEN_CHUNK_MIN", 400))
    TOKEN_CHUNK_MAX: int = field(default_factory=lambda: _env("TOKEN_CHUNK_MAX", 600))
    TOKEN_CHUNK_OVERLAP_PCT: float = field(default_factory=lambda: _env("TOKEN_CHUNK_OVERLAP_PCT", 0.12))
    EMBEDDING_DIM: int = field(default_factory=lambda: _env("EMBEDDING_DIM", 384))
    BM25_TOPK: int = field(default_factory=lambda: _env("BM25_TOPK", 30))
    ANN_TOPK: int = field(default_factory=lambda: _env("ANN_TOPK", 30))
    RERANK_TOPK: int = field(default_factory=lambda: _env("RERANK_TOPK", 10))
    FINAL_TOPK: int = field(default_factory=lambda: _env("FINAL_TOPK", 10))
    RRF_K: int = field(default_factory=lambda: _env("RRF_K", 60))
    LLM_CONCURRENCY: int = field(default_factory=lambda: _env("LLM_CONCURRENCY", 5))
    LLM_CONTEXT_PASSAGES: int = field(default_factory=lambda: _env("LLM_CONTEXT_PASSAGES", 3))
    #: Larger files are not read, and go to quarantine: a reader holds a file whole.
    MAX_FILE_BYTES: int = field(default_factory=lambda: _env("MAX_FILE_BYTES", 256 << 20))
    #: 0: every vector is compared; -1: a cell index with the root of their number of cells; else so many cells.
    VECTOR_CELLS: int = field(default_factory=lambda: _env("VECTOR_CELLS", 0))
    #: 0: exact; else cells that a query is compared with.
    VECTOR_PROBES: int = field(default_factory=lambda: _env("VECTOR_PROBES", 0))
    #: 1: ranked searches skip blocks of postings that can't reach the best.
    BLOCK_SEARCH: int = field(default_factory=lambda: _env("BLOCK_SEARCH", 0))
    RUNTIME_LIMIT_SECONDS: float = field(default_factory=lambda: _env("RUNTIME_LIMIT_SECONDS", 30.0))

    def token_overlap(self) -> int:
        """Tokens that successive token chunks share."""
        return max(1, int(((self.TOKEN_CHUNK_MIN + self.TOKEN_CHUNK_MAX) // 2) * self.TOKEN_CHUNK_OVERLAP_PCT))

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}
