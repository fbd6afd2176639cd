"""Settings of the engine, from arguments or environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

MODES = ("vector", "bm25", "hybrid")


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of every knob; ``candidate_k`` is never below ``top_k``."""

    chunk_unit: str = "token"
    chunk_size: int = 384
    chunk_overlap: int = 80
    chunk_normalize: bool = False
    top_k: int = 4
    score_threshold: float | None = None
    ingest_normalize: bool = True
    index: str = "exact"
    nlist: int = 256
    nprobe: int = 8
    ef: int = 64
    mode: str = "hybrid"
    candidate_k: int = 50
    rrf_k: int = 60
    rerank: bool = False
    vector_weight: float = 1.0
    bm25_weight: float = 1.0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {MODES}")
        if not (1 <= self.top_k and 1 <= self.candidate_k and 1 <= self.rrf_k):
            raise ValueError("top_k, candidate_k and rrf_k are at least 1")
        if self.chunk_unit not in ("token", "char"):
            raise ValueError(f"unknown chunk unit {self.chunk_unit!r}")
        object.__setattr__(self, "candidate_k", max(self.candidate_k, self.top_k))

    @classmethod
    def from_env(cls, prefix: str = "TESSERA_", **given) -> EngineConfig:
        """``TESSERA_TOP_K`` and so on; none, off or null stand for no threshold."""
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None or f.name in given:
                continue
            kind = type(f.default)
            if f.name == "score_threshold":
                given[f.name] = None if raw.strip().lower() in ("", "none", "off", "null") else float(raw)
            else:
                given[f.name] = raw == "1" if kind is bool else kind(raw)
        return cls(**given)


def parse_weights(text: str, channels: tuple[str, ...] = ("vector", "bm25")) -> dict[str, float]:
    """``"1,2"`` to a weight for each channel; full-width commas count, a wrong number raises."""
    parts = [p for p in text.replace("，", ",").split(",") if p.strip()]
    if len(parts) != len(channels):
        raise ValueError(f"{len(channels)} weights expected, {len(parts)} given")
    return dict(zip(channels, map(float, parts), strict=True))
