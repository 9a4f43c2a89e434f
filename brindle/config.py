"""Settings with defaults, from a JSON or, where the reader is installed, a YAML file."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    embedding_dimension: int = 1024
    chunk_size: int = 1000
    max_chunk_size: int = 2000
    chunk_overlap: int = 150
    rrf_k: int = 60
    vector_weight: float = 0.5
    bm25_weight: float = 0.5
    initial_top_k: int = 50
    final_top_k: int = 10
    max_context_tokens: int = 4000
    max_context_chunks: int = 20
    graph_score: float = 0.5
    max_file_mb: int = 100


def load(path: str | None = None, **over) -> Settings:
    """Defaults, over them the file's known keys, over them the arguments. Unknown keys of the file are ignored."""
    found = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text) or {}
        else:
            found = json.loads(text)
    names = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in found.items() if k in names} | over)
