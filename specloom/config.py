"""Settings, from the environment where they are secrets."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _key(name: str) -> str:
    return field(default_factory=lambda: os.environ.get(f"API_KEY_{name.upper()}", f"{name}-key"))


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 1024
    chunk_words: int = 200
    chunk_overlap: int = 40
    top_k: int = 12
    api_key_read: str = _key("read")
    api_key_write: str = _key("write")
    api_key_admin: str = _key("admin")
