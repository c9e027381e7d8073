"""Settings of a digest run."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    folder: str = "Newsletters"
    max_messages: int = 50
    fetch_chunk: int = 50
    similarity: float = 0.55
    noise_batch: int = 30
    pair_batch: int = 20
    filter_batch: int = 25
    encode_chars: int = 400
    noise_chars: int = 300
    pair_chars: int = 350
    filter_chars: int = 300
    noise_tokens: int = 512
    pair_tokens: int = 512
    filter_tokens: int = 1024

    @classmethod
    def from_env(cls, prefix: str = "WEFTLINE_", env: dict[str, str] | None = None) -> Settings:
        """Settings with values taken from environment variables named ``prefix`` + upper-case field."""
        env = os.environ if env is None else env
        kinds = {"str": str, "int": int, "float": float}
        return cls(**{f.name: kinds[f.type](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env})
