"""Settings of the engine, all of them parameters with defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def unique_list(value: str) -> list[str]:
    """Items between commas or line ends, trimmed, without blanks or repeats, in order."""
    return list(dict.fromkeys(x for x in (p.strip() for p in re.split(r"[,\n]", value)) if x))


def read_dotenv(path: str) -> dict[str, str]:
    """``NAME=value`` lines of a file, with or without ``export`` and quotes; an absent file has none."""
    if not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("\"'")
    return found


@dataclass(frozen=True)
class Settings:
    """Sizes are in characters, thresholds are cosines."""

    embed_model: str = "hashing"
    embed_dim: int = 256
    generators: tuple[str, ...] = ("extractive",)
    keys: tuple[str, ...] = field(default=(), repr=False)
    chunk_chars: int = 1400
    chunk_overlap: int = 200
    min_chunk_chars: int = 120
    mode: str = "flat"
    cluster_size: int = 20
    embed_batch: int = 32
    retries: int = 6
    items_per_minute: int = 95
    answers_per_minute: int = 10
    candidates: int = 30
    top_k: int = 6
    rrf_k: int = 60
    mmr_lambda: float = 0.7
    dedup_cosine: float = 0.95
    min_cosine: float = 0.55
    bm25_k1: float = 1.5
    bm25_b: float = 0.75

    @classmethod
    def from_env(cls, prefix: str = "SPARKGROVE_", env: dict[str, str] | None = None, dotenv: str | None = None) -> Settings:
        """Defaults overridden by ``<prefix><FIELD>`` of the environment, and before it of a file of ``NAME=value`` lines; lists are parsed by :func:`unique_list`."""
        env = (read_dotenv(dotenv) if dotenv else {}) | (dict(os.environ) if env is None else env)
        found: dict[str, object] = {}
        for name, spec in cls.__dataclass_fields__.items():
            if (raw := env.get(prefix + name.upper())) is not None:
                kind = type(getattr(cls(), spec.name))
                found[name] = tuple(unique_list(raw)) if kind is tuple else kind(raw)
        return cls(**found)  # type: ignore[arg-type]
