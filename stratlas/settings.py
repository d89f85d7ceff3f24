"""Settings from an environment: pools of keys, numbers with defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


def pool(env: Mapping[str, str], plural: str, singular: str) -> list[str]:
    """Keys parted by commas under the plural name; only where it names none, the singular one. Blanks and repeats fall away."""
    many = [k.strip() for k in env.get(plural, "").split(",") if k.strip()]
    one = env.get(singular, "").strip()
    return list(dict.fromkeys(many)) or ([one] if one else [])


def number(env: Mapping[str, str], name: str, default: float) -> float:
    """A number, or the default where the name is missing or blank; anything else raises."""
    text = env.get(name, "").strip()
    return float(text) if text else default


@dataclass(frozen=True)
class Settings:
    """What the clients of outside services need."""

    code_host_tokens: tuple[str, ...] = ()
    embedding_keys: tuple[str, ...] = ()
    teacher_keys: tuple[str, ...] = ()
    requests_per_minute: float = 40.0
    concurrency: int = 8

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(
            tuple(pool(env, "CODE_HOST_TOKENS", "CODE_HOST_TOKEN")), tuple(pool(env, "EMBEDDING_KEYS", "EMBEDDING_KEY")), tuple(pool(env, "TEACHER_KEYS", "TEACHER_KEY")),
            number(env, "REQUESTS_PER_MINUTE", 40.0), int(number(env, "CONCURRENCY", 8)),
        )
