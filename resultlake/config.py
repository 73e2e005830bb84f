"""Settings: defaults, overridden by a JSON file, environment and arguments, in that order."""

from __future__ import annotations

import dataclasses
import json
import os
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Settings:
    limit: int = 99
    since: str | None = None
    rel_mode: str = "balanced"
    similarity: float = 0.42
    duplicate: float = 0.94
    reprint: float = 0.75
    max_cluster: int = 12
    max_bucket: int = 6
    as_of: str | None = None

    def checked(self) -> Settings:
        if not 1 <= self.limit <= 150:
            raise ValueError("limit must be within 1 and 150")
        if self.rel_mode not in ("balanced", "aggressive", "conservative"):
            raise ValueError(f"unknown rel_mode {self.rel_mode}")
        if not 0 <= self.reprint <= self.duplicate <= 1.01 or not 0 <= self.similarity <= 1:
            raise ValueError("similarities must be within 0 and 1, reprint not above duplicate")
        return self


_TYPES = {f.name: f.type for f in dataclasses.fields(Settings)}


def _value(name: str, raw):
    if raw is None or not isinstance(raw, str):
        return raw
    return int(raw) if _TYPES[name] == "int" else float(raw) if _TYPES[name] == "float" else raw


def settings(file: str | None = None, env: dict | None = None, **given) -> Settings:
    """Unknown names in the file or arguments raise ValueError; so do values out of range."""
    stored = json.loads(Path(file).read_text()) if file else {}
    for name in [*stored, *given]:
        if name not in _TYPES:
            raise ValueError(f"unknown setting {name}")
    env = os.environ if env is None else env
    found = {n: env[f"RESULTLAKE_{n.upper()}"] for n in _TYPES if f"RESULTLAKE_{n.upper()}" in env}
    merged = stored | found | {k: v for k, v in given.items() if v is not None}
    return Settings(**{k: _value(k, v) for k, v in merged.items()}).checked()
