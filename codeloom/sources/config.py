"""Settings: defaults, merged with a JSON file, checked."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Settings:
    scan_ignore: list[str] = field(default_factory=lambda: ["node_modules", "dist", ".git"])
    similarity_threshold: float = 0.7
    redundancy_threshold: float = 0.95
    top_k: int = 10
    budget_tokens: int = 8000
    contracts: list[dict] = field(default_factory=list)

    @staticmethod
    def load(text: str | None) -> Settings:
        """Settings from JSON text; unknown names and values of another kind raise ValueError."""
        got = json.loads(text) if text else {}
        known = {f.name: getattr(Settings(), f.name) for f in fields(Settings)}
        for k, v in got.items():
            if k not in known:
                raise ValueError(f"unknown setting {k}")
            if not isinstance(v, type(known[k])) and not (isinstance(known[k], float) and isinstance(v, int)):
                raise ValueError(f"setting {k} is of the wrong kind")
        return Settings(**(asdict(Settings()) | got))
