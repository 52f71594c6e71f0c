"""Settings by dotted names, with defaults, from YAML-like dictionaries."""

from __future__ import annotations

import copy
import json
from typing import Any

# The pipeline's parameters.
DEFAULTS = {
    "chunk": {"size": 3000, "step": 2700, "least": 50},
    "dedup": {"similarity_threshold": 0.85},
    "filter": {"min_importance": 1, "min_connections": 0},
    "context": {"window": 5},
    "limits": {"page": 1000, "depth": 3, "path": 10},
}


class Config:
    def __init__(self, values: dict | None = None):
        self.values = _merge(copy.deepcopy(DEFAULTS), values or {})

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON or, where a reader is installed, a YAML file; defaults fill what is missing, also a missing file."""
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        except FileNotFoundError:
            return cls()
        try:
            return cls(json.loads(text))
        except json.JSONDecodeError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path} is not JSON, and no YAML reader is installed") from e
            return cls(yaml.safe_load(text))

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value


def _merge(base: dict, over: dict) -> dict:
    for k, v in over.items():
        base[k] = _merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base
