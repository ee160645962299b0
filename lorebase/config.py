"""Configuration values: environment placeholders, nested overlay, dotted lookup, validation counts."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Mapping
from typing import Any

_PLACE = re.compile(r"\$\{([^}]+)\}")


def interpolate(text: str, env: Mapping[str, str] | None = None) -> str:
    """`${NAME}` and `${NAME:default}`; a name without value and default stays as it is."""
    values = os.environ if env is None else env

    def value(m: re.Match) -> str:
        name, _, default = m[1].partition(":")
        return values.get(name.strip(), default.strip() if default else m[0])

    return _PLACE.sub(value, text)


def overlay(base: dict[str, Any], update: Mapping[str, Any]) -> dict[str, Any]:
    """The base with the update over it, mappings being merged key by key."""
    return base | {k: overlay(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in update.items()}


def get(config: Any, path: str, default: Any = None) -> Any:
    for key in path.split("."):
        if not isinstance(config, Mapping) or key not in config:
            return default
        config = config[key]
    return config


def summary(results: list[tuple[str, str]]) -> dict[str, int]:
    """Counts of (level, message) by level."""
    return dict(Counter(level for level, _ in results))
