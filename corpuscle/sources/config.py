"""Configuration: dotted keys, environment variables, and the order in which settings hold."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

_NAME = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand_env(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """``${NAME:-default}`` in all strings of a nested value; a name without value and default stays as it is."""
    env = os.environ if env is None else env
    if isinstance(value, Mapping):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    if not isinstance(value, str):
        return value
    return _NAME.sub(lambda m: env.get(m[1]) or (m[2] if m[2] is not None else m[0]), value)


@dataclass
class Config:
    values: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(expand_env(yaml.safe_load(f) or {}))

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at


#: Knobs of a search that a call, a preset and the configuration may set, with what holds if none does.
KNOBS: dict[str, Any] = {"top_k": 7, "dense_k": 20, "sparse_k": 20, "rrf_k": 60, "rerank_mode": "lexical", "rerank_instruction": "", "hyde": False, "hype": True, "live": True, "scope_routing": True, "parent_context": True, "neighbor_context": True, "boost": True, "boost_code": False}


def resolve(call: Mapping[str, Any], presets: Mapping[str, Mapping[str, Any]], config: Mapping[str, Any], code_question: bool = False) -> dict[str, Any]:
    """Each knob from the call, else its preset, else the configuration, else the default.

    Zero and None fall through, except for False, and for an empty instruction, which mean
    something. Without a named preset, a question about code takes the preset ``code`` if
    ``auto_preset`` is on.
    """
    name = call.get("preset")
    if name and name not in presets:
        raise ValueError(f"unknown preset {name!r}; expected one of {sorted(presets)}")
    if not name and code_question and config.get("auto_preset") and "code" in presets:
        name = "code"
    layers = (call, presets.get(name, {}) if name else {}, config)
    means = lambda k, v: v is False or bool(v) or (k == "rerank_instruction" and v == "")
    out = {k: next((layer[k] for layer in layers if k in layer and means(k, layer[k])), default) for k, default in KNOBS.items()}
    return out | {"preset": name}
