"""Settings from JSON, TOML or YAML files over presets, and names and values from env files."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Mapping
from copy import deepcopy
from typing import Any

from .errors import ConfigError, MissingDependency

_SECRET = re.compile(r"(?i)(^|[_-])(api[_-]?key|secret|password|passwd|token|credentials?|private[_-]?key)$")
#: Settings whose names only look like secrets.
_HARMLESS = {"max_output_tokens", "max_tokens"}

BASE: dict[str, Any] = {
    "name": "assistant",
    "instructions": "",
    "sources": [],
    "index": "index",
    "chunker": {"provider": "structure", "size": 1200, "overlap": 150},
    "embedder": {"provider": "hashing", "dims": 384},
    "retriever": {"provider": "hybrid", "fusion": "rrf", "dense_weight": 0.5},
    "query_transform": None,
    "reranker": None,
    "llm": {"provider": "extractive"},
    "k": 5,
    "generation": {"min_chunks": 1, "min_score": 0.0, "require_verified": True, "verify": False, "on_unsupported": "abstain"},
    "guardrails": [],
    "access": {"enabled": False, "tenant": None, "roles": None, "attributes": {}},
    "evaluation": {"thresholds": {}, "seed": 0, "judge_sample": None},
    "budget": {"calls": None, "chars": None},
}
PRESETS: dict[str, dict[str, Any]] = {
    "free": {"retriever": {"provider": "sparse"}, "k": 5},
    "accurate": {"chunker": {"provider": "parent_child", "parent_size": 2400, "size": 400, "overlap": 50}, "reranker": {"provider": "overlap", "top_n": 5}, "generation": {"verify": True}},
    "cheap": {"chunker": {"provider": "fixed", "size": 800, "overlap": 80}, "retriever": {"provider": "sparse"}, "k": 3},
    "local": {"retriever": {"provider": "hybrid", "fusion": "weighted", "dense_weight": 0.7}},
}


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; mappings merge key by key, but one that names another provider takes the place of
    the whole component."""
    out = deepcopy(dict(base))
    for key, value in over.items():
        have = out.get(key)
        other = isinstance(value, Mapping) and isinstance(have, Mapping) and value.get("provider", have.get("provider")) != have.get("provider")
        out[key] = deep_merge(have, value) if isinstance(value, Mapping) and isinstance(have, Mapping) and not other else deepcopy(value)
    return out


def refuse_secrets(settings: Any, at: str = "") -> None:
    """Secrets belong in the environment: keys that are named like one are an error, wherever they stand. A key
    that ends in _env names a variable and is allowed."""
    if isinstance(settings, Mapping):
        for key, value in settings.items():
            if _SECRET.search(str(key)) and key not in _HARMLESS and value not in (None, ""):
                raise ConfigError(f"{at}{key} looks like a secret; put it into the environment")
            refuse_secrets(value, f"{at}{key}.")
    elif isinstance(settings, list | tuple):
        for n, value in enumerate(settings):
            refuse_secrets(value, f"{at}{n}.")


def resolve(settings: Mapping[str, Any]) -> dict[str, Any]:
    """All settings: the base, then a preset if one is named, then what is given. Unknown names are an error."""
    given = dict(settings)
    preset = given.pop("preset", None)
    if preset is not None and preset not in PRESETS:
        raise ConfigError(f"no preset {preset}; there are {', '.join(PRESETS)}")
    if unknown := sorted(set(given) - set(BASE)):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    refuse_secrets(given)
    return deep_merge(deep_merge(BASE, PRESETS.get(preset, {})), given)


def load_config(path: str) -> dict[str, Any]:
    """The settings in a file, paths in sources and index taken from the file's folder."""
    with open(path, "rb") as f:
        raw = f.read()
    kind = os.path.splitext(path)[1].lower()
    try:
        if kind == ".toml":
            given = tomllib.loads(raw.decode())
        elif kind in (".yaml", ".yml"):
            try:
                import yaml
            except ImportError as e:
                raise MissingDependency("yaml", "yaml") from e
            given = yaml.safe_load(raw) or {}
        else:
            given = json.loads(raw)
    except (ValueError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    if not isinstance(given, Mapping):
        raise ConfigError(f"{path} must hold a mapping")
    out = resolve(given)
    here = os.path.dirname(os.path.abspath(path))
    place = lambda p: p if "://" in p or os.path.isabs(p) else os.path.join(here, p)
    out["sources"] = [place(s) if isinstance(s, str) else s | {"location": place(s["location"])} for s in out["sources"]]
    out["index"] = place(out["index"])
    return out


_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines: export may stand before them; double quotes know escapes, single quotes take all as it is;
    what follows a # after space is a comment outside quotes."""
    out = {}
    for line in text.lstrip("﻿").splitlines():
        found = _LINE.match(line)
        if not found or line.lstrip().startswith("#"):
            continue
        key, value = found.groups()
        if m := re.match(r'"((?:[^"\\]|\\.)*)"', value):
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), m[1])
        elif m := re.match(r"'([^']*)'", value):
            value = m[1]
        else:
            value = re.sub(r"(^|\s)#.*$", "", value).rstrip()
        out[key] = value
    return out


def load_env(path: str, environment: dict[str, str] | None = None) -> list[str]:
    """Sets what the environment doesn't have yet; returns the names that were set, never values."""
    environment = os.environ if environment is None else environment
    with open(path, encoding="utf-8") as f:
        found = parse_env(f.read())
    new = {k: v for k, v in found.items() if k not in environment}
    environment.update(new)
    return sorted(new)
