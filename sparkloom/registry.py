"""Plug-ins by stage and name. A factory is a function; its keyword parameters are its settings, checked by
their annotations, and those named in DEPENDENCIES are handed in only where it asks for them."""

from __future__ import annotations

import importlib
import inspect
import types
import typing
from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

from .errors import ConfigError, MissingDependency

STAGES = ("loader", "chunker", "embedder", "store", "retriever", "reranker", "query_transform", "llm", "guardrail", "cache", "tracer", "metric", "ocr")
GROUP = "sparkloom.plugins"
DEPENDENCIES = ("spark", "model", "embedder", "store", "cache", "ocr", "index")
_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array", tuple: "array"}


class Registry:
    def __init__(self) -> None:
        self._held: dict[tuple[str, str], Callable | str] = {}
        self._extras: dict[tuple[str, str], str] = {}
        self._looked = False

    def register(self, stage: str, name: str) -> Callable[[Callable], Callable]:
        def add(factory: Callable) -> Callable:
            self._put(stage, name, factory)
            return factory

        return add

    def register_lazy(self, stage: str, name: str, target: str, extra: str = "") -> None:
        """target: "module:name", imported at the first use; extra: what to install where that fails."""
        self._put(stage, name, target)
        self._extras[stage, name] = extra

    def _put(self, stage: str, name: str, what: Callable | str) -> None:
        if stage not in STAGES:
            raise ConfigError(f"no stage {stage}; there are {', '.join(STAGES)}")
        self._held[stage, name] = what

    def names(self, stage: str) -> list[str]:
        self._installed()
        return sorted(n for s, n in self._held if s == stage)

    def _installed(self) -> None:
        """Plug-ins that other packages offer: each entry point is called with this registry, once."""
        if not self._looked:
            self._looked = True
            for point in entry_points(group=GROUP):
                point.load()(self)

    def factory(self, stage: str, name: str) -> Callable:
        self._installed()
        held = self._held.get((stage, name))
        if held is None:
            raise ConfigError(f"no {stage} {name}; there are {', '.join(self.names(stage)) or 'none'}")
        if isinstance(held, str):
            module, _, attribute = held.partition(":")
            try:
                held = getattr(importlib.import_module(module), attribute)
            except ImportError as e:
                raise MissingDependency(str(e.name), self._extras.get((stage, name)) or stage) from e
            self._held[stage, name] = held
        return held

    def create(self, stage: str, name: str, params: dict[str, Any] | None = None, **have: Any) -> Any:
        factory = self.factory(stage, name)
        settings, wanted = _settings(factory), dict(params or {})
        for key, value in wanted.items():
            if key not in settings:
                raise ConfigError(f"{stage} {name} has no setting {key}; it has {', '.join(settings) or 'none'}")
            if not _fits(value, settings[key][0]):
                raise ConfigError(f"{stage} {name}: {key} can't be {value!r}")
        for key, (_, default) in settings.items():
            if default is inspect.Parameter.empty and key not in wanted:
                raise ConfigError(f"{stage} {name} needs {key}")
        asked = [p for p in inspect.signature(factory).parameters if p in DEPENDENCIES]
        return factory(**wanted, **{p: have[p] for p in asked if p in have})

    def settings_schema(self, stage: str, name: str) -> dict:
        """JSON schema of a plug-in's settings."""
        out: dict[str, Any] = {"type": "object", "properties": {}, "additionalProperties": False}
        required = []
        for key, (kind, default) in _settings(self.factory(stage, name)).items():
            union = typing.get_origin(kind) in (typing.Union, types.UnionType)
            first = next(k for k in (typing.get_args(kind) if union else (kind,)) if k is not type(None))
            base = typing.get_origin(first) or first
            base = list if getattr(base, "__name__", "") == "Sequence" else base
            said = {"type": _KINDS[base]} if base in _KINDS else {}
            if default is inspect.Parameter.empty:
                required.append(key)
            elif default is None or isinstance(default, str | int | float | bool | list | tuple | dict):
                said["default"] = list(default) if isinstance(default, tuple) else default
            out["properties"][key] = said
        return out | ({"required": required} if required else {})


def _settings(factory: Callable) -> dict[str, tuple[Any, Any]]:
    try:
        hints = typing.get_type_hints(factory)
    except Exception:  # annotations that can't be resolved here say nothing
        hints = {}
    parameters = inspect.signature(factory).parameters.values()
    return {p.name: (hints.get(p.name, Any), p.default) for p in parameters if p.name not in DEPENDENCIES and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}


def _fits(value: Any, kind: Any) -> bool:
    if kind is Any:
        return True
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        return any(_fits(value, k) for k in typing.get_args(kind))
    base = typing.get_origin(kind) or kind
    if base is type(None) or kind is None:
        return value is None
    if base is float:
        return isinstance(value, int | float) and not isinstance(value, bool)
    if base is int:
        return isinstance(value, int) and not isinstance(value, bool)
    if base in (tuple, list) or getattr(base, "__name__", "") == "Sequence":
        return isinstance(value, list | tuple)
    return isinstance(value, base) if isinstance(base, type) else True


registry = Registry()

_OP, _SRC = "sparkloom.operators", "sparkloom.sources.loaders"
for _name in ("text", "csv", "html", "docx", "pptx", "xlsx", "pdf", "image"):
    registry.register_lazy("loader", _name, f"sparkloom.plugins:loader_{_name}", _name)
for _name in ("fixed", "structure", "parent_child", "semantic"):
    registry.register_lazy("chunker", _name, f"sparkloom.plugins:chunker_{_name}")
for _stage, _names in {
    "embedder": ("hashing",), "store": ("table",), "retriever": ("dense", "sparse", "hybrid", "agentic"), "reranker": ("overlap", "model"), "query_transform": ("condense", "rewrite", "multi_query", "hyde"),
    "llm": ("extractive",), "guardrail": ("pii", "injection", "scope"), "cache": ("memory", "table"), "tracer": ("memory", "logging", "table"), "metric": ("retrieval", "citation", "abstention", "judge"),
}.items():
    for _name in _names:
        registry.register_lazy(_stage, _name, f"sparkloom.plugins:{_stage}_{_name}")
