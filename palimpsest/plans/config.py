"""Configuration on the driver: mappings that inherit from base files, and dotted overrides. Names are looked up, never evaluated."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """base with over's values; mappings are merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parsed(text: str) -> Any:
    try:
        import yaml

        return yaml.safe_load(text)
    except ModuleNotFoundError:
        return json.loads(text)


def load(path: str | Path) -> dict:
    """A YAML (or JSON) file over the files that its _BASE_ list names, relative to it."""
    path = Path(path)
    own = _parsed(path.read_text(encoding="utf-8")) or {}
    bases = own.pop("_BASE_", [])
    out: dict = {}
    for base in [bases] if isinstance(bases, str) else bases:
        out = merged(out, load(path.parent / base))
    return merged(out, own)


def override(config: dict, pairs: list[str]) -> dict:
    """config with `a.b=value` pairs; values are read as JSON or YAML, else as text."""
    for pair in pairs:
        key, _, raw = pair.partition("=")
        try:
            value = _parsed(raw)
        except ValueError:
            value = raw
        for part in reversed(key.split(".")):
            value = {part: value}
        config = merged(config, value)
    return config


@dataclass(frozen=True)
class Settings:
    """Parameters of the video and image pipelines, at the values the command line has."""

    drop_score: float = 0.9
    roi: str | None = "0.1,0.6,0.9,0.97"
    size_least: tuple[float, float] = (0.02, 0.02)
    size_most: tuple[float, float] = (0.9, 0.09)
    line_y: float = 0.5
    line_gap: float = 0.3
    overlap: float = 0.5
    alike: float = 0.8
    sec_skip: float = 0.5
    segment_sec: float = 120.0
    sampler: str = "segmented"
    skip_logos: bool = True
    min_interval: float = 5.0  # accepted for compatibility; nothing reads it

    @classmethod
    def of(cls, config: dict) -> Settings:
        return cls(**{f.name: config[f.name] for f in fields(cls) if f.name in config})


class Registry:
    """Named steps DataFrame -> DataFrame; chain() applies a list of {name: parameters}."""

    def __init__(self):
        self._steps: dict[str, Callable] = {}

    def register(self, step: Callable, name: str | None = None) -> Callable:
        self._steps[name or step.__name__] = step
        return step

    def chain(self, df, steps: list[dict]):
        for step in steps:
            ((name, params),) = step.items()
            if name not in self._steps:
                raise KeyError(f"no step {name}; there are {sorted(self._steps)}")
            df = self._steps[name](df, **(params or {}))
        return df
