"""Settings in layers: later layers win where they say something."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass
from pathlib import Path

from tessera.operators.repomap import NON_CODE

#: Units of durations, in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(text: str) -> float:
    """Seconds of a duration such as ``500ms`` or ``1h30m``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"{text!r} is no duration")
    return sum(float(a) * UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Config:
    """All settings. None means that a layer does not say."""

    root: str | None = None
    store: str | None = None
    extensions: tuple[str, ...] | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    ignore: tuple[str, ...] | None = None
    ignore_files: tuple[str, ...] | None = None
    max_file_size: int | None = None
    embedding_model: str | None = None
    embedding_width: int | None = None
    query_prefix: str | None = None
    graph: bool | None = None
    non_code: tuple[str, ...] | None = None
    debounce: str | None = None
    poll_interval: str | None = None
    stale_refresh: int | None = None
    reindex_cooldown: str | None = None
    map_tokens: int | None = None

    def merge(self, other: Config) -> Config:
        """``other`` over this: what it says wins. A size below zero means no limit."""
        said = {f.name: v for f in dataclasses.fields(other) if (v := getattr(other, f.name)) is not None}
        return dataclasses.replace(self, **said)

    def checked(self) -> Config:
        for name in ("debounce", "poll_interval", "reindex_cooldown"):
            if (v := getattr(self, name)) is not None:
                duration(v)
        if self.embedding_width is not None and self.embedding_width < 1:
            raise ValueError("embedding_width must be positive")
        if self.stale_refresh is not None and self.stale_refresh < 0:
            raise ValueError("stale_refresh must not be negative")
        return self

    @classmethod
    def of(cls, said: dict) -> Config:
        """From a mapping, as of a file; an unknown key is an error."""
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := sorted(set(said or {}) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in (said or {}).items()})

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON or, where a parser is installed, YAML file; an empty file says nothing."""
        text = Path(path).read_text()
        if not text.strip():
            return cls()
        if path.endswith(".json"):
            import json

            return cls.of(json.loads(text))
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML settings needs a YAML parser") from e
        return cls.of(yaml.safe_load(text) or {})


DEFAULTS = Config(
    extensions=(), include=(), exclude=(), ignore=(), ignore_files=(".gitignore",), max_file_size=1 << 20, embedding_model="hashing", embedding_width=64, graph=True,
    non_code=NON_CODE, debounce="500ms", poll_interval="5s", stale_refresh=10, reindex_cooldown="30s", map_tokens=2000,
)


def layered(*layers: Config) -> Config:
    out = DEFAULTS
    for layer in layers:
        out = out.merge(layer)
    return out.checked()
