"""Settings of the engine, from a TOML file or by default."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Watch:
    """Folders and files whose changes are events, and the log of conversations."""

    paths: tuple[str, ...] = (".",)
    extensions: tuple[str, ...] = ("rs", "ts", "js", "py", "md", "toml", "json", "yaml")
    ignore: tuple[str, ...] = ("target/", "node_modules/", ".git/objects/", ".git/logs/", "*.lock")
    debounce_ms: int = 500
    conversations: bool = True
    conversations_folder: str = ""


@dataclass(frozen=True)
class Intake:
    batch_interval_secs: int = 5
    importance_threshold: float = 0.4
    dedup_threshold: float = 0.92


@dataclass(frozen=True)
class Retention:
    days: int = 30
    importance: float = 0.5


@dataclass(frozen=True)
class Output:
    """Where memories are kept and written to besides; an empty folder or address is none."""

    tables: str = "memories"
    memory_files: bool = True
    memory_folder: str = ""
    vault_files: bool = False
    vault_folder: str = ""
    service: bool = False
    service_url: str = ""
    service_key: str = ""


@dataclass(frozen=True)
class Config:
    watch: Watch = field(default_factory=Watch)
    intake: Intake = field(default_factory=Intake)
    retention: Retention = field(default_factory=Retention)
    output: Output = field(default_factory=Output)


def _filled(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    made = {}
    for name, value in values.items():
        default = getattr(kind(), name)
        made[name] = _filled(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(value, list) else value
    return kind(**made)


def load(path: str | None = None) -> Config:
    """Settings of a file; what it leaves out keeps its default."""
    if path is None:
        return Config()
    with open(path, "rb") as file:
        return _filled(Config, tomllib.load(file))


def save(config: Config, path: str) -> None:
    """Write all settings as TOML, to be loaded again."""

    def text(value: Any) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return "[" + ", ".join(map(text, value)) + "]" if isinstance(value, tuple) else json.dumps(value, ensure_ascii=False)

    with open(path, "w", encoding="utf-8") as file:
        for part in fields(config):
            own = getattr(config, part.name)
            file.write(f"[{part.name}]\n" + "".join(f"{f.name} = {text(getattr(own, f.name))}\n" for f in fields(own)) + "\n")
