"""Project configuration: ``.naming.toml`` files, their ``extends`` chain and new files."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from .presets import NAMES, PRESETS, STARTER

FILE_NAME = ".naming.toml"


class ConfigError(Exception):
    pass


@dataclass
class Context:
    convention: str
    prefix: str | None = None
    suffix: str | None = None


@dataclass
class Config:
    version: int = 1
    name: str = ""
    extends: list[str] | None = None
    convention: str = ""
    immutable: bool | None = None
    singular: bool | None = None
    vectors: dict | None = None
    patterns: dict[str, str] | None = None
    externals: dict | None = None
    packages: dict | None = None
    contexts: dict[str, Context] | None = None
    tags: dict | None = None


def from_dict(data: dict) -> Config:
    """A configuration from parsed TOML; keys that are not known are ignored."""
    for need in ("version", "name"):
        if need not in data:
            raise ConfigError(f"missing field `{need}`")
    known = {k: v for k, v in data.items() if k in Config.__dataclass_fields__ and k not in ("contexts", "vectors", "externals", "tags", "packages")}
    config = Config(**known)
    if "contexts" in data:
        config.contexts = {}
        for name, rule in data["contexts"].items():
            if "convention" not in rule:
                raise ConfigError(f"missing field `convention` in context `{name}`")
            config.contexts[name] = Context(rule["convention"], rule.get("prefix"), rule.get("suffix"))
    if "vectors" in data:
        config.vectors = {"join": "_", "namespace": "__"} | data["vectors"]
    if "externals" in data:
        config.externals = {"preserve_casing": True, "join_with": "_"} | data["externals"]
    if "packages" in data:
        config.packages = {"separator": "", "pattern": ""} | data["packages"]
    if "tags" in data:
        config.tags = {"open": False, "declared": {}} | data["tags"]
    return config


def load(path: str) -> Config:
    """One file, without what it extends."""
    try:
        with open(path, "rb") as f:
            text = f.read().decode()
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"failed to read {path}: {e}") from e
    try:
        return from_dict(tomllib.loads(text))
    except (tomllib.TOMLDecodeError, ConfigError, TypeError) as e:
        raise ConfigError(f"failed to parse {path}: {e}") from e


def merge(target: Config, source: Config) -> Config:
    """``target`` with what ``source`` sets: maps merge by key with whole values, the rest is replaced."""
    if source.convention:
        target.convention = source.convention
    for name in ("immutable", "singular", "vectors", "externals", "packages"):
        if getattr(source, name) is not None:
            setattr(target, name, getattr(source, name))
    for name in ("patterns", "contexts"):
        if getattr(source, name) is not None:
            setattr(target, name, {**(getattr(target, name) or {}), **getattr(source, name)})
    if source.tags is not None:
        declared = (target.tags or {}).get("declared", {})
        target.tags = {"open": source.tags["open"], "declared": {**declared, **source.tags["declared"]}}
    return target


def builtin(name: str) -> Config | None:
    language = NAMES.get(name)
    return from_dict(PRESETS[language]) if language else None


def to_contexts(data: dict) -> list[dict]:
    """Contexts of parsed TOML as plain tables: of each built-in preset that it extends, left to right, then its own."""
    out = []
    for entry in data.get("extends") or []:
        if entry not in NAMES:
            raise ConfigError(f"`{entry}` is no built-in preset")
        out.append(PRESETS[NAMES[entry]].get("contexts", {}))
    return [*out, data.get("contexts", {})]


def resolve(path: str) -> Config:
    """A file merged onto what it extends, left to right; entries are built-in names or paths from its folder.

    What an extended file itself extends is ignored.
    """
    project = load(path)
    if not project.extends:
        return project
    merged = Config()
    for entry in project.extends:
        merged = merge(merged, builtin(entry) or load(os.path.join(os.path.dirname(path), entry)))
    merged = merge(merged, project)
    merged.version, merged.name, merged.extends = project.version, project.name, None
    return merged


def find(start: str) -> str | None:
    """The nearest configuration file in the start folder (a file's own) or above it."""
    here = os.path.dirname(start) if os.path.isfile(start) else start
    while True:
        path = os.path.join(here, FILE_NAME)
        if os.path.isfile(path):
            return path
        parent = os.path.dirname(here.rstrip("/")) if here not in ("", "/") else None
        if parent is None or parent == here:
            return None
        here = parent


def _toml(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def to_toml(data: dict, prefix: str = "") -> str:
    """TOML text of nested tables of plain values."""
    plain = [f"{k} = {_toml(v)}" for k, v in data.items() if not isinstance(v, dict)]
    tables = [(k, v) for k, v in data.items() if isinstance(v, dict)]
    out = "\n".join(plain) + "\n" if plain else ""
    for k, v in tables:
        name = f"{prefix}{k}"
        own = any(not isinstance(x, dict) for x in v.values())
        out += (f"\n[{name}]\n" if own else "") + to_toml(v, name + ".")
    return out


def generate(language: str | None = None, preset: str | None = None) -> str:
    """A new file's text: of the language, else of the preset, else the starter; unknown names give the starter."""
    if language in NAMES and NAMES[language] != "immutable-tag":
        return to_toml(PRESETS[NAMES[language]])
    return to_toml(PRESETS["immutable-tag"] if preset == "immutable-tag" else STARTER)
