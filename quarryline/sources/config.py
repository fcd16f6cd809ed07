"""Settings: defaults, then a file, then the environment, then what is given."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path


def _merged(low: dict, high: Mapping) -> dict:
    """Sections are merged, other values replaced; a None above leaves what is below."""
    out = dict(low)
    for key, value in high.items():
        if isinstance(value, Mapping) and isinstance(out.get(key), dict):
            out[key] = _merged(out[key], value)
        elif value is not None:
            out[key] = value
    return out


def _typed(text: str, like):
    """Text of the environment as the kind of value it replaces; lists are split at commas."""
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)):
        return type(like)(text)
    return [x.strip() for x in text.split(",") if x.strip()] if isinstance(like, list) else text


def from_environment(defaults: dict, prefix: str, environment: Mapping[str, str]) -> dict:
    """Values of ``<PREFIX>_<SECTION>_<KEY>`` for the settings that have a default."""
    out: dict = {}
    for key, value in defaults.items():
        name = f"{prefix}_{key}".upper()
        if isinstance(value, dict):
            if inner := from_environment(value, name, environment):
                out[key] = inner
        elif name in environment:
            out[key] = _typed(environment[name], value)
    return out


def env_file(text: str) -> dict[str, str]:
    """``KEY=value`` lines; comments, ``export`` and quotes around a value are left out."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and key.strip() and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


def yaml_section(text: str, section: str) -> dict:
    """Scalars and lists of one section of a plain YAML file; an optional package reads what is more."""
    try:
        import yaml
    except ImportError:
        out: dict = {}
        inside, last = False, None
        for line in text.splitlines():
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            if not bare[0].isspace():
                inside = bare == f"{section}:"
            elif inside and bare.lstrip().startswith("- ") and last:
                out[last] = [*(out[last] or []), bare.lstrip()[2:].strip("\"' ")]
            elif inside and ":" in bare:
                last, _, value = bare.strip().partition(":")
                out[last] = value.strip().strip("\"'") or None
        return out
    return (yaml.safe_load(text) or {}).get(section) or {}


def load(defaults: dict, path: str | None = None, prefix: str = "QUARRYLINE", given: Mapping | None = None, environment: Mapping[str, str] | None = None) -> dict:
    """All settings. ``path`` is a TOML file, and may be missing; beside it a ``.env`` file counts as environment, below the real one."""
    out = dict(defaults)
    files: dict[str, str] = {}
    if path and (file := Path(path)).exists():
        out = _merged(out, tomllib.loads(file.read_text(encoding="utf-8")))
        if (extra := file.parent / ".env").exists():
            files = env_file(extra.read_text(encoding="utf-8"))
    seen = {**files, **(os.environ if environment is None else environment)}
    return _merged(_merged(out, from_environment(defaults, prefix, seen)), given or {})
