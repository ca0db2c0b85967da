"""Settings from a JSON file, with ${NAME} taken from the environment."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from .errors import ConfigError


def substituted(value, env=os.environ):
    if isinstance(value, dict):
        return {k: substituted(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] not in env:
            raise ConfigError(f"the environment has no {m[1]}")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", one, value)


def raw(path: str) -> dict:
    """The settings as they stand in the file."""
    file = Path(path)
    if not file.exists():
        raise ConfigError(f"no file {path}")
    try:
        found = json.loads(file.read_text())
    except ValueError as problem:
        raise ConfigError(f"{path} isn't JSON: {problem}") from problem
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no object")
    return found


def load(path: str, env=os.environ) -> dict:
    return substituted(raw(path), env)


def save(path: str, settings: dict) -> None:
    """Writes the settings as JSON; references to the environment stay references."""
    Path(path).write_text(json.dumps(settings, indent=2, ensure_ascii=False) + "\n")


def put(settings: dict, dotted: str, value) -> dict:
    """A copy with one setting changed, as in put(s, "data.dir", "/x")."""
    head, _, rest = dotted.partition(".")
    return settings | {head: put(settings.get(head) or {}, rest, value) if rest else value}


def masked(settings: dict) -> dict:
    """For display: tokens show their last four signs only."""
    return {k: masked(v) if isinstance(v, dict) else "*" * 8 + str(v)[-4:] if "token" in k and v else v for k, v in settings.items()}
