"""Driver-side configuration: nested mappings with ${NAME} and ${NAME:default} references."""

from __future__ import annotations

import re
from pathlib import Path

_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")
KINDS = ("codec_roundtrip", "zero_shot", "generate")


class ConfigError(ValueError):
    pass


def read_env(text: str) -> dict[str, str]:
    """NAME=value lines; comments and blank lines are skipped, matching quotes removed."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            name, value = line.split("=", 1)
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out[name.strip()] = value
    return out


def expand(value, env: dict[str, str]):
    """References in all strings of a nested value; an unknown name without default raises."""
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ConfigError(f"unknown variable {m[1]}")
        return m[2]

    return _REFERENCE.sub(one, value)


def load(path: str, env: dict[str, str] | None = None) -> dict:
    """A JSON file, or a YAML file where a parser is installed."""
    import json

    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("no YAML parser is installed; use JSON") from e
        raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    return expand(raw, env or {})


def catalog(folder: str) -> list[str]:
    """Names of the configurations in a folder."""
    return sorted({p.stem for p in Path(folder).glob("*") if p.suffix in (".yaml", ".json")})


def check_backend(raw: dict) -> dict:
    """Required keys of a backend: an interpreter, a script or command, and a model."""
    if not raw.get("python"):
        raise ConfigError("python is required")
    if not raw.get("script") and not raw.get("command"):
        raise ConfigError("script or command is required")
    if not (raw.get("model") or {}).get("path_or_id"):
        raise ConfigError("model.path_or_id is required")
    return raw


def check_cases(cases: list[dict]) -> list[dict]:
    for c in cases:
        if c.get("kind") not in KINDS:
            raise ConfigError(f"unknown kind {c.get('kind')!r}")
    return cases
