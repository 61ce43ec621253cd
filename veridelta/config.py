"""TOML configuration: named databases and runs."""

from __future__ import annotations

import os
import re
import tomllib
from typing import Any

from .errors import ConfigError


def substituted(value: Any) -> Any:
    """``${NAME}`` from the environment; nothing where it is unset."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: substituted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v) for v in value]
    return value


def run_options(text: str, run: str | None = None, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """Options of a run: its own over the default's, ``given`` over both; a database
    named by an option becomes its settings."""
    try:
        whole = substituted(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    runs = whole.get("run", {})
    out = dict(runs.get("default", {}))
    if run is not None:
        if run not in runs:
            raise ConfigError(f"no run {run!r}; there are {', '.join(runs) or 'none'}")
        out |= runs[run]
    for side in ("1", "2"):
        if isinstance(part := out.pop(side, None), dict):
            out |= {f"{k}{side}": v for k, v in part.items() if k != "threads"}
    out |= {k: v for k, v in (given or {}).items() if v is not None}
    databases = whole.get("database", {})
    for k in ("database1", "database2"):
        if isinstance(out.get(k), str) and "://" not in out[k]:
            if out[k] not in databases:
                raise ConfigError(f"no database {out[k]!r}")
            out[k] = databases[out[k]]
    return out
