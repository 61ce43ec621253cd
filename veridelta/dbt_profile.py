"""Where a project's tables lie: the profile's credentials as a source for ``connect``."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any

from .errors import ConnectError

#: Adapter: source, and for each of its settings the credentials that give it.
ADAPTERS: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = {
    "postgres": ("postgresql", {"host": ("host",), "port": ("port",), "database": ("dbname", "database"), "user": ("user",), "password": ("password", "pass")}),
    "redshift": ("redshift", {"host": ("host",), "port": ("port",), "database": ("dbname", "database"), "user": ("user",), "password": ("password", "pass")}),
    "snowflake": (
        "snowflake",
        {
            "host": ("account",), "database": ("database",), "schema": ("schema",), "warehouse": ("warehouse",), "role": ("role",), "user": ("user",),
            "password": ("password",), "authenticator": ("authenticator",), "private_key_file": ("private_key_path",), "private_key_file_pwd": ("private_key_passphrase",),
        },
    ),
    "bigquery": ("bigquery", {"host": ("project", "database"), "dataset": ("dataset", "schema"), "OAuthPvtKeyPath": ("keyfile",), "ServiceAccountImpersonationTarget": ("impersonate_service_account",)}),
    "databricks": ("databricks", {"host": ("host",), "path": ("http_path",), "catalog": ("catalog", "database"), "schema": ("schema",), "PWD": ("token",)}),
    "duckdb": ("duckdb", {"file": ("path",)}),
    "spark": ("spark", {}),
}
#: Settings that are options of the driver, not parts of the address.
OPTIONS = {"role", "authenticator", "private_key_file", "private_key_file_pwd", "OAuthPvtKeyPath", "ServiceAccountImpersonationTarget", "PWD"}
_ENV = re.compile(r"""\{\{\s*env_var\(\s*['"]([^'"]+)['"]\s*(?:,\s*['"]([^'"]*)['"]\s*)?\)\s*(?:\|\s*\w+\s*)?\}\}""")


def rendered(value: Any) -> Any:
    """``env_var`` calls filled in; one that is neither set nor has a default fails."""
    if isinstance(value, dict):
        return {k: rendered(v) for k, v in value.items()}
    if not isinstance(value, str):
        return value

    def fill(m: re.Match) -> str:
        got = os.environ.get(m[1], m[2])
        if got is None:
            raise ConnectError(f"the profile needs the environment variable {m[1]}")
        return got

    return _ENV.sub(fill, value)


def credentials(profiles: dict, name: str, target: str | None = None) -> dict[str, Any]:
    """The credentials of a profile's target."""
    if name not in profiles:
        raise ConnectError(f"no profile {name!r}")
    profile = rendered(profiles[name])
    target = target or profile.get("target", "default")
    outputs = profile.get("outputs") or {}
    if target not in outputs:
        raise ConnectError(f"profile {name!r} has no target {target!r}")
    return outputs[target]


def source_of(given: dict[str, Any]) -> dict[str, Any]:
    """Credentials as what ``connect`` takes."""
    kind = str(given.get("type", "")).lower()
    if kind not in ADAPTERS:
        raise ConnectError(f"no source for the adapter {kind!r}; known: {', '.join(ADAPTERS)}")
    driver, fields = ADAPTERS[kind]
    if kind == "snowflake":
        ways = [k for k in ("password", "private_key_path", "authenticator") if given.get(k)]
        if {"password", "private_key_path"} <= set(ways):
            raise ConnectError("give a password or a key, not both")
        if not ways:
            raise ConnectError("a password, a key or an authenticator is needed")
    if kind == "bigquery" and given.get("method") not in ("oauth", "service-account"):
        raise ConnectError("the method must be oauth or service-account")
    if kind == "redshift" and (given.get("method") == "iam" or not (given.get("password") or given.get("pass"))):
        raise ConnectError("only a password opens this source")
    out: dict[str, Any] = {"driver": driver}
    for setting, names in fields.items():
        value = next((given[n] for n in names if given.get(n) not in (None, "")), None)
        if value is not None and not (setting == "OAuthPvtKeyPath" and given.get("method") != "service-account"):
            out[setting] = value
    return out


def project_source(folder: str | Path, profiles_folder: str | Path | None = None, profile: str | None = None, target: str | None = None) -> dict[str, Any]:
    """The source of a project's profile: ``profiles.yml`` of the given folder, else of
    the project's, else of the home directory's."""
    import yaml

    project = yaml.safe_load((Path(folder) / "dbt_project.yml").read_text())
    places = [Path(profiles_folder)] if profiles_folder else [Path(folder), Path.home() / ".dbt"]
    found = next((p / "profiles.yml" for p in places if (p / "profiles.yml").exists()), None)
    if found is None:
        raise ConnectError(f"no profiles.yml in {', '.join(map(str, places))}")
    return source_of(credentials(yaml.safe_load(found.read_text()), profile or project.get("profile", "default"), target))
