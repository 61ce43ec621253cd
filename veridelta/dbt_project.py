"""Compare a project's models between production and development schemas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .dbt_profile import project_source
from .operators.diff import diff_tables
from .operators.result import DiffResult
from .operators.schema_diff import schema_diff
from .sources.connect import connect


@dataclass(frozen=True)
class Model:
    """What a comparison needs of a model in the manifest."""

    unique_id: str
    name: str
    database: str | None
    schema: str
    alias: str
    meta: dict = field(default_factory=dict)
    columns: dict[str, dict] = field(default_factory=dict)
    materialized: str = "table"

    @property
    def path(self) -> str:
        return ".".join(p for p in (self.database, self.schema, self.alias) if p)


def model_of(node: dict[str, Any]) -> Model:
    if lacking := [k for k in ("unique_id", "name", "schema") if not node.get(k)]:
        raise ValueError(f"a model of the manifest lacks {', '.join(lacking)}")
    config = node.get("config", {})
    return Model(
        node["unique_id"], node["name"], node.get("database"), node["schema"], node.get("alias") or node["name"],
        {**config.get("meta", {}), **node.get("meta", {})}, node.get("columns", {}), config.get("materialized", "table"),
    )


class Project:
    def __init__(self, folder: str | Path, state: str | Path | None = None):
        target = Path(folder) / "target"
        results = target / "run_results.json"
        before = json.loads(Path(state).read_text()) if state else None
        self._take(json.loads((target / "manifest.json").read_text()), json.loads(results.read_text()) if results.exists() else None, before)

    @classmethod
    def of(cls, manifest: dict, results: dict | None = None, before: dict | None = None) -> Project:
        out = cls.__new__(cls)
        out._take(manifest, results, before)
        return out

    def _take(self, manifest: dict, results: dict | None, before: dict | None) -> None:
        self.manifest, self.results, self.before = manifest, results or {"results": []}, before
        for r in self.results["results"]:
            if lacking := {"unique_id", "status"} - set(r):
                raise ValueError(f"a run result lacks {', '.join(sorted(lacking))}")

    def models(self, select: str | None = None) -> list[Model]:
        """The models that the last run built, or those selected by name or pattern;
        tables and incrementals, no views of other kinds."""
        nodes = {k: v for k, v in self.manifest.get("nodes", {}).items() if v.get("resource_type", "model") == "model"}
        if select:
            names = [re.compile("".join(".*" if c == "*" else re.escape(c) for c in s)) for s in select.split()]
            chosen = [v for v in nodes.values() if any(n.fullmatch(v["name"]) for n in names)]
        else:
            built = {r["unique_id"] for r in self.results["results"] if r.get("status") == "success"}
            chosen = [v for k, v in nodes.items() if k in built]
        return [m for m in map(model_of, chosen) if m.materialized != "ephemeral"]

    def production(self, model: Model, database: str | None = None, schema: str | None = None) -> str:
        """Where the model lies in production: in the former manifest, else by the
        given database and schema."""
        if self.before:
            node = self.before.get("nodes", {}).get(model.unique_id)
            if node is None:
                raise ValueError(f"{model.name} is not in the production manifest")
            return model_of(node).path
        vars_ = self.manifest.get("metadata", {}).get("vars", {})
        database = database or vars_.get("prod_database") or model.database
        schema = schema or vars_.get("prod_schema")
        if not schema:
            raise ValueError("give a production schema or a former manifest")
        return ".".join(p for p in (database, schema.replace("<schema>", model.schema), model.alias) if p)

    def primary_key(self, model: Model) -> list[str]:
        """From the model's meta, else its columns' meta or tags, else its uniqueness tests."""
        told = model.meta.get("primary-key") or model.meta.get("primary_key")
        if told:
            return [told] if isinstance(told, str) else list(told)
        by_column = [c for c, v in model.columns.items() if any({**v.get("meta", {}), **v.get("config", {}).get("meta", {})}.get(k) for k in ("primary-key", "primary_key"))]
        by_column = by_column or [c for c, v in model.columns.items() if {"primary-key", "primary_key"} & set(v.get("tags", []))]
        if by_column:
            return by_column
        for node in self.manifest.get("nodes", {}).values():
            test = node.get("test_metadata")
            if node.get("resource_type") != "test" or not test or model.unique_id not in node.get("depends_on", {}).get("nodes", []):
                continue
            args = test.get("kwargs", {})
            if test["name"] == "unique_combination_of_columns":
                return list(args["combination_of_columns"])
            if test["name"] == "unique":
                return unique_columns(args.get("column_name", ""))
        return []


def unique_columns(expression: str) -> list[str]:
    """Columns of ``a``, ``concat(a, b)`` or ``a || '-' || b``."""
    inner = re.fullmatch(r"\s*concat\((.*)\)\s*", expression, re.I | re.S)
    parts = re.split(r",", inner[1]) if inner else expression.split("||")
    names = [re.sub(r"^coalesce\((.*)$", r"\1", p.strip(), flags=re.I).strip(" )`\"") for p in parts]
    return [n for n in names if n and not n.startswith("'")]


def summary(found: dict[str, list], result: DiffResult | None, keys: list[str]) -> str:
    lines = []
    for what, label in (("added", "Columns added"), ("removed", "Columns removed"), ("changed", "Types changed")):
        if found[what]:
            lines.append(f"{label}: {', '.join(c if isinstance(c, str) else f'{c[0]} ({c[1]} -> {c[2]})' for c in found[what])}")
    if result is None:
        return "\n".join([*lines, "no primary key is known: rows are not compared"])
    s = result.stats
    width = max(len(str(v)) for v in (s["rows_A"], s["rows_B"]))
    lines += [
        f"Primary key: {', '.join(keys)}",
        f"rows       PROD {s['rows_A']:>{width}}   DEV {s['rows_B']:>{width}}",
        f"added      {s['exclusive_B']}",
        f"removed    {s['exclusive_A']}",
        f"updated    {s['updated']}",
        f"unchanged  {s['unchanged']}",
    ]
    counts = {k: v for k, v in (s["stats"].get("columns_changed") or {}).items() if v}
    lines += [f"  {c}: {n} values changed" for c, n in counts.items()]
    return "\n".join(lines if s["total"] or any(found.values()) else [*lines, "No row differences"])


def diff_models(spark: SparkSession, o: dict) -> Iterator[tuple[str, str]]:
    """(model, summary) for each model, several at a time (``threads``). Tables are read
    from the profile's source where a profiles folder is given, else from the session's
    catalog."""
    folder = o.get("dbt_project_dir") or "."
    project = Project(folder, o.get("state"))
    source = connect(spark, project_source(folder, o["dbt_profiles_dir"]) if o.get("dbt_profiles_dir") else {"driver": "spark"})

    def one(model: Model) -> tuple[str, str]:
        prod = project.production(model, o.get("prod_database"), o.get("prod_schema"))
        if not source.has_table(prod):
            return model.name, f"{prod} does not exist: a new model"
        a, b = source.table(prod), source.table(model.path)
        found, keys = schema_diff(a, b), project.primary_key(model)
        changed = {c for c, *_ in found["changed"]}
        include, exclude = model.meta.get("include_columns"), set(model.meta.get("exclude_columns", []))
        columns = [c for c in a.columns if c in b.columns and c not in changed | exclude | set(keys) and (not include or c in include)]
        result = None
        if keys and set(keys) <= set(a.columns) & set(b.columns):
            result = diff_tables(a, b, key_columns=tuple(keys), extra_columns=tuple(columns), where=model.meta.get("filter"), algorithm="joindiff", skip_null_keys=True)
            result.extra["columns_changed"] = column_changes(result)
        return model.name, summary(found, result, keys)

    at_once = o.get("threads")
    with ThreadPoolExecutor(int(at_once) if str(at_once or "").isdigit() else 1 if at_once == "serial" else 4) as pool:
        yield from pool.map(one, project.models(o.get("select")))


def column_changes(result: DiffResult) -> dict[str, int]:
    """Changed values of each column among rows that both sides have."""
    from pyspark.sql import functions as F

    differ = result.sources
    both = differ.joined.filter("is_exclusive_a = 0 and is_exclusive_b = 0")
    names = [c for c in differ.names if c not in differ.key_names]
    if not names:
        return {}
    return {k: int(v or 0) for k, v in both.agg(*(F.sum(f"`is_diff_{c}`").alias(c) for c in names)).first().asDict().items()}
