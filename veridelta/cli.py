"""Command line: veridelta DB1 TABLE1 [DB2] TABLE2 -k KEY -c COLUMN..."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.ages import before
from .operators.diff import diff_tables
from .operators.hashdiff import DEFAULT_FACTOR, DEFAULT_THRESHOLD
from .operators.result import json_error
from .operators.schema_diff import expand, schema_diff
from .operators.segment import Segment
from .sources.connect import connect, redacted
from .sources.pushdown import FORMS, remote_table

VERSION = "0.1.0"
log = logging.getLogger("veridelta")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("veridelta", description=__doc__)
    p.add_argument("places", nargs="*", help="DB1 TABLE1 TABLE2, or DB1 TABLE1 DB2 TABLE2")
    p.add_argument("-k", "--key-columns", action="append")
    p.add_argument("-t", "--update-column")
    p.add_argument("-c", "--columns", action="append", default=None, help="more columns; %% and ? are wildcards")
    p.add_argument("-l", "--limit", type=int)
    p.add_argument("--bisection-factor", type=int)
    p.add_argument("--bisection-threshold", type=int)
    p.add_argument("-m", "--materialize-to-table")
    p.add_argument("--min-age", help="only rows older than this, as in 5min")
    p.add_argument("--max-age")
    p.add_argument("-s", "--stats", action="store_true", default=None)
    p.add_argument("-d", "--debug", action="store_true", default=None)
    p.add_argument("--json", action="store_true", default=None, dest="json_output")
    p.add_argument("-v", "--verbose", action="store_true", default=None)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("-i", "--interactive", action="store_true", default=None)
    p.add_argument("--case-sensitive", action="store_true", default=None)
    p.add_argument("--assume-unique-key", action="store_true", default=None)
    p.add_argument("--sample-exclusive-rows", action="store_true", default=None)
    p.add_argument("--materialize-all-rows", action="store_true", default=None)
    p.add_argument("--table-write-limit", type=int)
    p.add_argument("-j", "--threads", help="partitions of a shuffle, or 'serial'")
    p.add_argument("-w", "--where")
    p.add_argument("-a", "--algorithm", choices=("auto", "joindiff", "hashdiff", "rangediff"))
    p.add_argument("--conf")
    p.add_argument("--run")
    p.add_argument("--dbt", action="store_true", default=None)
    p.add_argument("--dbt-project-dir")
    p.add_argument("--dbt-profiles-dir")
    p.add_argument("--select")
    p.add_argument("--state")
    p.add_argument("-pd", "--prod-database")
    p.add_argument("-ps", "--prod-schema")
    return p


def threads(text: str | None) -> int | None:
    if text is None:
        return None
    if text == "serial":
        return 1
    if not text.isdigit() or int(text) < 1:
        raise ValueError("-j takes a number from 1, or 'serial'")
    return int(text)


def options(argv: list[str]) -> dict:
    given = vars(parser().parse_args(argv))
    places = given.pop("places")
    if len(places) == 3:
        places = [places[0], places[1], places[0], places[2]]
    if places and len(places) != 4:
        raise ValueError("give DB1 TABLE1 TABLE2, or DB1 TABLE1 DB2 TABLE2")
    given |= dict(zip(("database1", "table1", "database2", "table2"), places))
    conf, run = given.pop("conf"), given.pop("run")
    return config.run_options(Path(conf).read_text() if conf else "", run, given)


def run(spark: SparkSession, o: dict, out=print) -> int:
    if o.get("dbt"):
        from .dbt_project import diff_models

        for name, text in diff_models(spark, o):
            out(f"{name}\n{text}\n")
        return 0
    if o.get("limit") is not None and o.get("stats"):
        raise ValueError("--limit and --stats exclude each other")
    if (n := threads(o.get("threads"))) is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    sources = [connect(spark, o["database1"]), connect(spark, o["database2"])]
    log.info("comparing %s and %s", *(redacted(o[k]) for k in ("database1", "database2")))
    tables = [s.table(o[f"table{i}"]) for i, s in enumerate(sources, 1)]
    keys = o.get("key_columns") or ["id"]
    update = o.get("update_column")
    extras = expand(o.get("columns") or [], *tables, skip={*keys, update})
    for what, names in schema_diff(*tables, bool(o.get("case_sensitive"))).items():
        if names:
            log.warning("schemas differ: %s %s", what, names)
    bounds = {}
    if o.get("min_age") or o.get("max_age"):
        now: datetime = spark.range(1).select(F.current_timestamp()).first()[0]
        bounds = {b: before(now, o[a]) for a, b in (("min_age", "max_update"), ("max_age", "min_update")) if o.get(a)}
    sides = [
        Segment(t, tuple(keys), update, tuple(extras), where=o.get("where"), case_sensitive=bool(o.get("case_sensitive")), **bounds) for t in tables
    ]
    result = diff_tables(
        *sides,
        algorithm=o.get("algorithm") or "auto",
        remote=sources[0] is not sources[1],
        remote_tables=tuple(remote_table(s, o[f"table{i}"]) if s.kind in FORMS else None for i, s in enumerate(sources, 1)),
        bisection_factor=o.get("bisection_factor") or DEFAULT_FACTOR,
        bisection_threshold=o.get("bisection_threshold") or DEFAULT_THRESHOLD,
        validate_unique_key=not o.get("assume_unique_key"),
        sample_exclusive_rows=bool(o.get("sample_exclusive_rows")),
        materialize_to_table=o.get("materialize_to_table"),
        materialize_all_rows=bool(o.get("materialize_all_rows")),
        table_write_limit=o.get("table_write_limit", 1000),
    )
    if o.get("interactive"):
        result.df.explain("formatted")
        if input("Run it? [y/n] ").strip().lower() != "y":
            return 1
    if o.get("stats"):
        out(json.dumps(result.stats, default=str) if o.get("json_output") else result.text_stats())
        return 0
    if o.get("limit") is not None:
        result.df = result.ordered().limit(o["limit"])
    if o.get("json_output"):
        for row in result.json_lines().toLocalIterator():
            out(row["value"])
    else:
        for line in result.text_rows(colour=sys.stdout.isatty()):
            out(line)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    wants_json = "--json" in argv
    try:
        o = options(argv)
        logging.basicConfig(level=logging.DEBUG if o.get("debug") else logging.INFO if o.get("verbose") else logging.WARNING)
        return run(SparkSession.builder.appName("veridelta").getOrCreate(), o)
    except Exception as e:
        if wants_json:
            print(json.dumps(json_error(e)))
        else:
            print(f"error: {e}", file=sys.stderr)
        if "-d" in argv or "--debug" in argv:
            raise
        return 1


if __name__ == "__main__":
    sys.exit(main())
