"""Relative ages such as ``5min`` or ``1w2d3h``."""

from __future__ import annotations

import difflib
import re
from datetime import datetime, timedelta

from veridelta.errors import AgeError

_DAY = 86_400
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": _DAY, "week": 7 * _DAY, "month": 30 * _DAY, "year": 365 * _DAY}
_NAMES = {
    "second": ("s", "sec", "secs", "seconds"),
    "minute": ("min", "mins", "minutes"),
    "hour": ("h", "hr", "hours"),
    "day": ("d", "days"),
    "week": ("w", "weeks"),
    "month": ("mon", "months"),
    "year": ("y", "years"),
}
_BY_NAME = {n: unit for unit, names in _NAMES.items() for n in (unit, *names)}


def age(text: str) -> timedelta:
    parts = re.findall(r"\s*(\d+)\s*([a-zA-Z]+)", text)
    if not parts or re.sub(r"\s*\d+\s*[a-zA-Z]+", "", text).strip():
        raise AgeError(f"{text!r} is no age: give numbers with units, as in 5min or 1d12h")
    total, seen = 0, set()
    for amount, name in parts:
        unit = _BY_NAME.get(name.lower())
        if unit is None:
            near = difflib.get_close_matches(name.lower(), _BY_NAME, 1)
            raise AgeError(f"unknown unit {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        if unit in seen:
            raise AgeError(f"{unit} is given twice in {text!r}")
        seen.add(unit)
        total += int(amount) * _UNITS[unit]
    return timedelta(seconds=total)


def before(now: datetime, text: str) -> datetime:
    return now - age(text)
