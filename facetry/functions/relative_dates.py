"""Relative dates such as 'last 7 days' as conditions on a column."""

from __future__ import annotations

import re

_UNITS = ("day", "week", "month", "quarter", "year")
_PHRASE = re.compile(r"(last|this|next)\s+(?:(\d+)\s+)?(day|week|month|quarter|year)s?$", re.IGNORECASE)
_FILTER = re.compile(r"^\s*(?P<col>[\w.]+)\s*(?P<op>=|!=|<>|>=|<=|>|<)\s*'(?P<value>[^']+)'\s*$")


def _shift(start: str, n: int, unit: str) -> str:
    if unit == "day":
        return f"date_add({start}, {n})"
    if unit == "week":
        return f"date_add({start}, {7 * n})"
    months = {"month": 1, "quarter": 3, "year": 12}[unit] * n
    return f"add_months({start}, {months})"


def point(phrase: str) -> str | None:
    """The day that a relative date stands for beside <, <=, > and >=; None if it is none."""
    phrase = phrase.strip().lower()
    today = "current_date()"
    named = {"today": 0, "yesterday": -1, "tomorrow": 1}
    if phrase in named:
        return _shift(today, named[phrase], "day") if named[phrase] else today
    found = _PHRASE.match(phrase)
    if not found:
        return None
    which, count, unit = found[1], found[2], found[3]
    if count and unit in ("day", "week"):
        return None if which == "this" else _shift(today, int(count) * (1 if which == "next" else -1), unit)
    if (count and which != "last") or (unit == "day" and not count):
        return None
    start = f"cast(date_trunc('{unit}', {today}) as date)"
    n = {"last": -int(count or 1), "this": 0, "next": 1}[which]
    return _shift(start, n, unit) if n else start


def period(phrase: str) -> tuple[str, str | None] | None:
    """(first day, day after the last, None if open) of a relative date as SQL; None if it is none.

    'last 7 days' starts so many days ago and is open; 'next 7 days' is today and so many days
    more; months, quarters and years are whole ones: 'last 3 months' ends with the last month."""
    phrase = phrase.strip().lower()
    day = point(phrase)
    if day is None:
        return None
    found = _PHRASE.match(phrase)
    if not found:
        return day, f"date_add({day}, 1)"
    which, count, unit = found[1], found[2], found[3]
    if count and unit in ("day", "week"):
        return (day, None) if which == "last" else ("current_date()", f"date_add({day}, 1)")
    return day, _shift(day, int(count or 1), unit)


def expand(text: str) -> str:
    """A filter whose value is a relative date becomes a range, or a comparison with its day; any other stays."""
    m = _FILTER.match(text)
    span = m and period(m["value"])
    if not span:
        return text
    column, (start, end) = m["col"], span
    inside = f"{column} >= {start}" + (f" AND {column} < {end}" if end else "")
    return {"=": f"({inside})", "!=": f"NOT ({inside})", "<>": f"NOT ({inside})"}.get(m["op"], f"{column} {m['op']} {point(m['value'])}")
