"""Date rules of ``dates`` on Python strings."""

from __future__ import annotations

import re

from proofgrid.functions import dates as dt
from proofgrid.functions.rows import Pattern, translated

_plain = lambda rx: re.compile(translated(rx))
RANGE, SINCE, OPEN, YEAR = _plain(dt.RANGE), _plain(dt.SINCE), _plain(f"^(?:{dt.OPEN_END})$"), _plain("\\d{4}")
MONTH_FIRST, YEAR_FIRST = _plain("^(\\d{1,2})\\s*[/.]\\s*(\\d{4})$"), _plain("^(\\d{4})\\s*/\\s*(\\d{1,2})$")
NAMED = _plain(f"^(?:({dt.MONTH_WORD})\\.?\\s+)?(\\d{{4}})$")
UNIT, MONTH = Pattern(dt.QUANTITY_AFTER), Pattern(f"^({dt.MONTH_WORD})\\b")

Month = tuple[int, int | None]


def year_month(token: str) -> Month | None:
    t = token.strip(" ")
    if m := MONTH_FIRST.search(t):
        year, n = int(m[2]), int(m[1])
    elif m := YEAR_FIRST.search(t):
        year, n = int(m[1]), int(m[2])
    elif m := NAMED.search(t):
        return int(m[2]), dt.MONTHS.get(MONTH.first(t))
    else:
        return None
    return year, n if 1 <= n <= 12 else None


def is_open(token: str) -> bool:
    return OPEN.search(token.strip(" ")) is not None


def ordinal(ym: Month | None, default_month: int = dt.DEFAULT_MONTH) -> int | None:
    return None if ym is None else ym[0] * 12 + (default_month if ym[1] is None else ym[1]) - 1


def iso(ym: Month | None) -> str | None:
    return None if ym is None else f"{ym[0]:04d}" if ym[1] is None else f"{ym[0]:04d}-{ym[1]:02d}"


def plausible(start: str, end: str, after: str, last: int) -> bool:
    begins, ends = YEAR.search(start), YEAR.search(end)
    if not begins or not dt.FIRST_YEAR <= int(begins[0]) <= last:
        return False
    return (not ends or dt.FIRST_YEAR <= int(ends[0]) <= last or is_open(end)) and UNIT.search(after) is None


def first_range(folded: str, today: str) -> tuple[str, str] | None:
    """First plausible range (start, end) of a line, or an open range after "since"."""
    if YEAR.search(folded) is None:
        return None
    last = int(today[:4]) + 1
    for m in RANGE.finditer(folded):
        own = RANGE.search(m[0])
        s, e = (own[1], own[2]) if own else ("", "")
        if plausible(s, e, folded[m.end() : m.end() + 24], last):
            return s, e
    since = SINCE.search(folded)
    return (since[1], "present") if since and plausible(since[1], "present", "", last) else None


def dated_to_month(start: Month | None, end: Month | None, current: bool) -> bool:
    return start is not None and start[1] is not None and (current or (end is not None and end[1] is not None))


def duration(start: Month | None, end: Month | None, current: bool, today: str) -> int | None:
    s, e = ordinal(start), dt.today_ordinal(today) if current else ordinal(end)
    if s is None or e is None or e < s:
        return None
    return max(1, e - s + dated_to_month(start, end, current))
