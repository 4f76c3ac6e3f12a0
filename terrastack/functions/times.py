"""Days and time ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def solar_day(instant: Column, lon: Column) -> Column:
    """Date of an instant at a longitude: shifted by whole hours of lon / 15, cut towards zero."""
    return F.to_date(instant + F.make_dt_interval(F.lit(0), (lon / 15).cast("int")))


def item_instant(dt_: Column, start: Column, end: Column) -> Column:
    """An item's time: its own, else the start, else the end of its range."""
    return F.coalesce(dt_, start, end)


def parse_range(text: str) -> tuple[dt.date | None, dt.date | None]:
    """``a/b`` with ``..`` or nothing for an open end; one instant is both ends. Days are the first ten characters."""
    first, slash, last = text.partition("/")
    ends = [first, last if slash else first]
    return tuple(None if e in ("", "..") else dt.date.fromisoformat(e[:10]) for e in ends)  # type: ignore[return-value]


def within(instant: Column, text: str) -> Column:
    """Whether an instant's day lies in a range as of ``parse_range``; open ends add no condition."""
    lo, hi = parse_range(text)
    day = F.to_date(instant)
    terms = [day >= F.lit(lo)] * (lo is not None) + [day <= F.lit(hi)] * (hi is not None)
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def request_range(start: str | None, end: str | None) -> tuple[str, str] | None:
    """Full days for a footprint request; an open end becomes a far one; nothing given asks for all times."""
    if start is None and end is None:
        return None
    return f"{start or '1900-01-01'}T00:00:00Z", f"{end or '2100-01-01'}T23:59:59Z"
