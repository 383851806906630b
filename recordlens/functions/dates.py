"""Date readings found in the feeds, and date windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_ws

_SLASH = r"^\d{1,2}/\d{1,2}/\d{4}$"


def _reading(col: Column, pattern: str) -> Column:
    text = trim_ws(col)
    return F.when(text.rlike(_SLASH), F.try_to_date(text, pattern))


def slash_date(col: Column) -> Column:
    """Month first where that is a date, else day first, else null."""
    return F.coalesce(_reading(col, "M/d/yyyy"), _reading(col, "d/M/yyyy"))


def is_ambiguous_date(col: Column) -> Column:
    """Both readings are dates and they differ."""
    return F.coalesce(_reading(col, "M/d/yyyy") != _reading(col, "d/M/yyyy"), F.lit(False))


def compact_date(col: Column) -> Column:
    """``yyyyMMdd``; anything else is null."""
    text = trim_ws(col)
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def covers(opened: Column, closed: Column, day: Column) -> Column:
    """The window holds the day; an open end holds every later day."""
    return (day >= opened) & (closed.isNull() | (day <= closed))


def is_stale(last_success: Column, now: Column, interval_hours: int = 24) -> Column:
    """No success yet, or the last one at least one interval ago."""
    limit = last_success + F.make_dt_interval(hours=F.lit(interval_hours))
    return last_success.isNull() | (now >= limit)
