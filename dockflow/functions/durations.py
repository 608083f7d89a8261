"""Duration texts such as ``"30m"`` or ``"2h10m"`` and date arithmetic on wall-clock columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {"y": 12, "q": 3, "mo": 1}
_MICROS = {
    "w": 7 * 86_400_000_000,
    "d": 86_400_000_000,
    "h": 3_600_000_000,
    "m": 60_000_000,
    "s": 1_000_000,
    "ms": 1_000,
    "us": 1,
}
_PART = re.compile(r"(\d+)(mo|ms|us|ns|[yqwdhms])")


def parse_duration(text: str) -> tuple[int, int]:
    """``text`` as (calendar months, microseconds); a leading ``-`` turns the whole duration round."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    months = sum(int(n) * _MONTHS[u] for n, u in parts if u in _MONTHS)
    micros = sum(int(n) * _MICROS[u] for n, u in parts if u in _MICROS)
    micros += sum(int(n) for n, u in parts if u == "ns") // 1000
    return sign * months, sign * micros


def duration_seconds(text: str) -> int:
    """A fixed-length duration in whole seconds."""
    months, micros = parse_duration(text)
    if months or micros <= 0 or micros % 1_000_000:
        raise ValueError(f"need a positive number of whole seconds: {text!r}")
    return micros // 1_000_000


def interval_text(text: str) -> str:
    """A fixed-length duration in the form ``F.window`` takes."""
    return f"{duration_seconds(text)} seconds"


def offset_by(column: Column | str, text: str) -> Column:
    """``column`` moved by a duration. Months keep the day and clamp to the month's end."""
    moved = F.col(column) if isinstance(column, str) else column
    months, micros = parse_duration(text)
    if months:
        moved = moved + F.make_ym_interval(F.lit(0), F.lit(months))
    if micros:
        seconds = F.lit(f"{micros / 1_000_000:.6f}").cast("decimal(18,6)")
        moved = moved + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return moved


def wall_seconds(column: Column | str) -> Column:
    """Whole seconds since 1970-01-01 on the wall clock, whatever the session's time zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
