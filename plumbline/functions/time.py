"""Decimal years, mixed-precision dates and publication cycles, all in UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _year_start(year: Column) -> Column:
    one = F.lit(1)
    return F.unix_micros(F.make_timestamp(year, one, one, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))


def decyear(t: Column) -> Column:
    """Year and the elapsed part of it, exact in leap years."""
    stamp = t.cast("timestamp")
    year = F.year(stamp)
    begin, end = _year_start(year), _year_start(year + 1)
    return year + (F.unix_micros(stamp) - begin) / (end - begin)


def decyear_inv(y: Column) -> Column:
    """The timestamp of a decimal year, to the microsecond."""
    year = F.floor(y).cast("int")
    begin, end = _year_start(year), _year_start(year + 1)
    return F.timestamp_micros((begin + F.round((y - year) * (end - begin))).cast("long"))


def mixed_date(s: Column) -> Column:
    """YYYYMMDD, YYYYMM (its first day) or YYYY (2 July, mid-year); anything else is null."""
    t = F.trim(s)
    n = F.length(t)
    parse = lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd"))
    return F.when(n == 8, parse(t)).when(n == 6, parse(F.concat(t, F.lit("01")))).when(n == 4, parse(F.concat(t, F.lit("0702"))))


CYCLE_ANCHOR, CYCLE_DAYS = dt.date(2022, 12, 1), 28


def cycle_date(day: Column) -> Column:
    """The latest 28-day publication date on or before a day."""
    anchor = F.lit(CYCLE_ANCHOR)
    whole = F.floor(F.datediff(day.cast("date"), anchor) / CYCLE_DAYS).cast("int")
    return F.date_add(anchor, whole * CYCLE_DAYS)


def short_date(s: Column) -> Column:
    """YYMMMDD such as 17NOV10; years 69 to 99 lie in the last century."""
    t = F.trim(s)
    year = F.substring(t, 1, 2).try_cast("int")
    full = F.concat(F.when(year >= 69, F.lit("19")).otherwise(F.lit("20")), F.substring(t, 1, 2), F.initcap(F.substring(t, 3, 3)), F.substring(t, 6, 2))
    return F.try_to_timestamp(full, F.lit("yyyyMMMdd"))


def decimal_year(value: float | str | dt.date) -> float:
    """A driver argument (decimal year, ISO text or date) as a decimal year."""
    if isinstance(value, int | float):
        return float(value)
    when = dt.datetime.fromisoformat(value) if isinstance(value, str) else dt.datetime(*value.timetuple()[:6])
    when = when.astimezone(dt.UTC) if when.tzinfo else when.replace(tzinfo=dt.UTC)
    begin, end = (dt.datetime(y, 1, 1, tzinfo=dt.UTC) for y in (when.year, when.year + 1))
    return when.year + (when - begin) / (end - begin)


def time_range(start: float | str | dt.date, end: float | str | dt.date) -> tuple[float, float]:
    """Both ends as decimal years; a start after the end raises."""
    a, b = decimal_year(start), decimal_year(end)
    if a > b:
        raise ValueError(f"the range starts after its end: {start} > {end}")
    return a, b
