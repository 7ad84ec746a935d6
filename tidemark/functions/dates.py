"""Local sessions, openings and calendar arithmetic. Timestamps carry no zone and are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
OPEN_MINUTE, PRE_MINUTE, CLOSE_MINUTE, POST_MINUTE = 570, 240, 960, 1200


def local(ts: Column, zone: str = MARKET_ZONE) -> Column:
    """UTC to wall clock, by the zone's rules of that day."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def utc(ts: Column, zone: str = MARKET_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session(ts: Column) -> Column:
    """weekend, pre, rth, post or overnight, by local time."""
    t = local(ts)
    m = minute_of_day(t)
    return F.when(F.weekday(t) >= 5, "weekend").when((m >= PRE_MINUTE) & (m < OPEN_MINUTE), "pre").when((m >= OPEN_MINUTE) & (m < CLOSE_MINUTE), "rth").when((m >= CLOSE_MINUTE) & (m < POST_MINUTE), "post").otherwise("overnight")


def next_open(ts: Column) -> Column:
    """The next local opening strictly after ``ts``: from the opening minute on, tomorrow's."""
    t = local(ts)
    day = F.date_trunc("day", t).cast("timestamp_ntz")
    ahead = F.when(minute_of_day(t) < OPEN_MINUTE, F.lit(0)).otherwise(F.lit(1))
    return utc(day + F.make_dt_interval(ahead, F.lit(0), F.lit(OPEN_MINUTE)))


def wall_clock(year: Column, month: Column, day: Column, hour: Column, minute: Column, zone: str = MARKET_ZONE) -> Column:
    """A wall clock in ``zone`` to UTC; null for dates that don't exist."""
    return utc(F.try_make_timestamp(year, month, day, hour, minute, F.lit(0)), zone)


def chunks(start: Column, end: Column, days: int) -> Column:
    """[from, to] pairs of at most ``days`` days that cover both ends."""
    starts = F.sequence(start, end, F.make_dt_interval(F.lit(days)))
    return F.transform(starts, lambda s: F.struct(s.alias("from"), F.least(F.date_add(s, days - 1), end).alias("to")))


def month_after(month: Column, n: int = 1) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")
