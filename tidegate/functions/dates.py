"""Dates and instants: local time by two passes, partial dates, holidays, due times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_MIN = 30
CONFIRMED_DAYS = 90


def zone_offset_min(instant: Column, zone: str) -> Column:
    """How far a zone's wall clock is ahead of UTC at an instant, in minutes."""
    return ((F.unix_millis(F.from_utc_timestamp(instant, zone)) - F.unix_millis(instant)) / 60000).cast("int")


def from_local(local: Column, zone: str) -> Column:
    """The instant at which a zone's clock reads a local time, by two passes.

    The first pass takes the offset of the local time read as UTC, the second
    that of its result; a time that occurs twice is the first of the two.
    """
    ahead = lambda t: F.make_dt_interval(mins=zone_offset_min(t, zone))
    guess = local - ahead(local)
    return local - ahead(guess)


def partial_date(value: Column) -> Column:
    """struct<from, until>: the days of a year, a month or a day, until excluded; null for anything else."""
    part = lambda n: F.nullif(F.regexp_extract(F.trim(value), r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$", n), F.lit("")).cast("int")
    year, month, day = part(1), part(2), part(3)
    first = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.coalesce(month, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(day, F.lit(1)).cast("string"), 2, "0")))
    until = F.when(day.isNotNull(), F.date_add(first, 1)).when(month.isNotNull(), F.add_months(first, 1)).otherwise(F.add_months(first, 12))
    return F.when(year.between(1000, 9998) & first.isNotNull(), F.struct(first.alias("from"), until.alias("until")))


def stated_instant(value: Column, zone: str) -> Column:
    """An instant from a page's date: with its own offset, else on the wall clock of the zone; null for a day that is none."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?"
    full = F.regexp_replace(value, r"(T\d{2}:\d{2})(?!:)", "$1:00")
    own = F.try_to_timestamp(full)
    local = F.try_to_timestamp(F.regexp_extract(full, shape, 0))
    return F.when(value.rlike(shape + r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"), own).when(value.rlike(shape + "$"), from_local(local, zone))


def confirmed(verified: Column, conflict: Column, now: Column) -> Column:
    """Whether a verification is fresh enough, and undisputed, to count as a confirmation."""
    age = F.unix_seconds(now) - F.unix_seconds(verified)
    return F.coalesce(~conflict & age.between(-86400, CONFIRMED_DAYS * 86400), F.lit(False))


def next_due(every_min: Column, success: Column, failure: Column) -> Column:
    """When a job is next due: its cadence after its last success, or a retry after a failure since."""
    after = lambda t, n: t + F.make_dt_interval(mins=n)
    by_success = F.coalesce(after(success, every_min), F.lit("1970-01-01").cast("timestamp"))
    failed = failure.isNotNull() & (success.isNull() | (failure > success))
    return F.when(failed, F.greatest(by_success, after(failure, F.least(every_min, F.lit(RETRY_MIN))))).otherwise(by_success)


def buffer_at(hour: Column, windows: list[tuple[int, int, int]], default: int) -> Column:
    """The minutes of the first window (from, to, minutes) of hours that holds the hour; windows may wrap past midnight."""
    found = F.lit(None).cast("int")
    for start, end, minutes in reversed(windows):
        inside = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
        found = F.when(inside, F.lit(minutes)).otherwise(found)
    return F.coalesce(found, F.lit(default))


def doubtful_close(daytime: Column, opens: Column, closes: Column) -> Column:
    """Whether a close looks mistyped: a daytime place, not open from midnight, that closes past 11pm or the next day; minutes of the opening's day."""
    return daytime & (opens > 0) & (closes > 23 * 60)


def new_york_holiday(day: Column) -> Column:
    """Whether a date is a public holiday there: fixed days, and days named by a week of a month."""
    month, date, weekday = F.month(day), F.dayofmonth(day), F.dayofweek(day) - 1
    fixed = F.date_format(day, "MM-dd").isin("01-01", "06-19", "07-04", "11-11", "12-25")
    nth = lambda m, w, n: (month == m) & (weekday == w) & (F.ceil(date / 7) == n)
    last_monday_of_may = (month == 5) & (weekday == 1) & (date > 24)
    return fixed | nth(1, 1, 3) | nth(2, 1, 3) | last_monday_of_may | nth(9, 1, 1) | nth(10, 1, 2) | nth(11, 4, 4)
