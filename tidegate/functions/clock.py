"""Weekly hours, day parts and local time, as column expressions.

Minutes count from local midnight; an interval that ends after 1440 runs into
the next day. Weekday 0 is Sunday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
#: An open interval around or after a minute of the week.
OPENING = "struct<open:int,close:int>"


def local_clock(ts: Column, zone: Column | str) -> Column:
    """Weekday, minute of the day and date of a UTC instant in a zone."""
    local = F.from_utc_timestamp(ts, zone)
    return F.struct((F.dayofweek(local) - 1).alias("weekday"), (F.hour(local) * 60 + F.minute(local)).alias("minute"), F.to_date(local).alias("day"))


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, halves rounded up."""
    return F.floor((F.unix_millis(b) - F.unix_millis(a)) / 60000.0 + 0.5).cast("int")


def around(hours: Column, weekday: Column, minute: Column) -> Column:
    """Intervals of yesterday, today and tomorrow in minutes from today's midnight.

    `hours` is array<struct<weekday, start, end>>. Intervals that touch are
    merged, so a place open past midnight stays open.
    """
    days = F.array(*map(F.lit, (-1, 0, 1)))
    of_day = lambda d: F.transform(F.filter(hours, lambda h: h["weekday"] == F.pmod(weekday + d, F.lit(7))), lambda h: F.struct((h["start"] + d * DAY).cast("int").alias("open"), (h["end"] + d * DAY).cast("int").alias("close")))
    flat = F.array_sort(F.flatten(F.transform(days, of_day)))
    none = F.array().cast(f"array<{OPENING}>")

    def merge(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["open"].alias("open"), F.greatest(last["close"], x["close"]).alias("close"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        return F.when(x["open"] <= last["close"], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(flat, none, merge)


def open_at(hours: Column, weekday: Column, minute: Column) -> Column:
    """The merged interval that holds the minute (its end excluded), or null."""
    return F.get(F.filter(around(hours, weekday, minute), lambda x: (x["open"] <= minute) & (minute < x["close"])), F.lit(0))


def next_opening(hours: Column, weekday: Column, minute: Column) -> Column:
    """The first merged interval that starts after the minute, or null."""
    return F.get(F.filter(around(hours, weekday, minute), lambda x: x["open"] > minute), F.lit(0))


def in_window(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day is in [start, end), which may wrap past midnight."""
    return F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))
