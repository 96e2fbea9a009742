"""Opening-hours rules of map tags as weekly intervals.

The mini-language is read by a small parser, once for each distinct rule; the
intervals then go back to the rows by a join, and column expressions evaluate
them (functions.clock).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS = ["Su", "Mo", "Tu", "We", "Th", "Fr", "Sa"]
_DAY = "(?:Su|Mo|Tu|We|Th|Fr|Sa)"
_DAYS = re.compile(rf"^((?:{_DAY}(?:\s*-\s*{_DAY})?|PH|SH)(?:\s*,\s*(?:{_DAY}(?:\s*-\s*{_DAY})?|PH|SH))*)\s*:?\s*")
_SPAN = re.compile(r"^(\d{1,2}):(\d\d)\s*-\s*(\d{1,2}):(\d\d)$")


def days_of(text: str) -> tuple[list[int], bool]:
    """(weekdays, whether holidays were named too)."""
    found: list[int] = []
    named = False
    for part in re.split(r"\s*,\s*", text):
        if part in ("PH", "SH"):
            named = True
            continue
        first, _, last = (x.strip() for x in part.partition("-"))
        a = DAYS.index(first)
        b = DAYS.index(last) if last else a
        found += [(a + i) % 7 for i in range((b - a) % 7 + 1)]
    return found, named


def spans_of(text: str) -> list[tuple[int, int]] | None:
    """The time spans of a day; one that ends at or before its start runs past midnight."""
    found = []
    for part in re.split(r"\s*,\s*", text.strip()):
        m = _SPAN.match(part)
        if not m:
            return None
        a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
        if a >= 1440 or b > 2880:
            return None
        found.append((a, b if b > a else b + 1440))
    return found


def parse(rule: str | None) -> tuple[list[tuple[int, int, int]] | None, bool]:
    """((weekday, start, end) in order, approximate), or (None, False) for what can't be read.

    A later part of a rule replaces the days it names; "off" empties them. Parts
    for holidays alone are left out and make the result approximate.
    """
    week: dict[int, list[tuple[int, int]]] = {}
    approximate = False
    parts = [p.strip() for p in (rule or "").split(";") if p.strip()]
    if not parts:
        return None, False
    for part in parts:
        if part == "24/7":
            week = {d: [(0, 1440)] for d in range(7)}
            continue
        m = _DAYS.match(part)
        days, named = days_of(m[1]) if m else (list(range(7)), False)
        rest = part[m.end() :].strip() if m else part
        approximate |= named
        if named and not days:
            continue
        spans = [] if rest in ("off", "closed") else spans_of(rest)
        if spans is None:
            return None, False
        for d in days:
            week[d] = spans
    return sorted((d, a, b) for d, spans in week.items() for a, b in spans), approximate


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MONTH = "(?:" + "|".join(MONTHS) + ")"
_MONTHS = re.compile(rf"^({_MONTH}(?:\s*-\s*{_MONTH})?(?:\s*,\s*{_MONTH}(?:\s*-\s*{_MONTH})?)*)\s*:?\s*")
RULES = "array<struct<seq:int,fallback:boolean,months:array<int>,days:array<int>,holiday:boolean,spans:array<struct<start:int,end:int>>>>"


def months_of(text: str) -> list[int]:
    found: list[int] = []
    for part in re.split(r"\s*,\s*", text):
        first, _, last = (x.strip() for x in part.partition("-"))
        a, b = MONTHS.index(first), MONTHS.index(last or first)
        found += [(a + i) % 12 + 1 for i in range((b - a) % 12 + 1)]
    return found


def parts_of(rule: str | None) -> list[tuple] | None:
    """The parts of a rule as (seq, fallback, months, days, holiday, spans), or None for what can't be read.

    Months and days that are not named are all; days are empty for a part about
    holidays alone. Comments in quotes are left aside; a part after || is a
    fallback; "off" has no spans.
    """
    found: list[tuple] = []
    for group, text in enumerate(re.sub(r'"[^"]*"', "", rule or "").split("||")):
        for part in filter(None, (p.strip() for p in text.split(";"))):
            months, days, holiday = list(range(1, 13)), list(range(7)), False
            if m := _MONTHS.match(part):
                months, part = months_of(m[1]), part[m.end() :].strip()
            if m := _DAYS.match(part):
                (days, holiday), part = days_of(m[1]), part[m.end() :].strip()
            spans = [] if part in ("off", "closed") else [(0, 1440)] if part in ("24/7", "") and (part or months != list(range(1, 13)) or len(days) < 7) else spans_of(part)
            if spans is None:
                return None
            found.append((len(found), group > 0, months, days, holiday, spans))
    return found or None


def dated_hours(rows: DataFrame, days: DataFrame, rule: str = "opening_hours") -> DataFrame:
    """The rows, which have a day, with holiday and spans: the hours of that day, null for a rule that can't be read.

    `days` says which days are holidays (day date, holiday boolean).

    Each distinct rule is read once. The last part that speaks of a day decides;
    a fallback speaks only where the others leave the day without hours.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("seq", "fallback", "months", "days", "holiday")
        for b in batches:
            read = [parts_of(r) for r in b[rule]]
            yield pd.DataFrame({rule: b[rule], "parts": [None if p is None else [dict(zip(names, x[:5], strict=True)) | {"spans": [{"start": a, "end": z} for a, z in x[5]]} for x in p] for p in read]})

    parts = rows.select(rule).where(f"`{rule}` is not null").distinct().mapInPandas(of, f"`{rule}` string, parts {RULES}")
    d = days.select("day", "holiday", (F.dayofweek("day") - 1).alias("_weekday"), F.month("day").alias("_month"))
    speaks = lambda p: F.array_contains(p["months"], F.col("_month")) & (F.array_contains(p["days"], F.col("_weekday")) | (p["holiday"] & F.col("holiday")))
    last = lambda fallback: F.try_element_at(F.filter("parts", lambda p: speaks(p) & (p["fallback"] == fallback)), F.lit(-1))["spans"]
    main, other = last(F.lit(False)), last(F.lit(True))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.when(F.col("parts").isNull(), None).when(F.coalesce(F.size(main), F.lit(0)) > 0, main).otherwise(F.coalesce(other, empty))
    return rows.join(parts, rule).join(d, "day").select(*rows.columns, "holiday", spans.alias("spans"))


def weekly_hours(rows: DataFrame, rule: str = "opening_hours") -> DataFrame:
    """The rows with hours array<struct<weekday, start, end>>, approximate and unread."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(r, *parse(r)) for r in b[rule]]
            yield pd.DataFrame({rule: [g[0] for g in got], "hours": [None if g[1] is None else [dict(zip(("weekday", "start", "end"), x, strict=True)) for x in g[1]] for g in got], "approximate": [g[2] for g in got], "unread": [g[1] is None for g in got]})

    kind = f"`{rule}` string, hours array<struct<weekday:int,start:int,end:int>>, approximate boolean, unread boolean"
    read = rows.select(rule).where(f"`{rule}` is not null").distinct().mapInPandas(of, kind)
    return rows.join(read, rule, "left")
