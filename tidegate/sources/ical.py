"""iCalendar events as rows, by a table function over whole feeds.

Lines are unfolded, components nest, values unescape. Times are UTC, floating or
in a named zone, or whole days; a recurring event is marked, not expanded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame

EVENT = "uid string, title string, start_at timestamp, end_at timestamp, all_day boolean, location string, cancelled boolean, recurring boolean"
#: Events that are handed on together, but for the last feed's.
AT_ONCE = 2000
#: What each letter of a duration counts, before and after its T.
UNITS = {"W": "weeks", "D": "days"}, {"H": "hours", "M": "minutes", "S": "seconds"}


def unescape(text: str) -> str:
    return re.sub(r"\\([\;,nN])", lambda m: "\n" if m[1] in "nN" else m[1], text)


def lines_of(feed: str) -> Iterator[tuple[str, dict[str, str], str]]:
    """(name, parameters, value) of each content line."""
    for line in re.sub(r"\r?\n[ \t]", "", feed).splitlines():
        head, colon, value = line.partition(":")
        while colon and head.count('"') % 2:  # a colon inside quotes
            more, colon, value = value.partition(":")
            head = f"{head}:{more}"
        if not colon:
            continue
        name, *params = head.split(";")
        yield name.upper(), {k.upper(): v.strip('"') for k, _, v in (p.partition("=") for p in params)}, value


def instant(value: str, params: dict[str, str], zone: str) -> tuple[datetime | None, bool]:
    """(UTC instant, whole day) of a time, or (None, False)."""
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)(Z?))?", value.strip()):
        try:
            day = m[4] is None
            parts = [int(x) for x in m.groups()[: 3 if day else 6]]
            tz = UTC if m[7] == "Z" else ZoneInfo(params.get("TZID", zone))
            return datetime(*parts, tzinfo=tz).astimezone(UTC).replace(tzinfo=None), day
        except (ValueError, KeyError, OSError):
            return None, False
    return None, False


def length(value: str) -> timedelta | None:
    """A duration, read number by number; None for anything else."""
    sign, mark, rest = value.strip().partition("P")
    if not mark or sign not in ("", "+", "-"):
        return None
    total, seen = timedelta(), False
    for part, units in zip(rest.partition("T")[::2], UNITS, strict=True):
        at = 0
        for m in re.finditer(r"(\d+)([A-Z])", part):
            if m.start() != at or m[2] not in units:
                return None
            total, at, seen = total + timedelta(**{units[m[2]]: int(m[1])}), m.end(), True
        if at != len(part):
            return None
    return (-total if sign == "-" else total) if seen else None


def events_of(feed: str | None, zone: str = "UTC") -> list[tuple]:
    """All events of the feed; those without a start are left out."""
    found: list[tuple] = []
    stack: list[str] = []
    own: dict[str, tuple[dict[str, str], str]] = {}
    for name, params, value in lines_of(feed or ""):
        if name == "BEGIN":
            stack.append(value.upper())
            if value.upper() == "VEVENT":
                own = {}
        elif name == "END":
            if stack and stack.pop() == "VEVENT" and "DTSTART" in own:
                start, day = instant(own["DTSTART"][1], own["DTSTART"][0], zone)
                end = instant(own["DTEND"][1], own["DTEND"][0], zone)[0] if "DTEND" in own else None
                if end is None and start and "DURATION" in own and (span := length(own["DURATION"][1])):
                    end = start + span
                if start:
                    text = lambda k: unescape(own[k][1]) if k in own else None  # noqa: B023, E731
                    found.append((text("UID"), text("SUMMARY"), start, end, day, text("LOCATION"), own.get("STATUS", ({}, ""))[1].upper() == "CANCELLED", "RRULE" in own))
        elif stack and stack[-1] == "VEVENT":
            own.setdefault(name, (params, value))
    return found


def whole(feed: str | None) -> bool:
    """Whether a feed was read to its end: only then may it withdraw events."""
    text = (feed or "").strip()
    return text.upper().startswith("BEGIN:VCALENDAR") and text.upper().endswith("END:VCALENDAR")


def _frames(batches: Iterator[pd.DataFrame], zone: str) -> Iterator[pd.DataFrame]:
    """The events of batches of feeds, in pieces: a batch may hold many long feeds."""
    names = ["feed_id", *(c.split()[0] for c in EVENT.split(", "))]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"start_at": "datetime64[us]", "end_at": "datetime64[us]"})
    for b in batches:
        rows: list[tuple] = []
        for feed_id, body in zip(b["feed_id"], b["body"], strict=True):
            rows.extend((feed_id, *e) for e in events_of(body, zone))
            if len(rows) >= AT_ONCE:
                yield frame(rows)
                rows = []
        yield frame(rows)


def parse(feeds: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events of the feeds (feed_id, body), one row each."""
    return feeds.select("feed_id", "body").mapInPandas(lambda batches: _frames(batches, zone), f"feed_id long, {EVENT}")
