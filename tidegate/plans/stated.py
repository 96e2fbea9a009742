"""Queries of what pages state of places and events: the given pages, each with a piece of markup put into it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidegate.session import table
from tidegate.sources import structured

_LD = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
_WEEK = {"dayOfWeek": ["Monday", "https://schema.org/Friday"], "opens": "09:00", "closes": "17:30"}
_LATE = {"dayOfWeek": "Saturday", "opens": "18:00", "closes": "02:00"}

#: Markup, the facts it states (attribute, value, status, method) and its events (place, title, start in UTC, status, low, high, free).
SAID: list[tuple[str, list[tuple], list[tuple]]] = [
    (_LD({"@context": "x", "@type": "Restaurant", "name": "Blue Door", "telephone": "555-0100", "openingHoursSpecification": [_WEEK, _LATE, {**_WEEK, "validFrom": "2024-12-24"}], "priceRange": "$$", "acceptsReservations": "True"}),
     [("name", "Blue Door", "stated", "jsonld"), ("phone", "555-0100", "stated", "jsonld"), ("opening_hours", "1:540-1050 5:540-1050 6:1080-1560", "stated", "jsonld"), ("price", "15-35", "stated", "jsonld"), ("admission", "reservation_available", "stated", "jsonld")], []),
    (_LD({"@graph": [{"@graph": [{"@type": ["Thing", "https://schema.org/Museum"], "name": "Deep", "openingHours": ["Mo 09:00 - 17:00 Tu 09:00 - 17:00", "Su 10:00-12:00"]}]}, {"@type": "WebSite", "name": "no place"}]}),
     [("name", "Deep", "stated", "jsonld"), ("opening_hours", "Mo 09:00-17:00; Tu 09:00-17:00; Su 10:00-12:00", "stated", "jsonld")], []),
    (_LD({"@type": "MusicVenue", "name": "Hall", "event": [{"@type": "MusicEvent", "name": "Trio", "startDate": "2024-10-24T19:30", "offers": [{"price": "12.50", "priceCurrency": "USD"}, {"price": 30}]}, {"@type": "Event", "startDate": "2024-11-05", "eventStatus": "https://schema.org/EventCancelled"}, {"@type": "Event", "name": "no date"}]}),
     [("name", "Hall", "stated", "jsonld")], [(1, "Trio", "2024-10-24 23:30:00", "scheduled", 12.5, 30.0, False), (2, "(untitled event)", "2024-11-05 05:00:00", "cancelled", None, None, False)]),
    ('<div itemscope itemtype="https://schema.org/Store"><meta itemprop="openingHours" content="Mo-Fr 08:00 - 18:00"><time itemprop=\'openingHours\' datetime="Sa 09:00-13:00">Sat</time><span itemprop="openingHours">Su 10:00&nbsp;- 12:00</span><span itemprop="openingHours">call us</span></div>',
     [("opening_hours", "Mo-Fr 08:00-18:00; Sa 09:00-13:00; Su 10:00-12:00", "stated", "microdata")], []),
    ("<hr><p>-</p><h2>Hours</h2><p>Monday - Friday: 9am - 5pm</p><p>Saturday: 10am - 4pm</p>",
     [("opening_hours", "1:540-1020 2:540-1020 3:540-1020 4:540-1020 5:540-1020 6:600-960", "stated", "text")], []),
    (_LD({"@type": "CafeOrCoffeeShop", "openingHours": "", "priceRange": "cheap", "acceptsReservations": False}) + '<i itemprop="openingHours" content="Tu-Su 07:00-15:00">x</i>',
     [("price", "unknown", "ambiguous", "jsonld"), ("admission", "walk_in", "stated", "jsonld"), ("opening_hours", "Tu-Su 07:00-15:00", "stated", "microdata")], []),
    ('<script type="application/ld+json">{"@type": "Bakery", "name": "trailing comma",}</script><SCRIPT data-x=1 type=\'application/ld+json\'>[{"@type": "TheaterEvent", "name": "Play", "startDate": "2024-07-01T20:00:00-04:00", "offers": {"price": 0, "availability": "https://schema.org/SoldOut"}}]</SCRIPT>',
     [], [(1, "Play", "2024-07-02 00:00:00", "sold_out", 0.0, 0.0, True)]),
    ('<script>var x = "application/ld+json"; {"@type": "Bakery"}</script><p itemprop="name">nothing</p>', [], []),
    (_LD([{"@type": "Library", "location": {"@type": "Park", "name": "Green"}, "subEvent": {"@type": "Event", "name": "Bad\u0001 day", "startDate": "2024-02-30"}}, {"@type": "Event", "name": " Talk ", "startDate": "2024-03-10 02:30", "isAccessibleForFree": True}]),
     [("name", "Green", "stated", "jsonld")], [(1, "Talk", "2024-03-10 06:30:00", "scheduled", None, None, True)]),  # 02:30 is skipped by the clock that night: the second pass counts
]


def pages(spark, d):
    """Every page with one of the pieces at its end."""
    said = F.get(F.array(*(F.lit(x) for x, _, _ in SAID)), (F.col("page_id") % len(SAID)).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), said).alias("html"))


def site_facts(spark, d):
    return structured.facts(pages(spark, d))


def site_events(spark, d):
    e = structured.events(pages(spark, d))
    return e.select("page_id", "place", "title", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "status", "low", "high", "free")


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}" if isinstance(x, int) else f"{x}::DOUBLE" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"


_stated = lambda at: ", ".join(f"({i}, {', '.join(map(_value, row))})" for i, said in enumerate(SAID) for row in said[at])

QUERIES = {"site_facts": site_facts, "site_events": site_events}
ORACLES = {
    "site_facts": f"SELECT page_id, attribute, value, status, method FROM pages JOIN (VALUES {_stated(1)}) AS s(n, attribute, value, status, method) ON n = page_id % {len(SAID)}",
    "site_events": f"SELECT page_id, place::INT AS place, title, start_at, status, low::DOUBLE AS low, high::DOUBLE AS high, free FROM pages JOIN (VALUES {_stated(2)}) AS s(n, place, title, start_at, status, low, high, free) ON n = page_id % {len(SAID)}",
}
