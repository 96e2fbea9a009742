"""What a page states of a place and its events: JSON-LD, microdata, then its words.

Blocks are found by patterns that pass over a page once. The nodes of a block,
however deep its @graph, are read by a small walk in Python, one block at a
time; everything after it is expressions. A block that is no JSON, is longer
than 200,000 characters or nests too deep to read states nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import dates, text
from tidegate.sources import prose_hours

# Types of a place, keys whose nodes count too, bands of a price sign, and limits of one page.
BUSINESS = [
    "LocalBusiness", "Restaurant", "CafeOrCoffeeShop", "BarOrPub", "Bakery", "IceCreamShop", "FoodEstablishment", "Museum", "ArtGallery", "MovieTheater", "PerformingArtsTheater", "MusicVenue",
    "Library", "BookStore", "Store", "TouristAttraction", "Park", "NightClub", "Organization", "EntertainmentBusiness", "Winery", "Brewery", "BowlingAlley", "Casino", "AmusementPark",
]
INNER = ("location", "subEvent", "event", "mainEntity")
BANDS = {1: "0-15", 2: "15-35", 3: "35-70", 4: "70-150"}
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MOST_EVENTS, MOST_TITLE, MOST_BLOCK, MOST_HOURS_TEXT, MOST_MICRO = 100, 200, 200_000, 1000, 14

NODE = (
    "array<struct<types:array<string>,name:string,phone:string,hours:string,spec:array<struct<days:array<string>,opens:string,closes:string>>,price_range:string,"
    "reserves:string,begins:string,ends:string,status:string,url:string,free:boolean,sold_out:boolean,prices:array<string>,currency:string>>"
)


def _list(v: object) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def _str(v: object) -> str | None:
    return v if isinstance(v, str) else None


def _types(node: dict) -> list[str]:
    return [t.rsplit("/", 1)[-1] for t in _list(node.get("@type")) if isinstance(t, str)]


def walk(root: object) -> list[dict]:
    """Every typed node in order: those of a node's @graph, the node, then those it holds."""
    out, todo = [], [(root, False)]
    while todo:
        node, reached = todo.pop()
        if isinstance(node, list):
            todo += [(x, False) for x in reversed(node)]
        elif isinstance(node, dict):
            if reached:
                if node.get("@type"):
                    out.append(node)
                continue
            todo += [(node[k], False) for k in reversed(INNER) if node.get(k)]
            todo.append((node, True))
            if isinstance(node.get("@graph"), list):
                todo.append((node["@graph"], False))
    return out


def fields(node: dict) -> dict:
    """The fields of a node that are used, each as text or lists of texts; of another type than meant they are null."""
    offers = [o for o in _list(node.get("offers")) if isinstance(o, dict)]
    hours = node.get("openingHours")
    spec = [s for s in _list(node.get("openingHoursSpecification")) if isinstance(s, dict) and not s.get("validFrom") and not s.get("validThrough")]
    reserves = node.get("acceptsReservations")
    return {
        "types": _types(node), "name": _str(node.get("name")), "phone": _str(node.get("telephone")), "price_range": _str(node.get("priceRange")), "url": _str(node.get("url")),
        "hours": "; ".join(x for x in hours if isinstance(x, str)) if isinstance(hours, list) else _str(hours),
        "spec": [{"days": [d for d in _list(s.get("dayOfWeek")) if isinstance(d, str)], "opens": _str(s.get("opens")), "closes": _str(s.get("closes"))} for s in spec],
        "reserves": reserves if isinstance(reserves, str) else json.dumps(reserves) if "acceptsReservations" in node else None,
        "begins": _str(node.get("startDate")), "ends": _str(node.get("endDate")), "status": _str(node.get("eventStatus")), "free": node.get("isAccessibleForFree") in (True, "true", "True"),
        "sold_out": any(str(o.get("availability", "")).endswith("SoldOut") for o in offers), "prices": [str(o["price"]) for o in offers if isinstance(o.get("price"), (str, int, float)) and not isinstance(o.get("price"), bool)],
        "currency": next((o["priceCurrency"] for o in reversed(offers) if isinstance(o.get("priceCurrency"), str)), "USD"),
    }


def _no_number(name: str) -> None:
    raise ValueError(name)


def read_block(block: str) -> list[dict]:
    """The nodes of one block's text; none where it does not read."""
    try:
        return [fields(n) for n in walk(json.loads(block, parse_constant=_no_number))]
    except (ValueError, RecursionError):
        return []


def _read(bodies: pd.Series) -> pd.Series:
    return pd.Series([read_block(b) for b in bodies])


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, block, node, n): the fields n of each typed node of each page (page_id, html)."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*(?:>.*?(?:</script>|\z)|\z)"), 0)  # one that never closes takes the rest, so that each sign is passed once
    ours = F.filter(scripts, lambda s: s.rlike(r"""(?is)\A<script\b[^>]*\btype\s*=\s*["']application/ld\+json["']""") & F.lower(F.right(s, F.lit(9))).eqNullSafe("</script>"))
    inside = lambda s: F.substring(s, F.locate(">", s) + 1, F.length(s) - F.locate(">", s) - 9)
    bodies = F.transform(ours, lambda s: F.trim(inside(s), F.lit(" \t\r\n\f")))
    blocks = pages.where(F.contains(F.lower("html"), F.lit("ld+json"))).select("page_id", F.posexplode(bodies).alias("block", "body"))
    fine = blocks.where((F.length("body") > 0) & (F.length("body") <= MOST_BLOCK))
    return fine.select("page_id", "block", F.posexplode(F.pandas_udf(_read, NODE)("body")).alias("node", "n"))


def as_rule(stated: Column) -> Column:
    """Hours in the schema's form as an opening rule: dashes without spaces, days apart by semicolons."""
    folded = F.regexp_replace(F.regexp_replace(stated, r"\s+", " "), r" ?[-–] ?(?=\d)", "-")
    return F.trim(F.regexp_replace(folded, r"(\d{2}:\d{2}) (?=(Mo|Tu|We|Th|Fr|Sa|Su|PH)\b)", "$1; "))


def microdata_hours(html: Column) -> Column:
    """Opening hours that marked elements state, by attribute or else in their text, each once."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<[^<>]*\bitemprop\s*=\s*["']openingHours["'][^<>]*>[^<]{0,120}"""), 0)
    stated = F.transform(found, lambda e: F.coalesce(F.nullif(F.regexp_extract(e, r"""(?i)\A<[^<>]*\b(?:content|datetime)\s*=\s*["']([^"']{1,120})["']""", 1), F.lit("")), F.regexp_extract(e, r"(?s)\A<[^<>]*>(.*)", 1)))
    words = F.transform(stated, text.visible_text)
    return F.slice(F.array_distinct(F.filter(words, lambda v: v.rlike(r"\d") & v.rlike("(?i)[a-z]{2}"))), 1, MOST_MICRO)


def schema_instant(value: Column, zone: str) -> Column:
    """An instant from a page's date, whose time may follow a blank; a day alone is its first minute in the zone."""
    v = F.trim(value)
    joined = F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2}) (?=\d{2}:\d{2}(:\d{2}(\.\d+)?)?$)", "$1T")
    return dates.stated_instant(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit("T00:00"))).otherwise(joined), zone)


def week_text(weekly: Column) -> Column:
    """A week's intervals as text: weekday:start-end, in order."""
    return F.array_join(F.transform(weekly, lambda x: F.concat(x["weekday"].cast("string"), F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")


def _clock(v: Column) -> Column:
    """Minutes of a clock time, null where it is none; 24:00 is the day's end."""
    h, m = F.regexp_extract(v, r"^\s*(\d{1,2}):(\d{2})", 1), F.regexp_extract(v, r"^\s*(\d{1,2}):(\d{2})", 2)
    hour, minute = F.nullif(h, F.lit("")).try_cast("int"), F.nullif(m, F.lit("")).try_cast("int")
    return F.when((hour <= 24) & (minute <= 59), hour * 60 + minute)


def spec_week(spec: Column) -> Column:
    """The intervals of a list of opening specifications; a close at or before the open is on the next day."""
    day = F.create_map(*(F.lit(x) for i, d in enumerate(DAYS) for name in (d.lower(), d[:2].lower()) for x in (name, i)))
    part = lambda d: F.lower(F.element_at(F.split(d, "/"), -1))
    one = lambda s: F.transform(F.filter(s["days"], lambda d: day[part(d)].isNotNull()), lambda d: F.struct(day[part(d)].alias("weekday"), _clock(s["opens"]).alias("start"), F.when(_clock(s["closes"]) <= _clock(s["opens"]), _clock(s["closes"]) + 1440).otherwise(_clock(s["closes"])).alias("end")))
    return F.filter(F.flatten(F.transform(spec, one)), lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def facts(pages: DataFrame, words: Column | None = None) -> DataFrame:
    """(page_id, attribute, value, status, method) of each page (page_id distinct, html).

    Hours come from the first that states any: JSON-LD, microdata, the page's
    words; the words only where `words` holds (not on pages of many places).
    Other attributes come from JSON-LD alone. A null page states nothing.
    """
    n = nodes(pages).where(F.arrays_overlap("n.types", F.array(*map(F.lit, BUSINESS)))).select("page_id", "n.*")
    week, rule = spec_week(F.col("spec")), as_rule(F.trim("hours"))
    told = F.when(F.size(week) > 0, week_text(week)).when(F.col("hours").rlike(r"\d") & (F.length(F.trim("hours")) <= MOST_HOURS_TEXT), rule)
    tier = F.length("price_range") - F.length(F.replace("price_range", F.lit("$"), F.lit("")))
    band = F.create_map(*(F.lit(x) for pair in BANDS.items() for x in pair))[tier]
    accepts = F.col("reserves").isin("true", "True") | F.col("reserves").startswith("http")
    fact = lambda name, value, status=F.lit("stated"): F.when(value.isNotNull(), F.struct(F.lit(name).alias("attribute"), value.alias("value"), status.alias("status")))
    stated = F.array_compact(F.array(
        fact("name", F.col("name")), fact("phone", F.col("phone")), fact("opening_hours", told), fact("price", F.when(F.col("price_range").isNotNull(), F.coalesce(band, F.lit("unknown"))), F.when(band.isNotNull(), "stated").otherwise("ambiguous")),
        fact("admission", F.when(F.col("reserves").isNotNull(), F.when(accepts, "reservation_available").otherwise("walk_in"))),
    ))
    linked = n.select("page_id", F.inline(stated)).withColumn("method", F.lit("jsonld"))
    timed = linked.where("attribute = 'opening_hours'").select("page_id").distinct()
    rest = pages.join(timed, "page_id", "left_anti").select("page_id", "html", (F.lit(True) if words is None else words).alias("_words"), microdata_hours(F.col("html")).alias("_micro"))
    micro = rest.where(F.size("_micro") > 0).select("page_id", F.lit("opening_hours").alias("attribute"), as_rule(F.array_join("_micro", "; ")).alias("value"), F.lit("stated").alias("status"), F.lit("microdata").alias("method"))
    spoken = prose_hours.hours_of_pages(rest.where("_words and coalesce(size(_micro), 0) < 1").select("page_id", "html")).where("reason = ''")
    said = spoken.select("page_id", F.lit("opening_hours").alias("attribute"), week_text(F.col("weekly")).alias("value"), F.lit("stated").alias("status"), F.lit("text").alias("method"))
    return linked.unionByName(micro).unionByName(said)


def events(pages: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """(page_id, place, title, start_at, end_at, all_day, status, low, high, free, url): the first hundred events of a page that have a date."""
    is_event = F.exists("n.types", lambda t: t.endswith("Event"))
    begins = schema_instant(F.col("n.begins"), zone)
    rows = nodes(pages).where(is_event).select("page_id", "block", "node", "n", begins.alias("start_at")).where("start_at is not null")
    turn = Window.partitionBy("page_id").orderBy("block", "node")
    rows = rows.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= MOST_EVENTS)
    title = F.substring(F.trim(F.regexp_replace("n.name", r"[\x00-\x1f\x7f]+", " ")), 1, MOST_TITLE)
    status = F.when(F.col("n.sold_out"), "sold_out").when(F.element_at(F.split("n.status", "/"), -1) == "EventCancelled", "cancelled").otherwise("scheduled")
    number = lambda p: F.when(F.trim(p) == "", 0.0).when(F.trim(p).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?$"), F.trim(p).try_cast("double"))
    prices = F.filter(F.transform("n.prices", number), lambda p: p.isNotNull())
    free = F.col("n.free") | F.coalesce((F.array_min(prices) == 0) & (F.array_max(prices) == 0), F.lit(False))
    return rows.select(
        "page_id", "place", F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled event)")).alias("title"), "start_at", schema_instant(F.col("n.ends"), zone).alias("end_at"), F.trim("n.begins").rlike(r"^\d{4}-\d{2}-\d{2}$").alias("all_day"),
        status.alias("status"), F.array_min(prices).alias("low"), F.array_max(prices).alias("high"), free.alias("free"), F.col("n.url").alias("url"),
    )
