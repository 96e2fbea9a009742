"""Web pages: structured blocks, links and event feeds, by expressions where they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text

#: A page's structured block may nest objects in @graph; fields that are used.
BLOCK = "struct<`@type`:string,name:string,telephone:string,startDate:string,endDate:string,url:string>"


def structured_blocks(html: Column) -> Column:
    """The JSON of each application/ld+json script, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)


def structured(pages: DataFrame) -> DataFrame:
    """(page_id, item): objects of each page's blocks, with those of @graph lifted out."""
    blocks = pages.select("page_id", F.explode(structured_blocks(F.col("html"))).alias("json"))
    graph = F.from_json(F.get_json_object("json", "$.@graph"), f"array<{BLOCK}>")
    one = F.from_json("json", BLOCK)
    many = F.from_json("json", f"array<{BLOCK}>")
    items = F.when(F.trim("json").startswith("["), many).when(graph.isNotNull(), graph).otherwise(F.array(one))
    return blocks.select("page_id", F.explode(items).alias("item")).where("item.`@type` is not null")


def event_feeds(html: Column) -> Column:
    """Links of a page that look like calendars, without repeats."""
    return F.array_distinct(F.filter(text.links(html), lambda u: F.lower(u).rlike(r"\.ics(\?|$)|^webcal:|[?&](ical|outlook-ical)=|/calendar/")))


def places_scan(path_rows: DataFrame, west: float, east: float, south: float, north: float, licenses: list[str]) -> DataFrame:
    """Open-place records in a box, whose every source has an accepted license.

    The comparisons on bbox reach the Parquet scan, so row groups outside the
    box are skipped. A record without sources fails closed.
    """
    b = F.col("bbox")
    inside = (b["xmin"] <= east) & (b["xmax"] >= west) & (b["ymin"] <= north) & (b["ymax"] >= south)
    fine = (F.size("sources") > 0) & F.forall("sources", lambda s: F.coalesce(s["license"].isin(licenses), F.lit(False)))
    return path_rows.where(inside).where(fine).select("id", F.col("names.primary").alias("name"), "confidence", "websites", "phones", "operating_status", "basic_category", ((b["xmin"] + b["xmax"]) / 2).alias("lon"), ((b["ymin"] + b["ymax"]) / 2).alias("lat"))


def map_elements(snapshot: DataFrame) -> DataFrame:
    """(external_id, lat, lon, tags, version) of a map snapshot's elements.

    An element without a place is dropped, and so is one without a name unless
    it is parking.
    """
    e = snapshot.select(F.explode("elements").alias("e"))
    rows = e.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("external_id"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.col("e.tags").alias("tags"), F.col("e.version").alias("version"))
    return rows.where(F.col("lat").isNotNull() & (F.col("tags")["name"].isNotNull() | (F.col("tags")["amenity"] == "parking")))


def hourly_forecast(bodies: DataFrame) -> DataFrame:
    """(area, start_at, end_at, temp_f, rain) of forecast documents, Celsius turned to Fahrenheit."""
    period = "struct<startTime:timestamp,endTime:timestamp,temperature:double,temperatureUnit:string,probabilityOfPrecipitation:struct<value:double>>"
    rows = bodies.select("area", F.explode(F.from_json("body", f"struct<properties:struct<periods:array<{period}>>>")["properties"]["periods"]).alias("p"))
    temp = F.when(F.col("p.temperatureUnit") == "C", F.col("p.temperature") * 9 / 5 + 32).otherwise(F.col("p.temperature"))
    short = F.unix_millis("p.endTime") - F.unix_millis("p.startTime") <= 7_200_000
    return rows.where(short).select("area", F.col("p.startTime").alias("start_at"), F.col("p.endTime").alias("end_at"), temp.alias("temp_f"), F.col("p.probabilityOfPrecipitation.value").alias("rain"))
