"""A source's file of events taken in as one batch: checked, placed, laid over what is held, and what it no longer lists withdrawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import geo, text
from tidegate.operators.publish import Book
from tidegate.session import cut

# How long an event may run, how far ahead it may lie, how long one lasts that states no end.
LONGEST_DAYS = 14
AHEAD_DAYS = 400
DEFAULT_HOURS = 2

TABLES = {
    "events": ("key string, venue string, title string, start_at timestamp, end_at timestamp, status string", ["key"]),
    "facts": ("key string, attribute string, value string", ["key", "attribute"]),
    "listings": ("source string, area string, key string", ["source", "area", "key"]),
    "rejects": ("batch string, line long, reason string", ["batch", "line"]),
}
FILE = "line long, id string, venue string, place string, lat double, lon double, title string, start_at timestamp, end_at timestamp, status string, facts map<string,string>"


def over_at() -> Column:
    return F.coalesce("end_at", F.col("start_at") + F.make_dt_interval(hours=F.lit(DEFAULT_HOURS)))


def checked(file: DataFrame, now: Column, center: tuple[float, float], radius_m: float) -> DataFrame:
    """The file's rows with `reason`, null where an event may be written.

    A null id, title or start is missing; an event stands at a venue or, within
    the radius, at a place of its own. Of good rows with one id the first counts.
    """
    c, days = F.col, lambda n: F.make_dt_interval(days=F.lit(n))
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    apart = geo.distance_m(F.lit(center[0]), F.lit(center[1]), c("lat"), c("lon"))
    rules = [
        (blank("id"), "id: missing"), (blank("title"), "title: missing"), (c("start_at").isNull(), "start: missing"),
        (c("end_at") < c("start_at"), "end: before the start"), (c("end_at") > c("start_at") + days(LONGEST_DAYS), "end: runs too long"),
        (c("start_at") > now + days(AHEAD_DAYS), "start: too far ahead"), (over_at() < now, "already over"),
        (blank("venue") & (blank("place") | c("lat").isNull() | c("lon").isNull()), "place: missing"), (blank("venue") & (apart > radius_m), "place: outside the area"),
    ]
    rows = file.withColumn("reason", F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(why)) for rule, why in rules)))
    # ids that come once, nearly all, need no order
    first = rows.where("reason is null").groupBy("id").agg(F.min("line").alias("_first"))
    return rows.join(first, "id", "left").withColumn("reason", F.when(c("reason").isNull() & (c("line") != c("_first")), "id: listed twice in this file").otherwise(c("reason"))).drop("_first")


def venue_of() -> Column:
    """The venue's name in the file, or the key of a site of its own: one name at nearly one point is one site."""
    return F.when(F.coalesce(F.trim("venue"), F.lit("")) != "", F.col("venue")).otherwise(F.concat(F.lit("site/"), text.match_key(F.col("place")), F.lit("@"), F.format_string("%.4f,%.4f", "lat", "lon")))


def ingest(book: Book, batch: str, file: DataFrame, source: str, area: str, now: Column, center: tuple[float, float], radius_m: float, complete: bool = True) -> bool:
    """Takes a file in as one batch of the book, which has TABLES; false if the book has the batch.

    An event's facts replace what its source said of it before. A complete file
    is the area's listing from then on: what it lacks leaves the listing, and
    what no area of the source lists any more, and is not over, is withdrawn.
    The audit refuses a batch with a fact that says nothing, or none of whose
    rows could be written.
    """
    if book.has(batch):
        return False
    key = F.concat(F.lit(f"{source}:"), F.col("id"))
    rows = cut(checked(file, now, center, radius_m).withColumn("key", key), "checked")  # every table of the batch is made from these
    good = rows.where("reason is null")
    facts, listed = book.rows("facts", of=good.select("key")), book.rows("listings").where(F.col("source") == source)
    events = good.select("key", venue_of().alias("venue"), "title", "start_at", "end_at", F.coalesce("status", F.lit("scheduled")).alias("status"))
    said = good.select("key", F.explode("facts").alias("attribute", "value"))
    unsaid = facts.join(said, ["key", "attribute"], "left_anti")
    marked = lambda df, gone: df.withColumn("gone", F.lit(gone))
    stage = {"facts": marked(said, False).unionByName(marked(unsaid, True)), "rejects": marked(rows.where("reason is not null").select(F.lit(batch).alias("batch"), "line", "reason"), False)}
    if complete:
        mine = good.select(F.lit(source).alias("source"), F.lit(area).alias("area"), "key")
        left = listed.where(F.col("area") == area).join(mine, "key", "left_anti")
        alone = left.join(listed.where(F.col("area") != area), "key", "left_anti").select("key")
        open_ = F.col("status").isin("scheduled", "sold_out") & (over_at() > now)
        withdrawn = book.rows("events", of=alone).where(open_).withColumn("status", F.lit("withdrawn"))
        stage["listings"] = marked(mine, False).unionByName(marked(left.select("source", "area", "key"), True))
        events = events.unionByName(withdrawn)
    stage["events"] = marked(events, False)

    def audit(wrote: dict[str, DataFrame]) -> dict[str, DataFrame]:
        silent = wrote["facts"].where("not gone and coalesce(trim(value), '') = ''")
        stray = wrote["facts"].join(wrote["events"], "key", "left_anti")
        return {"a fact says nothing": silent, "a fact of no event": stray, "no row could be written": wrote["rejects"].where(F.lit(good.isEmpty()))}

    return book.publish(batch, stage, audit)
