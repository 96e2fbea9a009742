"""Event feeds in other forms: paged JSON, RSS, ticketing, park rows, event files, and checks of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "struct<events:array<struct<id:long,title:string,start:string,end:string,venue:string,cost:string>>,next:string>"
TICKETED = "struct<id:string,name:string,test:boolean,start:string,tba:boolean,prices:array<struct<min:double,max:double>>,kinds:array<string>,adults:boolean>"
#: Kinds of a ticketed event and the interests they say; the earlier of two that exclude each other wins.
KINDS = {"comedy": "comedy", "music": "live_music", "theatre": "theatre", "sports": "sports", "film": "film"}
ROLLS_UP_TO_H = 12
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def paged_events(pages: DataFrame) -> DataFrame:
    """(page_id, id, title, start_at, end_at, price_min, price_max) of JSON pages; amounts are all numbers of the cost."""
    rows = pages.select("page_id", F.explode(F.from_json("body", PAGE)["events"]).alias("e"))
    amounts = F.transform(F.regexp_extract_all("e.cost", F.lit(r"\d+(?:\.\d+)?"), 0), lambda x: x.cast("double"))
    at = lambda c: F.try_to_timestamp(F.col(c))
    out = rows.select("page_id", "e.id", unescaped(F.col("e.title")).alias("title"), at("e.start").alias("start_at"), at("e.end").alias("end_at"), F.array_min(amounts).alias("price_min"), F.array_max(amounts).alias("price_max"))
    return out.where("start_at is not null")


def next_page(pages: DataFrame, origin: Column, most: int = 12) -> DataFrame:
    """(page_id, next, complete): the next page to read, only on the feed's own origin and within `most` pages.

    complete is whether the read ended because there was nothing more.
    """
    url = F.from_json("body", PAGE)["next"]
    own = F.startswith(url, F.concat(origin, F.lit("/")))
    go = F.coalesce(own & (F.col("number") < most), F.lit(False))
    return pages.select("page_id", F.when(go, url).alias("next"), url.isNull().alias("complete"))


def rss_events(feeds: DataFrame) -> DataFrame:
    """(feed_id, title, start_at) of RSS items whose description names a date and a time ("Event date: 06/01/2024", "Event Time: 07:30 PM")."""
    part = lambda p: F.expr(f"xpath(body, 'rss/channel/item/{p}/text()')")
    items = feeds.where(rss_whole(F.col("body"))).select("feed_id", F.explode(F.arrays_zip(part("title").alias("title"), part("description").alias("description"))).alias("i"))
    day = F.regexp_extract("i.description", r"(?i)date:\s*(\d{2}/\d{2}/\d{4})", 1)
    time = F.regexp_extract("i.description", r"(?i)time:\s*(\d{1,2}:\d{2}\s*[AP]M)", 1)
    at = F.try_to_timestamp(F.concat_ws(" ", day, F.lpad(F.upper(F.regexp_replace(time, r"\s+", " ")), 8, "0")), F.lit("MM/dd/yyyy hh:mm a"))
    return items.select("feed_id", F.col("i.title").alias("title"), at.alias("start_at")).where("start_at is not null")


def rss_whole(body: Column) -> Column:
    """Whether an RSS feed was read to its end."""
    return F.coalesce(body.rlike(r"(?is)^\s*(<\?xml[^>]*>\s*)?<rss\b.*</channel>\s*</rss>\s*$"), F.lit(False))


def calendar_whole(body: Column) -> Column:
    """Whether a calendar was read to its end: only then may it withdraw events."""
    return F.coalesce(body.rlike(r"(?is)^\s*BEGIN:VCALENDAR\b.*\bEND:VCALENDAR\s*$"), F.lit(False))


def ticketed_events(bodies: DataFrame) -> DataFrame:
    """(id, skip, name, start_at, price_min, price_max, interests, adults): each event, or the first reason to leave it out."""
    e = bodies.select(F.from_json("body", TICKETED).alias("e")).select("e.*")
    skip = F.coalesce(F.when(F.col("test"), "test"), F.when(F.col("name").rlike(r"(?i)\bparking\b"), "parking"), F.when(F.col("tba") | F.col("start").isNull(), "no time"))
    said = F.array_compact(F.array(*(F.when(F.array_contains("kinds", k), F.lit(v)) for k, v in KINDS.items())))
    interests = F.when(F.array_contains(said, "comedy"), F.array_remove(said, "theatre")).otherwise(said)
    return e.select("id", skip.alias("skip"), "name", F.try_to_timestamp("start").alias("start_at"), F.array_min(F.transform("prices", lambda p: p["min"])).alias("price_min"), F.array_max(F.transform("prices", lambda p: p["max"])).alias("price_max"), interests.alias("interests"), F.coalesce("adults", F.lit(False)).alias("adults"))


def park_events(rows: DataFrame) -> DataFrame:
    """(id, title, lat, lon, start_at, end_at): the first point of "lat, lon; …"; an end at or before the start is of the next day, if that makes 12 hours or less."""
    point = F.split(F.get(F.split("coordinates", ";"), F.lit(0)), ",")
    at = lambda t: F.try_to_timestamp(F.concat_ws(" ", "day", F.col(t)), F.lit("yyyy-MM-dd HH:mm"))
    start, end = at("start"), at("end")
    rolled = F.when(end > start, end).when(F.unix_seconds(end) + 86400 - F.unix_seconds(start) <= ROLLS_UP_TO_H * 3600, end + F.expr("interval 1 day"))
    return rows.select("id", unescaped(F.col("title")).alias("title"), F.trim(F.get(point, F.lit(0))).cast("double").alias("lat"), F.trim(F.get(point, F.lit(1))).cast("double").alias("lon"), start.alias("start_at"), rolled.alias("end_at"))


def event_refused(now: Column) -> Column:
    """Why a row of an events file is refused, null where it is taken; columns title, start_at, end_at, price_min, url."""
    c = F.col
    return F.coalesce(
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title"),
        F.when(c("start_at").isNull(), "no start"),
        F.when(c("end_at") <= c("start_at"), "ends before it starts"),
        F.when(F.coalesce("end_at", "start_at") < now, "over"),
        F.when(c("price_min") < 0, "price below nothing"),
        F.when(~c("url").rlike("(?i)^https?://"), "url of another kind"),
    )


def whole_files(rows: DataFrame, bad: Column) -> DataFrame:
    """(file, rows, bad, accepted): a file with one bad row is refused whole, since a dropped row would read as a disappearance."""
    n = rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"))
    return n.withColumn("accepted", (F.col("bad") == 0) & (F.col("rows") > 0))


def sane_time(stated: Column, read: Column) -> Column:
    """The data time of a snapshot; one more than an hour after the read is unknown."""
    return F.when(stated <= read + F.expr("interval 1 hour"), stated)


def too_old(stated: Column, read: Column) -> Column:
    """Whether a snapshot is refused: its data is more than three days behind the read."""
    return F.coalesce(stated < read - F.expr("interval 3 days"), F.lit(False))
