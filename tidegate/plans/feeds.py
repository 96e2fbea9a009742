"""Queries of the sources: bodies made from the given tables, parsed, and held to the rows they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import dates, hours
from tidegate.operators import ledger
from tidegate.plans import adapters as A
from tidegate.session import table
from tidegate.sources import feeds, ical, pages, robots
from tidegate.streaming import events as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _time(c, form="yyyy-MM-dd HH:mm"):
    return F.coalesce(F.date_format(c, form), F.lit(""))


@query("SELECT s_suppkey::VARCHAR AS id, s_suppkey % 3 AS version FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 5 <> 0 OR s_suppkey % 10 = 0)")
def map_elements(spark, d):
    k = F.col("s_suppkey")
    lat, lon = F.lit(40.7) + k / F.lit(10000.0), F.lit(-74.0) + k / F.lit(10000.0)
    point = k % 2 == 0
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(k % 5 != 0, F.col("s_name")), F.lit("amenity"), F.when(k % 10 == 0, "parking").otherwise("cafe")), lambda n, v: v.isNotNull())
    e = F.struct(F.lit("node").alias("type"), k.alias("id"), F.when(point & (k % 7 != 0), lat).alias("lat"), F.when(point & (k % 7 != 0), lon).alias("lon"), F.when(~point & (k % 7 != 0), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"), tags.alias("tags"), (k % 3).alias("version"))
    snapshot = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(e).alias("elements"))
    return pages.map_elements(snapshot).select(F.substring_index("external_id", "/", -1).alias("id"), "version")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 300 <= 60 THEN true ELSE o_orderkey % 300 > 200 END AS known, o_orderkey % 300 <= 60 AND o_orderkey % 2 = 0 AND o_orderkey % 6000 > 4320 AS refused FROM orders")
def snapshot_times(spark, d):
    k, read = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    late = k % 300
    stated = F.when((late <= 60) & (k % 2 == 0), read - F.make_dt_interval(mins=(k % 6000).cast("int"))).when(late <= 60, read + F.make_dt_interval(mins=late.cast("int"))).when(late > 200, read).otherwise(read + F.make_dt_interval(mins=late.cast("int")))
    return table(spark, d, "orders").select("o_orderkey", feeds.sane_time(stated, read).isNotNull().alias("known"), feeds.too_old(feeds.sane_time(stated, read), read).alias("refused"))


_ICAL = "SELECT o_orderkey::VARCHAR AS uid, 'Show, no ' || o_orderkey AS title, strftime(o_orderdate + INTERVAL 19 HOUR, '%Y-%m-%d %H:%M') AS start_at, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 21 HOUR, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate + INTERVAL 20 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') ELSE '' END AS end_at, o_orderstatus = 'F' AS cancelled, o_orderkey % 5 = 0 AS recurring FROM orders WHERE o_custkey % 4 <> 3"


def _calendars(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    end = F.when(k % 3 == 0, F.concat(F.lit("DTEND:"), day, F.lit("T210000Z\r\n"))).when(k % 3 == 1, F.lit("DURATION:PT1H30M\r\n")).otherwise("")
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), k.cast("string"), F.lit("\r\nSUMMARY:Show\\, \r\n no "), k.cast("string"), F.lit("\r\nDTSTART:"), day, F.lit("T190000Z\r\n"), end, F.when(F.col("o_orderstatus") == "F", "STATUS:CANCELLED\r\n").otherwise(""), F.when(k % 5 == 0, "RRULE:FREQ=WEEKLY\r\n").otherwise(""), F.lit("END:VEVENT\r\n"))
    fed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("feed_id")).agg(F.array_join(F.collect_list(event), "").alias("events"))
    return fed.select("feed_id", F.concat(F.lit("BEGIN:VCALENDAR\r\n"), "events", F.when(F.col("feed_id") % 4 == 3, "").otherwise("END:VCALENDAR\r\n")).alias("body"))


@query(_ICAL)
def calendar_events(spark, d):
    whole = _calendars(spark, d).where(feeds.calendar_whole(F.col("body")))
    return ical.parse(whole).select("uid", "title", _time("start_at").alias("start_at"), _time("end_at").alias("end_at"), "cancelled", "recurring")


@query(f"SELECT CASE WHEN cancelled THEN 'cancelled' WHEN recurring THEN 'recurring' WHEN end_at = '' THEN 'no end' WHEN start_at < '1996-01-01' THEN 'past' ELSE '' END AS skip, count(*) AS n FROM ({_ICAL}) GROUP BY 1")
def calendar_skips(spark, d):
    c = F.col
    skip = F.coalesce(F.when(c("cancelled"), "cancelled"), F.when(c("recurring"), "recurring"), F.when(c("end_at").isNull(), "no end"), F.when(c("start_at") < F.lit("1996-01-01").cast("timestamp"), "past"), F.lit(""))
    return ical.parse(_calendars(spark, d).where(feeds.calendar_whole(c("body")))).groupBy(skip.alias("skip")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 3 <> 0 WHEN s_suppkey % 4 = 1 THEN s_suppkey % 6 = 0 OR s_suppkey % 3 = 1 ELSE true END AS allowed FROM supplier")
def robots_allowed(spark, d):
    files = spark.createDataFrame([("h0", "User-agent: *\nDisallow: /p0\n\nUser-agent: mine\nDisallow: /p0\nAllow: /p1"), ("h1", "User-agent: *\nDisallow: /\nAllow: /p1$\nAllow: /p0/even\n"), ("h2", "")], "host string, body string")
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/p"), (k % 3).cast("string"), F.when((k % 4 == 1) & (k % 3 == 0), F.when(k % 2 == 0, "/even").otherwise("/odd")).otherwise(""))
    asked = table(spark, d, "supplier").select(F.concat(F.lit("h"), (k % 4).cast("string")).alias("host"), path.alias("path"), k.alias("id"))
    return asked.join(robots.allowed(asked.select("host", "path").distinct(), files, "mine"), ["host", "path"]).select("id", "allowed")


_HOURLY = "SELECT o_custkey AS area, o_orderdate + to_hours((o_orderkey % 24)::INT) AS start_at, o_orderdate + to_hours((o_orderkey % 24 + CASE WHEN o_orderkey % 9 = 0 THEN 6 ELSE 1 END)::INT) AS end_at, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 40) * 9 / 5.0::DOUBLE + 32 ELSE (o_orderkey % 40)::DOUBLE END AS temp_f FROM orders"


def _forecasts(spark, d):
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))
    until = at + F.make_dt_interval(hours=F.when(k % 9 == 0, 6).otherwise(1))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    period = F.struct(iso(at).alias("startTime"), iso(until).alias("endTime"), (k % 40).cast("double").alias("temperature"), F.when(k % 2 == 0, "C").otherwise("F").alias("temperatureUnit"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("area")).agg(F.to_json(F.struct(F.struct(F.collect_list(period).alias("periods")).alias("properties"))).alias("body"))


@query(f"SELECT area, strftime(start_at, '%Y-%m-%d %H:%M') AS start_at, round(temp_f, 4) AS temp_f FROM ({_HOURLY}) WHERE end_at <= start_at + INTERVAL 2 HOUR")
def hourly_forecast(spark, d):
    return pages.hourly_forecast(_forecasts(spark, d)).select("area", _time("start_at").alias("start_at"), F.round("temp_f", 4).alias("temp_f"))


@query(f"WITH h AS ({_HOURLY}), q AS (SELECT o_orderkey AS id, o_custkey AS area, o_orderdate + to_minutes((o_orderkey * 7 % 1440)::INT) AS at FROM orders) SELECT id, max(round(temp_f, 4)) AS temp_f FROM q JOIN h USING (area) WHERE start_at <= q.at AND end_at > q.at AND end_at <= start_at + INTERVAL 2 HOUR GROUP BY 1")
def forecast_at(spark, d):
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("area"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k * 7 % 1440).cast("int"))).alias("at"))
    h = pages.hourly_forecast(_forecasts(spark, d)).withColumn("hour", F.explode(F.expr("sequence(date_trunc('hour', start_at), date_trunc('hour', end_at), interval 1 hour)")))
    met = asked.withColumn("hour", F.date_trunc("hour", "at")).join(h, ["area", "hour"]).where("start_at <= at and end_at > at")
    return met.groupBy("id").agg(F.max(F.round("temp_f", 4)).alias("temp_f"))


@query("SELECT o_orderkey AS id, 'R&B <live> ' || o_orderkey AS title, strftime(o_orderdate + INTERVAL 20 HOUR, '%Y-%m-%d %H:%M') AS start_at, CASE o_orderkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 12.5 ELSE -1 END::DOUBLE AS price_min, CASE o_orderkey % 3 WHEN 0 THEN 40.0 WHEN 1 THEN 12.5 ELSE -1 END::DOUBLE AS price_max FROM orders WHERE o_orderkey % 8 <> 0")
def paged_calendar(spark, d):
    k = F.col("o_orderkey")
    e = F.struct(k.alias("id"), F.concat(F.lit("R&amp;B &lt;live&gt; "), k.cast("string")).alias("title"), F.when(k % 8 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 20:00:00"))).otherwise("soon").alias("start"), F.when(k % 3 == 0, "$5 - $40").when(k % 3 == 1, "12.50 USD").otherwise("ask").alias("cost"))
    bodies = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.to_json(F.struct(F.collect_list(e).alias("events"))).alias("body"))
    none = F.lit(-1.0)
    return feeds.paged_events(bodies).select("id", "title", _time("start_at").alias("start_at"), F.coalesce("price_min", none).alias("price_min"), F.coalesce("price_max", none).alias("price_max"))


@query("SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 = 1 AND s_suppkey % 20 < 12 THEN 'https://a.example/p' || s_suppkey ELSE '' END AS next, s_suppkey % 3 = 0 AS complete FROM supplier")
def paged_next(spark, d):
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 1, F.concat(F.lit("https://a.example/p"), k.cast("string"))).when(k % 3 == 2, "https://a.example.evil/p")
    bodies = table(spark, d, "supplier").select(k.alias("page_id"), (k % 20).alias("number"), F.to_json(F.struct(url.alias("next"))).alias("body"))
    return feeds.next_page(bodies, F.lit("https://a.example")).select("page_id", F.coalesce("next", F.lit("")).alias("next"), "complete")


@query("SELECT s_suppkey AS feed_id, 'Fair ' || s_suppkey AS title, CASE WHEN s_suppkey % 2 = 0 THEN '2024-06-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') || ' 19:30' ELSE '2024-06-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') || ' 09:05' END AS start_at FROM supplier WHERE s_suppkey % 6 <> 5")
def rss_calendar(spark, d):
    k = F.col("s_suppkey")
    day = F.concat(F.lit("06/"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit("/2024"))
    item = F.concat(F.lit("<item><title>Fair "), k.cast("string"), F.lit("</title><description>Event date: "), day, F.lit(" Event Time: "), F.when(k % 2 == 0, "07:30 PM").otherwise("9:05 am"), F.lit("</description></item><item><title>x</title><description>no date</description></item>"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), item, F.when(k % 6 == 5, "").otherwise("</channel></rss>"))
    return feeds.rss_events(table(spark, d, "supplier").select(k.alias("feed_id"), body.alias("body"))).select("feed_id", "title", _time("start_at").alias("start_at"))


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'test' WHEN o_orderkey % 7 = 0 THEN 'parking' WHEN o_orderkey % 5 = 0 THEN 'no time' ELSE '' END AS skip, (5 + o_orderkey % 10)::DOUBLE AS price_min, (40 + o_orderkey % 30)::DOUBLE AS price_max,
  CASE WHEN o_orderkey % 3 = 0 THEN 'comedy' WHEN o_orderkey % 3 = 1 THEN 'theatre' ELSE 'live_music,film' END AS interests, o_orderkey % 2 = 0 AS adults FROM orders""")
def ticketed_events(spark, d):
    k = F.col("o_orderkey")
    price = lambda a, b: F.struct(a.cast("double").alias("min"), b.cast("double").alias("max"))
    kinds = F.when(k % 3 == 0, F.array(F.lit("theatre"), F.lit("comedy"))).when(k % 3 == 1, F.array(F.lit("theatre"))).otherwise(F.array(F.lit("film"), F.lit("music")))
    e = F.struct(k.cast("string").alias("id"), F.when(k % 7 == 0, "Arena Parking").otherwise("Show").alias("name"), (k % 11 == 0).alias("test"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("start"), (k % 5 == 0).alias("tba"), F.array(price(10 + k % 10, 40 + k % 30), price(5 + k % 10, F.lit(20))).alias("prices"), kinds.alias("kinds"), F.when(k % 2 == 0, True).alias("adults"))
    got = feeds.ticketed_events(table(spark, d, "orders").select(F.to_json(e).alias("body")))
    return got.select("id", F.coalesce("skip", F.lit("")).alias("skip"), "price_min", "price_max", F.array_join("interests", ",").alias("interests"), "adults")


@query("""SELECT o_orderkey AS id, 40.5::DOUBLE + o_orderkey % 100 / 1000.0::DOUBLE AS lat, CASE WHEN o_orderkey % 24 < 20 THEN strftime(o_orderdate + INTERVAL 22 HOUR, '%Y-%m-%d %H:%M') WHEN o_orderkey % 24 = 23 THEN strftime(o_orderdate + INTERVAL 23 HOUR, '%Y-%m-%d %H:%M') ELSE '' END AS end_at FROM orders WHERE o_orderkey % 24 < 20 OR o_orderkey % 24 >= 22""".replace("o_orderdate + INTERVAL 22 HOUR", "CASE WHEN o_orderkey % 24 < 10 THEN o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR ELSE o_orderdate + INTERVAL 22 HOUR END"))
def park_events(spark, d):
    k = F.col("o_orderkey")
    hour = k % 24
    rows = table(spark, d, "orders").where((hour < 20) | (hour >= 22)).select(k.alias("id"), F.lit("A &amp; B").alias("title"), F.concat((F.lit(40.5) + k % 100 / F.lit(1000.0)).cast("string"), F.lit(", -73.9; 1, 2")).alias("coordinates"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(hour < 20, "18:00").otherwise("20:00").alias("start"), F.when(hour < 10, "02:00").when(hour < 20, "22:00").when(hour == 23, "23:00").otherwise("12:00").alias("end"))
    return feeds.park_events(rows).select("id", "lat", _time("end_at").alias("end_at"))


_FILE = "SELECT o_orderkey AS id, o_custkey AS file, CASE WHEN o_orderkey % 31 = 0 THEN 'no title' WHEN o_orderkey % 29 = 0 THEN 'ends before it starts' WHEN o_orderdate + INTERVAL 1 HOUR < TIMESTAMP '1993-01-01' THEN 'over' WHEN o_orderkey % 23 = 0 THEN 'price below nothing' WHEN o_orderkey % 19 = 0 THEN 'url of another kind' ELSE '' END AS reason FROM orders"


def _event_file(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("file"), F.when(k % 31 == 0, " ").otherwise("t").alias("title"), at.alias("start_at"), F.when(k % 29 == 0, at).otherwise(at + F.expr("interval 1 hour")).alias("end_at"), F.when(k % 23 == 0, -1.0).otherwise(1.0).alias("price_min"), F.when(k % 19 == 0, "ftp://x").otherwise("https://x").alias("url"))
    return rows.withColumn("reason", F.coalesce(feeds.event_refused(F.lit("1993-01-01").cast("timestamp")), F.lit("")))


@query(_FILE)
def event_file_rows(spark, d):
    return _event_file(spark, d).select("id", "file", "reason")


@query(f"SELECT file, count(*) AS rows, count(*) FILTER (reason <> '') AS bad, count(*) FILTER (reason <> '') = 0 AS accepted FROM ({_FILE}) GROUP BY 1")
def capture_check(spark, d):
    return feeds.whole_files(_event_file(spark, d), F.col("reason") != "")


@query("""SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 1000 BETWEEN 100 AND 600 AND s_suppkey % 4 NOT IN (1, 2)""")
def places_in_box(spark, d):
    k = F.col("s_suppkey")
    x = (F.lit(-74.0) + k % 1000 / F.lit(1000.0)).cast("float")
    source = lambda dataset, lic: F.struct(F.lit(dataset).alias("dataset"), F.lit(lic).cast("string").alias("license"))
    sources = F.when(k % 4 == 1, F.array().cast("array<struct<dataset:string,license:string>>")).when(k % 4 == 2, F.array(source("m", "CDLA"), source("f", None))).otherwise(F.array(source("m", "CDLA")))
    rows = table(spark, d, "supplier").select(k.alias("id"), F.struct(F.col("s_name").alias("primary")).alias("names"), F.struct(x.alias("xmin"), x.alias("xmax"), F.lit(40.7).cast("float").alias("ymin"), F.lit(40.7).cast("float").alias("ymax")).alias("bbox"), F.lit(0.9).alias("confidence"), F.lit(None).cast("array<string>").alias("websites"), F.lit(None).cast("array<string>").alias("phones"), F.lit("open").alias("operating_status"), F.lit("cafe").alias("basic_category"), sources.alias("sources"))
    return pages.places_scan(rows, -73.9004, -73.3996, 40.0, 41.0, ["CDLA"]).select("id")


@query("SELECT s_suppkey AS page_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['Cafe:' || s_suppkey, 'Event:Y'] ELSE ['Bar:Z'] END) AS item FROM supplier")
def structured_items(spark, d):
    k = F.col("s_suppkey").cast("string")
    two = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Cafe", "name": "'), k, F.lit('"}, {"@type": "Event", "name": "Y"}, {"name": "no type"}]}</script>'))
    html = F.concat(F.lit("<p>x</p>"), F.when(F.col("s_suppkey") % 2 == 0, two).otherwise('<script type="application/ld+json">{"@type": "Bar", "name": "Z"}</script>'))
    got = pages.structured(table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")))
    return got.select("page_id", F.concat_ws(":", "item.`@type`", "item.name").alias("item"))


@query("SELECT o_custkey AS k, max(o_orderdate)::DATE::VARCHAR AS release FROM orders GROUP BY 1")
def newest_release(spark, d):
    """An older release that comes after a newer one overwrites nothing."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release"))
    first = ledger.latest_wins(o.where("release >= '1995-01-01'"), o.where("release < '1995-01-01'"), ["k"], "release")
    return first.select("k", "release")


@query("SELECT count(DISTINCT (user_id, event_type, date_trunc('day', ts))) AS n FROM events")
def first_of_key(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.date_trunc("day", "ts"))
    return stream.first_of_key(e, ["user_id", "event_type", "day"]).agg(F.count("*").alias("n"))


@query(f"SELECT occ_id, venue_id FROM ({A.OCC_SQL}) WHERE start_at >= TIMESTAMP '1996-06-01' AND start_at <= TIMESTAMP '1996-06-01 02:00'")
def happening_soon(spark, d):
    now = F.lit("1996-06-01").cast("timestamp")
    return A.occurrences(spark, d).where((F.col("start_at") >= now) & (F.col("start_at") <= now + F.expr("interval 120 minutes"))).select("occ_id", "venue_id")


RULED = ["Apr-Oct Mo-Fr 09:00-17:00; Nov-Mar Mo-Fr 10:00-16:00", "Mo-Su 08:00-20:00; PH off", "24/7", 'Sa,Su 10:00-02:00 "ring the bell" || Mo 12:00-13:00', "Mo-Fr 09:00-12:00,13:00-18:00; Dec off", "sunrise-sunset"]


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderkey % 6 AS r, dayofweek(o_orderdate) AS w, month(o_orderdate) AS m, day(o_orderdate) AS n, (day(o_orderdate) + 6) // 7 AS k FROM orders),
  h AS (SELECT *, strftime(day, '%m-%d') IN ('01-01', '06-19', '07-04', '11-11', '12-25') OR (w = 1 AND ((m IN (1, 2) AND k = 3) OR (m = 5 AND n > 24) OR (m = 9 AND k = 1) OR (m = 10 AND k = 2))) OR (m = 11 AND w = 4 AND k = 4) AS hol FROM o)
  SELECT id, CASE r WHEN 0 THEN CASE WHEN w BETWEEN 1 AND 5 THEN CASE WHEN m BETWEEN 4 AND 10 THEN '540-1020' ELSE '600-960' END ELSE '' END WHEN 1 THEN CASE WHEN hol THEN '' ELSE '480-1200' END WHEN 2 THEN '0-1440' WHEN 3 THEN CASE w WHEN 6 THEN '600-1560' WHEN 0 THEN '600-1560' WHEN 1 THEN '720-780' ELSE '' END
    WHEN 4 THEN CASE WHEN m = 12 OR w IN (0, 6) THEN '' ELSE '540-720,780-1080' END ELSE 'unread' END AS spans FROM h""")
def dated_hours(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    o = table(spark, d, "orders").select(k.alias("id"), day.alias("day"), F.get(F.array(*map(F.lit, RULED)), (k % 6).cast("int")).alias("opening_hours"))
    days = o.select("day").distinct().withColumn("holiday", dates.new_york_holiday(F.col("day")))
    got = hours.dated_hours(o, days)
    return got.select("id", F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ","), F.lit("unread")).alias("spans"))
