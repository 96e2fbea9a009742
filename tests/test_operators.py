"""Small cases for operators whose rules SQL over the tables does not reach."""

from collections import namedtuple
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.functions import clock, hours, text
from tidegate.operators import diff, identity, ledger, ordering, spatial
from tidegate.sources import ical, pages, robots, tags
from tidegate.streaming import events as stream

Row = namedtuple("Row", ordering.NEEDS)
CALENDAR = "BEGIN:VCALENDAR\n{}\nEND:VCALENDAR"


def option(i, category="cafe", standing="ready", merit=0.5, **more):
    base = dict(request_id=1, option_id=i, venue_id=i, parent_id=None, name_key=f"n{i}", category=category, activity=category, kind=None, lat=40.0 + i, lon=-74.0, standing=standing, merit=merit, taste=0.5, lead=None, off=False, age_doubt=False, rank=i)
    return Row(**base | more)


def shown(rows, **kw):
    table = pd.DataFrame(rows, columns=ordering.NEEDS)
    return ordering.first_page_loves(table.iloc[ordering.arrange(table, **kw)])["option_id"].tolist()


def test_variety_leads_and_standing_orders():
    rows = [option(1, merit=0.9), option(2, merit=0.8), option(3, "bar", merit=0.7), option(4, "park", "check_first", 0.95)]
    assert shown(rows) == [1, 3, 2, 4]
    assert shown(rows, narrowed=True)[:2] == [1, 2]


def test_child_waits_for_its_parent_and_never_follows_it():
    rows = [option(1, merit=0.9, parent_id=2), option(2, "museum", merit=0.5)]
    assert shown(rows) == [2]


def test_same_name_nearby_shows_once_but_far_apart_twice():
    near = [option(1, merit=0.9, name_key="x"), option(2, merit=0.8, name_key="x", lat=41.0005)]
    assert shown(near) == [1]
    assert shown([near[0], near[1]._replace(lat=42.0)]) == [1, 2]


def test_age_doubt_comes_last():
    rows = [option(1, merit=0.9, age_doubt=True), option(2, "bar", "check_first", 0.1)]
    assert shown(rows) == [2, 1]


def test_love_reaches_the_first_page_but_not_its_top():
    rows = [option(i, f"c{i}", merit=1 - i / 10) for i in range(1, 6)] + [option(6, "c1", merit=0.1, taste=0.95, lead="books")]
    order = shown([r._replace(taste=0.5 if r.taste == 0.5 else 0.95) for r in rows])
    assert 6 in order[:3]


def test_overnight_hours_wrap(spark):
    df = spark.sql("select array(named_struct('weekday', 6, 'start', 1200, 'end', 1560)) as h")
    got = df.select(clock.open_at(F.col("h"), F.lit(0), F.lit(60)).alias("o"), clock.open_at(F.col("h"), F.lit(0), F.lit(120)).alias("p"), clock.next_opening(F.col("h"), F.lit(6), F.lit(0)).alias("n")).first()
    assert got.o.close == 120 and got.p is None and got.n.open == 1200


def test_name_keys(spark):
    rows = spark.createDataFrame([("The Café & Bar, Inc.", "(914) 555-0100", "https://www.x.org/a")], "n string, p string, u string")
    got = rows.select(text.match_key(F.col("n")).alias("n"), text.phone_key(F.col("p")).alias("p"), text.domain_key(F.col("u")).alias("u")).first()
    assert (got.n, got.p, got.u) == ("cafe and bar", "9145550100", "x.org")


def test_same_show(spark):
    cases = [("Faust", "Faust with Goethe", True), ("Early Bird Blues", "Early Bird Improv", False), ("Winter Tale", "Winter Tale Part III", False), ("Faust", "Faust in the old town hall", False), ("Otters at Herons", "Herons vs. Otters", True), ("", "Faust", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    for r in df.select("want", text.same_show(text.title_words(F.col("a")), text.title_words(F.col("b"))).alias("got")).collect():
        assert r.want == r.got


def test_closure_wins_unless_answered(spark):
    t = datetime
    rows = [
        (1, 1, "business_status", "closed_permanently", "published", "osm", "a", 0.7, t(2024, 1, 1), None),
        (2, 1, "business_status", "operating", "published", "osm", "b", 0.9, t(2024, 1, 2), None),
        (3, 2, "business_status", "closed_permanently", "published", "osm", "a", 0.7, t(2024, 1, 1), None),
        (4, 2, "business_status", "operating", "published", "founder", "b", 0.9, t(2024, 1, 2), None),
    ]
    df = spark.createDataFrame(rows, "claim_id long, subject_id long, attribute string, value string, class string, source string, lineage string, confidence double, seen_at timestamp, valid_until timestamp")
    got = {r.subject_id: r for r in ledger.resolve(df).collect()}
    assert got[1].value == "closed_permanently" and got[1].conflict
    assert got[2].value == "operating" and not got[2].conflict


def test_one_voice_a_lineage(spark):
    rows = [(i, 1, "price", "5", "published", "osm", "same" if i < 3 else "other", 0.5, datetime(2024, 1, i), None) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "claim_id long, subject_id long, attribute string, value string, class string, source string, lineage string, confidence double, seen_at timestamp, valid_until timestamp")
    got = ledger.resolve(df).first()
    assert got.independent == 2 and got.confidence == 0.75


def test_tombstones_wait_for_every_area(spark):
    holders = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "area string, id long")
    read = spark.createDataFrame([], "id long")
    assert [r.id for r in diff.tombstones(holders, read, "a").collect()] == [1]


def test_resolution_follows_the_best_earlier_record(spark):
    records = spark.createDataFrame([(i,) for i in range(1, 8)], "record_id long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.6), (3, 6, 0.9), (6, 7, 0.95)], "a_id long, b_id long, score double")
    links = spark.createDataFrame([(6, 77)], "record_id long, entity_id long")
    got = {r.record_id: (r.entity_id, r.how) for r in identity.resolve(records, pairs, links).collect()}
    assert got == {1: (1, "new"), 2: (1, "auto"), 3: (1, "auto"), 4: (4, "review"), 5: (5, "new"), 6: (77, "linked"), 7: (77, "auto")}


def test_resolution_of_a_long_chain(spark):
    records = spark.range(1, 201).toDF("record_id")
    pairs = spark.range(1, 200).selectExpr("id AS a_id", "id + 1 AS b_id", "0.9D AS score")
    got = identity.resolve(records, pairs).collect()
    assert len(got) == 200 and {r.entity_id for r in got} == {1} and sum(r.how == "new" for r in got) == 1
    with pytest.raises(RuntimeError):
        identity.resolve(records, pairs, rounds=2)


def test_radius_join_everywhere_on_the_globe(spark):
    import math
    import random

    rng = random.Random(3)
    base = [(la, lo) for la in (0.0, 45.0, 59.9, 60.1, 75.0, 89.2, 89.999, -90.0, -89.9995) for lo in (-180.0, -179.9999, -10.0, 0.0, 120.5, 179.9999)]
    points = [(max(-90.0, min(90.0, la + rng.uniform(-0.02, 0.02))), lo + rng.uniform(-0.04, 0.04) * (1 if la < 70 else 40)) for la, lo in base for _ in range(6)]
    points = [(i, la, (lo + 180) % 360 - 180) for i, (la, lo) in enumerate(points)]
    a = spark.createDataFrame(points, "a_id long, a_lat double, a_lon double")
    b = spark.createDataFrame(points, "b_id long, b_lat double, b_lon double")

    def metres(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(h)))

    for reach in (50.0, 900.0, 4000.0):
        got = sorted((r.a_id, r.b_id) for r in spatial.radius_join(a, b, reach).collect())
        assert got == sorted((p[0], q[0]) for p in points for q in points if metres(p, q) <= reach)


def test_pages_of_brackets_take_no_time(spark):
    import time

    pages = [("<" * 1_000_000,), ("<script>" * 120_000,), ("<!--" * 250_000,), ("<a " * 300_000,), ("<a href=" * 120_000,)]
    df = spark.createDataFrame(pages, "h string")
    began = time.monotonic()
    df.select(F.length(text.visible_text(F.col("h"))), F.size(text.links(F.col("h")))).collect()
    assert time.monotonic() - began < 15


def test_links_and_prices(spark):
    html = """<a href="/one">1</a><A class=x HREF='/two'>2</A><a href=/three>3</a><abbr href="/no">"""
    got = spark.createDataFrame([(html, "from $1,200 or $12345.50, $ 7")], "h string, t string").select(text.links(F.col("h")).alias("l"), text.stated_prices(F.col("t")).alias("p")).first()
    assert got.l == ["/one", "/two", "/three"] and got.p == [1200.0, 12345.5, 7.0]


def test_calendar_keeps_every_event():
    feed = CALENDAR.format("\n".join(f"BEGIN:VEVENT\nUID:{i}\nDTSTART:20240601T100000Z\nEND:VEVENT" for i in range(2500)))
    assert len(ical.events_of(feed)) == 2500
    assert [ical.length(x) for x in ("P1DT2H", "-PT15M", "P2W", "PT", "P1H", "x")] == [timedelta(days=1, hours=2), timedelta(minutes=-15), timedelta(weeks=2), None, None, None]


def test_quotes_are_whole(spark):
    from tidegate.operators import quotes

    pages = spark.createDataFrame([(1, "so a b c  d e\nf g end"), (2, "a b c d e x"), (3, None), (4, "hi"), (5, "hix")], "page_id long, text string")
    asked = spark.createDataFrame([(1, "a b c d e f g"), (2, "hi"), (3, ""), (4, None), (5, "c d e")], "quote_id long, quote string")
    got = sorted((r.page_id, r.quote_id) for r in quotes.on_page(pages, asked).collect())
    assert got == [(1, 1), (1, 5), (2, 5), (4, 2)]
    assert quotes.on_page(pages, asked.limit(0)).count() == 0


def test_calendar_feed(spark):
    body = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Jazz\\, live and\r\n  loud\r\nDTSTART;TZID=America/New_York:20240601T200000\r\nDURATION:PT1H30M\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20240602\r\nSTATUS:CANCELLED\r\nRRULE:FREQ=DAILY\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = ical.parse(spark.createDataFrame([(7, body), (8, None)], "feed_id long, body string")).orderBy("uid").collect()
    assert got[0].title == "Jazz, live and loud" and got[0].start_at == datetime(2024, 6, 2, 0, 0) and got[0].end_at == datetime(2024, 6, 2, 1, 30)
    assert got[1].all_day and got[1].cancelled and got[1].recurring and len(got) == 2
    assert ical.whole(body) and not ical.whole(body[:-5])


def test_robots_longest_rule_wins(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n\nUser-agent: other\nDisallow: /")], "host string, body string")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/z.pdf"), ("h", "/z.pdfx"), ("g", "/a")], "host string, path string")
    got = {(r.host, r.path): r.allowed for r in robots.allowed(paths, files, "mine").collect()}
    assert got == {("h", "/a/x"): False, ("h", "/a/b/c"): True, ("h", "/z.pdf"): False, ("h", "/z.pdfx"): True, ("g", "/a"): True}


def test_structured_blocks(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Cafe", "name": "X"}, {"@type": "Event", "name": "Y"}]}</script><script type="application/ld+json">{"@type": "Bar", "name": "Z"}</script>'
    got = pages.structured(spark.createDataFrame([(1, html)], "page_id long, html string")).select("item.name").collect()
    assert sorted(r.name for r in got) == ["X", "Y", "Z"]


def test_visible_text(spark):
    html = "<p>A&amp;B <b>c</b></p><script>x()</script><!-- no -->d"
    assert spark.createDataFrame([(html,)], "h string").select(text.visible_text(F.col("h"))).first()[0] == "A&B c d"


def test_open_places_need_a_license(spark):
    schema = "id string, names struct<primary:string>, bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>, confidence double, websites array<string>, phones array<string>, operating_status string, basic_category string, sources array<struct<dataset:string,license:string>>"
    row = lambda i, x, s: (i, (i,), (x, x, 41.0, 41.0), 0.9, None, None, "open", "cafe", s)
    df = spark.createDataFrame([row("a", -74.0, [("m", "CDLA")]), row("b", -74.0, []), row("c", -74.0, [("m", "CDLA"), ("f", None)]), row("d", 0.0, [("m", "CDLA")])], schema)
    assert [r.id for r in pages.places_scan(df, -75, -73, 40, 42, ["CDLA"]).collect()] == ["a"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed_counts(live, late="365 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("hours").collect()}
    assert got == {tuple(r) for r in stream.windowed_counts(source).collect()}


def test_late_old_version_changes_nothing(spark, tmp_path):
    for i, rows in enumerate(([(1, 3, "c"), (1, 2, "b")], [(1, 1, "a"), (2, 1, "x")])):
        spark.createDataFrame(rows, "id long, version long, body string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    live = spark.readStream.schema("id long, version long, body string").parquet(str(tmp_path / "in" / "*"))
    q = stream.newest_versions(live).writeStream.outputMode("append").format("memory").queryName("versions").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("versions").collect()} == {(1, 3, "c"), (2, 1, "x")}


def test_hours_rules():
    week = lambda days, *span: [(d, *span) for d in days]
    assert hours.parse("Mo-Fr 09:00-17:00; Sa 10:00-02:00") == (sorted(week((1, 2, 3, 4, 5), 540, 1020) + [(6, 600, 1560)]), False)
    assert hours.parse("24/7")[0] == week(range(7), 0, 1440)
    assert hours.parse("08:00-12:00,13:00-18:00; Su,We off; PH off") == (sorted(week((1, 2, 4, 5, 6), 480, 720) + week((1, 2, 4, 5, 6), 780, 1080)), True)
    assert hours.parse("Fr-Mo 10:00-11:00")[0] == week((0, 1, 5, 6), 600, 660)
    assert hours.parse("sunrise-sunset") == (None, False) and hours.parse(None) == (None, False)


def test_hours_join_back(spark):
    df = spark.createDataFrame([(1, "Mo 09:00-10:00"), (2, None), (3, "Mo 09:00-10:00"), (4, "dawn")], "id long, opening_hours string")
    got = {r.id: r for r in hours.weekly_hours(df).collect()}
    assert got[1].hours == got[3].hours and got[1].hours[0].start == 540 and got[2].hours is None and got[4].unread


def test_tags_become_facts(spark):
    schema = "external_id string, tags map<string,string>, edited timestamp"
    rows = [("n/1", {"amenity": "cafe", "name": "X", "opening_hours": "24/7", "wheelchair": "yes", "min_age": "200"}, datetime(2024, 1, 1)), ("n/2", {"disused:amenity": "bar", "name": "Y"}, None), ("n/3", {"tourism": "museum", "fee": "yes"}, None), ("n/4", {"leisure": "sports_centre", "sport": "climbing"}, None)]
    now = F.lit("2024-06-01").cast("timestamp")
    got = {(r.external_id, r.attribute): (r.value, r["class"], r.confidence) for r in tags.facts(spark.createDataFrame(rows, schema), now).collect()}
    assert got["n/1", "category"] == ("cafe", "published", 0.8) and got["n/1", "admission"] == ("walk_in", "estimate", 0.55)
    assert got["n/1", "opening_hours"][2] == 0.595 and ("n/1", "age_limit") not in got and got["n/1", "business_status"][2] == 0.5
    assert got["n/2", "business_status"] == ("closed_permanently", "published", 0.75) and ("n/2", "admission") not in got
    assert got["n/3", "admission"] == ("ticket", "published", 0.6) and got["n/3", "price"][0] == "paid" and got["n/4", "category"][0] == "activity"
