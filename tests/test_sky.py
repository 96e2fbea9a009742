"""The sun, dated rules, hours in words, and choices of records that lie apart, against plain Python."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidegate.functions import dates, rules, sun
from tidegate.operators import selection
from tidegate.plans import sky
from tidegate.sources import prose_hours


def test_sun_of_known_days(spark):
    """Almanac times, within three minutes; polar day and night have none."""
    rows = [("2024-06-20", 40.71, -74.01, "America/New_York"), ("2024-12-21", 51.51, -0.13, "Europe/London"), ("2024-06-21", 69.65, 18.96, "Europe/Oslo"), ("2024-12-21", 69.65, 18.96, "Europe/Oslo"), ("2024-03-10", 40.71, -74.01, "America/New_York"), (None, None, None, "UTC"), ("2013-03-05", 50.5, 30.5, "UTC")]
    df = spark.createDataFrame(rows, "day string, lat double, lon double, zone string")
    got = [r.sun for r in sun.with_sun(df, F.col("day").cast("date")).collect()]
    near = lambda have, want: all(abs(a - b) <= 3 for a, b in zip(have, want, strict=True))
    assert near((got[0].sunrise, got[0].sunset), (5 * 60 + 25, 20 * 60 + 31)) and near((got[1].sunrise, got[1].sunset), (8 * 60 + 4, 15 * 60 + 53))
    assert got[2].sunrise is None and got[2].sunset is None and got[3].sunrise is None and got[3].dawn is not None
    assert near((got[4].sunrise,), (7 * 60 + 14,))  # the clock goes forward that night
    assert got[5].dusk is None
    assert tuple(got[6]) == (4 * 60 + 35, 15 * 60 + 47, 4 * 60 + 2, 16 * 60 + 20)  # as published for this method: 04:34:56, 15:46:57, 04:02:17, 16:19:36


RULES = [
    "Mo-Fr 09:00-17:00; Sa 10:00-02:00", "24/7; Dec 25 off", "Apr-Sep 08:00-20:00; Oct-Mar 09:00-17:00; PH off", "We[1],We[3] 10:00-12:00; Fr[-1] 13:00-14:00", "week 1-53/3 Tu 08:00-09:00", "2023 Mo 10:00-11:00; 2024+ Mo 12:00-13:00", "Mo-Su 10:00-14:00, Fr,Sa 13:00-22:00",
    "Nov 15-Feb 10 off || 10:00-11:00", "Mo off; Tu-Su 10:00-18:00 || 12:00-12:30", "Mo-Fr 22:00-03:00,02:30-04:00", "PH 10:00-12:00; Mo-Fr 09:00-10:00", "Dec 20-31,Jan 1-6 closed; 09:30-18:00",
]


def plain_hours(rule, day):
    """Minutes of a day at which a rule has hours that began then, with a reader of its own."""
    names, months = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"], ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    thanks = [d for d in range(1, 31) if dt.date(day.year, 11, d).weekday() == 3][3]
    holiday = (day.month, day.day) in {(1, 1), (6, 19), (7, 4), (11, 11), (12, 25), (11, thanks)} or day.weekday() == 0 and (day.month, (day.day + 6) // 7) in {(1, 3), (2, 3), (9, 1), (10, 2)} or (day.month == 5 and day.weekday() == 0 and day.day > 24)
    last = ((day.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)).day
    main, other = set(), set()
    for group, whole in enumerate(rule.split("||")):
        for part in whole.replace("Mo-Su 10:00-14:00, Fr", "Mo-Su 10:00-14:00;+Fr").split(";"):
            words, adds, ok, named_day = part.strip().lstrip("+").split(), "+" in part, True, False
            spans, i = {(0, 1440)}, 0
            while i < len(words):
                w = words[i]
                if w in ("off", "closed"):
                    spans = set()
                elif w == "24/7":
                    pass
                elif ":" in w:
                    spans = set()
                    for s in w.split(","):
                        (a, b), (c, d) = (map(int, x.split(":")) for x in s.split("-"))
                        spans.add((a * 60 + b, c * 60 + d + 1440 * (c * 60 + d <= a * 60 + b)))
                elif w == "week":
                    i += 1
                    r, step = words[i].split("/")
                    a, b = map(int, r.split("-"))
                    n = day.isocalendar()[1]
                    ok &= a <= n <= b and (n - a) % int(step) == 0
                elif w[:4].isdigit():
                    ok &= day.year >= int(w[:4]) if "+" in w else day.year == int(w[:4])
                elif w[:3] in months:
                    text = w if "-" in w and w.split("-")[1] in months else " ".join(words[i : i + (3 if words[i + 1].count("-") and words[i + 1].split("-")[1] in months else 2)])
                    if "," in words[i + 1] and w == "Dec":
                        ok &= (day.month, day.day) >= (12, 20) or (day.month, day.day) <= (1, 6)
                        i += 2
                    elif text == w:
                        a, b = (months.index(x) + 1 for x in w.split("-"))
                        ok &= a <= day.month <= b if a <= b else day.month >= a or day.month <= b
                    elif "Nov 15-Feb 10" in text:
                        ok &= (day.month, day.day) >= (11, 15) or (day.month, day.day) <= (2, 10)
                        i += 2
                    else:
                        ok &= (day.month, day.day) == (12, 25)
                        i += 1
                else:
                    hit = False
                    for x in w.split(","):
                        if x == "PH":
                            hit |= holiday
                        elif "[" in x:
                            n = int(x[3:-1])
                            hit |= names[day.weekday()] == x[:2] and ((day.day + 6) // 7 == n or (n < 0 and (last - day.day) // 7 + 1 == -n))
                        else:
                            a, _, b = x.partition("-")
                            a, b = names.index(a), names.index(b or a)
                            hit |= (day.weekday() - a) % 7 <= (b - a) % 7
                    ok &= hit
                i += 1
            if ok:
                at = {m for a, b in spans for m in range(a, b)}
                if group:
                    other = at
                else:
                    main = main | at if adds else at
    return main or other


def test_rules_equal_a_minute_by_minute_reading(spark):
    days = [dt.date(2023, 11, 1) + dt.timedelta(i) for i in range(400)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*RULES, "Mo 9-10", "Mo-", None, ""])], "id int, opening_hours string").crossJoin(spark.createDataFrame([(d,) for d in days], "day date"))
    df = df.withColumns({"lat": F.lit(40.7), "lon": F.lit(-74.0), "zone": F.lit("America/New_York"), "parts": F.lit("x")})
    got = {(r.id, r.day): r.spans for r in rules.hours_on(df, F.col("day"), dates.new_york_holiday(F.col("day"))).collect()}
    assert len(got) == 400 * (len(RULES) + 4) and all(v is None for (i, _), v in got.items() if i >= len(RULES))
    for (i, day), spans in got.items():
        if i < len(RULES):
            assert {m for s in spans for m in range(s.start, s.end)} == plain_hours(RULES[i], day), (RULES[i], day)
            assert all(a.end < b.start for a, b in zip(spans, spans[1:], strict=False))


def test_an_end_by_the_sun_is_that_of_its_day(spark):
    df = spark.createDataFrame([(1, "sunset-sunrise", dt.date(2024, 3, 9)), (2, "(sunrise-20:00)-12:00", dt.date(2024, 3, 9))], "id int, opening_hours string, day date").withColumns({"lat": F.lit(40.71), "lon": F.lit(-74.01), "zone": F.lit("America/New_York")})
    got = {r.id: [tuple(s) for s in r.spans] for r in rules.hours_on(df, F.col("day"), F.lit(False)).collect()}
    assert abs(got[1][0][0] - (17 * 60 + 56)) <= 2 and abs(got[1][0][1] - (1440 + 7 * 60 + 15)) <= 2  # the next day's clock is an hour ahead
    assert got[2] == [(0, 720)]


def test_intervals_join_and_part(spark):
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([([(5, 9), (1, 3), (3, 4), (8, 12), (20, 30)], [(0, 2), (6, 7), (11, 25)]), ([], [(1, 2)])], f"a {kind}, b {kind}")
    got = df.select(rules.merged(F.col("a")).alias("m"), rules.without(rules.merged(F.col("a")), rules.merged(F.col("b"))).alias("d")).collect()
    assert [tuple(x) for x in got[0].m] == [(1, 4), (5, 12), (20, 30)] and [tuple(x) for x in got[0].d] == [(2, 4), (5, 6), (7, 11), (25, 30)]
    assert got[1].m == [] and got[1].d == []


LINES = [
    ("Mon-Fri 9am-5pm", None, [([1, 2, 3, 4, 5], [(540, 1020)])]), ("Tues, Thurs & Sat: 11:30 a.m. - 2 p.m.", None, [([2, 4, 6], [(690, 840)])]), ("Fri–Sun noon – midnight", None, [([5, 6, 0], [(720, 1440)])]), ("Mon 11-10pm", None, [([1], [(660, 1320)])]),
    ("Mon 5-10pm, Tue 6pm-2am", None, [([1], [(1020, 1320)]), ([2], [(1080, 1560)])]), ("Mon 9-5", None, None), ("Mon 09:00-17:00", None, [([1], [(540, 1020)])]), ("Mon 09:00-12:00", None, None), ("Mon 9am-9am", None, None), ("Mon 9am-5", None, None),
    ("Mondays closed", None, [([1], [])]), ("7 days a week: 8am-10am, 6pm-8pm", None, [(list(range(7)), [(480, 600), (1080, 1200)])]), ("Open weekends:", "10am - 4pm", [([0, 6], [(600, 960)])]), ("Weekends", "10am - 4pm or so", None), ("Mon 13am-2pm", None, None),
    ("Monday, March 3", None, None), ("Sat - 9am-1pm", None, [([6], [(540, 780)])]), ("sundry 9am-5pm", None, None), ("Mon: 9am-12pm and 1pm-5pm", None, [([1], [(540, 720), (780, 1020)])]), ("Mon. - Wed. 10a-6p", None, [([1, 2, 3], [(600, 1080)])]), ("Every day 24:00-25:00", None, None),
]


@pytest.mark.parametrize("line,following,want", LINES)
def test_lines_are_read(line, following, want):
    got = prose_hours.read_line(line, following)
    assert (got and [(s["days"], [(r["start"], r["end"]) for r in s["ranges"]]) for s in got["statements"]]) == want


def test_lines_and_their_headings(spark):
    html = "<head><title>no</title></head><h1>One <b>two</b></h1>a&nbsp;b<br>c<section><h2>In</h2><p>d &#233;&#x1F600; &amp;lt;</section>e<!-- x --><script>f</script><div>g"
    df = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<!-- open <p>x")], "page_id int, html string")
    got = [(r.page_id, r.pos, r.line, r.heading, r.under) for r in prose_hours.page_lines(df).orderBy("page_id", "pos").collect()]
    assert got == [(1, 1, "One two", True, "One two"), (1, 2, "a b", False, "One two"), (1, 3, "c", False, "One two"), (1, 4, "In", True, "In"), (1, 5, "d é😀 &lt;", False, "In"), (1, 6, "e", False, ""), (1, 7, "g", False, "")]
    week = {r.page_id: r.reason for r in prose_hours.hours_of_pages(df).collect()}
    assert week == dict.fromkeys((1, 2, 3, 4), "none")


def greedy(rows, twins, standing=()):
    taken, out = list(standing), {}
    for r in sorted(rows, key=lambda r: (-(r["merit"] if r["merit"] is not None else -math.inf), r["id"])):
        out[r["id"]] = not any(twins(r, s) for s in taken)
        if out[r["id"]]:
            taken.append(r)
    return out


def metres(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_outings_equal_the_loop_in_order_of_merit(spark):
    sf = "/root/testdata/sf0.01"

    def twins(a, b):
        x, y, m = set(a["words"]), set(b["words"]), metres(a, b)
        return bool(m <= 3000 and x and y and (x <= y or y <= x)) or (m <= 10_000 and a["names"] == b["names"])

    want = greedy([r.asDict() for r in sky.sights(spark, sf).collect()], twins)
    got = {r.id: r.chosen for r in sky.outings_apart(spark, sf).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_new_places_equal_the_loop(spark):
    sf = "/root/testdata/sf0.01"
    rows = [{"id": k, "merit": k * 613 % 97 / 100.0, "lat": 40.70 + (k * 7919 % 30011) / 2_000_000.0, "lon": -74.00 + (k * 104729 % 30011) / 2_000_000.0, "kind": k % 3} for (k,) in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    known = [{"lat": 40.70 + (k * 7919 % 30011) / 2_000_000.0, "lon": -74.00 + (k * 104729 % 30011) / 2_000_000.0, "kind": k % 3} for (k,) in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    want = greedy(rows, lambda a, b: metres(a, b) <= 60 and a["kind"] == b["kind"], known)
    got = {r.id: r.chosen for r in sky.new_places_apart(spark, sf).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_one_spot_with_many_twins_and_odd_rows(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 3), 10.0, 20.0, ["a"]) for i in range(60)] + [(100, 1.0, 10.0, 20.0, []), (101, 1.0, 10.0, 20.0, None), (102, 0.0, None, None, ["a"])]
    df = spark.createDataFrame(rows, "id long, merit double, lat double, lon double, names array<string>").withColumn("b", F.lit(1))
    got = selection.choose_apart(df, {"names": 100.0}, lambda a, b: a["names"] == b["names"]).where("chosen").collect()
    assert sorted(r.id for r in got) == [2, 100, 101, 102]
    assert selection.choose_apart(df.limit(0), {"names": 100.0}, lambda a, b: a["names"] == b["names"]).count() == 0
