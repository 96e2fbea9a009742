"""Queries of the sun, dated rules, hours in words and choices of records that lie apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import dates, rules, sun, text
from tidegate.operators import selection
from tidegate.session import table
from tidegate.sources import prose_hours

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Where customers stand for places: longitudes and their clocks, from the tropics to beyond the polar circle.
ZONES = [(-74, "America/New_York"), (13, "Europe/Berlin"), (139, "Asia/Tokyo"), (151, "Australia/Sydney")]


def visits(spark, d):
    """Each order as a visit to its customer's place on its date."""
    k = F.col("o_custkey")
    zone = F.get(F.array(*(F.lit(z) for _, z in ZONES)), (k % 4).cast("int"))
    west = F.get(F.array(*(F.lit(x) for x, _ in ZONES)), (k % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", ((k * 37 % 1130) / F.lit(10.0) - 45).alias("lat"), (west + (k * 91 % 1000) / F.lit(100.0) - 5).alias("lon"), zone.alias("zone"), F.col("o_orderdate").cast("date").alias("day"))


VISITS_SQL = f"""(SELECT o_orderkey, o_custkey, (o_custkey * 37 % 1130) / 10.0::DOUBLE - 45 AS lat, {[x for x, _ in ZONES]}[o_custkey % 4 + 1] + (o_custkey * 91 % 1000) / 100.0::DOUBLE - 5 AS lon,
  {[z for _, z in ZONES]}[o_custkey % 4 + 1] AS zone, o_orderdate::DATE AS day FROM orders)"""


@query(f"SELECT o_orderkey, {', '.join(f'coalesce({e}, -1) AS {e}' for e in sun.EVENTS)} FROM {sun.sun_sql(VISITS_SQL, 'day')}")
def sun_times(spark, d):
    """Sunrise, sunset, dawn and dusk of every visit's day."""
    return sun.with_sun(visits(spark, d), F.col("day")).select("o_orderkey", *(F.coalesce(f"sun.{e}", F.lit(-1)).alias(e) for e in sun.EVENTS))


RULES = [
    "sunrise-sunset", "dawn-(dusk+00:30)", "Mo-Fr 08:00-sunset; Sa,Su (sunrise+01:00)-20:00", "(sunset-02:00)-(sunrise+00:15)", "Mo-Fr 08:00-12:00, We 14:00-18:00", "We[1],Th[-1] 09:00-10:00",
    "week 2-52/2 Mo-Su 10:00-12:00,11:30-15:00", "1993-1995 Apr-Oct 09:00-17:00; PH off", "10:00-18:00; Dec 24-Jan 02 off", 'Fr 22:00-03:00 "late" || Sa 12:00-13:00', "Mo 9-10",
]
_SPAN = lambda s, e, n: f"({s})::VARCHAR || '-' || (CASE WHEN {e} > {s} THEN {e} ELSE 1440 + {n} END)::VARCHAR"
_HOLIDAY = "(strftime(day, '%m-%d') IN ('01-01', '06-19', '07-04', '11-11', '12-25') OR (w = 1 AND ((month(day) IN (1, 2) AND nth = 3) OR (month(day) = 5 AND day(day) > 24) OR (month(day) = 9 AND nth = 1) OR (month(day) = 10 AND nth = 2))) OR (month(day) = 11 AND w = 4 AND nth = 4))"


@query(f"""WITH a AS {sun.sun_sql(VISITS_SQL, 'day')}, b AS {sun.sun_sql(VISITS_SQL, 'day + 1')},
  x AS (SELECT a.*, b.sunrise AS nr, b.sunset AS ns, b.dusk AS nk, dayofweek(a.day) AS w, (day(a.day) + 6) // 7 AS nth, (day(last_day(a.day)) - day(a.day)) // 7 AS lefts FROM a JOIN b USING (o_orderkey)),
  h AS (SELECT *, {_HOLIDAY} AS holiday FROM x)
  SELECT o_orderkey, coalesce(CASE o_custkey % 12
    WHEN 0 THEN {_SPAN('sunrise', 'sunset', 'ns')}
    WHEN 1 THEN {_SPAN('dawn', '(dusk + 30)', '(nk + 30)')}
    WHEN 2 THEN CASE WHEN w BETWEEN 1 AND 5 THEN {_SPAN('480', 'sunset', 'ns')} ELSE {_SPAN('(sunrise + 60)', '1200', '1200')} END
    WHEN 3 THEN {_SPAN('greatest(0, sunset - 120)', '(sunrise + 15)', '(nr + 15)')}
    WHEN 4 THEN CASE WHEN w = 3 THEN '480-720,840-1080' WHEN w BETWEEN 1 AND 5 THEN '480-720' ELSE '' END
    WHEN 5 THEN CASE WHEN (w = 3 AND nth = 1) OR (w = 4 AND lefts = 0) THEN '540-600' ELSE '' END
    WHEN 6 THEN CASE WHEN week(day) BETWEEN 2 AND 52 AND week(day) % 2 = 0 THEN '600-900' ELSE '' END
    WHEN 7 THEN CASE WHEN holiday THEN '' WHEN year(day) BETWEEN 1993 AND 1995 AND month(day) BETWEEN 4 AND 10 THEN '540-1020' ELSE '' END
    WHEN 8 THEN CASE WHEN strftime(day, '%m%d') >= '1224' OR strftime(day, '%m%d') <= '0102' THEN '' ELSE '600-1080' END
    WHEN 9 THEN CASE w WHEN 5 THEN '1320-1620' WHEN 6 THEN '720-780' ELSE '' END END, 'unread') AS spans FROM h""")
def rule_hours(spark, d):
    """The hours of each visit's place on its day, by rules with the sun, weeks, dates, additions and fallbacks."""
    rule = F.get(F.array(*map(F.lit, RULES)), (F.col("o_custkey") % 12).cast("int"))
    got = rules.hours_on(visits(spark, d).withColumn("opening_hours", rule), F.col("day"), dates.new_york_holiday(F.col("day")))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return got.select("o_orderkey", F.coalesce(shown, F.lit("unread")).alias("spans"))


#: What pages say, and what week it is read as; by hand.
SAID = [
    ("", "none", ""),
    ("<h2>Hours</h2><p>Monday &#8211; Friday: 11am &ndash; 10pm</p><p>Sat, Sun: noon-midnight</p>", "", "0:720-1440 1:660-1320 2:660-1320 3:660-1320 4:660-1320 5:660-1320 6:720-1440"),
    ("<p>Daily 9am-5pm</p>", "", "0:540-1020 1:540-1020 2:540-1020 3:540-1020 4:540-1020 5:540-1020 6:540-1020"),
    ("<section><h3>Delivery hours</h3><p>We bring it.</p><p>Daily 9am-5pm</p></section><p>Welcome</p><p>Mon-Thu 5-10pm; Fri &amp; Sat 5pm-1am; Sun closed</p>", "", "1:1020-1320 2:1020-1320 3:1020-1320 4:1020-1320 5:1020-1500 6:1020-1500"),
    ("<p>Weekdays 9am to 5pm</p>", "no_weekend", ""),
    ("<p>Sat &amp; Sun 10:00-18:00</p>", "few_days", ""),
    ("<p>Mon-Sun 9am-5pm</p><p>or so</p><p>Tues-Fri 10am-6pm</p>", "two_sets", ""),
    ("<p>Daily 9am-5pm</p><p>Mondays closed</p>", "closed_and_open", ""),
    ("<p>Summer</p><p>Daily 9am-5pm</p>", "none", ""),
    ("<p>Every day 9-5</p>", "none", ""),
    ("<p>Open Tuesday to Sunday</p><p>11:00 - 15:00, 17:30 - 22:00</p><p>Thanksgiving: Thursday 10am-2pm</p>", "", "0:660-900 0:1050-1320 2:660-900 2:1050-1320 3:660-900 3:1050-1320 4:660-900 4:1050-1320 5:660-900 5:1050-1320 6:660-900 6:1050-1320"),
    ("<script>Daily 9am-5pm</script><!-- Daily 9am-5pm --><p>Happy hour</p><p>Daily 4pm-6pm</p>", "none", ""),
]
_Q = lambda s: "'" + s.replace("'", "''") + "'"


@query(f"SELECT page_id, [{', '.join(_Q(r) for _, r, _ in SAID)}][page_id % {len(SAID)} + 1] AS reason, [{', '.join(_Q(w) for _, _, w in SAID)}][page_id % {len(SAID)} + 1] AS weekly FROM pages")
def prose_week(spark, d):
    """The week that each page states in words; the given pages, with a notice put into each."""
    notice = F.get(F.array(*(F.lit(x) for x, _, _ in SAID)), (F.col("page_id") % len(SAID)).cast("int"))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("<hr><p>-</p>"), notice).alias("html"))
    got = prose_hours.hours_of_pages(pages)
    shown = F.array_join(F.transform("weekly", lambda x: F.concat(x["weekday"].cast("string"), F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")
    return got.select("page_id", "reason", F.coalesce(shown, F.lit("")).alias("weekly"))


SIGHTS = ["Croton Point", "Croton Point Park", "Mill Pond", "Mill Pond Nature", "Old Mill", "Fort Hill", "High Rock Beach", "Rockwood Hall", "Rockwood"]


def sights(spark, d):
    """Customers as outings over a wide area, with what tells two records of one outing."""
    k = F.col("c_custkey")
    name = F.get(F.array(*map(F.lit, SIGHTS)), (k * 31 % len(SIGHTS)).cast("int"))
    key = text.match_key(name)
    words = F.array_except(F.split(key, " "), F.array(*map(F.lit, ("park", "beach"))))
    return table(spark, d, "customer").select(k.alias("id"), ((k * 613 % 97) / F.lit(100.0)).alias("merit"), (F.lit(40.5) + (k * 7919 % 30011) / F.lit(60000.0)).alias("lat"), (F.lit(-74.5) + (k * 104729 % 30011) / F.lit(60000.0)).alias("lon"), F.array(key).alias("names"), words.alias("words"))


#: Twins filed twice: named alike within 3 km, or the very same within 10.
def sight_twins(a, b):
    from tidegate.functions import geo

    metres = geo.distance_m(a["lat"], a["lon"], b["lat"], b["lon"])
    return ((metres <= 3000) & selection.shares_words(a["words"], b["words"])) | ((metres <= 10_000) & (a["names"] == b["names"]))


@query(None)
def outings_apart(spark, d):
    """Which outings stay when of any two twins the better one stays."""
    return selection.choose_apart(sights(spark, d), {"names": 10_000.0, "words": 3000.0}, sight_twins)


@query(None)
def new_places_apart(spark, d):
    """Which new places are neither on the spot of a known place of their kind nor of a better new one."""
    from tidegate.functions import geo

    spot = lambda t, k, kind: table(spark, d, t).select(F.col(k).alias("id"), (F.col(k) * 613 % 97 / F.lit(100.0)).alias("merit"), (F.lit(40.70) + (F.col(k) * 7919 % 30011) / F.lit(2_000_000.0)).alias("lat"), (F.lit(-74.00) + (F.col(k) * 104729 % 30011) / F.lit(2_000_000.0)).alias("lon"), F.array((F.col(k) % kind).cast("string")).alias("kinds"))
    twins = lambda a, b: (geo.distance_m(a["lat"], a["lon"], b["lat"], b["lon"]) <= 60) & (a["kinds"] == b["kinds"])
    return selection.choose_apart(spot("customer", "c_custkey", 3), {"kinds": 60.0}, twins, standing=spot("supplier", "s_suppkey", 3))
