"""Queries of the request path: reach, gates, scores, orderings and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions import clock, geo, text
from tidegate.operators import feasibility, ordering, scoring, spatial
from tidegate.plans import adapters as A
from tidegate.session import table

HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_SPEED = "CASE WHEN ({h}) BETWEEN 7 AND 10 OR ({h}) BETWEEN 16 AND 19 THEN {p} WHEN ({h}) >= 22 OR ({h}) < 6 THEN {n} ELSE {d} END * 1000.0 / 60.0"
TOWN = lambda h: _SPEED.format(h=h, p="25.0::DOUBLE", n="45.0::DOUBLE", d="35.0::DOUBLE")
ROAD = lambda h: _SPEED.format(h=h, p="40.0::DOUBLE", n="70.0::DOUBLE", d="60.0::DOUBLE")


def drive_sql(d: str, h: str) -> str:
    road = f"(least({d}, 5000.0) * 1.4 + greatest(0.0, {d} - 5000.0) * 1.25)"
    return f"(least({road}, 4000.0) / ({TOWN(h)}) + ({road} - least({road}, 4000.0)) / ({ROAD(h)}))"


EVALUATED_SQL = f"""
v AS ({A.venues_sql('customer')}), r AS ({A.REQUESTS_SQL}),
p AS (SELECT *, {HAVERSINE.format(a='r_', b='')} AS distance, CASE mode WHEN 'walk' THEN 25 WHEN 'drive' THEN 30 ELSE 35 END AS max_travel FROM r CROSS JOIN v),
t AS (SELECT *, ceil(CASE mode WHEN 'walk' THEN distance * 1.3 / 80.0 WHEN 'transit' THEN distance * 1.3 / 300.0 + 8.0 ELSE {drive_sql('distance', '(at_min // 60)')} + 8.0 END)::INT AS travel FROM p),
near AS (SELECT *, at_min + travel AS arrival, at_min + window_min AS deadline FROM t
  WHERE distance <= CASE mode WHEN 'walk' THEN 25 * 80.0 / 1.3 WHEN 'transit' THEN 27 * 300.0 / 1.3 ELSE 5000 + (4000 + (22.0 - 4000 / 750.0) * 70000 / 60.0 - 7000) / 1.25 END),
c AS (SELECT *, CASE WHEN arrival >= open_min AND arrival < close_min THEN close_min WHEN arrival + 1440 >= open_min AND arrival + 1440 < close_min THEN close_min - 1440 END AS closes FROM near),
u AS (SELECT *, greatest(0, least(deadline, closes) - arrival) AS useful FROM c),
e AS (SELECT *, CASE WHEN status LIKE 'closed%' THEN 'CLOSED_PERMANENTLY' WHEN youngest < min_age THEN 'AGE_LIMIT' WHEN travel > max_travel THEN 'TOO_FAR' WHEN closes IS NULL THEN 'CLOSED_ON_ARRIVAL'
  WHEN useful < min_useful THEN 'NOT_ENOUGH_TIME' WHEN price > budget THEN 'OVER_BUDGET' WHEN need_wheelchair AND wheelchair = 'no' THEN 'NOT_ACCESSIBLE' END AS excluded_by,
  (status IS NULL)::INT + (budget IS NOT NULL AND price IS NULL)::INT + (need_wheelchair AND wheelchair IS NULL)::INT AS n_doubts FROM u),
x AS (SELECT *, CASE WHEN excluded_by IS NOT NULL THEN 'ineligible' WHEN n_doubts > 0 THEN 'check_first' ELSE 'ready' END AS class FROM e)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feasibility.evaluate(A.requests(spark), A.venues(spark, sf_dir, "customer"))


ONE_REQUEST = 7


def one_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a single search."""
    return scoring.ranked(scored(spark, sf_dir, A.requests(spark).where(f"request_id = {ONE_REQUEST}")))


def scored(spark: SparkSession, sf_dir: str, requests: DataFrame | None = None) -> DataFrame:
    pairs = evaluated(spark, sf_dir) if requests is None else feasibility.evaluate(requests, A.venues(spark, sf_dir, "customer"))
    rows = pairs.where("class <> 'ineligible'")
    fit = scoring.fit_score(F.col("travel"), F.col("max_travel"), F.col("window_min"), F.col("useful"), F.col("min_useful"), F.col("min_useful") * 2)
    complete = (F.col("status").isNotNull().cast("int") + F.col("price").isNotNull().cast("int") + F.lit(1)) / 3
    appeal = scoring.appeal_score(event=F.lit(False), landmark=F.col("venue_id") % 50 == 0, completeness=complete, part=F.when(F.col("arrival").between(600, 1200), "prime").otherwise("fair"), chain=F.col("venue_id") % 9 == 0, boost=F.lit(0.0))
    out = feasibility.once(feasibility.once(rows, "fit", fit), "appeal", appeal).withColumn("novelty", F.when(F.col("venue_id") % 13 == F.col("request_id") % 13, 0.4).otherwise(1.0))
    return out.withColumn("merit", F.round(scoring.merit(F.col("appeal"), F.col("fit"), F.col("novelty")), 6))


SCORED_SQL = f"""{EVALUATED_SQL},
f AS (SELECT *, greatest(0.0, least(1.0, (window_min - 90) / 150.0::DOUBLE)) AS long, least(max_travel, greatest(10.0, window_min * 0.25::DOUBLE)) AS reach,
  1 - 2 * travel / (2 * travel + min_useful * 2)::DOUBLE AS worth FROM x WHERE class <> 'ineligible'),
g AS (SELECT *, round(greatest(0.0, least(1.0, 0.4::DOUBLE * ((1 - long * 0.5::DOUBLE) * greatest(0.0, 1 - travel / reach) + long * 0.5::DOUBLE * worth)
  + 0.3::DOUBLE * greatest(0.0, least(1.0, (useful - min_useful) / greatest(15.0::DOUBLE, min_useful))) + 0.15::DOUBLE * 0.5::DOUBLE + 0.15::DOUBLE * 0.5::DOUBLE)), 3) AS fit,
  round(greatest(0.0, least(1.0, 0.5::DOUBLE + CASE WHEN venue_id % 50 = 0 THEN 0.1::DOUBLE ELSE 0 END + 0.1::DOUBLE * ((status IS NOT NULL)::INT + (price IS NOT NULL)::INT + 1) / 3
  + CASE WHEN arrival BETWEEN 600 AND 1200 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN venue_id % 9 = 0 THEN 0.15::DOUBLE ELSE 0 END)), 3) AS appeal,
  CASE WHEN venue_id % 13 = request_id % 13 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS novelty FROM f),
s AS (SELECT *, round(appeal * 0.5::DOUBLE + fit * 0.35::DOUBLE + novelty * 0.15::DOUBLE, 6) AS merit FROM g)"""


def near_open_ranked(spark, d):
    return scoring.ranked(scored(spark, d)).select("request_id", "place", "venue_id", "name", "class", "travel", "useful", "merit")


def page_slice(spark, d):
    return scoring.ranked(scored(spark, d), offset=6).select("request_id", "place", "venue_id", "merit")


RANK_SQL = "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE class WHEN 'ready' THEN 0 ELSE 1 END, merit DESC, travel, name, venue_id)::INT AS place FROM s"


def travel_estimate(spark, d):
    pairs = feasibility.in_reach(A.requests(spark), A.venues(spark, d))
    hour = F.floor(F.col("at_min") / 60).cast("int")
    return pairs.select("request_id", "venue_id", "mode", geo.travel_minutes(F.col("distance"), F.col("mode"), hour).alias("minutes"), F.round("distance", 1).alias("metres"))


def reach_inverse(spark, d):
    """How far each order's customer gets in its minutes, by its mode."""
    o = table(spark, d, "orders")
    mode = F.get(F.array(*map(F.lit, ("walk", "drive", "transit"))), (F.col("o_custkey") % 3).cast("int"))
    return o.select("o_orderkey", F.round(geo.reach_m(mode, (5 + F.col("o_orderkey") % 116).cast("int")), 2).alias("metres"))


def drive_two_speed(spark, d):
    """Wheel time over as many metres as an order's price has whole units."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(geo.drive_minutes(F.floor("o_totalprice").cast("double"), F.col("o_orderkey") % 24), 6).alias("minutes"))


def feasibility_codes(spark, d):
    return evaluated(spark, d).select("request_id", "venue_id", "class", F.coalesce("excluded_by", F.lit("")).alias("excluded_by"), "travel", "useful")


def exclusion_histogram(spark, d):
    return evaluated(spark, d).where("excluded_by is not null").groupBy("request_id", "excluded_by").agg(F.count("*").alias("n"))


def relaxation_offer(spark, d):
    return scoring.relaxations(evaluated(spark, d), scoring.OFFERS).select("request_id", "code", "admits", F.col("place").cast("int").alias("place"))


_OFFERS = ", ".join(f"({i}, '{code}', '{x}')" for i, (code, xs) in enumerate(scoring.OFFERS) for x in xs)


def fit_and_appeal(spark, d):
    return scored(spark, d).select("request_id", "venue_id", "fit", "appeal", "merit")


def open_share_peers(spark, d):
    return scoring.open_shares(A.venues(spark, d, "customer"), list(range(480, 1440, 120)))


def likely_open(spark, d):
    shares = open_share_peers(spark, d)
    return shares.where(scoring.likely_open(F.col("listed"), F.col("open"))).select("category", "slot", F.round(scoring.likely_cost(F.col("listed"), F.col("open")), 6).alias("cost"))


SHARES_SQL = f"""h AS (SELECT category, slot, count(*) AS listed,
  count(*) FILTER ((open_min <= slot AND close_min >= slot + 60) OR (open_min <= slot + 1440 AND close_min >= slot + 1500)) AS open
  FROM ({A.venues_sql('customer')}) CROSS JOIN (SELECT range::INT AS slot FROM range(480, 1440, 120)) GROUP BY ALL)"""


def coverage_cells(spark, d):
    per = evaluated(spark, d).groupBy("request_id", "at_min", "window_min", "mode").agg(F.count_if(F.col("class") != "ineligible").alias("eligible"), F.count_if(F.col("class") == "ready").alias("ready"))
    return per.groupBy("at_min", "window_min").agg(F.count("*").alias("contexts"), F.count_if(F.col("eligible") >= 3).alias("with_three"), F.count_if(F.col("ready") >= 3).alias("with_three_ready"), F.round(F.avg("eligible"), 4).alias("avg_eligible"))


def coverage_cube(spark, d):
    per = evaluated(spark, d).groupBy("request_id", "at_min", "mode").agg(F.count_if(F.col("class") != "ineligible").alias("eligible"))
    return per.cube("at_min", "mode").agg(F.count("*").alias("contexts"), F.count_if(F.col("eligible") >= 3).alias("with_three"), F.sum("eligible").alias("eligible"))


def coverage_pivot(spark, d):
    per = evaluated(spark, d).where("class <> 'ineligible'")
    p = per.groupBy("at_min").pivot("mode", ["walk", "drive", "transit"]).agg(F.count(F.lit(1)))  # a pair of request and venue is one row
    return p.select("at_min", *(F.coalesce(F.col(m), F.lit(0)).alias(m) for m in ("walk", "drive", "transit")))


def grid_radius_join(spark, d):
    a = A.venues(spark, d).select(F.col("venue_id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = A.venues(spark, d, "customer").select(F.col("venue_id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return a, b


def radius_pairs(spark, d):
    return spatial.radius_join(*grid_radius_join(spark, d), 800.0).select("a_id", "b_id", F.round("metres", 2).alias("metres"))


def knn_nearest(spark, d):
    return spatial.nearest(*grid_radius_join(spark, d), 3, 1200.0).select("a_id", "b_id", F.col("place").cast("int").alias("place"))


def no_neighbour(spark, d):
    return spatial.without_neighbour(*grid_radius_join(spark, d), 9.0).select("a_id")


_PAIRS = f"a AS (SELECT venue_id AS a_id, lat AS a_lat, lon AS a_lon FROM ({A.venues_sql()})), b AS (SELECT venue_id AS b_id, lat AS b_lat, lon AS b_lon FROM ({A.venues_sql('customer')})), m AS (SELECT a_id, b_id, {HAVERSINE.format(a='a_', b='b_')} AS metres FROM a CROSS JOIN b)"


def _weekly(spark, d):
    v = A.venues(spark, d)
    days = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda x: x != F.col("venue_id") % 7), lambda x: F.named_struct(F.lit("weekday"), x, F.lit("start"), F.col("open_min"), F.lit("end"), F.col("close_min")))
    asked = F.explode(F.array(*(F.struct(F.lit(w).alias("weekday"), F.lit(m).alias("minute")) for w in (0, 3, 6) for m in (30, 600, 1380))))
    return v.select("venue_id", days.alias("hours"), asked.alias("q")).select("venue_id", "hours", "q.weekday", "q.minute")


def weekly_open_now(spark, d):
    return _weekly(spark, d).select("venue_id", "weekday", "minute", clock.open_at(F.col("hours"), F.col("weekday"), F.col("minute")).alias("o")).select("venue_id", "weekday", "minute", F.col("o").isNotNull().alias("is_open"), F.coalesce("o.close", F.lit(-1)).alias("closes"))


def next_opening(spark, d):
    return _weekly(spark, d).select("venue_id", "weekday", "minute", clock.next_opening(F.col("hours"), F.col("weekday"), F.col("minute")).alias("o")).select("venue_id", "weekday", "minute", F.coalesce("o.open", F.lit(-1)).alias("opens"))


_WEEKLY = f"""w AS (SELECT venue_id, open_min, close_min, weekday, minute FROM ({A.venues_sql()}) CROSS JOIN (SELECT unnest([0, 3, 6]) AS weekday) CROSS JOIN (SELECT unnest([30, 600, 1380]) AS minute)),
i AS (SELECT venue_id, weekday, minute, open_min + s * 1440 AS o, close_min + s * 1440 AS c FROM w CROSS JOIN (SELECT unnest([-1, 0, 1]) AS s) WHERE (weekday + s + 7) % 7 <> venue_id % 7)"""


# When kinds of places are at their best, in minutes that may pass midnight.
PARTS = [("cafe", "prime", 420, 690), ("cafe", "fair", 690, 1110), ("bar", "prime", 1020, 1560), ("bar", "fair", 960, 1020), ("restaurant", "prime", 690, 870), ("restaurant", "prime", 1050, 1320), ("restaurant", "fair", 480, 690), ("restaurant", "fair", 870, 1050), ("restaurant", "fair", 1320, 1500)]


def daypart_class(spark, d):
    """The part of the day at which each occurrence begins, for the kind of its place."""
    def of(category):
        hit = lambda part: reduce(lambda x, y: x | y, (F.lit(False), *(((F.col("minute") >= a) & (F.col("minute") < b)) | ((F.col("minute") + 1440 >= a) & (F.col("minute") + 1440 < b)) for c, p, a, b in PARTS if c == category and p == part)))
        return F.when(hit("prime"), "prime").when(hit("fair"), "fair").otherwise("off")

    kinds = ("cafe", "bar", "restaurant")
    occ = A.occurrences(spark, d).select("occ_id", (F.hour("start_at") * 60 + F.minute("start_at")).alias("minute"), F.get(F.array(*map(F.lit, kinds)), (F.col("venue_id") % 3).cast("int")).alias("category"))
    return occ.select("occ_id", "category", F.coalesce(*(F.when(F.col("category") == c, of(c)) for c in kinds)).alias("part"))


def event_feasible(spark, d):
    occ = A.occurrences(spark, d)
    at = F.date_trunc("day", "start_at") + F.make_dt_interval(mins=((F.col("occ_id") * 7) % 1440).cast("int"))
    rows = occ.withColumn("arrive_at", at).withColumn("deadline_at", F.col("arrive_at") + F.make_dt_interval(mins=F.lit(240)))
    return feasibility.event_codes(rows).select("occ_id", "useful", F.coalesce("excluded_by", F.lit("")).alias("excluded_by"))


def budget_gate(spark, d):
    v = A.venues(spark, d).crossJoin(F.broadcast(spark.range(4).select((F.col("id") * 15).cast("int").alias("budget"), (F.col("id") == 0).alias("free_only"))))
    return v.select("venue_id", "budget", feasibility.price_standing(F.col("price"), F.col("budget"), F.col("free_only")).alias("standing"))


def kitchen_last_order(spark, d):
    v = A.venues(spark, d).select("venue_id", (F.col("close_min") - 60).alias("kitchen"), F.explode(F.sequence(F.lit(600), F.lit(1440), F.lit(60))).alias("arrival"))
    return v.select("venue_id", "arrival", feasibility.kitchen_open(F.col("arrival"), F.col("kitchen")).alias("serves"))


def detour_payback(spark, d):
    rows = scored(spark, d).withColumn("near", F.col("travel") <= 15)
    group = Window.partitionBy("request_id", "category")
    near_ready = F.max((F.col("near") & (F.col("class") == "ready")).cast("int")).over(group) == 1
    cost = F.when(~F.col("near") & near_ready, 0.1 * F.least(F.lit(1.0), (F.col("travel") - 15) / 20.0)).otherwise(0.0)
    return rows.select("request_id", "venue_id", F.round(cost, 4).alias("cost"))


def displayable(spark, d):
    """The eligible options of all requests, with what their display order depends on."""
    rows = scored(spark, d)
    kinds = F.create_map(*(F.lit(x) for pair in (("cafe", "eat"), ("restaurant", "eat"), ("bar", "drink"), ("park", "outdoors"), ("museum", "culture"), ("library", "culture"), ("cinema", "show"), ("bookshop", "shop")) for x in pair))
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("class") == "ready", 0).otherwise(1), F.desc("merit"), "travel", "name", "venue_id")
    return rows.select(
        "request_id", F.col("venue_id").alias("option_id"), "venue_id", F.when(F.col("venue_id") % 20 == 0, F.col("venue_id") + 1).alias("parent_id"), text.match_key(F.col("name")).alias("name_key"), "category",
        kinds[F.col("category")].alias("activity"), F.when(F.col("venue_id") % 3 == 0, F.concat("category", F.lit(":x"))).alias("kind"), "lat", "lon", F.col("class").alias("standing"), "merit",
        F.when(F.col("venue_id") % 31 == 0, 0.9).otherwise(0.5).alias("taste"), F.when(F.col("venue_id") % 31 == 0, F.col("category")).alias("lead"), (F.col("venue_id") % 23 == 0).alias("off"), F.lit(False).alias("age_doubt"), F.row_number().over(order).alias("rank"),
    )


def diverse_order(spark, d):
    return ordering.display_order(displayable(spark, d))


QUERIES = {
    "near_open_ranked": near_open_ranked, "page_slice": page_slice, "travel_estimate": travel_estimate, "reach_inverse": reach_inverse, "drive_two_speed": drive_two_speed, "feasibility_codes": feasibility_codes,
    "exclusion_histogram": exclusion_histogram, "relaxation_offer": relaxation_offer, "fit_and_appeal": fit_and_appeal, "open_share_peers": open_share_peers, "likely_open": likely_open, "coverage_cells": coverage_cells,
    "coverage_cube": coverage_cube, "coverage_pivot": coverage_pivot, "radius_pairs": radius_pairs, "knn_nearest": knn_nearest, "no_neighbour": no_neighbour, "weekly_open_now": weekly_open_now, "next_opening": next_opening,
    "daypart_class": daypart_class, "event_feasible": event_feasible, "budget_gate": budget_gate, "kitchen_last_order": kitchen_last_order, "detour_payback": detour_payback, "diverse_order": diverse_order,
}

_REACH = lambda h: f"CASE WHEN w <= 4000 / ({TOWN(h)}) THEN w * ({TOWN(h)}) ELSE 4000 + (w - 4000 / ({TOWN(h)})) * ({ROAD(h)}) END"

ORACLES = {
    "near_open_ranked": f"WITH {SCORED_SQL} SELECT request_id, place, venue_id, name, class, travel, useful, merit FROM ({RANK_SQL}) WHERE place <= 3",
    "page_slice": f"WITH {SCORED_SQL} SELECT request_id, place, venue_id, merit FROM ({RANK_SQL}) WHERE place BETWEEN 7 AND 9",
    "travel_estimate": f"WITH {EVALUATED_SQL.replace(A.venues_sql('customer'), A.venues_sql())} SELECT request_id, venue_id, mode, travel AS minutes, round(distance, 1) AS metres FROM near",
    "reach_inverse": f"""WITH o AS (SELECT o_orderkey, o_custkey % 3 AS mode, (5 + o_orderkey % 116)::INT AS minutes FROM orders), b AS (SELECT DISTINCT minutes FROM o), h AS (SELECT minutes, greatest(0, minutes - 8)::DOUBLE AS w, range AS hour FROM b CROSS JOIN range(24)),
      g AS (SELECT minutes, {_REACH('hour')} AS road FROM h), d AS (SELECT minutes, max(CASE WHEN road <= 7000 THEN road / 1.4::DOUBLE ELSE 5000 + (road - 7000) / 1.25::DOUBLE END) AS far FROM g GROUP BY minutes)
      SELECT o_orderkey, round(CASE mode WHEN 0 THEN minutes * 80.0::DOUBLE / 1.3::DOUBLE WHEN 1 THEN far ELSE greatest(0, minutes - 8) * 300.0::DOUBLE / 1.3::DOUBLE END, 2) AS metres FROM o JOIN d USING (minutes)""",
    "drive_two_speed": f"SELECT o_orderkey, round({drive_sql('floor(o_totalprice)::DOUBLE', '(o_orderkey % 24)')}, 6) AS minutes FROM orders",
    "feasibility_codes": f"WITH {EVALUATED_SQL} SELECT request_id, venue_id, class, coalesce(excluded_by, '') AS excluded_by, travel, useful FROM x",
    "exclusion_histogram": f"WITH {EVALUATED_SQL} SELECT request_id, excluded_by, count(*) AS n FROM x WHERE excluded_by IS NOT NULL GROUP BY ALL",
    "relaxation_offer": f"""WITH {EVALUATED_SQL}, o(i, code, excluded_by) AS (VALUES {_OFFERS}), g AS (SELECT request_id, code, i, count(*) AS admits FROM x JOIN o USING (excluded_by) GROUP BY ALL)
      SELECT request_id, code, admits, place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i)::INT AS place FROM g) WHERE place <= 3""",
    "fit_and_appeal": f"WITH {SCORED_SQL} SELECT request_id, venue_id, fit, appeal, merit FROM s",
    "open_share_peers": f"WITH {SHARES_SQL} SELECT * FROM h",
    "likely_open": f"WITH {SHARES_SQL} SELECT category, slot, round(0.02::DOUBLE + (1 - open / listed) * 0.25::DOUBLE, 6) AS cost FROM h WHERE listed >= 8 AND open >= 0.8 * listed",
    "coverage_cells": f"""WITH {EVALUATED_SQL}, p AS (SELECT request_id, at_min, window_min, mode, count(*) FILTER (class <> 'ineligible') AS eligible, count(*) FILTER (class = 'ready') AS ready FROM x GROUP BY ALL)
      SELECT at_min, window_min, count(*) AS contexts, count(*) FILTER (eligible >= 3) AS with_three, count(*) FILTER (ready >= 3) AS with_three_ready, round(avg(eligible), 4) AS avg_eligible FROM p GROUP BY ALL""".replace(", p AS (SELECT request_id, at_min", ", pp AS (SELECT request_id, at_min").replace("FROM p GROUP BY ALL", "FROM pp GROUP BY ALL"),
    "coverage_cube": f"""WITH {EVALUATED_SQL}, pp AS (SELECT request_id, at_min, mode, count(*) FILTER (class <> 'ineligible') AS eligible FROM x GROUP BY ALL)
      SELECT at_min, mode, count(*) AS contexts, count(*) FILTER (eligible >= 3) AS with_three, sum(eligible)::BIGINT AS eligible FROM pp GROUP BY CUBE (at_min, mode)""",
    "coverage_pivot": f"WITH {EVALUATED_SQL} SELECT at_min, count(*) FILTER (mode = 'walk') AS walk, count(*) FILTER (mode = 'drive') AS drive, count(*) FILTER (mode = 'transit') AS transit FROM x WHERE class <> 'ineligible' GROUP BY at_min",
    "radius_pairs": f"WITH {_PAIRS} SELECT a_id, b_id, round(metres, 2) AS metres FROM m WHERE metres <= 800",
    "knn_nearest": f"WITH {_PAIRS} SELECT a_id, b_id, place FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY metres, b_id)::INT AS place FROM m WHERE metres <= 1200) WHERE place <= 3",
    "no_neighbour": f"WITH {_PAIRS} SELECT a_id FROM a WHERE a_id NOT IN (SELECT a_id FROM m WHERE metres <= 9)",
    "weekly_open_now": f"""WITH {_WEEKLY}, g AS (SELECT *, max(c) OVER (PARTITION BY venue_id, weekday, minute ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
      s AS (SELECT *, sum(CASE WHEN before >= o THEN 0 ELSE 1 END) OVER (PARTITION BY venue_id, weekday, minute ORDER BY o) AS island FROM g), z AS (SELECT venue_id, weekday, minute, island, min(o) AS o, max(c) AS c FROM s GROUP BY ALL)
      SELECT venue_id, weekday, minute, z.c IS NOT NULL AS is_open, coalesce(z.c, -1) AS closes FROM w LEFT JOIN z USING (venue_id, weekday, minute) WHERE z.o <= minute AND minute < z.c
      UNION ALL SELECT venue_id, weekday, minute, false, -1 FROM w WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.venue_id = w.venue_id AND z.weekday = w.weekday AND z.minute = w.minute AND z.o <= w.minute AND w.minute < z.c)""",
    "next_opening": f"""WITH {_WEEKLY}, g AS (SELECT *, max(c) OVER (PARTITION BY venue_id, weekday, minute ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
      z AS (SELECT venue_id, weekday, minute, o FROM g WHERE before IS NULL OR before < o)
      SELECT w.venue_id, w.weekday, w.minute, coalesce(min(z.o), -1) AS opens FROM w LEFT JOIN z ON z.venue_id = w.venue_id AND z.weekday = w.weekday AND z.minute = w.minute AND z.o > w.minute GROUP BY ALL""",
    "daypart_class": f"""WITH s(category, part, a, b) AS (VALUES {', '.join(f"('{c}', {2 if x == 'prime' else 1}, {a}, {b})" for c, x, a, b in PARTS)}),
      o AS (SELECT occ_id, hour(start_at) * 60 + minute(start_at) AS minute, ['cafe', 'bar', 'restaurant'][venue_id % 3 + 1] AS category FROM ({A.OCC_SQL}))
      SELECT occ_id, category, CASE max(CASE WHEN (minute >= a AND minute < b) OR (minute + 1440 >= a AND minute + 1440 < b) THEN part ELSE 0 END) WHEN 2 THEN 'prime' WHEN 1 THEN 'fair' ELSE 'off' END AS part FROM o JOIN s USING (category) GROUP BY ALL""",
    "event_feasible": f"""WITH o AS (SELECT *, date_trunc('day', start_at) + to_minutes(((occ_id * 7) % 1440)::INT) AS arr, coalesce(end_at, start_at + INTERVAL 2 HOUR) AS ends FROM ({A.OCC_SQL})),
      u AS (SELECT *, arr + INTERVAL 4 HOUR AS dead FROM o), m AS (SELECT *, floor((epoch_ms(least(ends, dead)) - epoch_ms(greatest(arr, start_at))) / 60000.0)::INT AS useful FROM u)
      SELECT occ_id, useful, CASE WHEN status = 'cancelled' THEN 'EVENT_CANCELLED' WHEN status = 'sold_out' THEN 'EVENT_SOLD_OUT' WHEN ends <= arr THEN 'EVENT_ENDED' WHEN arr > start_at AND NOT late_entry THEN 'NO_LATE_ENTRY'
      WHEN ends > dead + INTERVAL 15 MINUTE THEN 'EVENT_ENDS_AFTER_DEADLINE' WHEN useful < 30 THEN 'NOT_ENOUGH_TIME' ELSE '' END AS excluded_by FROM m""",
    "budget_gate": f"""SELECT venue_id, (range * 15)::INT AS budget, CASE WHEN range = 0 AND price IS NULL THEN 'unknown' WHEN range = 0 AND price > 0 THEN 'not_free' WHEN price IS NULL THEN 'unknown' WHEN price > range * 15 THEN 'over' ELSE 'within' END AS standing
      FROM ({A.venues_sql()}) CROSS JOIN range(4)""",
    "kitchen_last_order": f"SELECT venue_id, range::INT AS arrival, range <= close_min - 75 AS serves FROM ({A.venues_sql()}) CROSS JOIN range(600, 1441, 60)",
    "detour_payback": f"""WITH {SCORED_SQL}, z AS (SELECT *, max((travel <= 15 AND class = 'ready')::INT) OVER (PARTITION BY request_id, category) AS near_ready FROM s)
      SELECT request_id, venue_id, round(CASE WHEN travel > 15 AND near_ready = 1 THEN 0.1::DOUBLE * least(1.0, (travel - 15) / 20.0::DOUBLE) ELSE 0.0 END, 4) AS cost FROM z""",
}


# When kinds of places are busy; days 0 (Sunday) to 6, minutes that may pass midnight.
BUSY = [
    ("bar", (1, 2, 3, 4, 5), 1020, 1170, 1), ("bar", (5, 6), 1080, 1260, 1), ("bar", (0, 1, 2, 3), 1200, 1380, 1), ("bar", (4,), 1260, 1500, 2), ("bar", (5, 6), 1260, 1590, 2),
    ("museum", (1, 2, 3, 4, 5), 660, 900, 1), ("museum", (0, 6), 660, 960, 2), ("park", (1, 2, 3, 4, 5), 720, 780, 1), ("park", (0, 1, 2, 3, 4, 5, 6), 1020, 1140, 1), ("park", (0, 6), 660, 1020, 2),
]


def busy_level(spark, d):
    """How busy the kind of place of each event's user usually is at the event's time; the night belongs to the day before."""
    kinds = ("bar", "museum", "park")
    e = table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, kinds)), (F.col("user_id") % 3).cast("int")).alias("category"), (F.dayofweek("ts") - 1).alias("weekday"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))

    def level(category):
        within = lambda day, a, b: ((F.col("weekday") == day) & (F.col("minute") >= a) & (F.col("minute") < b)) | ((F.col("weekday") == (day + 1) % 7) & (F.col("minute") + 1440 >= a) & (F.col("minute") + 1440 < b))
        hit = lambda n: reduce(lambda x, y: x | y, (F.lit(False), *(within(day, a, b) for c, days, a, b, m in BUSY if c == category and m == n for day in days)))
        return F.when(hit(2), "busy").when(hit(1), "moderate").otherwise("quiet")

    return e.select("event_id", "category", F.coalesce(*(F.when(F.col("category") == c, level(c)) for c in kinds)).alias("level"))


def tag_facts(spark, d):
    """Facts of places whose tags are made up from `customer`."""
    from tidegate.sources import tags

    k = F.col("c_custkey")
    made = F.map_from_arrays(F.array(*map(F.lit, ("amenity", "name", "fee", "wheelchair", "reservation"))), F.array(F.get(F.array(*map(F.lit, ("cafe", "bar", "library", "theatre", "restaurant", "parking"))), (k % 6).cast("int")), F.col("c_name"), F.when(k % 5 == 0, "yes").when(k % 5 == 1, "no"), F.when(k % 3 == 0, "designated").when(k % 3 == 1, "no"), F.when(k % 7 == 0, "required").when(k % 7 == 1, "yes")))
    tagged = table(spark, d, "customer").select(k.cast("string").alias("external_id"), F.map_filter(made, lambda _, v: v.isNotNull()).alias("tags"), F.lit("2023-06-01").cast("timestamp").alias("edited"))
    return tags.facts(tagged, F.lit("2024-06-01").cast("timestamp"))


def hours_of_rules(spark, d):
    """Weekly intervals of rules put together from `supplier`."""
    from tidegate.functions import hours

    k = F.col("s_suppkey")
    rule = F.concat(F.lit("Mo-Fr "), F.format_string("%02d:00-%02d:30", (k % 12).cast("int"), (F.lit(12) + k % 10).cast("int")), F.when(k % 2 == 0, "; Sa 22:00-02:00").otherwise("; Tu off"))
    rows = hours.weekly_hours(table(spark, d, "supplier").select("s_suppkey", rule.alias("opening_hours")))
    return rows.select("s_suppkey", F.explode("hours").alias("h")).select("s_suppkey", "h.weekday", "h.start", "h.end")


QUERIES |= {"busy_level": busy_level, "tag_facts": tag_facts, "hours_of_rules": hours_of_rules}
_BUSY = ", ".join(f"('{c}', {day}, {a}, {b}, {n})" for c, days, a, b, n in BUSY for day in days)
ORACLES |= {
    "busy_level": f"""WITH s(category, day, a, b, level) AS (VALUES {_BUSY}), q AS (SELECT event_id, ['bar', 'museum', 'park'][user_id % 3 + 1] AS category, dayofweek(ts) AS weekday, hour(ts) * 60 + minute(ts) AS minute FROM events)
      SELECT event_id, category, CASE max(CASE WHEN (day = weekday AND minute >= a AND minute < b) OR (day = (weekday + 6) % 7 AND minute + 1440 >= a AND minute + 1440 < b) THEN level ELSE 0 END) WHEN 2 THEN 'busy' WHEN 1 THEN 'moderate' ELSE 'quiet' END AS level
      FROM q JOIN s USING (category) GROUP BY ALL""",
    "tag_facts": """WITH t AS (SELECT c_custkey::VARCHAR AS external_id, ['cafe', 'bar', 'library', 'theatre', 'restaurant', NULL][c_custkey % 6 + 1] AS cat, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS fee,
        CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS w, CASE c_custkey % 7 WHEN 0 THEN 'required' WHEN 1 THEN 'yes' END AS r FROM customer)
      SELECT external_id, 'name' AS attribute, name AS value, 'published' AS class, 0.9::DOUBLE AS confidence FROM t
      UNION ALL SELECT external_id, 'category', cat, 'published', 0.8 FROM t WHERE cat IS NOT NULL
      UNION ALL SELECT external_id, 'business_status', 'operating', 'estimate', 0.5 FROM t
      UNION ALL SELECT external_id, 'wheelchair', w, 'published', 0.7 FROM t WHERE w IS NOT NULL
      UNION ALL SELECT external_id, 'admission', CASE WHEN r = 'required' THEN 'reservation' WHEN cat IN ('cafe', 'bar', 'library') THEN 'walk_in' WHEN cat = 'restaurant' THEN CASE r WHEN 'yes' THEN 'reservation_available' ELSE 'walk_in' END WHEN cat = 'theatre' THEN 'ticket' END,
        CASE WHEN r = 'required' THEN 'published' ELSE 'estimate' END, CASE WHEN r = 'required' THEN 0.7 WHEN cat IN ('cafe', 'bar', 'library') THEN 0.55 WHEN cat = 'restaurant' THEN 0.45 ELSE 0.6 END FROM t WHERE r = 'required' OR cat IS NOT NULL
      UNION ALL SELECT external_id, 'price', CASE fee WHEN 'no' THEN 'free' WHEN 'yes' THEN 'paid' ELSE 'free' END, CASE WHEN fee IS NULL THEN 'estimate' ELSE 'published' END, CASE fee WHEN 'no' THEN 0.7 WHEN 'yes' THEN 0.6 ELSE 0.7 END FROM t WHERE fee IS NOT NULL OR cat = 'library'
      UNION ALL SELECT external_id, 'indoor_outdoor', 'indoor', 'estimate', 0.6 FROM t WHERE cat IS NOT NULL""",
    "hours_of_rules": """WITH s AS (SELECT s_suppkey, s_suppkey % 12 * 60 AS a, (12 + s_suppkey % 10) * 60 + 30 AS b FROM supplier)
      SELECT s_suppkey, d::INT AS weekday, a::INT AS start, b::INT AS "end" FROM s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE s_suppkey % 2 = 0 OR d <> 2
      UNION ALL SELECT s_suppkey, 6, 1320, 1560 FROM s WHERE s_suppkey % 2 = 0""",
}
