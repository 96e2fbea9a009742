"""Queries of trips between the shores of a water, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import geo, water
from tidegate.operators import feasibility
from tidegate.plans.places import HAVERSINE, drive_sql
from tidegate.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


#: Points on both shores by a key: integer arithmetic, so that both engines make the same doubles. Some lie on one longitude.
LAT, LON = "40.6D + {k} * 7919 % 8003 / 10000.0D", "-74.0D + {k} * 104729 % 997 / 400.0D"
_sql = lambda e: e.replace("D", "::DOUBLE")
_LINE = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate([water.BRIDGE, *water.MIDDLE]))
_BRIDGE = f"{water.BRIDGE[1]}::DOUBLE AS m_lat, {water.BRIDGE[0]}::DOUBLE AS m_lon"


def crossing_sql(trips: str) -> str:
    """CTEs from trips (id, a_lat, a_lon, b_lat, b_lon) to `far` (those and metres, crosses): gaps at every shared longitude."""
    return f"""tr AS ({trips}), line(i, x, y) AS (VALUES {_LINE}), seg AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, b.i AS i FROM line a JOIN line b ON b.i = a.i + 1),
e AS (SELECT id, least(a_lon, b_lon) AS wx, CASE WHEN a_lon > b_lon THEN b_lat ELSE a_lat END AS wy, greatest(a_lon, b_lon) AS ex, CASE WHEN a_lon > b_lon THEN a_lat ELSE b_lat END AS ey FROM tr),
s AS (SELECT *, greatest(wx, (SELECT min(x) FROM line)) AS f, least(ex, (SELECT max(x) FROM line)) AS t FROM e),
pt AS (SELECT id, wx, wy, ex, ey, f AS x, wy AS flat FROM s WHERE f <= t UNION ALL SELECT id, wx, wy, ex, ey, t, ey FROM s WHERE f <= t UNION ALL SELECT id, wx, wy, ex, ey, l.x, NULL FROM s JOIN line l ON l.x > f AND l.x < t),
gap AS (SELECT id, CASE WHEN wx = ex THEN flat ELSE wy + (pt.x - wx) / (ex - wx) * (ey - wy) END - (SELECT arg_min(y0 + (pt.x - x0) / (x1 - x0) * (y1 - y0), i) FROM seg WHERE pt.x <= x1) AS g FROM pt),
side AS (SELECT id, min(g) < 0 AND max(g) > 0 AS crosses FROM gap GROUP BY id),
far AS (SELECT * EXCLUDE (m_lat, m_lon), CASE WHEN crosses THEN {HAVERSINE.format(a='a_', b='m_')} + {HAVERSINE.format(a='m_', b='b_')} ELSE {HAVERSINE.format(a='a_', b='b_')} END AS metres
  FROM (SELECT tr.*, coalesce(crosses, false) AS crosses, {_BRIDGE} FROM tr LEFT JOIN side USING (id)))"""


_TRIPS = f"SELECT o_orderkey AS id, {_sql(LAT.format(k='o_custkey'))} AS a_lat, {_sql(LON.format(k='o_custkey'))} AS a_lon, {_sql(LAT.format(k='(o_orderkey * 31 + 7)'))} AS b_lat, CASE WHEN o_orderkey % 50 = 3 THEN {_sql(LON.format(k='o_custkey'))} ELSE {_sql(LON.format(k='(o_orderkey * 31 + 7)'))} END AS b_lon FROM orders"
_DIVIDE = "(SELECT arg_min(y0 + (b_lon - x0) / (x1 - x0) * (y1 - y0), i) FROM seg WHERE i > 1 AND b_lon <= x1)"


@query(f"""WITH {crossing_sql(_TRIPS)} SELECT id AS o_orderkey, crosses, round(metres, 2) AS metres, coalesce(b_lon BETWEEN {water.MIDDLE[0][0]} AND {water.MIDDLE[-1][0]} AND b_lat >= {water.FAR_FROM} AND b_lat <= greatest({water.FAR_LEAST}, {_DIVIDE}), false) AS far_shore,
  ceil({drive_sql('metres', '(id % 24)')} + 8.0)::INT AS minutes FROM far""")
def trips_over_water(spark, d):
    """The drive of each order from its customer to a point of its own: over the bridge where the water lies between."""
    at = lambda e, k: F.expr(e.format(k=k))
    here, there = "o_custkey", "(o_orderkey * 31 + 7)"
    b_lon = F.when(F.col("o_orderkey") % 50 == 3, at(LON, here)).otherwise(at(LON, there))
    trips = table(spark, d, "orders").select("o_orderkey", at(LAT, here).alias("a_lat"), at(LON, here).alias("a_lon"), at(LAT, there).alias("b_lat"), b_lon.alias("b_lon"))
    ends = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    far = feasibility.once(feasibility.once(trips, "crosses", water.crosses(*ends)), "metres", water.trip_m(*ends))
    minutes = geo.travel_minutes(F.col("metres"), F.lit("drive"), F.col("o_orderkey") % 24)
    return far.select("o_orderkey", "crosses", F.round("metres", 2).alias("metres"), water.far_shore(F.col("b_lat"), F.col("b_lon")).alias("far_shore"), minutes.alias("minutes"))


#: In how many parts the places of a cell meet the searches that cover it.
PARTS = 16

#: Searches from the near shore; each asks for places around by car, by train or on foot.
_ASKED = "SELECT s_suppkey AS request_id, ['drive', 'transit', 'walk'][s_suppkey % 3 + 1] AS mode, 40.86::DOUBLE + s_suppkey * 37 % 400 / 2000.0::DOUBLE AS r_lat, -73.79::DOUBLE + s_suppkey * 91 % 700 / 1000.0::DOUBLE AS r_lon FROM supplier"
_PLACES = "SELECT c_custkey AS venue_id, 40.74::DOUBLE + c_custkey * 7919 % 3301 / 10000.0::DOUBLE AS lat, -73.82::DOUBLE + c_custkey * 104729 % 997 / 1300.0::DOUBLE AS lon FROM customer"
_REACH = "CASE mode WHEN 'walk' THEN 25 * 80.0 / 1.3 WHEN 'transit' THEN 27 * 300.0 / 1.3 ELSE 5000 + (4000 + (22.0 - 4000 / 750.0) * 70000 / 60.0 - 7000) / 1.25 END"
_PAIRS = "SELECT request_id * 10000000 + venue_id AS id, request_id, venue_id, mode, r_lat AS a_lat, r_lon AS a_lon, lat AS b_lat, lon AS b_lon FROM rq JOIN pl ON abs(r_lat - lat) < 0.25 AND abs(r_lon - lon) < 0.33"


@query(f"""WITH rq AS ({_ASKED}), pl AS ({_PLACES}), {crossing_sql(_PAIRS)} SELECT request_id, mode, count(*) AS places, count(*) FILTER (crosses) AS over_bridge, sum(round(metres)::BIGINT)::BIGINT AS metres FROM far WHERE metres <= {_REACH} GROUP BY ALL""")
def reach_over_water(spark, d):
    """How many places each search reaches when trips go around the water, how many of them over the bridge, and how far in all."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    asked = table(spark, d, "supplier").select(k.alias("request_id"), F.get(F.array(*map(F.lit, ("drive", "transit", "walk"))), (k % 3).cast("int")).alias("mode"), (F.lit(40.86) + k * 37 % 400 / F.lit(2000.0)).alias("r_lat"), (F.lit(-73.79) + k * 91 % 700 / F.lit(1000.0)).alias("r_lon"))
    places = table(spark, d, "customer").select(c.alias("venue_id"), (F.lit(40.74) + c * 7919 % 3301 / F.lit(10000.0)).alias("lat"), (F.lit(-73.82) + c * 104729 % 997 / F.lit(1300.0)).alias("lon"))
    # searches alike in place and mode reach the same, and places of one point are measured once;
    # each end's way to the bridge is known before the ends meet; the crossing is settled once a pair, of those in straight reach
    bridge = F.lit(water.BRIDGE[1]), F.lit(water.BRIDGE[0])
    kinds = asked.select("mode", "r_lat", "r_lon").distinct()
    kinds = feasibility.once(kinds, "to_bridge", geo.distance_m(F.col("r_lat"), F.col("r_lon"), *bridge)).withColumn("r_mid", water.middle_at(F.col("r_lon")))
    spots = places.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    spots = feasibility.once(spots, "from_bridge", geo.distance_m(*bridge, F.col("lat"), F.col("lon"))).withColumn("mid", water.middle_at(F.col("lon")))
    near = feasibility.in_reach(kinds, spots, parts=PARTS)
    told = water.crossed(near, "over", ("r_lat", "r_lon", "r_mid"), ("lat", "lon", "mid"))
    pairs = feasibility.once(told, "trip", F.when(F.col("over"), F.col("to_bridge") + F.col("from_bridge")).otherwise(F.col("distance"))).where("trip <= reach")
    whole = F.floor("trip")
    metres = whole + (F.col("trip") - whole >= 0.5).cast("long")  # to whole metres; F.round goes by decimal digits, which takes longer than all else
    found = pairs.groupBy("mode", "r_lat", "r_lon").agg(F.sum("n").alias("places"), F.sum(F.when(F.col("over"), F.col("n")).otherwise(0)).alias("over_bridge"), F.sum(F.col("n") * metres).alias("metres"))
    return asked.join(found, ["mode", "r_lat", "r_lon"]).groupBy("request_id", "mode").agg(*(F.sum(c).alias(c) for c in ("places", "over_bridge", "metres")))
