"""The whole gate over places of the given tables, with its SQL.

Both engines read the same texts for the candidates' attributes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import geo, sun
from tidegate.operators import feasibility, gate
from tidegate.plans import adapters as A
from tidegate.plans.places import EVALUATED_SQL
from tidegate.session import table

#: What candidates and requests say, as SQL of both engines, over pairs of request and venue.
SAID = {
    "kind": "CASE WHEN venue_id % 4 = 3 THEN 'occurrence' ELSE 'venue' END",
    "overridden": "venue_id % 41 = 0",
    "dismissed": "(request_id + venue_id) % 37 = 0",
    "asked_category": "CASE WHEN request_id % 6 = 5 THEN 'cafe' END",
    "asked_cuisine": "CASE WHEN request_id % 13 = 7 THEN 'pizza' END",
    "cuisine": "CASE WHEN venue_id % 2 = 0 THEN 'pizza' WHEN venue_id % 5 = 0 THEN 'thai' END",
    "asked_diet": "CASE WHEN request_id % 17 = 3 THEN 'vegan' END",
    "diet_level": "CASE venue_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'only' WHEN 2 THEN 'limited' END",
    "diet_named": "venue_id % 10 = 0",
    "asked_feature": "CASE WHEN request_id % 19 = 4 THEN 'wifi' END",
    "feature": "CASE WHEN venue_id % 3 = 1 THEN 'wifi' ELSE 'none' END",
    "status_estimate": "venue_id % 34 = 0",
    "status_percent": "venue_id % 100",
    "closure_min": "CASE WHEN venue_id % 29 = 0 THEN 480 + venue_id % 15 * 60 END",
    "requirement": "CASE venue_id % 7 WHEN 0 THEN 'ticket' WHEN 1 THEN 'tour_only' WHEN 2 THEN 'members_only' WHEN 3 THEN 'reservation' WHEN 4 THEN 'unknown' WHEN 5 THEN 'walk_in' END",
    "confirmed": "venue_id % 14 = 0",
    "age_estimate": "venue_id % 3 = 0",
    "age_limit": "CASE WHEN venue_id % 6 = 2 THEN 21 WHEN venue_id % 6 = 4 THEN 16 END",
    "family": "request_id % 5 = 1",
    "takeout": "CASE venue_id % 9 WHEN 0 THEN 'no' WHEN 1 THEN 'only' END",
    "taking_out": "request_id % 7 = 6",
    "own_site": "venue_id % 16 < 9",
    "back_by": "CASE WHEN request_id % 4 = 2 THEN at_min + window_min - 20 END",
    "return_travel": "travel",
    "hours": "CASE venue_id % 11 WHEN 0 THEN 'none' WHEN 1 THEN 'error' WHEN 2 THEN 'approx' WHEN 3 THEN 'always' ELSE 'exact' END",
    "dawn_dusk": "category = 'park'",
    "kitchen_open": "CASE WHEN venue_id % 3 = 0 THEN open_min + 60 END",
    "kitchen_close": "CASE WHEN venue_id % 3 = 0 THEN close_min - 45 END",
    "last_entry": "CASE WHEN venue_id % 5 = 2 THEN 45 END",
    "free": "venue_id % 12 = 5",
    "free_only": "request_id % 9 = 8",
    "part": "CASE WHEN (at_min + travel) % 1440 >= 1020 THEN 'prime' ELSE 'fair' END",
    "e_start": "540 + venue_id * 7 % 720",
    "e_end": "CASE WHEN venue_id % 3 <> 0 THEN 570 + venue_id * 7 % 720 + venue_id % 5 * 40 END",
    "e_status": "CASE venue_id % 23 WHEN 3 THEN 'cancelled' WHEN 7 THEN 'sold_out' END",
    "late_entry": "venue_id % 8 = 3",
    "popup": "venue_id % 16 = 11",
}


#: The requests' Saturday, and its clock.
DAY, ZONE = "2024-06-01", "America/New_York"


def candidates(spark, d):
    """Pairs in reach with all that the gate reads."""
    lit = sun.with_sun(A.venues(spark, d).withColumn("zone", F.lit(ZONE)), F.lit(DAY).cast("date"))
    lit = lit.select(*(c for c in lit.columns if c not in ("zone", "sun")), "sun.sunrise", "sun.sunset")
    pairs = feasibility.timed(feasibility.in_reach(A.requests(spark), lit))
    rows = pairs.select(*[c for c in pairs.columns if c not in ("arrival", "deadline", "closes", "useful", "min_age")], *(F.expr(v).alias(k) for k, v in SAID.items()))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    return rows.select("*", one("asked_category").alias("categories"), one("asked_cuisine").alias("cuisines_asked"), one("cuisine").alias("cuisines"), one("asked_diet").alias("diets_asked"), F.create_map(F.lit("vegan"), F.col("diet_level")).alias("diet_levels"), one("asked_feature").alias("features_asked"), one("feature").alias("features"))


def gate_codes(spark, d):
    return gate.gated(candidates(spark, d)).select("request_id", "venue_id", "class", F.coalesce("excluded_by", F.lit("")).alias("excluded_by"), F.array_join("doubts", ",").alias("doubts"), F.coalesce("useful", F.lit(-1)).cast("long").alias("useful"), F.col("leave_at").cast("long").alias("leave_at"))


def gate_histogram(spark, d):
    return gate.with_closures_told(candidates(spark, d)).groupBy("excluded_by").agg(F.count("*").alias("n")).select(F.coalesce("excluded_by", F.lit("")).alias("excluded_by"), "n")


def parking_choice(spark, d):
    rows = gate.gated(candidates(spark, d)).where("kind = 'venue' and mode = 'drive' and excluded_by is null").select("request_id", "venue_id", "arrival", "finish")
    v = A.venues(spark, d).select("venue_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    lots = v.select("venue_id", (F.col("venue_id") * 10 + F.col("n")).alias("lot_id"), (F.col("n") * 3 + F.col("venue_id") % 4).alias("walk_min"), (F.lit(300) + F.col("venue_id") * F.col("n") % 9 * 60).alias("open_min"), (F.lit(1000) + F.col("venue_id") * F.col("n") % 11 * 60).alias("close_min"))
    return gate.parked(rows, lots).select("request_id", "venue_id", F.coalesce("lot_id", F.lit(-1)).alias("lot_id"))


def destination_reach(spark, d):
    """How far an outing may be for each order taken for a request: its window by the order, its mode by the customer."""
    w = table(spark, d, "orders").select("o_orderkey", (30 + F.col("o_orderkey") % 27 * 10).cast("int").alias("window_min"), F.get(F.array(*map(F.lit, (25, 30, 35))), (F.col("o_custkey") % 3).cast("int")).alias("base"))
    return w.select("o_orderkey", F.round(F.col("base") * geo.destination_multiplier(F.col("window_min"))).cast("int").alias("limit_min"))


QUERIES = {f.__name__: f for f in (gate_codes, gate_histogram, parking_choice, destination_reach)}

_SAID = ", ".join(f"{v} AS {k}" for k, v in SAID.items())
_FOOD = "(category IN ('restaurant', 'cafe', 'dessert', 'bar') AND kind = 'venue')"
_MINOR = "coalesce(youngest < 18, family, false)"
_YOUNG = "coalesce(CASE WHEN youngest IS NOT NULL THEN youngest < age_limit ELSE family AND age_limit >= 18 END, false)"
_AFTER = "CASE WHEN {c} - 1440 > {t} THEN -1440 WHEN {c} > {t} THEN 0 ELSE 1440 END"


def _gate_sql(closure: str = "closure_min") -> str:
    """The steps of the gate from w (pairs with SAID) on."""
    return f"""
g0 AS (SELECT * REPLACE ({closure} AS closure_min), at_min + travel AS came, least(at_min + window_min, back_by - return_travel - 5) AS user_deadline FROM w),
g1 AS (SELECT *, least(user_deadline, closure_min) AS stop, CASE WHEN taking_out AND category IN ('restaurant', 'cafe', 'dessert', 'bar') THEN 15 WHEN kind = 'venue' AND category = 'cinema' THEN greatest(min_useful, 120) ELSE min_useful END AS need,
  CASE WHEN overridden THEN 'EXCLUDED_BY_OVERRIDE' WHEN dismissed THEN 'DISMISSED' WHEN category <> asked_category THEN 'NOT_REQUESTED' WHEN asked_cuisine IS NOT NULL AND NOT {_FOOD} THEN 'NOT_REQUESTED' WHEN asked_cuisine IS NOT NULL AND cuisine IS DISTINCT FROM asked_cuisine THEN 'OTHER_CUISINE'
  WHEN asked_diet IS NOT NULL AND NOT {_FOOD} THEN 'NOT_REQUESTED' WHEN asked_diet IS NOT NULL AND coalesce(diet_level, '') NOT IN ('yes', 'only') THEN 'DIET_NOT_KNOWN' WHEN asked_feature <> feature THEN 'FEATURE_NOT_KNOWN'
  WHEN status = 'closed_temporarily' AND (NOT status_estimate OR status_percent >= 60) THEN 'CLOSED_TEMPORARILY' WHEN status LIKE 'closed%' AND (NOT status_estimate OR status_percent >= 60) THEN 'CLOSED_PERMANENTLY' WHEN closure_min <= at_min THEN 'CLOSED_PERMANENTLY'
  WHEN requirement = 'members_only' THEN 'MEMBERS_ONLY' WHEN {_YOUNG} AND NOT age_estimate THEN 'AGE_RESTRICTED' WHEN taking_out AND category IN ('restaurant', 'cafe', 'dessert', 'bar') AND takeout = 'no' THEN 'NO_TAKEOUT' WHEN NOT taking_out AND category = 'restaurant' AND takeout = 'only' THEN 'TAKEOUT_ONLY'
  WHEN kind = 'venue' AND category = 'cinema' AND (NOT own_site OR {_MINOR}) THEN 'NO_PROGRAMME' WHEN travel > max_travel THEN 'TOO_FAR' END AS early, hours IN ('exact', 'approx') AS known FROM g0),
g2 AS (SELECT *, CASE WHEN known THEN open_min + {_AFTER.format(c='close_min', t='came')} END AS io, CASE WHEN known THEN close_min + {_AFTER.format(c='close_min', t='came')} END AS ic FROM g1),
g3 AS (SELECT *, greatest(came, io) AS opened, coalesce(io > came AND stop - io < need, false) AS no_wait, hours = 'none' AND dawn_dusk AND came < sunset AND least(sunset, stop) - greatest(came, sunrise) >= need AS daylight FROM g2),
g4 AS (SELECT *, CASE WHEN daylight THEN greatest(came, sunrise) ELSE opened END AS seated, category = 'restaurant' AND kitchen_open IS NOT NULL AND NOT daylight AS cooks FROM g3),
g5 AS (SELECT *, CASE WHEN cooks THEN kitchen_open + {_AFTER.format(c='kitchen_close', t='seated')} END AS ko, CASE WHEN cooks THEN kitchen_close + {_AFTER.format(c='kitchen_close', t='seated')} END AS kc FROM g4),
g6 AS (SELECT *, greatest(seated, ko) AS arrival, coalesce(kc - 15 <= greatest(ko, seated) OR (ko > seated AND stop - ko < need), false) OR coalesce(greatest(seated, ko) > kc - 15, false) AS cold,
  coalesce(known AND category IN ('museum', 'library', 'bookshop') AND (io + 2880) % 1440 > 0 AND ic - io + (io + 2880) % 1440 > 1380, false) AS doubted FROM g5),
g7 AS (SELECT *, CASE WHEN daylight THEN sunset WHEN known AND NOT doubted THEN ic END AS closes FROM g6),
g8 AS (SELECT *, least(closes - CASE WHEN category = 'restaurant' AND NOT cooks AND NOT daylight THEN 30 ELSE 0 END, stop) AS finish, coalesce(e_end, e_start + 120) AS ends FROM g7),
g9 AS (SELECT *, least(ends, stop) - greatest(came, e_start) AS e_useful, CASE WHEN min_useful > 0 THEN min_useful ELSE least(45, greatest(20, (ends - e_start) // 2)) END AS e_need FROM g8),
ga AS (SELECT *, CASE WHEN kind = 'occurrence' THEN CASE WHEN e_status = 'cancelled' THEN 'EVENT_CANCELLED' WHEN e_status = 'sold_out' THEN 'EVENT_SOLD_OUT' WHEN e_end <= at_min THEN 'EVENT_STARTED' WHEN came > e_start AND NOT late_entry AND NOT popup THEN 'EVENT_STARTED'
    WHEN (ends > user_deadline + 15 AND NOT popup) OR coalesce(ends > closure_min, false) THEN 'EVENT_ENDS_AFTER_DEADLINE' WHEN e_useful < e_need THEN 'NOT_ENOUGH_TIME' END
  ELSE CASE WHEN no_wait THEN 'CLOSED_ON_ARRIVAL' WHEN cold THEN 'KITCHEN_CLOSED' WHEN arrival > closes - last_entry AND NOT daylight THEN 'LAST_ENTRY_PASSED' WHEN finish - arrival < need THEN 'NOT_ENOUGH_TIME' END END AS during,
  CASE WHEN kind = 'venue' AND category = 'cinema' AND part <> 'prime' THEN 'NO_PROGRAMME' WHEN free_only AND NOT free THEN 'NOT_FREE' WHEN NOT free AND price > budget THEN 'OVER_BUDGET' WHEN need_wheelchair AND wheelchair IS NULL THEN 'ACCESS_UNKNOWN' WHEN need_wheelchair AND wheelchair = 'no' THEN 'NOT_ACCESSIBLE' END AS late FROM g9),
gb AS (SELECT *, coalesce(early, during, late) AS excluded, concat_ws(',', CASE WHEN asked_diet IS NOT NULL AND diet_named THEN 'DIET_FROM_NAME' END, CASE WHEN {_YOUNG} AND age_estimate THEN 'AGE_LIMIT_LIKELY' END, CASE WHEN age_limit > 0 AND NOT {_YOUNG} AND youngest IS NULL AND family THEN 'AGE_LIMIT_UNCERTAIN' END,
  CASE WHEN age_limit IS NULL AND {_MINOR} AND category = 'bar' THEN 'KIDS_UNCERTAIN' END, CASE WHEN kind = 'venue' AND category = 'cinema' THEN 'PROGRAMME_UNLISTED' END, CASE WHEN kind = 'occurrence' AND came > e_start AND NOT popup THEN 'LATE_ENTRY_UNCERTAIN' END,
  CASE WHEN (kind = 'occurrence' AND e_end IS NULL) OR (kind = 'venue' AND hours = 'approx') THEN 'HOURS_APPROXIMATE' END, CASE WHEN kind = 'venue' AND hours IN ('none', 'error') AND NOT daylight THEN 'HOURS_UNKNOWN' END, CASE WHEN kind = 'venue' AND doubted THEN 'HOURS_DOUBTFUL' END,
  CASE WHEN NOT free AND price IS NULL AND budget IS NOT NULL THEN 'PRICE_UNKNOWN' END, CASE WHEN need_wheelchair AND wheelchair = 'limited' THEN 'ACCESS_LIMITED' END, CASE WHEN requirement IN ('ticket', 'reservation') AND NOT confirmed THEN 'ADMISSION_UNCONFIRMED' END,
  CASE WHEN requirement = 'tour_only' THEN 'TOUR_ONLY' END, CASE WHEN coalesce(requirement, 'unknown') = 'unknown' THEN 'ADMISSION_UNKNOWN' END) AS doubts FROM ga)"""


_PAIRS = f"{EVALUATED_SQL.replace(A.venues_sql('customer'), A.venues_sql())}, sky AS (SELECT venue_id, sunrise, sunset FROM {sun.sun_sql(f"(SELECT venue_id, lat, lon, '{ZONE}' AS zone FROM ({A.venues_sql()}))", f"DATE '{DAY}'")}), w AS (SELECT *, {_SAID} FROM (SELECT * EXCLUDE (arrival, deadline) FROM near) JOIN sky USING (venue_id))"

ORACLES = {
    "gate_codes": f"""WITH {_PAIRS}, {_gate_sql()} SELECT request_id, venue_id, CASE WHEN excluded IS NOT NULL THEN 'ineligible' WHEN doubts <> '' THEN 'check_first' ELSE 'ready' END AS class, coalesce(excluded, '') AS excluded_by, doubts,
      coalesce(CASE WHEN kind = 'occurrence' THEN e_useful ELSE finish - arrival END, -1)::BIGINT AS useful, (CASE WHEN kind = 'occurrence' THEN at_min ELSE greatest(at_min, arrival - travel) END)::BIGINT AS leave_at FROM gb""",
    "gate_histogram": f"""WITH {_PAIRS}, real AS (WITH {_gate_sql()} SELECT request_id, venue_id, excluded FROM gb), other AS (WITH {_gate_sql('NULL::INT')} SELECT request_id, venue_id, excluded AS e2 FROM gb),
      tt AS (SELECT CASE WHEN excluded IN ('NOT_ENOUGH_TIME', 'CLOSED_ON_ARRIVAL', 'KITCHEN_CLOSED', 'EVENT_ENDS_AFTER_DEADLINE') AND e2 IS NULL AND venue_id % 29 = 0 THEN 'CLOSED_PERMANENTLY' ELSE excluded END AS excluded FROM real JOIN other USING (request_id, venue_id))
      SELECT coalesce(excluded, '') AS excluded_by, count(*) AS n FROM tt GROUP BY 1""",
    "parking_choice": f"""WITH {_PAIRS}, {_gate_sql()}, rr AS (SELECT request_id, venue_id, arrival, finish FROM gb WHERE kind = 'venue' AND mode = 'drive' AND excluded IS NULL),
      l AS (SELECT s_suppkey AS venue_id, s_suppkey * 10 + n AS lot_id, n * 3 + s_suppkey % 4 AS walk, 300 + s_suppkey * n % 9 * 60 AS o, 1000 + s_suppkey * n % 11 * 60 AS c FROM supplier CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)),
      b AS (SELECT request_id, venue_id, arg_min(lot_id, (walk, lot_id)) AS lot_id FROM rr JOIN l USING (venue_id) WHERE o <= arrival - walk AND c >= finish + walk GROUP BY ALL) SELECT request_id, venue_id, coalesce(lot_id, -1) AS lot_id FROM rr LEFT JOIN b USING (request_id, venue_id)""",
    "destination_reach": "SELECT o_orderkey, round([25, 30, 35][o_custkey % 3 + 1] * CASE WHEN 30 + o_orderkey % 27 * 10 >= 210 THEN 2.0 WHEN 30 + o_orderkey % 27 * 10 >= 150 THEN 1.5 ELSE 1.0 END)::INT AS limit_min FROM orders",
}
