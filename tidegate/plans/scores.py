"""The whole score over places of the given tables, with its SQL; both engines read the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import appeal, feasibility
from tidegate.plans import adapters as A
from tidegate.plans.places import EVALUATED_SQL

SAID = {
    "landmark": "venue_id % 50 = 0",
    "event": "venue_id % 4 = 3",
    "starts_in": "venue_id % 200 - 20",
    "popularity": "venue_id % 101",
    "destination": "venue_id % 9 = 0",
    "named": "venue_id % 18 = 0",
    "for_kids": "venue_id % 12 = 7",
    "minor": "coalesce(youngest < 18, false)",
    "adult_for_minor": "coalesce(youngest < 18, false) AND category = 'bar'",
    "company_kind": "CASE WHEN request_id % 3 > 0 THEN category IN ('restaurant', 'bar', 'cinema') END",
    "suits_company": "category IN ('restaurant', 'cinema') OR (category = 'bar' AND venue_id % 3 = 0)",
    "chain": "venue_id % 10 = 9",
    "asked_for": "request_id % 4 = 0 AND category = 'cafe'",
    "hour": "(at_min + travel) // 60 % 24",
    "late_kind": "category IN ('bar', 'restaurant')",
    "part": "CASE WHEN (venue_id + request_id) % 3 = 0 THEN 'prime' WHEN (venue_id + request_id) % 3 = 1 THEN 'off' ELSE 'fair' END",
    "hours_fresh": "venue_id % 7 = 0",
    "sunset_kind": "category = 'park'",
    "to_sunset": "1200 - at_min - travel",
    "happy_hour": "category = 'bar' AND venue_id % 2 = 0",
    "outdoor_seating": "venue_id % 6 = 1",
    "restroom_accessible": "venue_id % 5 = 0",
    "young_child": "coalesce(youngest < 13, false)",
    "kid_facilities": "venue_id % 8 = 0",
    "no_restroom": "venue_id % 5 = 1",
    "outdoor": "category = 'park'",
    "temp_f": "CASE WHEN request_id % 6 > 0 THEN 20 + request_id * 7 % 80 END",
    "rain": "CASE WHEN request_id % 6 > 1 THEN request_id * 13 % 100 END",
    "queue": "CASE venue_id % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'short' WHEN 2 THEN 'long' END",
    "queue_until": "at_min + venue_id % 40",
    "crowd": "CASE WHEN (venue_id + request_id) % 4 = 0 THEN 'busy' ELSE 'quiet' END",
    "style": "CASE venue_id % 4 WHEN 0 THEN 'dine_in' WHEN 1 THEN 'counter' WHEN 2 THEN 'bowling' ELSE 'other' END",
    "booked": "venue_id % 3 = 0",
    "last_order": "CASE WHEN venue_id % 5 = 3 THEN at_min + travel + 20 END",
    "closes_soon": "venue_id % 14 = 3",
    "typical_min": "min_useful * 2",
    "complete": "venue_id % 4 * 0.25",
    "boost": "CASE WHEN venue_id % 33 = 0 THEN 0.05 ELSE 0.0 END",
    "seen": "(venue_id + request_id) % 13 = 0",
    "venue_seen": "(venue_id + request_id) % 5 = 0",
    "hours_conf": "venue_id % 10 * 0.1",
    "status_conf": "venue_id % 5 * 0.2",
    "admission_conf": "venue_id % 3 * 0.5",
    "match": "CASE WHEN request_id % 2 = 0 THEN (venue_id % 21) * 0.05 END",
}
FLOATS = ("complete", "boost", "hours_conf", "status_conf", "admission_conf", "match")


def full_scores(spark, d):
    rows = feasibility.evaluate(A.requests(spark), A.venues(spark, d)).where("class <> 'ineligible'")
    both = lambda v: v.replace("//", "div")
    said = rows.select(*rows.columns, *(F.expr(both(v)).cast("double").alias(k) if k in FLOATS else F.expr(both(v)).alias(k) for k, v in SAID.items()))
    out = appeal.full_scores(said)
    stands = appeal.standing(F.col("venue_id") % 6 == 0, F.col("outdoor"), F.col("to_sunset") < -60)
    return out.select("request_id", "venue_id", "fit", "appeal", "novelty", "evidence", "merit", "check_wait", stands.alias("standing"))


QUERIES = {"full_scores": full_scores}

_SAID = ", ".join(f"({v})::DOUBLE AS {k}" if k in FLOATS else f"{v} AS {k}" for k, v in SAID.items())
_C = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))".format
_TERMS = " + ".join(f"CASE WHEN {cond} THEN {w}::DOUBLE ELSE 0 END" for _, cond, w in appeal.TERMS)
ORACLES = {
    "full_scores": f"""WITH {EVALUATED_SQL.replace(A.venues_sql('customer'), A.venues_sql())},
  s0 AS (SELECT *, {_SAID} FROM x WHERE class <> 'ineligible'),
  s1 AS (SELECT *, temp_f IS NOT NULL OR rain IS NOT NULL AS forecast, coalesce(rain >= 50, false) AS rainy, coalesce(rain < 50, false) AS dry, coalesce(temp_f <= 38, false) AS cold, coalesce(temp_f >= 90, false) AS hot, queue IS NOT NULL AND queue_until > arrival AS holds FROM s0),
  s2 AS (SELECT *, CASE WHEN holds THEN CASE queue WHEN 'none' THEN 0 WHEN 'short' THEN 5 ELSE 15 END WHEN crowd = 'busy' AND NOT (style IN ('dine_in', 'bowling') AND booked) THEN CASE style WHEN 'dine_in' THEN 15 WHEN 'counter' THEN 5 WHEN 'bowling' THEN 20 ELSE 0 END ELSE 0 END AS wmin,
    CASE WHEN holds THEN CASE queue WHEN 'none' THEN 0 WHEN 'short' THEN 15 ELSE 30 END WHEN crowd = 'busy' AND NOT (style IN ('dine_in', 'bowling') AND booked) THEN CASE style WHEN 'dine_in' THEN 30 WHEN 'counter' THEN 15 WHEN 'bowling' THEN 45 ELSE 0 END ELSE 0 END AS wmax,
    {_C('(window_min - 90) / 150.0::DOUBLE')} AS long,
    {_C("0.5::DOUBLE + CASE WHEN company_kind IS NULL THEN 0 WHEN adult_for_minor THEN -0.25 WHEN suits_company THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN for_kids AND minor THEN 0.25 ELSE 0 END::DOUBLE")} AS chips,
    CASE WHEN NOT forecast THEN 0.5 WHEN outdoor THEN CASE WHEN rainy OR cold THEN 0.1 WHEN hot THEN 0.5 WHEN dry THEN 0.9 ELSE 0.5 END WHEN rainy OR cold THEN 0.7 ELSE 0.5 END::DOUBLE AS sky FROM s1),
  s3 AS (SELECT *, {_C("0.4::DOUBLE * ((1 - long * 0.5::DOUBLE) * greatest(0.0, 1 - travel / least(max_travel, greatest(10.0, window_min * 0.25::DOUBLE))) + long * 0.5::DOUBLE * (1 - 2 * travel / (2 * travel + typical_min)::DOUBLE)) + 0.3::DOUBLE * greatest(0.0, least(1.0, (useful - wmin - min_useful) / greatest(15.0::DOUBLE, min_useful))) + 0.15::DOUBLE * chips + 0.15::DOUBLE * sky")} AS raw FROM s2),
  s4 AS (SELECT *, round({_C("raw - CASE WHEN closes_soon THEN 0.1::DOUBLE ELSE 0 END")} + 1e-9, 3) AS fit, round({_C(f"0.5::DOUBLE + {_TERMS} + 0.1::DOUBLE * complete + CASE WHEN destination THEN long * 0.1::DOUBLE ELSE 0 END + boost")} + 1e-9, 3) AS appeal,
    round(greatest(0.0, 1 - CASE WHEN seen THEN 0.6::DOUBLE ELSE 0 END - CASE WHEN event AND venue_seen THEN 0.3::DOUBLE ELSE 0 END) + 1e-9, 3) AS novelty, round(0.5::DOUBLE * hours_conf + 0.3::DOUBLE * status_conf + 0.2::DOUBLE * admission_conf + 1e-9, 3) AS evidence,
    CASE WHEN (NOT event AND part = 'off') OR adult_for_minor THEN CASE WHEN match IS NOT NULL THEN least(match, 0.5::DOUBLE) END ELSE match END AS taste FROM s3)
  SELECT request_id, venue_id, fit, appeal, novelty, evidence, round(CASE WHEN taste IS NULL THEN appeal * 0.5::DOUBLE + fit * 0.35::DOUBLE + novelty * 0.15::DOUBLE ELSE taste * 0.4::DOUBLE + appeal * 0.3::DOUBLE + fit * 0.2::DOUBLE + novelty * 0.1::DOUBLE END, 6) AS merit,
    wmax > 0 AND (useful - wmax < min_useful OR coalesce(arrival + wmax > last_order, false)) AS check_wait, CASE WHEN outdoor AND to_sunset < -60 THEN 'after_dark' WHEN class = 'ready' OR venue_id % 6 = 0 THEN 'ready' ELSE class END AS standing FROM s4""",
}
