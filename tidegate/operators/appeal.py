"""The whole score of a feasible candidate: fit, appeal, novelty, evidence, merit and standing.

Every term of appeal is a named condition with a weight; an unknown condition
adds nothing. Columns say what is known of the candidate and the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.feasibility import once
from tidegate.operators.scoring import clamp, fit_score, merit

# What each term adds to appeal, from a prior of one half.
PRIOR = 0.5
TERMS: list[tuple[str, str, float]] = [
    ("landmark", "landmark", 0.1),
    ("event", "event", 0.25),
    ("event_soon", "event and starts_in between 1 and 90", 0.05),
    ("popular", "event and popularity >= 70 and not adult_for_minor", 0.1),
    ("destination", "destination", 0.1),
    ("destination_named", "destination and named", 0.05),
    ("kids_for_adults", "for_kids and not minor", -0.35),
    ("not_for_company", "company_kind and not suits_company", -0.15),
    ("chain", "chain and not asked_for", -0.15),
    ("late_night", "(hour >= 21 or hour < 4) and late_kind", 0.1),
    ("prime", "not event and part = 'prime'", 0.05),
    ("off", "not event and part = 'off'", -0.25),
    ("hours_confirmed", "hours_fresh", 0.1),
    ("sunset", "sunset_kind and (event or part <> 'off') and to_sunset between -20 and 60 and (not forecast or dry)", 0.15),
    ("happy_hour", "happy_hour and not minor", 0.05),
    ("outdoor_seating", "outdoor_seating and dry and not cold", 0.05),
    ("accessible_restroom", "need_wheelchair and restroom_accessible", 0.05),
    ("kid_facilities", "young_child and kid_facilities", 0.05),
    ("no_restroom", "young_child and no_restroom", -0.05),
    ("rain_outdoors", "outdoor and rainy", -0.25),
    ("cold_outdoors", "outdoor and cold", -0.15),
    ("rain_indoors", "not outdoor and rainy", 0.05),
]
COMPLETE, LONG_DESTINATION, BOOST_SHARE = 0.1, 0.1, 1.0
SEEN, VENUE_SEEN = 0.6, 0.3
EVIDENCE = {"hours": 0.5, "status": 0.3, "admission": 0.2}
SOON_CLOSED = 0.1
RAIN_FROM, COLD_TO, HOT_FROM = 50, 38, 90


def _three(x: Column) -> Column:
    """Three places, a half rounded up whatever the last bits of a sum say."""
    return F.round(x + 1e-9, 3)


def weather(rows: DataFrame) -> DataFrame:
    """Adds forecast, rainy, dry, cold and hot; an hour without a chance of rain says nothing about rain."""
    known = F.col("temp_f").isNotNull() | F.col("rain").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumn("forecast", known).withColumn("rainy", yes(F.col("rain") >= RAIN_FROM)).withColumn("dry", yes(F.col("rain") < RAIN_FROM)).withColumn("cold", yes(F.col("temp_f") <= COLD_TO)).withColumn("hot", yes(F.col("temp_f") >= HOT_FROM))


def weather_score() -> Column:
    outdoor, bad = F.col("outdoor"), F.col("rainy") | F.col("cold")
    out = F.when(bad, 0.1).when(F.col("hot"), 0.5).when(F.col("dry"), 0.9).otherwise(0.5)
    return F.when(~F.col("forecast"), 0.5).when(outdoor, out).when(bad, 0.7).otherwise(0.5)


def company_score() -> Column:
    """0.5, more for a place that suits who is going or an event for their children, less for adults' places with a minor."""
    own = F.when(F.col("company_kind").isNull(), 0.0).when(F.col("adult_for_minor"), -0.25).when(F.col("suits_company"), 0.25).otherwise(0.0)
    return clamp(0.5 + own + F.when(F.col("for_kids") & F.col("minor"), 0.25).otherwise(0.0))


def waits(rows: DataFrame) -> DataFrame:
    """Adds wait_min and wait_max: a report that still holds on arrival, else what is usual where it is busy, by the style of visit."""
    said = F.create_map(*(F.lit(x) for k, v in {"none": (0, 0), "short": (5, 15), "long": (15, 30)}.items() for x in (k, f"{v[0]}-{v[1]}")))
    usual = F.create_map(*(F.lit(x) for k, v in {"dine_in": (15, 30), "counter": (5, 15), "takeout": (5, 15), "bowling": (20, 45), "nightclub": (10, 30)}.items() for x in (k, f"{v[0]}-{v[1]}")))
    holds = F.col("queue").isNotNull() & F.coalesce(F.col("queue_until") > F.col("arrival"), F.lit(False))
    booked = F.col("style").isin("dine_in", "bowling") & F.col("booked")
    span = F.when(holds, said[F.col("queue")]).when((F.col("crowd") == "busy") & ~booked, usual[F.col("style")])
    part = lambda i: F.coalesce(F.get(F.split(span, "-"), F.lit(i)).cast("int"), F.lit(0))
    return rows.withColumn("wait_min", part(0)).withColumn("wait_max", part(1))


def wait_may_not_fit() -> Column:
    """Whether the longest wait leaves too little of the visit, or runs past a published last order."""
    return (F.col("wait_max") > 0) & ((F.col("useful") - F.col("wait_max") < F.col("min_useful")) | F.coalesce(F.col("arrival") + F.col("wait_max") > F.col("last_order"), F.lit(False)))


def full_scores(rows: DataFrame) -> DataFrame:
    """The rows with fit, appeal, novelty, evidence, taste, merit and check_wait, each score of three places in [0, 1]."""
    rows = waits(weather(rows))
    long = clamp((F.col("window_min") - 90) / 150.0)
    fit = fit_score(F.col("travel"), F.col("max_travel"), F.col("window_min"), F.col("useful") - F.col("wait_min"), F.col("min_useful"), F.col("typical_min"), company_score(), weather_score(), places=None)
    soon = F.when(F.col("closes_soon"), SOON_CLOSED).otherwise(0.0)
    rows = once(rows, "fit", _three(clamp(fit - soon)))
    terms = sum((F.when(F.expr(cond), w).otherwise(0.0) for _, cond, w in TERMS), F.lit(PRIOR))
    appeal = terms + COMPLETE * F.col("complete") + F.when(F.col("destination"), long * LONG_DESTINATION).otherwise(0.0) + BOOST_SHARE * F.col("boost")
    rows = once(rows, "appeal", _three(clamp(appeal)))
    novelty = F.greatest(F.lit(0.0), 1 - F.when(F.col("seen"), SEEN).otherwise(0.0) - F.when(F.col("event") & F.col("venue_seen"), VENUE_SEEN).otherwise(0.0))
    evidence = EVIDENCE["hours"] * F.col("hours_conf") + EVIDENCE["status"] * F.col("status_conf") + EVIDENCE["admission"] * F.col("admission_conf")
    held = F.when((~F.col("event") & (F.col("part") == "off")) | F.col("adult_for_minor"), F.when(F.col("match").isNotNull(), F.least("match", F.lit(0.5)))).otherwise(F.col("match"))
    rows = rows.withColumn("novelty", _three(novelty)).withColumn("evidence", _three(evidence)).withColumn("taste", held)
    return rows.withColumn("merit", F.round(merit(F.col("appeal"), F.col("fit"), F.col("novelty"), F.col("taste")), 6)).withColumn("check_wait", wait_may_not_fit())


def standing(likely_open: Column, outdoor: Column, dark: Column) -> Column:
    """ready, check_first or after_dark: likely open counts as ready, a place outdoors in the dark does not count at all."""
    return F.when(outdoor & dark, "after_dark").when((F.col("class") == "ready") | likely_open, "ready").otherwise(F.col("class"))
