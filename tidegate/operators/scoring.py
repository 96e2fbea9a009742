"""Scores of feasible candidates, their merit, and the marks that look across a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Score weights.
FIT = {"travel": 0.4, "slack": 0.3, "chips": 0.15, "weather": 0.15}
MERIT = {"appeal": 0.5, "fit": 0.35, "novelty": 0.15}
MERIT_TASTE = {"taste": 0.4, "appeal": 0.3, "fit": 0.2, "novelty": 0.1}
TRIP_FROM_MIN, TRIP_FULL_MIN, TRIP_SHARE = 90, 240, 0.5
EVENT_BONUS, LANDMARK_BONUS, COMPLETE_BONUS, PRIME_BONUS, OFF_COST, CHAIN_COST = 0.25, 0.1, 0.1, 0.05, 0.25, 0.15
LIKELY_LISTED, LIKELY_SHARE, LIKELY_CHECK, LIKELY_MISS = 8, 0.8, 0.02, 0.25


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fit_score(travel: Column, max_travel: Column, window: Column, useful: Column, least: Column, typical: Column, chips: Column | float = 0.5, weather: Column | float = 0.5, places: int | None = 3) -> Column:
    """How well a visit fits the time there is: travel, slack, company, weather."""
    chips, weather = (x if isinstance(x, Column) else F.lit(x) for x in (chips, weather))
    reach = F.least(max_travel, F.greatest(F.lit(10.0), window * 0.25))
    long = clamp((window - TRIP_FROM_MIN) / float(TRIP_FULL_MIN - TRIP_FROM_MIN))
    worth = 1 - 2 * travel / (2 * travel + typical)
    near = F.greatest(F.lit(0.0), 1 - travel / reach)
    score = (1 - long * TRIP_SHARE) * near + long * TRIP_SHARE * worth
    slack = clamp((useful - least) / F.greatest(F.lit(15.0), least))
    whole = clamp(FIT["travel"] * score + FIT["slack"] * slack + FIT["chips"] * chips + FIT["weather"] * weather)
    return whole if places is None else F.round(whole, places)


def appeal_score(*, event: Column, landmark: Column, completeness: Column, part: Column, chain: Column, boost: Column) -> Column:
    """From a modest prior, by what is known in favour and against."""
    add = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    raw = F.lit(0.5) + add(event, EVENT_BONUS) + add(landmark, LANDMARK_BONUS) + COMPLETE_BONUS * completeness + add(part == "prime", PRIME_BONUS) - add(part == "off", OFF_COST) - add(chain, CHAIN_COST) + boost
    return F.round(clamp(raw), 3)


def merit(appeal: Column, fit: Column, novelty: Column, taste: Column | None = None) -> Column:
    """One number in a class; a taste leads where there is one."""
    plain = appeal * MERIT["appeal"] + fit * MERIT["fit"] + novelty * MERIT["novelty"]
    if taste is None:
        return plain
    led = taste * MERIT_TASTE["taste"] + appeal * MERIT_TASTE["appeal"] + fit * MERIT_TASTE["fit"] + novelty * MERIT_TASTE["novelty"]
    return F.when(taste.isNull(), plain).otherwise(led)


def ranked(rows: DataFrame, page: int = 3, offset: int = 0, max_offset: int = 300) -> DataFrame:
    """Places of the eligible rows of each request, and the page that starts at offset.

    The order is total: class, merit, evidence (here none), travel, name, id.
    Requests partition the work; the page is cut before rows leave their task.
    """
    start = min(max(0, offset), max_offset)
    standing = F.when(F.col("class") == "ready", 0).when(F.col("class") == "check_first", 1).otherwise(2)
    order = Window.partitionBy("request_id").orderBy(standing, F.desc("merit"), "travel", "name", "venue_id")
    placed = _near_top(rows.where(F.col("class") != "ineligible"), standing, start + page).withColumn("place", F.row_number().over(order))
    return placed.where((F.col("place") > start) & (F.col("place") <= start + page))


def _near_top(rows: DataFrame, standing: Column, most: int) -> DataFrame:
    """Of each request's rows the `most` best by standing and merit, what ties with the last of them, and few more.

    Rows go in fixed parts by venue. If `most` parts have a row at or above some
    merit, so have the `most` best rows: only those reach the sort, which would
    else hold all rows of a task.
    """
    parts = 64 + 4 * most
    down = F.when(F.isnan("merit"), float("-inf")).otherwise(F.coalesce(-F.col("merit").cast("double"), F.lit(float("inf"))))  # as desc sorts
    best = rows.groupBy("request_id", standing.alias("_at"), F.pmod(F.xxhash64("venue_id"), F.lit(parts)).alias("_part")).agg(F.min(down).alias("_down"))
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("_at", "_down"))
    last = best.withColumn("_n", nth).where(F.col("_n") == most).select(F.col("request_id").alias("_of"), F.col("_at").alias("_last_at"), F.col("_down").alias("_last_down"))
    met = rows.join(F.broadcast(last), F.col("request_id").eqNullSafe(F.col("_of")), "left")
    above = (standing < F.col("_last_at")) | ((standing == F.col("_last_at")) & (down <= F.col("_last_down")))
    return met.where(F.coalesce(above, F.lit(True))).drop("_of", "_last_at", "_last_down")


def open_shares(peers: DataFrame, slots: list[int], length: int = 60) -> DataFrame:
    """(category, slot, listed, open): of the places with stated hours, those open throughout each slot."""
    slot = F.explode(F.array(*map(F.lit, slots)))
    rows = peers.where("open_min is not null").select("category", "open_min", "close_min", slot.alias("slot"))
    holds = lambda shift: (F.col("open_min") <= F.col("slot") + shift) & (F.col("close_min") >= F.col("slot") + shift + length)
    return rows.groupBy("category", "slot").agg(F.count("*").alias("listed"), F.count_if(holds(0) | holds(1440)).alias("open"))


def likely_open(listed: Column, open_: Column) -> Column:
    return (listed >= LIKELY_LISTED) & (open_ >= LIKELY_SHARE * listed)


def likely_cost(listed: Column, open_: Column) -> Column:
    """What merit loses for being likely open, not known to be."""
    return LIKELY_CHECK + (1 - open_ / listed) * LIKELY_MISS


def relaxations(evaluated: DataFrame, offers: list[tuple[str, list[str]]], most: int = 3) -> DataFrame:
    """(request_id, code, admits, place): the first offers, in their fixed order, that would admit someone."""
    pairs = [(code, rule, i) for i, (code, rules) in enumerate(offers) for rule in rules]
    rules = evaluated.sparkSession.createDataFrame(pairs, "code string, excluded_by string, i int")
    counts = evaluated.where("excluded_by is not null").groupBy("request_id", "excluded_by").count()
    admits = counts.join(F.broadcast(rules), "excluded_by").groupBy("request_id", "code", "i").agg(F.sum("count").alias("admits"))
    return admits.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("i"))).where(F.col("place") <= most).drop("i")


#: Offers in the order in which they are made, with the exclusions they lift.
OFFERS = [("longer_travel", ["TOO_FAR"]), ("more_time", ["NOT_ENOUGH_TIME"]), ("different_time", ["CLOSED_ON_ARRIVAL", "KITCHEN_CLOSED"]), ("higher_budget", ["OVER_BUDGET"]), ("include_paid", ["NOT_FREE"]), ("more_categories", ["NOT_REQUESTED"]), ("stay_later", ["EVENT_ENDS_AFTER_DEADLINE"])]
