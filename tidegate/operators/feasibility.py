"""The feasibility gate: ordered rules of which the first that fails names the exclusion.

An unknown never counts as a yes in a gate, and an estimate never excludes; it
leaves a code that makes the result "check first".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import geo
from tidegate.session import spread

#: Minutes by which an event may run past the deadline.
DEADLINE_GRACE_MIN = 15
ASSUMED_EVENT_MIN = 120
LAST_ORDER_MIN = 15


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """The code of the first rule that holds, null if none does; unknown is not a failure."""
    return F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for rule, code in rules))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is computed once.

    Filters that read it later are not rewritten in terms of what it is made of,
    which would repeat long expressions many times over.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def in_reach(requests: DataFrame, venues: DataFrame, degrees: float = 0.05, metres: Callable[[Column, Column, Column, Column], Column] = geo.distance_m, parts: int | None = None) -> DataFrame:
    """Pairs of request and venue whose distance the travel limit allows.

    `metres` measures a trip from point to point; it may be longer than the
    straight line (water.trip_m), never shorter, since the cells are by that line.
    Requests are spread over the grid cells that their reach covers, so the join
    is an equi-join on cells and never a cross join; venues are read once and dealt
    out over all tasks, as each of them meets many requests. Where the requests are
    many as well, `parts` deals both sides out by cell and part of its venues.
    """
    limit = F.create_map(*(x for m, n in geo.MAX_TRAVEL_MIN.items() for x in (F.lit(m), F.lit(n))))
    asked = requests.withColumn("max_travel", limit[F.col("mode")]).withColumn("reach", geo.reach_m(F.col("mode"), F.col("max_travel")))
    dlat = F.degrees(F.col("reach") / geo.EARTH_M)
    dlon = dlat / F.cos(F.radians(F.col("r_lat")))
    span = lambda c, d: F.sequence(F.floor((F.col(c) - d) / degrees), F.floor((F.col(c) + d) / degrees))
    covered = asked.withColumn("_y", F.explode(span("r_lat", dlat))).withColumn("_x", F.explode(span("r_lon", dlon)))
    on = lambda rows: rows.withColumn("_y", F.floor(F.col("lat") / degrees)).withColumn("_x", F.floor(F.col("lon") / degrees))
    if parts is None:
        pairs = covered.join(on(spread(venues)), ["_y", "_x"]).drop("_y", "_x")
    else:
        cell = ["_y", "_x", "_part"]
        placed = on(venues).withColumn("_part", F.pmod(F.xxhash64("lat", "lon"), F.lit(parts)).cast("int"))
        covered = covered.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = spread(covered, *cell).join(spread(placed, *cell), cell).drop(*cell)
    points = [F.col(c) for c in ("r_lat", "r_lon", "lat", "lon")]
    near = once(pairs, "distance", geo.distance_m(*points)).where("distance <= reach")
    if metres is geo.distance_m:
        return near
    return once(near.drop("distance"), "distance", metres(*points)).where("distance <= reach")


def timed(pairs: DataFrame) -> DataFrame:
    """Travel, arrival, deadline and the useful minutes inside opening hours."""
    hour = F.floor(F.col("at_min") / 60).cast("int")
    travel = geo.travel_minutes(F.col("distance"), F.col("mode"), hour)
    rows = once(pairs, "travel", travel).withColumn("arrival", F.col("at_min") + F.col("travel")).withColumn("deadline", F.col("at_min") + F.col("window_min"))
    inside = (F.col("arrival") >= F.col("open_min")) & (F.col("arrival") < F.col("close_min"))
    wraps = (F.col("arrival") + 1440 >= F.col("open_min")) & (F.col("arrival") + 1440 < F.col("close_min"))
    close = F.when(inside, F.col("close_min")).when(wraps, F.col("close_min") - 1440)
    return once(rows, "closes", close).withColumn("useful", F.greatest(F.lit(0), F.least(F.col("deadline"), F.col("closes")) - F.col("arrival")))


def visit_codes(rows: DataFrame) -> DataFrame:
    """Adds excluded_by (the first failing rule) and class for place visits."""
    rules = [
        (F.col("status").startswith("closed"), "CLOSED_PERMANENTLY"),
        ((F.col("youngest") < F.col("min_age")), "AGE_LIMIT"),
        (F.col("travel") > F.col("max_travel"), "TOO_FAR"),
        (F.col("closes").isNull(), "CLOSED_ON_ARRIVAL"),
        (F.col("useful") < F.col("min_useful"), "NOT_ENOUGH_TIME"),
        (F.col("price") > F.col("budget"), "OVER_BUDGET"),
        (F.col("need_wheelchair") & (F.col("wheelchair") == "no"), "NOT_ACCESSIBLE"),
    ]
    doubts = F.array_compact(
        F.array(
            F.when(F.col("status").isNull(), "STATUS_UNKNOWN"),
            F.when(F.col("budget").isNotNull() & F.col("price").isNull(), "PRICE_UNKNOWN"),
            F.when(F.col("need_wheelchair") & F.col("wheelchair").isNull(), "ACCESS_UNKNOWN"),
        )
    )
    out = once(rows, "excluded_by", first_failing(rules)).withColumn("doubts", doubts)
    return out.withColumn("class", F.when(F.col("excluded_by").isNotNull(), "ineligible").when(F.size("doubts") > 0, "check_first").otherwise("ready"))


def evaluate(requests: DataFrame, venues: DataFrame) -> DataFrame:
    """Every venue in reach of every request, timed and classed."""
    return visit_codes(timed(in_reach(requests, venues)))


def event_codes(rows: DataFrame, useful_min: int = 30) -> DataFrame:
    """Adds excluded_by for occurrences: columns arrive_at and deadline_at are instants.

    An event without an end is taken to last two hours. Joining late is allowed
    where the event says so, if enough of it is left.
    """
    ends = F.coalesce("end_at", F.col("start_at") + F.make_dt_interval(mins=F.lit(ASSUMED_EVENT_MIN)))
    late = F.col("arrive_at") > F.col("start_at")
    minutes = lambda a, b: F.floor((F.unix_millis(b) - F.unix_millis(a)) / 60000.0)
    useful = minutes(F.greatest("arrive_at", "start_at"), F.least(ends, F.col("deadline_at")))
    rules = [
        (F.col("status") == "cancelled", "EVENT_CANCELLED"),
        (F.col("status") == "sold_out", "EVENT_SOLD_OUT"),
        (ends <= F.col("arrive_at"), "EVENT_ENDED"),
        (late & ~F.col("late_entry"), "NO_LATE_ENTRY"),
        (ends > F.col("deadline_at") + F.make_dt_interval(mins=F.lit(DEADLINE_GRACE_MIN)), "EVENT_ENDS_AFTER_DEADLINE"),
        (useful < useful_min, "NOT_ENOUGH_TIME"),
    ]
    return rows.withColumn("useful", useful.cast("int")).withColumn("excluded_by", first_failing(rules))


def price_standing(price: Column, budget: Column, free_only: Column) -> Column:
    """within, over, not_free or unknown; free asks for a price known to be nothing."""
    return F.when(free_only & price.isNull(), "unknown").when(free_only & (price > 0), "not_free").when(price.isNull() | budget.isNull(), "unknown").when(price > budget, "over").otherwise("within")


def kitchen_open(arrival: Column, kitchen_close: Column) -> Column:
    """Whether an order is still taken on arrival."""
    return arrival <= kitchen_close - LAST_ORDER_MIN
