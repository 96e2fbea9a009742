"""The whole gate: every rule that can exclude a candidate, in order, and every doubt that asks to check first.

The first rule that holds names the exclusion. What is unknown is never a yes,
and an estimate never excludes. All times are minutes of the request's local
day; hours recur daily, and a close past midnight is more than 1440.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.feasibility import ASSUMED_EVENT_MIN, DEADLINE_GRACE_MIN, LAST_ORDER_MIN, first_failing, once

# Policy of the gate.
FOOD = ["restaurant", "cafe", "dessert", "bar"]
PROGRAMME_MIN = {"cinema": 120, "theatre": 120, "live_music": 90}
DAYTIME = ["museum", "gallery", "library", "bookshop", "garden"]
ADULT = ["bar", "nightclub"]
TAKEOUT_MIN = 15
RETURN_SLACK_MIN = 5
CLOSED_ESTIMATE_FROM = 60
KITCHEN_OFFSET_MIN = 30
SERVES = ["yes", "only"]

c = F.col


def said(condition: Column) -> Column:
    """Whether a condition is known to hold."""
    return F.coalesce(condition, F.lit(False))


def interval_after(opens: Column, closes: Column, at: Column) -> Column:
    """The daily interval that holds a minute, or the next one."""
    shifted = [F.struct((opens + s).alias("open"), (closes + s).alias("close")) for s in (-1440, 0, 1440)]
    return F.when(closes - 1440 > at, shifted[0]).when(closes > at, shifted[1]).otherwise(shifted[2])


def before_travel() -> list[tuple[Column, str]]:
    """Rules about what is asked for and who goes."""
    food = c("category").isin(FOOD) & (c("kind") == "venue")
    minor = F.coalesce(c("youngest") < 18, c("family"), F.lit(False))
    too_young = F.when(c("youngest").isNotNull(), c("youngest") < c("age_limit")).otherwise(c("family") & (c("age_limit") >= 18))
    unlisted = (c("kind") == "venue") & c("category").isin(list(PROGRAMME_MIN))
    sure = ~c("status_estimate") | (c("status_percent") >= CLOSED_ESTIMATE_FROM)
    return [
        (c("overridden"), "EXCLUDED_BY_OVERRIDE"),
        (c("dismissed"), "DISMISSED"),
        (~F.array_contains("categories", c("category")), "NOT_REQUESTED"),
        (c("cuisines_asked").isNotNull() & ~food, "NOT_REQUESTED"),
        (c("cuisines_asked").isNotNull() & ~said(F.arrays_overlap("cuisines_asked", "cuisines")), "OTHER_CUISINE"),
        (c("diets_asked").isNotNull() & ~food, "NOT_REQUESTED"),
        (c("diets_asked").isNotNull() & ~said(F.forall("diets_asked", lambda d: said(c("diet_levels")[d].isin(SERVES)))), "DIET_NOT_KNOWN"),
        (c("features_asked").isNotNull() & ~said(F.size(F.array_except("features_asked", "features")) == 0), "FEATURE_NOT_KNOWN"),
        ((c("status") == "closed_temporarily") & sure, "CLOSED_TEMPORARILY"),
        (c("status").startswith("closed") & sure, "CLOSED_PERMANENTLY"),
        (c("closure_min") <= c("at_min"), "CLOSED_PERMANENTLY"),
        (c("requirement") == "members_only", "MEMBERS_ONLY"),
        (too_young & ~c("age_estimate"), "AGE_RESTRICTED"),
        (c("taking_out") & c("category").isin(FOOD) & (c("takeout") == "no"), "NO_TAKEOUT"),
        (~c("taking_out") & (c("category") == "restaurant") & (c("takeout") == "only"), "TAKEOUT_ONLY"),
        (unlisted & (~c("own_site") | minor), "NO_PROGRAMME"),
        (c("travel") > c("max_travel"), "TOO_FAR"),
    ]


def limits(rows: DataFrame) -> DataFrame:
    """Adds came (the arrival as the trip gives it), user_deadline, deadline and need."""
    back = c("back_by") - c("return_travel") - RETURN_SLACK_MIN
    rows = rows.withColumn("came", c("at_min") + c("travel")).withColumn("user_deadline", F.least(c("at_min") + c("window_min"), back))
    own = F.create_map(*(F.lit(x) for kv in PROGRAMME_MIN.items() for x in kv))[c("category")]
    need = F.when(c("taking_out") & c("category").isin(FOOD), TAKEOUT_MIN).when((c("kind") == "venue") & own.isNotNull(), F.greatest("min_useful", own)).otherwise(c("min_useful"))
    return rows.withColumn("deadline", F.least("user_deadline", "closure_min")).withColumn("need", need)


def visited(rows: DataFrame) -> DataFrame:
    """Adds the visit of a place: v<code, arrival, finish, closes, hours_doubt>, code naming what hours rule out."""
    known = c("hours").isin("exact", "approx")
    rows = once(rows, "i", F.when(known, interval_after(c("open_min"), c("close_min"), c("came"))))
    rows = rows.withColumn("opened", F.greatest("came", "i.open")).withColumn("no_wait", (c("i.open") > c("came")) & (c("deadline") - c("i.open") < c("need")))
    # a park without hours is open by daylight, where that leaves enough of a visit
    light_from, light_to = F.greatest("came", "sunrise"), F.least("sunset", "deadline")
    rows = rows.withColumn("daylight", (c("hours") == "none") & c("dawn_dusk") & (c("came") < c("sunset")) & (light_to - light_from >= c("need")))
    # the kitchen decides when a meal can start
    rows = rows.withColumn("seated", F.when(c("daylight"), light_from).otherwise(c("opened")))
    cooks = (c("category") == "restaurant") & c("kitchen_open").isNotNull() & ~c("daylight")
    rows = once(rows, "k", F.when(cooks, interval_after(c("kitchen_open"), c("kitchen_close"), c("seated"))))
    last_order = c("k.close") - LAST_ORDER_MIN
    waits = c("k.open") > c("seated")
    cold = (last_order <= F.greatest("k.open", "seated")) | (waits & (c("deadline") - c("k.open") < c("need")))
    rows = rows.withColumn("arrival", F.greatest("seated", "k.open")).withColumn("cold", said(cold) | said(F.greatest("seated", "k.open") > last_order))
    doubted = known & c("category").isin(DAYTIME) & (F.pmod("i.open", F.lit(1440)) > 0) & (c("i.close") - c("i.open") + F.pmod("i.open", F.lit(1440)) > 23 * 60)
    rows = rows.withColumn("doubted", said(doubted)).withColumn("closes", F.when(c("daylight"), c("sunset")).when(known & ~c("doubted"), c("i.close")))
    earlier = F.when((c("category") == "restaurant") & c("k").isNull() & ~c("daylight"), KITCHEN_OFFSET_MIN).otherwise(0)
    rows = rows.withColumn("finish", F.least(c("closes") - earlier, c("deadline")))
    late = c("arrival") > c("closes") - c("last_entry")
    code = first_failing([(c("no_wait"), "CLOSED_ON_ARRIVAL"), (c("cold"), "KITCHEN_CLOSED"), (late & ~c("daylight"), "LAST_ENTRY_PASSED"), (c("finish") - c("arrival") < c("need"), "NOT_ENOUGH_TIME")])
    return rows.withColumn("v_code", code).withColumn("v_useful", c("finish") - c("arrival"))


def attended(rows: DataFrame) -> DataFrame:
    """Adds the visit of an event: e_code and e_useful."""
    ends = F.coalesce("e_end", c("e_start") + ASSUMED_EVENT_MIN)
    useful = F.least(ends, c("deadline")) - F.greatest("came", "e_start")
    need = F.when(c("min_useful") > 0, c("min_useful")).otherwise(F.least(F.lit(45), F.greatest(F.lit(20), ((ends - c("e_start")) / 2).cast("int"))))
    code = first_failing(
        [
            (c("e_status") == "cancelled", "EVENT_CANCELLED"),
            (c("e_status") == "sold_out", "EVENT_SOLD_OUT"),
            (c("e_end") <= c("at_min"), "EVENT_STARTED"),
            ((c("came") > c("e_start")) & ~c("late_entry") & ~c("popup"), "EVENT_STARTED"),
            (((ends > c("user_deadline") + DEADLINE_GRACE_MIN) & ~c("popup")) | said(ends > c("closure_min")), "EVENT_ENDS_AFTER_DEADLINE"),
            (useful < need, "NOT_ENOUGH_TIME"),
        ]
    )
    return rows.withColumn("e_code", code).withColumn("e_useful", useful)


def on_arrival() -> list[tuple[Column, str]]:
    """Rules that are read once a visit fits: the programme's time of day, money, access."""
    programme = (c("kind") == "venue") & c("category").isin(list(PROGRAMME_MIN))
    unpriced = ~c("free") & c("price").isNull()
    return [
        (programme & (c("part") != "prime"), "NO_PROGRAMME"),
        (c("free_only") & ~c("free"), "NOT_FREE"),
        (~c("free") & (c("price") > c("budget")) & ~unpriced, "OVER_BUDGET"),
        (c("need_wheelchair") & c("wheelchair").isNull(), "ACCESS_UNKNOWN"),
        (c("need_wheelchair") & (c("wheelchair") == "no"), "NOT_ACCESSIBLE"),
    ]


def doubts() -> Column:
    """What is to be checked first, in the order in which the rules come."""
    event = c("kind") == "occurrence"
    adult = c("age_limit") > 0
    too_young = F.when(c("youngest").isNotNull(), c("youngest") < c("age_limit")).otherwise(c("family") & (c("age_limit") >= 18))
    minor = F.coalesce(c("youngest") < 18, c("family"), F.lit(False))
    named = [
        (c("diets_asked").isNotNull() & c("diet_named"), "DIET_FROM_NAME"),
        (adult & too_young & c("age_estimate"), "AGE_LIMIT_LIKELY"),
        (adult & ~said(too_young) & c("youngest").isNull() & c("family"), "AGE_LIMIT_UNCERTAIN"),
        (c("age_limit").isNull() & minor & c("category").isin(ADULT), "KIDS_UNCERTAIN"),
        (~event & c("category").isin(list(PROGRAMME_MIN)), "PROGRAMME_UNLISTED"),
        (event & (c("came") > c("e_start")) & ~c("popup"), "LATE_ENTRY_UNCERTAIN"),
        ((event & c("e_end").isNull()) | (~event & (c("hours") == "approx")), "HOURS_APPROXIMATE"),
        (~event & c("hours").isin("none", "error") & ~c("daylight"), "HOURS_UNKNOWN"),
        (~event & c("doubted"), "HOURS_DOUBTFUL"),
        (~c("free") & c("price").isNull() & c("budget").isNotNull(), "PRICE_UNKNOWN"),
        (c("need_wheelchair") & (c("wheelchair") == "limited"), "ACCESS_LIMITED"),
        (c("requirement").isin("ticket", "reservation") & ~c("confirmed"), "ADMISSION_UNCONFIRMED"),
        (c("requirement") == "tour_only", "TOUR_ONLY"),
        (F.coalesce("requirement", F.lit("unknown")) == "unknown", "ADMISSION_UNKNOWN"),
    ]
    return F.array_compact(F.array(*(F.when(said(rule), F.lit(code)) for rule, code in named)))


def gated(rows: DataFrame) -> DataFrame:
    """The rows with excluded_by, doubts, class, useful and leave_at.

    leave_at is when to set off: later than now where the trip would otherwise
    end in waiting for a door or a kitchen. `rows` are pairs of request and
    candidate with the columns named in these rules; see plans.gate for a full set.
    """
    early = once(limits(rows), "early", first_failing(before_travel()))
    timed = attended(visited(early))
    event = c("kind") == "occurrence"
    timed = once(timed, "during", F.when(event, c("e_code")).otherwise(c("v_code")))
    out = once(timed, "excluded_by", F.coalesce("early", "during", first_failing(on_arrival()))).withColumn("doubts", doubts())
    out = out.withColumn("useful", F.when(event, c("e_useful")).otherwise(c("v_useful")))
    out = out.withColumn("leave_at", F.when(event, c("at_min")).otherwise(F.greatest("at_min", c("arrival") - c("travel"))))
    return out.withColumn("class", F.when(c("excluded_by").isNotNull(), "ineligible").when(F.size("doubts") > 0, "check_first").otherwise("ready"))


def with_closures_told(rows: DataFrame) -> DataFrame:
    """The gate, where a scheduled closure that leaves no visit is named as the closing it is.

    Time rules such a candidate out, and the same candidate without its closure
    passes: more time would not admit it.
    """
    timing = ["NOT_ENOUGH_TIME", "CLOSED_ON_ARRIVAL", "KITCHEN_CLOSED", "EVENT_ENDS_AFTER_DEADLINE"]
    keys = ["request_id", "venue_id"]
    passes = gated(rows.where(c("closure_min").isNotNull()).withColumn("closure_min", F.lit(None).cast("int"))).where("excluded_by is null").select(*keys, F.lit(True).alias("else_fine"))
    both = gated(rows).join(passes, keys, "left")
    return both.withColumn("excluded_by", F.when(said(c("else_fine") & c("excluded_by").isin(timing)), "CLOSED_PERMANENTLY").otherwise(c("excluded_by"))).drop("else_fine")


def parked(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """The lot that each visit parks in: the nearest open from parking to collecting, null where none is.

    `rows` have request_id, venue_id, arrival and finish; `lots` venue_id,
    lot_id, walk_min, open_min and close_min, at most a few a venue.
    """
    near = rows.join(lots, "venue_id").where((c("open_min") <= c("arrival") - c("walk_min")) & (c("close_min") >= c("finish") + c("walk_min")))
    best = near.groupBy("request_id", "venue_id").agg(F.min_by("lot_id", F.struct("walk_min", "lot_id")).alias("lot_id"))
    return rows.join(best, ["request_id", "venue_id"], "left")
