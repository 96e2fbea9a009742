"""Which sites to read next: due times, hosts that asked to wait, and each host's requests of a day.

The log of requests is the only state. Nothing is reserved one by one: a host's
first sites in order take what is left of its day, which is what a reader that
asks for each request in turn would get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Requests a host gets in a day, the least pause it may ask for, the pause after a refusal, and how long robots.txt holds (hours).
PER_DAY, PAUSE_H, REFUSED_H, ROBOTS_H = 4, 6, 720, 24


def hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n)


def host_states(log: DataFrame, now: Column, per_day: int = PER_DAY) -> DataFrame:
    """(host, left, wait_until, reads_robots) as of `now`, of hosts in the log; later requests are not seen.

    The last answer that asked for a pause counts: six hours, or more if it said
    so. Where robots.txt is older than a day, reading it takes one of the day's
    requests before any site.
    """
    seen = log.where(F.col("at") <= now)
    until = F.struct("at", (F.col("at") + F.make_dt_interval(secs=F.greatest(F.coalesce("asked_s", F.lit(0)), F.lit(PAUSE_H * 3600)))).alias("until"))
    found = seen.groupBy("host").agg(
        F.count_if(F.to_date("at") == F.to_date(now)).alias("spent"), F.max(F.when(F.col("outcome") == "wait", until)).alias("wait"), F.max(F.when(F.col("kind") == "robots", F.col("at"))).alias("robots_at")
    )
    stale = F.coalesce(F.col("robots_at") + hours(F.lit(ROBOTS_H)) <= now, F.lit(True))
    wait = F.when(F.col("wait.until") > now, F.col("wait.until"))
    return found.select("host", F.greatest(F.lit(0), per_day - F.col("spent") - stale.cast("int")).cast("int").alias("left"), wait.alias("wait_until"), stale.alias("reads_robots"))


def plan(sites: DataFrame, log: DataFrame, now: Column, per_day: int = PER_DAY, salts: int = 16) -> DataFrame:
    """(site_id, host, verdict, next_at) of every site (site_id, host, interval_h, lists_events).

    Verdicts: `go`, `not_due`, `backoff` (its host asked to wait) and `allowance`
    (the host's day is spent). next_at is the first time it may be asked again:
    now, when it falls due or its host's pause ends, whichever is later, or the
    next day. Never-read sites go first, then the longest unread, those that list
    events before others, then by id. A site refused once is due every 720 hours.
    A site without a host is left out, as no request can be made; site_ids are
    distinct. A hot host's sites are spread over `salts` parts for its state, and
    only its first few are ranked.
    """
    pages = log.where((F.col("kind") == "page") & (F.col("at") <= now))
    last = pages.groupBy("site_id").agg(F.max("at").alias("last_at"), F.coalesce(F.bool_or(F.col("outcome") == "refused"), F.lit(False)).alias("refused"))
    known = sites.where("host is not null").select("site_id", "host", "interval_h", F.coalesce("lists_events", F.lit(False)).alias("lists_events")).join(last, "site_id", "left")
    due_at = F.col("last_at") + hours(F.when(F.col("refused"), REFUSED_H).otherwise(F.col("interval_h")).cast("int"))
    spread = known.withColumn("due_at", due_at).withColumn("_part", F.pmod(F.xxhash64("site_id"), F.lit(salts)).cast("int"))
    states = host_states(log, now, per_day).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = spread.join(states, ["host", "_part"], "left").withColumn("left", F.coalesce("left", F.lit(per_day - 1)))  # an unknown host's robots.txt is read first
    due = F.coalesce(F.col("due_at") < now, F.lit(True))
    turn = Window.partitionBy("host").orderBy(F.col("last_at").asc_nulls_first(), F.col("lists_events").desc(), "site_id")
    first = rows.where(due & F.col("wait_until").isNull()).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_day).where("turn <= left").select("site_id", F.lit(True).alias("goes"))
    told = rows.join(first, "site_id", "left")
    verdict = F.when(~due, "not_due").when(F.col("wait_until").isNotNull(), "backoff").when(F.col("goes"), "go").otherwise("allowance")
    tomorrow = F.date_trunc("day", now) + hours(F.lit(24))
    next_at = F.when(~due | F.col("wait_until").isNotNull(), F.greatest("due_at", "wait_until", now)).when(F.col("goes"), now).otherwise(tomorrow)
    return told.select("site_id", "host", verdict.alias("verdict"), next_at.alias("next_at"))
