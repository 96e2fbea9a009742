"""Queries of the crawl's next requests, each with its SQL: `pages` are sites, `events` the log of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import frontier
from tidegate.session import table

NOW = "2024-01-20 12:00:00"


def sites(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select(k.alias("site_id"), text.domain_key(F.col("url")).alias("host"), (24 + k % 7 * 24).alias("interval_h"), (k % 5 == 0).alias("lists_events"))


def requests_log(spark, d):
    """Each event as a request to the site that its id falls on; sign-ups read robots.txt, errors ask to wait, refuse or fail."""
    e, s = table(spark, d, "events"), sites(spark, d)
    k = F.col("event_id")
    on = e.crossJoin(s.agg(F.count("*").alias("n"))).select((k * 7919 % F.col("n")).alias("site_id"), F.col("ts").cast("timestamp").alias("at"), "event_type", k)  # one row beside the events
    error = F.col("event_type") == "error"
    outcome = F.when(~error, "ok").when(k % 3 == 0, "wait").when(k % 30 == 2, "refused").otherwise("failed")
    log = on.select("site_id", "at", F.when(F.col("event_type") == "signup", "robots").otherwise("page").alias("kind"), outcome.alias("outcome"), F.when(outcome == "wait", (k % 40 * 3600).cast("int")).alias("asked_s"))
    return log.join(s.select("site_id", "host"), "site_id")


def _plan(spark, d):
    return frontier.plan(sites(spark, d), requests_log(spark, d), F.lit(NOW).cast("timestamp"))


def crawl_plan(spark, d):
    return _plan(spark, d).select("site_id", "host", "verdict", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


def host_budgets(spark, d):
    """For each host: how many of its sites go now, wait for its pause, for the next day or for their own time, and whether robots.txt is read first."""
    counts = _plan(spark, d).groupBy("host").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("go", "backoff", "allowance", "not_due")))
    states = frontier.host_states(requests_log(spark, d), F.lit(NOW).cast("timestamp"))
    return counts.join(states, "host", "left").select("host", "go", "backoff", "allowance", "not_due", F.coalesce("left", F.lit(frontier.PER_DAY - 1)).alias("left"), F.coalesce("reads_robots", F.lit(True)).alias("reads_robots"))


QUERIES = {f.__name__: f for f in (crawl_plan, host_budgets)}

_N = f"TIMESTAMP '{NOW}'"
PLAN_SQL = rf"""si AS (SELECT page_id AS site_id, nullif(regexp_extract(lower(url), '^(?:[a-z]+://)?(?:www\.)?([a-z0-9.-]+)', 1), '') AS host, 24 + page_id % 7 * 24 AS interval_h, page_id % 5 = 0 AS lists_events FROM pages),
lg AS (SELECT *, host FROM (SELECT event_id * 7919 % (SELECT count(*) FROM pages) AS site_id, ts AS t, event_type = 'signup' AS robots, CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 3 = 0 THEN 'wait' WHEN event_id % 30 = 2 THEN 'refused' ELSE 'failed' END AS outcome, event_id % 40 AS asked_h FROM events WHERE ts <= {_N}) JOIN si USING (site_id)),
ho AS (SELECT host, count(*) FILTER (t::DATE = {_N}::DATE) AS spent, arg_max(t + to_hours(greatest(6, asked_h)::INT), t) FILTER (outcome = 'wait') AS until, coalesce(max(t) FILTER (robots) + INTERVAL 24 HOUR <= {_N}, true) AS reads_robots FROM lg GROUP BY host),
st AS (SELECT host, greatest(0, 4 - spent - reads_robots::INT)::INT AS "left", CASE WHEN until > {_N} THEN until END AS until, reads_robots FROM ho),
la AS (SELECT site_id, max(t) AS last_at, bool_or(outcome = 'refused') AS refused FROM lg WHERE NOT robots GROUP BY site_id),
du AS (SELECT si.*, last_at, last_at + to_hours(CASE WHEN refused THEN 720 ELSE interval_h END::INT) AS due_at, coalesce("left", 3) AS "left", until, coalesce(reads_robots, true) AS reads_robots FROM si LEFT JOIN la USING (site_id) LEFT JOIN st USING (host) WHERE host IS NOT NULL),
tu AS (SELECT *, coalesce(due_at < {_N}, true) AS due, sum((coalesce(due_at < {_N}, true) AND until IS NULL)::INT) OVER (PARTITION BY host ORDER BY last_at NULLS FIRST, lists_events DESC, site_id ROWS UNBOUNDED PRECEDING) AS turn FROM du),
ve AS (SELECT *, CASE WHEN NOT due THEN 'not_due' WHEN until IS NOT NULL THEN 'backoff' WHEN turn <= "left" THEN 'go' ELSE 'allowance' END AS verdict FROM tu)"""

ORACLES = {
    "crawl_plan": f"WITH {PLAN_SQL} SELECT site_id, host, verdict, strftime(CASE verdict WHEN 'go' THEN {_N} WHEN 'allowance' THEN date_trunc('day', {_N}) + INTERVAL 1 DAY ELSE greatest(due_at, until, {_N}) END, '%Y-%m-%d %H:%M:%S') AS next_at FROM ve",
    "host_budgets": f"""WITH {PLAN_SQL} SELECT host, {', '.join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ('go', 'backoff', 'allowance', 'not_due'))}, any_value("left") AS "left", any_value(reads_robots) AS reads_robots FROM ve GROUP BY host""",
}
