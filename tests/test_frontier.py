"""The crawl's next requests, against a reader that asks for each request in turn."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidegate.operators import frontier

NOW = dt.datetime(2024, 3, 5, 15, 0)
SITES, LOG = "site_id long, host string, interval_h int, lists_events boolean", "site_id long, host string, at timestamp, kind string, outcome string, asked_s int"


def told(spark, sites, log, per_day=4):
    df = frontier.plan(spark.createDataFrame(sites, SITES), spark.createDataFrame(log, LOG), F.lit(str(NOW)).cast("timestamp"), per_day)
    return {r.site_id: (r.verdict, r.next_at) for r in df.collect()}


def one_by_one(sites, log, per_day):
    """Requests in turn: a host's robots.txt first where it is old, then its due sites until the day is spent."""
    log = [x for x in log if x[2] <= NOW]
    spent, until, robots, last, refused = {}, {}, {}, {}, set()
    for site, host, at, kind, outcome, asked in sorted(log, key=lambda x: x[2]):
        spent[host] = spent.get(host, 0) + (at.date() == NOW.date())
        if outcome == "wait":
            until[host] = at + dt.timedelta(seconds=max(asked or 0, 6 * 3600))
        if kind == "robots":
            robots[host] = at
        else:
            last[site] = at
            if outcome == "refused":
                refused.add(site)
    out, read_today = {}, set()
    for site, host, every, lists in sorted((s for s in sites if s[1]), key=lambda s: (s[0] in last, last.get(s[0], NOW), not s[3], s[0])):
        due = None if site not in last else last[site] + dt.timedelta(hours=720 if site in refused else every)
        waits = until.get(host) if until.get(host, NOW) > NOW else None
        if due is not None and due >= NOW:
            out[site] = ("not_due", max(due, waits or NOW))
            continue
        if waits:
            out[site] = ("backoff", waits)
            continue
        if host not in read_today and (host not in robots or NOW - robots[host] >= dt.timedelta(hours=24)):
            spent[host] = spent.get(host, 0) + 1
        read_today.add(host)
        if spent.get(host, 0) < per_day:
            spent[host] = spent.get(host, 0) + 1
            out[site] = ("go", NOW)
        else:
            out[site] = ("allowance", dt.datetime(2024, 3, 6))
    return out


def test_plan_is_what_a_reader_in_turn_gets(spark):
    pick = random.Random(9)
    hosts = ["hot.example"] * 20 + [f"h{i}.example" for i in range(25)] + [None]
    sites = [(i, pick.choice(hosts), pick.choice([24, 48, 168]), pick.random() < 0.3) for i in range(400)]
    log = []
    for i in range(900):
        site = pick.choice(sites[:300])
        kind = pick.choice(["page", "page", "page", "robots"])
        outcome = pick.choice(["ok"] * 12 + ["failed", "wait", "refused"])
        if site[1] and not (site[1] == "hot.example" and outcome == "wait"):
            log.append((site[0], site[1], NOW - dt.timedelta(minutes=pick.randint(-200, 9000), seconds=i % 60), kind, outcome, pick.choice([None, 60, 90_000]) if outcome == "wait" else None))
    for per_day in (4, 12):
        got, want = told(spark, sites, log, per_day), one_by_one(sites, log, per_day)
        assert got == want and {v for v, _ in want.values()} == {"go", "not_due", "backoff", "allowance"}


def test_nothing_known_and_nothing_asked(spark):
    assert told(spark, [], []) == {}
    got = told(spark, [(i, "new.example", 24, None) for i in range(5)] + [(9, None, 24, True)], [])
    assert [got[i][0] for i in range(5)] == ["go", "go", "go", "allowance", "allowance"] and 9 not in got  # robots.txt takes the first
    log = [(1, "a.example", NOW - dt.timedelta(hours=1), "page", "wait", None), (2, "a.example", NOW + dt.timedelta(hours=1), "page", "wait", 10**6)]
    assert told(spark, [(1, "a.example", 0, False)], log) == {1: ("backoff", NOW + dt.timedelta(hours=5))}


def test_only_the_first_of_a_host_are_ranked(spark):
    df = frontier.plan(spark.createDataFrame([(1, "a", 24, False)], SITES), spark.createDataFrame([], LOG), F.lit(str(NOW)).cast("timestamp"))
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
