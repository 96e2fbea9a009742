"""robots.txt: which paths a crawler may read, as joins and an aggregate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rules_of(body: str | None, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the group that names the agent, else of the group for all."""
    groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
    naming = False
    for line in (body or "").splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not naming:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            naming = True
        elif key in ("allow", "disallow"):
            naming = False
            if groups and value:
                groups[-1][1].append((key == "allow", value))
    own = [r for names, rules in groups if any(n != "*" and n in agent.lower() for n in names) for r in rules]
    named = any(n != "*" and n in agent.lower() for names, _ in groups for n in names)
    return own if named else [r for names, rules in groups if "*" in names for r in rules]


def pattern(rule: str) -> str:
    """A rule as a regular expression: * is anything, a last $ ends the path."""
    body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
    return "^" + ".*".join(re.escape(x) for x in body.split("*")) + end


def allowed(paths: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """(host, path, allowed): the longest matching rule decides, allow on ties, and no rule allows."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.host, a, pattern(p), len(p)) for r in b.itertuples() for a, p in rules_of(r.body, agent)], columns=["host", "allow", "pattern", "size"])

    rules = files.select("host", "body").mapInPandas(of, "host string, allow boolean, pattern string, size long")
    met = paths.select("host", "path").distinct().join(rules, "host", "left").withColumn("hit", F.rlike("path", F.col("pattern")))
    best = F.max_by("allow", F.when(F.col("hit"), F.struct("size", "allow")))
    return met.groupBy("host", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))
