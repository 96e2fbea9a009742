"""Differences of snapshots and listings; an older snapshot never wins over a newer one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): new, absent, older, unchanged or changed; both have id, version, body."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    change = F.when(F.col("o.id").isNull(), "new").when(F.col("n.id").isNull(), "absent").when(F.col("n.version") < F.col("o.version"), "older").when(F.col("n.body").eqNullSafe(F.col("o.body")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("o.id", "n.id").alias("id"), change.alias("change"))


def withdrawn(occurrences: DataFrame, listed: DataFrame, key: str, now: Column) -> DataFrame:
    """Scheduled occurrences that a complete listing no longer has and that aren't over."""
    ends = F.coalesce("end_at", F.col("start_at") + F.make_dt_interval(hours=F.lit(2)))
    return occurrences.join(listed.select(key), key, "left_anti").where((F.col("status") == "scheduled") & (ends > now))


def tombstones(holders: DataFrame, read: DataFrame, area: str) -> DataFrame:
    """Records that the area held, its complete read lacks, and no other area holds.

    `holders` has (area, id); `read` has the ids of the area's snapshot.
    """
    released = holders.where(F.col("area") == area).join(read.select("id"), "id", "left_anti").select("id")
    return released.join(holders.where(F.col("area") != area).select("id"), "id", "left_anti")
