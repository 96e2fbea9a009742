"""Streaming forms: guarded snapshots, expiring claims, taste folds and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# How far an action moves a weight.
NUDGE = {"purchase": 0.2, "click": 0.1, "view": -0.1, "error": -0.15}


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type in event-time windows; later ones than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start_at"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: runs of events with no longer pause than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "n")


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One event of each key: of a stream inside the watermark, of a table at all."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def newest_versions(snapshots: DataFrame) -> DataFrame:
    """(id, version, body) as each id's version rises; an older version that comes late changes nothing.

    One number is kept for each id, for as long as the query lives: an id that
    were forgotten would take an old version for a new one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        out = None
        for b in batches:
            top = b.loc[b["version"].idxmax()]
            if best is None or top["version"] > best:
                best = int(top["version"])
                out = (key[0], best, top["body"])
        if out is not None:
            state.update((best,))
            yield pd.DataFrame([out], columns=["id", "version", "body"])

    return snapshots.groupBy("id").applyInPandasWithState(step, "id long, version long, body string", "best long", "append", GroupStateTimeout.NoTimeout)


def _then(a: Column, b: Column) -> Column:
    """The clamped additions a and b, one after the other, as one: add, then keep within low and high."""
    within = lambda x: F.greatest(b["low"], F.least(b["high"], x + b["add"]))
    return F.struct((a["add"] + b["add"]).alias("add"), within(a["low"]).alias("low"), within(a["high"]).alias("high"))


def fold_taste(events: DataFrame, chunk: str = "hour") -> DataFrame:
    """(user_id, interest, weight): each user's weights after all their events, in order of time.

    Every step is clamped to [-1, 1] and rounded to hundredths, so order matters.
    A run of clamped additions is one clamped addition, so the events of each
    `chunk` of time become one step first, and a user's chunks are then folded;
    no task holds all events of a user.
    """
    nudge = F.create_map(*(F.lit(x) for k, v in NUDGE.items() for x in (k, round(v * 100))))
    keys = ["user_id", "interest"]
    rows = events.select("user_id", (F.col("event_id") % 4).alias("interest"), F.date_trunc(chunk, "ts").alias("at"), F.struct("ts", "event_id", F.coalesce(nudge[F.col("event_type")], F.lit(0)).alias("by")).alias("e"))
    nothing = F.struct(F.lit(0).alias("add"), F.lit(-100).alias("low"), F.lit(100).alias("high"))
    one = lambda e: F.struct(e["by"].alias("add"), F.lit(-100).alias("low"), F.lit(100).alias("high"))
    steps = rows.groupBy(*keys, "at").agg(F.aggregate(F.sort_array(F.collect_list("e")), nothing, lambda w, e: _then(w, one(e))).alias("step"))
    whole = steps.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("at", "step"))), nothing, lambda w, s: _then(w, s["step"])).alias("f"))
    weight = F.greatest(F.col("f.low"), F.least(F.col("f.high"), F.col("f.add")))
    return whole.select(*keys, (weight / 100).alias("weight"))
