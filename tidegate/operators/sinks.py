"""Writes as derivations: upserts with counts, ledger batches, extents, run logs, retention.

Tables are append-only or derived anew, so each write is a DataFrame of what the
table holds after it, and can be written over a path of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import geo

# How long an observation of each dynamic attribute holds, in minutes.
HOLDS_MIN = {"crowd_level": 30, "queue": 20, "open_state": 45}
CLAIM = ["subject_id", "attribute", "source", "record"]


def upserted(old: DataFrame, new: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """The rows after an upsert, with change: inserted, updated, unchanged, or kept where the batch has no such key."""
    o, n = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in body), F.lit(True).alias("_old")), new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in body), F.lit(True).alias("_new"))
    both = o.join(n, keys, "full_outer")
    same = F.lit(True)
    for c in body:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    return both.select(*keys, *(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in body), change.alias("change"))


def refused(rows: DataFrame, dynamic: list[str]) -> Column:
    """Why a claim may not enter the ledger, null where it may; the first reason that holds."""
    c = F.col
    rules = [
        (c("confidence").isNull() | F.isnan(c("confidence").cast("double")) | ~c("confidence").between(0, 1), "confidence out of range"),
        ((c("class") == "published") & c("evidence").isNull(), "published facts need evidence"),
        ((c("class") == "observation") & c("observed_at").isNull(), "observations need observed_at"),
        (c("attribute").isin(dynamic) & (c("class") != "observation"), "may only be an observation"),
        (c("value").isNull(), "value is required"),
    ]
    return F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(why)) for rule, why in rules))


def claim_hash() -> Column:
    """What a claim says and rests on; its source's edit time is no part of it."""
    part = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("null"))
    return F.substring(F.sha2(F.concat_ws("|", part("value"), part("class"), part("evidence"), part("observed_at")), 256), 1, 32)


def written_claims(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The active ledger after a batch of valid claims, with change: inserted, refreshed, kept or superseded.

    Both have CLAIM, value, class, evidence, observed_at, fetched_at, confidence
    and valid_until. A claim that the ledger already holds is refreshed; it keeps
    what the batch does not say. Claims of one record supersede its others of the
    attribute, and those of the time before records; observations never do, nor
    are they superseded, and hold for a time by default. Written twice, a batch
    changes nothing more.
    """
    key = [*CLAIM, "hash"]
    until = F.coalesce("valid_until", F.when(F.col("class") == "observation", F.coalesce("observed_at", "fetched_at") + F.make_dt_interval(mins=F.create_map(*(F.lit(x) for kv in HOLDS_MIN.items() for x in kv))[F.col("attribute")])))
    rows = lambda df: df.withColumn("record", F.coalesce("record", F.lit(""))).withColumn("hash", claim_hash())
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("fetched_at"), F.desc("confidence")))
    new = rows(batch).withColumn("valid_until", until).withColumn("_n", latest).where("_n = 1").drop("_n")
    old = rows(ledger)
    held = [c for c in old.columns if c not in key]
    both = old.select(*key, F.struct(*held).alias("o")).join(new.select(*key, F.struct(*held).alias("n")), key, "full_outer")
    merged = both.select(*key, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c not in ("valid_until",) else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in held), F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").otherwise("refreshed").alias("change"))
    said = new.where("class <> 'observation'").groupBy(*CLAIM).agg(F.max_by("hash", "fetched_at").alias("says"))
    any_record = said.where("record <> ''").select(*CLAIM[:3]).distinct().withColumn("named", F.lit(True))
    out = merged.join(said, CLAIM, "left").join(any_record, CLAIM[:3], "left")
    gone = (F.col("class") != "observation") & (F.coalesce(F.col("says") != F.col("hash"), F.lit(False)) | ((F.col("record") == "") & F.coalesce("named", F.lit(False))))
    return out.withColumn("change", F.when(gone, "superseded").otherwise(F.col("change"))).drop("says", "named")


def due_again(records: DataFrame, touched: DataFrame, rules: str, now: Column) -> DataFrame:
    """record_id of what must be normalised: changed records, those read by older rules, those whose own date came due."""
    stale = records.where(~F.col("normalized_with").eqNullSafe(F.lit(rules)) | (F.col("renormalize_at") <= now)).select("record_id")
    return stale.union(touched.select("record_id")).distinct()


def replaced_in_extent(held: DataFrame, read: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """The rows after everything inside a circle gave way to what was read; both have id, lat, lon."""
    inside = geo.distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= metres
    return held.where(~inside).join(read.select("id"), "id", "left_anti").unionByName(read)


def run_states(log: DataFrame) -> DataFrame:
    """(job, runs, last_success, last_failure, rows) from an append-only log of finishes: job, run_id, at, ok, rows."""
    ok = F.col("ok")
    return log.groupBy("job").agg(F.count("*").alias("runs"), F.max(F.when(ok, F.col("at"))).alias("last_success"), F.max(F.when(~ok, F.col("at"))).alias("last_failure"), F.sum(F.when(ok, F.col("rows")).otherwise(0)).alias("rows"))


def coarse(runs: DataFrame) -> DataFrame:
    """What may be kept of a search: its origin to two places, counts in place of ids, nothing of a taste but its size."""
    two = lambda c: F.round(F.col(c), 2).alias(c)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) if isinstance(c, Column) else F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return runs.select("run_id", two("lat"), two("lon"), size("seen_ids").alias("seen"), size("dismissed_ids").alias("dismissed"), size("taste").alias("taste"))


def prunable(runs: DataFrame, cutoff: Column, most: int = 500) -> DataFrame:
    """run_id of the oldest runs before the cutoff, at most `most` a call."""
    return runs.where(F.col("created_at") < cutoff).orderBy("created_at", "run_id").limit(most).select("run_id")
