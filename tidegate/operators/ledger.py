"""The append-only claim ledger: resolution, supersession, retraction, publishing.

A claim has claim_id, subject_id, attribute, value, class, source, lineage,
confidence, seen_at and valid_until. Current values are always rebuilt from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Trust in sources, and the rank of evidence classes.
TRUST = {"firstparty": 0.9, "founder": 0.85, "firstparty_found": 0.8, "venue_events": 0.8, "user_observation": 0.7, "osm": 0.6, "overture": 0.6, "foursquare_os": 0.6, "google_places": 0.65, "category_policy": 0.3}
DEFAULT_TRUST = 0.5
CLASS_RANK = {"published": 3, "observation": 2, "estimate": 1}
CLOSURE_FROM = 0.6
CONSEQUENCE = {"opening_hours": 1.0, "business_status": 1.0, "admission": 0.8, "price": 0.4}
WEAK_BELOW = 0.5


def lookup(keys: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[keys], F.lit(default))


def active(claims: DataFrame, now: Column) -> DataFrame:
    """Claims that have not expired; validity is half open."""
    return claims.where(F.col("valid_until").isNull() | (F.col("valid_until") > now))


def resolve(claims: DataFrame) -> DataFrame:
    """The current value of each (subject, attribute) with confidence, lineage count and conflict.

    Winner: an unanswered closure, then class, trust, confidence, recency, and
    the smallest claim id. A closure is answered by a more trusted and more
    recent claim of operating. Agreeing claims count once per lineage; the
    complement of the product of their doubts, less a share for a conflict, is
    the confidence. All windows share one partitioning by subject and attribute.
    """
    key = Window.partitionBy("subject_id", "attribute")
    trusted = claims.withColumn("trust", lookup(F.col("source"), TRUST, DEFAULT_TRUST)).withColumn("rank", lookup(F.col("class"), CLASS_RANK, 0).cast("int"))
    closure = (F.col("attribute") == "business_status") & F.col("value").startswith("closed") & (F.col("confidence") >= CLOSURE_FROM)
    # the latest claim of operating among the strictly more trusted ones
    above = key.orderBy(F.round(F.col("trust") * -1000).cast("int")).rangeBetween(Window.unboundedPreceding, -1)
    answered = F.coalesce(F.max(F.when(F.col("value") == "operating", F.col("seen_at"))).over(above) > F.col("seen_at"), F.lit(False))
    rows = trusted.withColumn("first", F.coalesce(closure & ~answered, F.lit(False)).cast("int"))
    order = key.orderBy(F.desc("first"), F.desc("rank"), F.desc("trust"), F.desc("confidence"), F.desc("seen_at"), "claim_id")
    best = F.first(F.struct("claim_id", "value", "class", "trust", "seen_at")).over(order)
    rows = rows.withColumn("w", best).where(F.col("class") == F.col("w.class"))
    agrees = F.col("value") == F.col("w.value")
    against = ~agrees & ((F.col("trust") >= F.col("w.trust")) | (F.col("seen_at") > F.col("w.seen_at")))
    voice = F.coalesce("lineage", "source")
    per_voice = rows.groupBy("subject_id", "attribute", "w", voice.alias("voice")).agg(
        F.max(F.when(agrees, F.col("confidence"))).alias("c"), F.count_if(against).alias("against"), F.min(F.when(agrees, F.col("valid_until"))).alias("until"), F.count_if(agrees).alias("claims")
    )
    doubt = F.product(1 - F.least(F.lit(0.95), F.col("c").cast("double")))
    got = per_voice.groupBy("subject_id", "attribute", "w").agg(doubt.alias("doubt"), F.count("c").alias("independent"), F.sum("against").alias("against"), F.min("until").alias("valid_until"), F.sum("claims").alias("claims"))
    raw = (1 - F.col("doubt")) * F.when(F.col("against") > 0, 0.7).otherwise(1.0)
    return got.select(
        "subject_id", "attribute", F.col("w.value").alias("value"), F.col("w.class").alias("class"), F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.97), raw)), 3).alias("confidence"),
        F.col("independent").cast("long").alias("independent"), (F.col("against") > 0).alias("conflict"), "valid_until", F.col("claims").cast("long").alias("claims")
    )


def documents_of(current: DataFrame) -> DataFrame:
    """One map a subject: attribute to its current fact."""
    fact = F.struct("value", "confidence", "conflict")
    return current.groupBy("subject_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", fact.alias("fact"))))).alias("facts"))


def superseded(claims: DataFrame) -> DataFrame:
    """Claims with superseded_at: when the same record next said something else.

    A record is (subject, attribute, source, lineage). A repeated value only
    refreshes; observations never supersede.
    """
    record = Window.partitionBy("subject_id", "attribute", "source", "lineage").orderBy("seen_at", "claim_id")
    rows = claims.where(F.col("class") != "observation")
    changed = rows.withColumn("_before", F.lag("value").over(record)).where(~F.col("value").eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    return changed.withColumn("superseded_at", F.lead("seen_at").over(record)).drop("_before")


def retract_except(ledger: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows of the records in `batch` whose attribute it no longer asserts."""
    return ledger.join(batch.select(*keys).distinct(), keys, "left_semi").join(batch.select(*keys, "attribute").distinct(), [*keys, "attribute"], "left_anti")


def publish_state(subjects: DataFrame, current: DataFrame) -> DataFrame:
    """eligible, excluded or candidate for each subject, from its current facts alone."""
    facts = current.groupBy("subject_id").agg(F.count("*").alias("facts"), F.max(F.when(F.col("attribute") == "business_status", F.col("value"))).alias("status"))
    state = F.when(F.col("status") == "closed_permanently", "excluded").when(F.coalesce("facts", F.lit(0)) == 0, "candidate").otherwise("eligible")
    return subjects.join(facts, "subject_id", "left").select("subject_id", state.alias("state"))


def verification_queue(current: DataFrame, states: DataFrame, attributes: list[str]) -> DataFrame:
    """Weak or missing facts of eligible subjects, with a priority and a key that dedupes."""
    wanted = states.where("state = 'eligible'").select("subject_id", F.explode(F.array(*map(F.lit, attributes))).alias("attribute"))
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    rows = wanted.join(current.select("subject_id", "attribute", "confidence"), ["subject_id", "attribute"], "left").where(conf < WEAK_BELOW)
    return rows.select("subject_id", "attribute", F.round(lookup(F.col("attribute"), CONSEQUENCE, 0.5) * (1 - conf), 3).alias("priority"), F.concat_ws(":", F.lit("venue"), F.col("subject_id").cast("string"), "attribute").alias("dedupe_key"))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """An upsert without a mutable table: per key the row of the highest version, the new one on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_place", place).where("_place = 1").drop("_place", "_new")
