"""Map tags as facts: one record becomes claims with a class and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The category of a tag, by key, in the order in which keys decide.
CATEGORY_OF = {
    "amenity": {
        "restaurant": "restaurant", "cafe": "cafe", "bar": "bar", "pub": "bar", "biergarten": "bar", "ice_cream": "dessert", "food_court": "restaurant", "theatre": "theatre", "cinema": "cinema",
        "arts_centre": "arts_centre", "community_centre": "community", "marketplace": "market", "library": "library", "nightclub": "nightclub", "music_venue": "live_music", "karaoke_box": "activity", "casino": "activity",
    },
    "tourism": {"museum": "museum", "gallery": "gallery", "attraction": "attraction", "viewpoint": "viewpoint", "zoo": "attraction", "aquarium": "attraction", "theme_park": "attraction"},
    "leisure": {"park": "park", "garden": "garden", "nature_reserve": "park", "bowling_alley": "bowling", "amusement_arcade": "arcade", "escape_game": "activity", "miniature_golf": "activity", "ice_rink": "activity"},
    "shop": {"books": "bookshop"},
    "natural": {"beach": "waterfront"},
}
WALK_IN = ["cafe", "bar", "dessert", "bookshop", "library", "park", "viewpoint", "waterfront", "market", "community"]
OUTDOOR = ["park", "garden", "viewpoint", "waterfront"]
TICKETED = ["museum", "attraction", "gallery", "garden"]


def category(tags: Column) -> Column:
    """The category of the first key that has one."""
    by_key = []
    for key, table in CATEGORY_OF.items():
        known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
        by_key.append(known[tags[key]])
    climbing = F.when((tags["leisure"] == "sports_centre") & tags["sport"].contains("climbing"), "activity")
    return F.coalesce(*by_key, climbing)


def hours_confidence(edited: Column, now: Column) -> Column:
    """Fresh edits count most; each year takes 0.06, down to 0.3. Unknown age: 0.45."""
    years = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(edited)) / (365.25 * 86_400_000))
    return F.when(edited.isNull(), 0.45).otherwise(F.greatest(F.lit(0.3), F.round(0.62 - 0.06 * years, 3)))


def facts(elements: DataFrame, now: Column) -> DataFrame:
    """(external_id, attribute, value, class, confidence) of elements with tags and edited.

    A published claim repeats what a tag says; an estimate follows from the kind
    of place alone. Every element has a status, and one with a category an
    admission and a setting.
    """
    t = F.col("tags")
    said = lambda name, value, conf: F.when(value.isNotNull(), F.struct(F.lit(name).alias("attribute"), value.alias("value"), F.lit("published").alias("class"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence")))
    guess = lambda name, value, conf: F.when(value.isNotNull(), F.struct(F.lit(name).alias("attribute"), value.alias("value"), F.lit("estimate").alias("class"), (conf if isinstance(conf, Column) else F.lit(conf)).alias("confidence")))
    cat = F.col("_category")
    rows = elements.withColumn("_category", category(t))
    gone = F.exists(F.map_keys(t), lambda k: k.rlike("^(disused|abandoned|was):")) | t["opening_hours"].isin("off", "closed")
    recent = F.unix_millis(now) - F.unix_millis("edited") < 2 * 365 * 86_400_000
    status = F.coalesce(said("business_status", F.when(gone, "closed_permanently"), 0.75), guess("business_status", F.lit("operating"), F.when(F.coalesce(recent, F.lit(False)), 0.5).otherwise(0.35)))
    site = F.coalesce(t["website"], t["contact:website"], t["url"])
    phone = F.coalesce(t["phone"], t["contact:phone"])
    open_ = F.when(~F.coalesce(t["opening_hours"].isin("off", "closed"), F.lit(True)), t["opening_hours"])
    admission = F.coalesce(
        said("admission", F.when(t["access"].isin("private", "no", "members", "permit", "residents"), "members_only"), 0.7),
        said("admission", F.when(t["reservation"] == "required", "reservation"), 0.7),
        said("admission", F.when((t["fee"] == "yes") & cat.isin(TICKETED), "ticket"), 0.6),
        guess("admission", F.when(t["leisure"] == "escape_game", "reservation"), 0.6),
        guess("admission", F.when(cat.isin(WALK_IN), "walk_in"), 0.55),
        guess("admission", F.when(cat.isin("bowling", "arcade", "nightclub", "activity"), "walk_in"), 0.45),
        guess("admission", F.when(cat == "restaurant", F.when(t["reservation"].isin("yes", "recommended"), "reservation_available").otherwise("walk_in")), 0.45),
        guess("admission", F.when(cat.isin("theatre", "cinema", "live_music"), "ticket"), 0.6),
        guess("admission", F.when(cat.isNotNull(), "unknown"), 0.2),
    )
    price = F.coalesce(
        said("price", F.when(t["fee"] == "no", "free"), 0.7),
        said("price", F.when(t["fee"] == "yes", "paid"), 0.6),
        guess("price", F.when(cat.isin(OUTDOOR) & ~F.coalesce(t["natural"] == "beach", F.lit(False)), "free"), 0.6),
        guess("price", F.when(cat == "library", "free"), 0.7),
    )
    wheel = F.lower(F.trim(t["wheelchair"]))
    step_free = F.when(wheel == "designated", "yes").when(wheel.isin("yes", "limited", "no"), wheel)
    age = F.when(t["min_age"].rlike(r"^\d{1,2}$") & (t["min_age"].try_cast("int") <= 25), t["min_age"])
    every = F.array_compact(
        F.array(
            said("name", F.nullif(F.trim(t["name"]), F.lit("")), 0.9), said("category", cat, 0.8), status, said("opening_hours", open_, hours_confidence(F.col("edited"), now)), said("website", site, 0.8),
            said("phone", phone, 0.8), said("takeout", F.when(t["takeaway"].isin("yes", "no", "only"), t["takeaway"]), 0.7), said("wheelchair", step_free, 0.7),
            said("age_limit", age, 0.75), admission, price, guess("indoor_outdoor", F.when(cat.isNotNull(), F.when(cat.isin(OUTDOOR), "outdoor").otherwise("indoor")), 0.6),
        )
    )
    return rows.select("external_id", F.inline(every))
