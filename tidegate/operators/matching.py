"""Matching by names and titles, and joins that lay one set of facts over another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import geo, titles
from tidegate.session import cut

POPULAR = 20
#: Facts of a venue that say nothing of an event held there.
NOT_INHERITED = ["opening_hours"]


def overlaid(occurrences: DataFrame, venues: DataFrame) -> DataFrame:
    """(occ_id, venue_id, facts): an event's own facts over those of its venue, less what it does not inherit.

    Both sides have a map column facts; an event without a venue keeps its own.
    """
    base = venues.select("venue_id", F.map_filter("facts", lambda k, v: ~k.isin(NOT_INHERITED)).alias("base"))
    rows = occurrences.join(base, "venue_id", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    over = F.map_zip_with(F.coalesce("base", none), F.coalesce("facts", none), lambda k, below, own: F.coalesce(own, below))
    return rows.select("occ_id", "venue_id", over.alias("facts"))


def by_name(asked: DataFrame, venues: DataFrame) -> DataFrame:
    """(ask_id, found, venue_id): exact, unique, ambiguous or none, and the venue where it is one.

    An equal key wins if one venue has it; else the one venue whose key starts
    with what was asked. Two or more are ambiguous.
    """
    # counted by key before asks meet them: asks that bear one name would each meet every venue of that name
    exact = venues.groupBy(F.col("key").alias("ask_key")).agg(F.count("*").alias("n_exact"), F.min("venue_id").alias("exact_id"))
    words = venues.select("venue_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", " "))), lambda n: F.array_join(F.slice(F.split("key", " "), F.lit(1), n), " "))).alias("ask_key"))
    begins = words.groupBy("ask_key").agg(F.count("*").alias("n"), F.min("venue_id").alias("id"))
    rows = asked.join(begins.join(exact, "ask_key", "left"), "ask_key", "left")
    found = F.when(F.col("n_exact") == 1, "exact").when(F.col("n_exact") > 1, "ambiguous").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return rows.select("ask_id", found.alias("found"), F.when(found == "exact", F.col("exact_id")).when(found == "unique", F.col("id")).alias("venue_id"))


def placed(locations: DataFrame, venues: DataFrame, generic: list[str]) -> DataFrame:
    """(loc_id, how, venue_id): where an event's location line is, by the first stage that finds just one venue.

    Stages: the same name key; all words of the venue's name among the line's,
    one of them not generic; the same address. Locations have loc_id, key and
    address, venues venue_id, key and address.
    """
    common = F.array(*map(F.lit, generic))
    words = lambda c: F.array_distinct(F.split(c, " "))
    own = F.array_except(words(F.col("key")), common)
    one = lambda df, how, rank: df.groupBy("loc_id").agg(F.countDistinct("venue_id").alias("n"), F.min("venue_id").alias("venue_id")).where("n = 1").select("loc_id", "venue_id", F.lit(how).alias("how"), F.lit(rank).alias("rank"))
    name = one(locations.select("loc_id", "key").join(venues.select("venue_id", "key"), "key"), "name", 1)
    # a venue meets a line through its first distinctive word, which the line must hold
    parts = venues.where(F.size(own) > 0).select("venue_id", words(F.col("key")).alias("all"), F.element_at(F.array_sort(own), 1).alias("word"))
    lines = locations.select("loc_id", words(F.col("key")).alias("line"), F.explode(words(F.col("key"))).alias("word"))
    subset = one(lines.join(parts, "word").where(F.size(F.array_except("all", "line")) == 0), "words", 2)
    address = one(locations.select("loc_id", "address").join(venues.select("venue_id", "address"), "address"), "address", 3)
    best = name.unionByName(subset).unionByName(address).groupBy("loc_id").agg(F.min_by(F.struct("how", "venue_id"), "rank").alias("b"))
    return locations.select("loc_id").join(best, "loc_id", "left").select("loc_id", F.coalesce("b.how", F.lit("none")).alias("how"), F.col("b.venue_id").alias("venue_id"))


def curated(entries: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """(entry_id, place_id): the record that each entry of a curated list is.

    Of the places within the radius that bear one of its names, the best by: the
    name itself, then an alias; filed as expected; nearer by half kilometres;
    more confidence; the smaller id. Entries have entry_id, key, aliases (keys),
    filed, e_lat, e_lon; places place_id, key, category, confidence, lat, lon.
    """
    names = entries.select("entry_id", "filed", "e_lat", "e_lon", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("alias"), F.col("key").alias("key"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("alias"), a.alias("key"))))).alias("n")).select("entry_id", "filed", "e_lat", "e_lon", "n.alias", "n.key")
    rows = names.join(places, "key").withColumn("metres", geo.distance_m(F.col("e_lat"), F.col("e_lon"), F.col("lat"), F.col("lon"))).where(F.col("metres") <= metres)
    rank = F.struct("alias", (F.col("category") != F.col("filed")).alias("unfiled"), F.floor(F.col("metres") / 500).alias("far"), (-F.col("confidence")).alias("doubt"), "place_id")
    return rows.groupBy("entry_id").agg(F.min_by("place_id", rank).alias("place_id"))


def popular_films(films: DataFrame, most: int | None = POPULAR) -> DataFrame:
    """(key, film_id, score): the `most` first of a list by popularity, or all, by title key; the tenth still scores 0.7, the 31st and later 0.

    A key of fewer than three letters would match too much; of two films with one
    key the more popular has it. Films have film_id, title and popularity; a film
    that several lists name counts once, at its most popular.
    """
    once = films.groupBy("film_id").agg(F.max_by(F.struct("title", "popularity"), "popularity").alias("f")).select("film_id", "f.title", "f.popularity")
    order = [F.desc("popularity"), F.col("film_id")]
    if most is None:
        ranked = _places(once, order)
    else:
        ranked = once.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # `most` rows
    keyed = ranked.select("film_id", "place", F.get(titles.film_keys(F.col("title")), F.lit(0)).alias("key")).where(F.length("key") >= 3)
    score = F.greatest(F.lit(0.0), 1 - (F.col("f.place") - 1) / 30)
    return keyed.groupBy("key").agg(F.min_by(F.struct("film_id", "place"), "place").alias("f")).select("key", "f.film_id", F.round(score, 3).alias("score"))


def _places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with their place in a total order: by ranges, each sorted by itself behind the counts of those before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("count")  # a row for each range
    starts = ranges.groupBy("_range").count().select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "_range").withColumn("place", F.col("_before") + own).drop("_range", "_before")


def by_title(screenings: DataFrame, films: DataFrame) -> DataFrame:
    """(occ_id, film_id, score): the film of each screening, by the closest of its title's keys that one has."""
    keys = screenings.select("occ_id", F.posexplode(titles.film_keys(F.col("title"))).alias("pos", "key"))
    return keys.join(films, "key").groupBy("occ_id").agg(F.min_by(F.struct("film_id", "score"), "pos").alias("f")).select("occ_id", "f.film_id", "f.score")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, in the given order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def once_across_sources(events: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """One event of each venue, title key and start minute: of the best ranked source, then the smaller id."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col("source")], F.lit(99))
    return first_of_each(events.withColumn("minute", F.date_trunc("minute", "start_at")), ["venue_id", "title_key", "minute"], [rank, F.col("occ_id")], 1).drop("minute")


def withdrawn_by_feed(held: DataFrame, read: DataFrame, feeds: DataFrame) -> DataFrame:
    """occ_id of a feed's events that its complete read no longer lists, up to the last day it read.

    `held` and `read` have feed_id, occ_id and start_at (held); feeds has
    feed_id, complete and last_day. An incomplete read withdraws nothing.
    """
    whole = feeds.where("complete").select("feed_id", "last_day")
    return held.join(whole, "feed_id").where(F.to_date("start_at") <= F.col("last_day")).join(read.select("feed_id", "occ_id"), ["feed_id", "occ_id"], "left_anti").select("occ_id")
