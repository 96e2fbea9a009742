"""The query of event files taken in as batches, one of them refused and one given twice, with its SQL.

Orders stand for what a source lists in two areas, which share some; a second
file of the first area lacks some, says others anew, and repeats a few ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import event_ingest
from tidegate.operators.publish import Book, Refused
from tidegate.session import shared_path, table

NOW = "1996-01-01 12:00:00"
CENTER = (40.75, -73.95)
RADIUS_M = 3000.0


def _file(spark, d, area: int, turn: int):
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    inside = (k % 2 == area) | (k % 7 == 0)
    start = F.lit(NOW).cast("timestamp") + F.make_dt_interval(days=(k % 450 - 20).cast("int"))
    price = F.map_from_arrays(F.array(F.lit("kind"), F.lit("price")), F.array(F.lit("show"), s(k % 30 + turn)))
    rows = table(spark, d, "orders").where(inside & (k % 10 != turn)).select(
        k.alias("line"), s(k).alias("id"), F.when(k % 5 != 0, F.concat(F.lit("v"), s(F.col("o_custkey") % 100))).alias("venue"), F.concat(F.lit("The Hall No. "), s(k % 40)).alias("place"),
        (40.75 + k % 40 / F.lit(1000.0)).alias("lat"), F.lit(-73.95).alias("lon"), F.concat(F.lit("Show "), s(k % 100), F.when((turn == 2) & (k % 4 == 0), ", again").otherwise("")).alias("title"),
        start.alias("start_at"), F.when(k % 3 == 0, start + F.make_dt_interval(hours=(k % 400 - 8).cast("int"))).alias("end_at"), F.when(k % 9 == 0, "cancelled").when(k % 9 == 1, "sold_out").alias("status"),
        F.when((turn == 2) & (k % 3 == 0), F.map_filter(price, lambda a, _: a != "price")).otherwise(price).alias("facts"),
    )
    again = rows.where(F.col("line") % 50 == 0).withColumn("line", F.col("line") + (1 << 40)).withColumn("title", F.lit("Another"))
    return rows.unionByName(again)


def event_batches(spark, d):
    book = Book.create(spark, shared_path(spark, "book"), event_ingest.TABLES)
    take = lambda batch, area, file: event_ingest.ingest(book, batch, file, "feed", f"area {area}", F.lit(NOW).cast("timestamp"), CENTER, RADIUS_M)
    take("first of area 0", 0, _file(spark, d, 0, 1))
    take("first of area 1", 1, _file(spark, d, 1, 1))
    second = _file(spark, d, 0, 2)
    try:
        take("second of area 0", 0, second.withColumn("title", F.lit("Never shown")).withColumn("facts", F.create_map(F.lit("kind"), F.lit(" "))))
    except Refused:
        take("second of area 0", 0, second)
    take("second of area 0", 0, second.withColumn("title", F.lit("Given twice")))
    facts = book.rows("facts").groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "attribute", "value"))), ",").alias("facts"))
    listed = book.rows("listings").groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("area")), ",").alias("listed"))
    rejected = book.rows("rejects").groupBy(F.expr("cast(line % 1099511627776 as string)").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("reason")), ",").alias("rejected"))
    rows = book.rows("events").join(facts, "key", "left").join(listed, "key", "left").withColumn("id", F.substring_index("key", ":", -1)).join(rejected, "id", "full_outer")
    return rows.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("venue", "title", "status", "facts", "listed", "rejected")))


_START = "(k % 450 - 20) * 24"
# Hours from now: over before 0; an end comes at k % 400 - 8 hours after the start.
_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 100 AS v, {_START} AS h, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 400 - 8 END AS runs FROM (SELECT *, o_orderkey AS k FROM orders)),
  c AS (SELECT *, CASE WHEN runs < 0 THEN 'end: before the start' WHEN runs > 336 THEN 'end: runs too long' WHEN h > 9600 THEN 'start: too far ahead' WHEN h + coalesce(runs, 2) < 0 THEN 'already over'
      WHEN k % 5 = 0 AND k % 40 / 1000.0 * pi() / 180 * 6371008.8 > {RADIUS_M} THEN 'place: outside the area' END AS reason, (k % 2 = 0 OR k % 7 = 0) AS a, (k % 2 = 1 OR k % 7 = 0) AS b FROM o),
  f AS (SELECT *, a AND k % 10 <> 1 AS f1, b AND k % 10 <> 1 AS f2, a AND k % 10 <> 2 AS f3 FROM c),
  g AS (SELECT *, f1::INT + f2::INT + f3::INT AS files, CASE k % 9 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'sold_out' ELSE 'scheduled' END AS said FROM f),
  e AS (SELECT *, reason IS NULL AS ok FROM g WHERE files > 0)
  SELECT k::VARCHAR AS id, CASE WHEN NOT ok THEN '' WHEN k % 5 <> 0 THEN 'v' || v ELSE 'site/hall no ' || k % 40 || '@' || printf('%.4f', 40.75 + k % 40 / 1000.0) || ',-73.9500' END AS venue,
    CASE WHEN NOT ok THEN '' ELSE 'Show ' || k % 100 || CASE WHEN f3 AND k % 4 = 0 THEN ', again' ELSE '' END END AS title,
    CASE WHEN NOT ok THEN '' WHEN NOT f3 AND NOT f2 AND said <> 'cancelled' AND h + coalesce(runs, 2) > 0 THEN 'withdrawn' ELSE said END AS status,
    CASE WHEN NOT ok THEN '' ELSE 'kind=show' || CASE WHEN NOT f3 THEN ',price=' || k % 30 + 1 WHEN k % 3 <> 0 THEN ',price=' || k % 30 + 2 ELSE '' END END AS facts,
    CASE WHEN NOT ok THEN '' ELSE concat_ws(',', CASE WHEN f3 THEN 'area 0' END, CASE WHEN f2 THEN 'area 1' END) END AS listed,
    array_to_string(list_resize([]::VARCHAR[], CASE WHEN NOT ok THEN files * (1 + (k % 50 = 0)::INT) WHEN k % 50 = 0 THEN files ELSE 0 END, coalesce(reason, 'id: listed twice in this file')), ',') AS rejected
  FROM e"""

QUERIES = {"event_batches": event_batches}
ORACLES = {"event_batches": _SQL}
