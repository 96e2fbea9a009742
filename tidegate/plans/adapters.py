"""Stand-ins for places, claims, occurrences and requests over the given tables.

Only integer arithmetic and literals, so that the SQL beside each adapter gives
the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import table

CATEGORIES = ["cafe", "restaurant", "bar", "park", "museum", "library", "cinema", "bookshop"]


def venues(spark: SparkSession, sf_dir: str, name: str = "supplier") -> DataFrame:
    """Places at pseudo-points: `supplier`, or `customer` for scale."""
    p = name[0]
    k = F.col(f"{p}_{name[:4]}key") if name == "supplier" else F.col("c_custkey")
    t = table(spark, sf_dir, name)
    cats = F.array(*map(F.lit, CATEGORIES))
    return t.select(
        k.alias("venue_id"),
        F.col(f"{p}_name").alias("name"),
        F.get(cats, (k % 8).cast("int")).alias("category"),
        (F.lit(40.70) + (k * 37 % 1000) / F.lit(10000.0)).alias("lat"),
        (F.lit(-74.00) + (k * 91 % 1000) / F.lit(10000.0)).alias("lon"),
        (F.lit(360) + k * 53 % 12 * 60).cast("int").alias("open_min"),
        (F.lit(360) + k * 53 % 12 * 60 + 360 + k * 29 % 9 * 60).cast("int").alias("close_min"),
        (F.lit(20) + k % 5 * 10).cast("int").alias("min_useful"),
        F.when(k % 4 != 0, (k % 60).cast("int")).alias("price"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").alias("wheelchair"),
        F.when(k % 8 == 2, F.when(k % 16 == 2, 21)).cast("int").alias("min_age"),
        F.when(k % 17 == 0, "closed_permanently").when(k % 2 == 0, "operating").alias("status"),
    )


def venues_sql(name: str = "supplier") -> str:
    k, n = ("s_suppkey", "s_name") if name == "supplier" else ("c_custkey", "c_name")
    cats = ", ".join(f"'{c}'" for c in CATEGORIES)
    return f"""SELECT {k} AS venue_id, {n} AS name, [{cats}][{k} % 8 + 1] AS category,
  40.70::DOUBLE + ({k} * 37 % 1000) / 10000.0::DOUBLE AS lat, -74.00::DOUBLE + ({k} * 91 % 1000) / 10000.0::DOUBLE AS lon,
  (360 + {k} * 53 % 12 * 60)::INT AS open_min, (360 + {k} * 53 % 12 * 60 + 360 + {k} * 29 % 9 * 60)::INT AS close_min,
  (20 + {k} % 5 * 10)::INT AS min_useful, CASE WHEN {k} % 4 <> 0 THEN ({k} % 60)::INT END AS price,
  CASE {k} % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS wheelchair, CASE WHEN {k} % 16 = 2 THEN 21 END AS min_age,
  CASE WHEN {k} % 17 = 0 THEN 'closed_permanently' WHEN {k} % 2 = 0 THEN 'operating' END AS status FROM {name}"""


def requests(spark: SparkSession, count: int = 48) -> DataFrame:
    """A grid of searches: where, when (minutes of a Saturday), how long, how, with what budget."""
    i = F.col("id")
    modes = F.array(*map(F.lit, ("walk", "drive", "transit")))
    return spark.range(count).select(
        i.alias("request_id"),
        (F.lit(40.72) + i % 4 * 2 / F.lit(100.0)).alias("r_lat"),
        (F.lit(-73.98) + F.floor(i / 4) % 3 * 2 / F.lit(100.0)).alias("r_lon"),
        (480 + i % 6 * 150).cast("int").alias("at_min"),
        (60 + i % 3 * 60).cast("int").alias("window_min"),
        F.get(modes, (i % 3).cast("int")).alias("mode"),
        F.when(i % 5 != 0, (15 + i % 5 * 10).cast("int")).alias("budget"),
        F.when(i % 7 == 0, 12).when(i % 7 == 1, 18).cast("int").alias("youngest"),
        (i % 11 == 0).alias("need_wheelchair"),
    )


REQUESTS_SQL = """SELECT range AS request_id, 40.72::DOUBLE + range % 4 * 2 / 100.0::DOUBLE AS r_lat, -73.98::DOUBLE + range // 4 % 3 * 2 / 100.0::DOUBLE AS r_lon,
  (480 + range % 6 * 150)::INT AS at_min, (60 + range % 3 * 60)::INT AS window_min, ['walk', 'drive', 'transit'][range % 3 + 1] AS mode,
  CASE WHEN range % 5 <> 0 THEN (15 + range % 5 * 10)::INT END AS budget,
  CASE range % 7 WHEN 0 THEN 12 WHEN 1 THEN 18 END AS youngest, range % 11 = 0 AS need_wheelchair FROM range(48)"""


SOURCES = ["firstparty", "founder", "osm", "overture", "user_observation", "venue_events", "category_policy"]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about users' attributes: `events` read as evidence."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*map(F.lit, SOURCES))
    kinds = F.array(*map(F.lit, ("published", "observation", "estimate")))
    status = F.when(F.col("event_type") == "error", F.when(k % 5 == 0, "closed_permanently").when(k % 5 == 1, "closed_temporarily").otherwise("operating"))
    return e.select(
        F.col("event_id").alias("claim_id"),
        (F.col("user_id") % 400).alias("subject_id"),
        F.when(F.col("event_type") == "error", "business_status").otherwise(F.col("event_type")).alias("attribute"),
        F.coalesce(status, (k % 5).cast("string")).alias("value"),
        F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("class"),
        F.get(names, (F.col("event_id") % 7).cast("int")).alias("source"),
        (F.col("event_id") % 4).cast("string").alias("lineage"),
        ((F.col("event_id") % 90 + 5) / F.lit(100.0)).cast("decimal(4,3)").alias("confidence"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        F.when(F.col("event_id") % 10 == 0, F.col("ts").cast("timestamp") + F.expr("interval 30 days")).alias("valid_until"),
    )


_NAMES = ", ".join(f"'{s}'" for s in SOURCES)
CLAIMS_SQL = f"""SELECT event_id AS claim_id, user_id % 400 AS subject_id, CASE WHEN event_type = 'error' THEN 'business_status' ELSE event_type END AS attribute,
  CASE WHEN event_type = 'error' THEN CASE k % 5 WHEN 0 THEN 'closed_permanently' WHEN 1 THEN 'closed_temporarily' ELSE 'operating' END ELSE (k % 5)::VARCHAR END AS value,
  ['published', 'observation', 'estimate'][event_id % 3 + 1] AS class, [{_NAMES}][event_id % 7 + 1] AS source, (event_id % 4)::VARCHAR AS lineage,
  ((event_id % 90 + 5) / 100.0)::DECIMAL(4,3) AS confidence, ts AS seen_at, CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 30 DAY END AS valid_until
  FROM (SELECT *, (json_extract_string(props, '$.k'))::INT AS k FROM events)"""

NOW = "2024-06-01 00:00:00"


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at venues: `orders`."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("occ_id"),
        (F.col("o_custkey") % 100).alias("venue_id"),
        start.alias("start_at"),
        F.when(F.col("o_orderkey") % 3 != 0, start + F.make_dt_interval(mins=(F.lit(60) + F.col("o_orderkey") % 120).cast("int"))).alias("end_at"),
        F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "P", "sold_out").otherwise("scheduled").alias("status"),
        (F.col("o_orderkey") % 4 == 0).alias("late_entry"),
    )


OCC_SQL = """SELECT o_orderkey AS occ_id, o_custkey % 100 AS venue_id, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS start_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_minutes((o_orderkey % 1440 + 60 + o_orderkey % 120)::INT) END AS end_at,
  CASE o_orderstatus WHEN 'F' THEN 'cancelled' WHEN 'P' THEN 'sold_out' ELSE 'scheduled' END AS status, o_orderkey % 4 = 0 AS late_entry FROM orders"""


LISTED = ["Blue Door", "Blue Door Cafe", "Blue Door Books", "North St. Market", "The North Street Market", "Café Nord", "Nord"]
LISTED_KEYS = ["blue door", "blue door cafe", "blue door books", "north street market", "north street market", "cafe nord", "nord"]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of places with contacts: `customer`, spread over a city."""
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, LISTED))
    cats = F.array(*map(F.lit, CATEGORIES))
    return table(spark, sf_dir, "customer").select(
        k.alias("record_id"),
        F.get(names, (k % 7).cast("int")).alias("name"),
        F.get(cats, (F.floor(k / 7) % 3).cast("int")).alias("category"),
        (F.lit(40.70) + (k * 7919 % 30011) / F.lit(1000000.0)).alias("lat"),
        (F.lit(-74.00) + (k * 104729 % 30011) / F.lit(1000000.0)).alias("lon"),
        F.when(k % 11 == 0, "acme").alias("brand"),
        F.when(k % 3 == 0, F.concat(F.lit("https://www.s"), (k % 50).cast("string"), F.lit(".example/x"))).alias("website"),
        F.when(k % 4 == 1, F.concat(F.lit("+1 (914) 555-01"), (F.lit(10) + k % 40).cast("string"))).alias("phone"),
        F.when(k % 5 == 0, (k % 4).cast("string")).alias("number"),
        F.when(k % 2 == 0, "Main St.").alias("street"),
        F.when(k % 97 == 0, F.array((k % 2).cast("string"))).alias("xids"),
    )


LISTINGS_SQL = f"""SELECT c_custkey AS id, {LISTED_KEYS}[c_custkey % 7 + 1] AS key, {CATEGORIES}[c_custkey // 7 % 3 + 1] AS category,
  40.70::DOUBLE + (c_custkey * 7919 % 30011) / 1000000.0::DOUBLE AS lat, -74.00::DOUBLE + (c_custkey * 104729 % 30011) / 1000000.0::DOUBLE AS lon,
  CASE WHEN c_custkey % 11 = 0 THEN 'acme' END AS brand, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS site, CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 40 END AS phone,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN c_custkey % 4 END AS address, CASE WHEN c_custkey % 97 = 0 THEN c_custkey % 2 END AS xid FROM customer"""
