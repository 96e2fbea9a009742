"""Relational, text and time queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import quotes
from tidegate.plans import adapters as A
from tidegate.session import table
from tidegate.sources import pages
from tidegate.streaming import events as stream


def semi_join_events(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def anti_join_no_events(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def left_join_hours(spark, d):
    n = table(spark, d, "nation")
    best = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))
    return n.join(best, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("best", F.lit(-1.0)).alias("best"))


def lateral_latest(spark, d):
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o.o_orderkey", "o.o_totalprice")


def union_sources(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(table(spark, d, "customer").select("c_nationkey"))
    return names.distinct()


def set_operations(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k"))
    return a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.subtract(b).withColumn("op", F.lit("left")))


def distinct_on_latest(spark, d):
    e = table(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("place", place).where("place = 1").select("user_id", "event_id", "event_type")


def having_stale(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("last") % 3 == 0))


def filtered_counts(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.countDistinct("o_custkey").alias("customers"))


def cursor_pages(spark, d):
    o = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(303)
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1
    return o.withColumn("at", at).select("o_orderkey", F.floor(F.col("at") / 3).cast("int").alias("page"), (F.col("at") % 3).cast("int").alias("slot"))


def missing_essentials(spark, d):
    v = A.venues(spark, d)
    return v.select("venue_id", F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("price", "wheelchair", "status")))), ",").alias("missing"))


def gap_prefix(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros("ts") / F.lit(1e6)  # with their fraction: a gap is cut to whole seconds, its ends are not
    gap = F.floor(seconds - F.lag(seconds).over(w))
    runs = e.withColumn("gap", gap).withColumn("broken", F.sum(F.when(F.col("gap") > 86400, 1).otherwise(0)).over(w))
    return runs.where("broken = 0").groupBy("user_id").agg(F.count("*").alias("n"))


def forecast_window(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "value")
    hourly = e.groupBy("hour").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    w = Window.orderBy(F.unix_seconds("hour")).partitionBy(F.to_date("hour")).rangeBetween(0, 7200)
    return hourly.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round(F.min("low").over(w), 4).alias("low"), F.round(F.max("high").over(w), 4).alias("high"))


def hour_windows(spark, d):
    rows = stream.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.date_format("start_at", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def session_taste(spark, d):
    rows = stream.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def taste_fold(spark, d):
    return stream.fold_taste(table(spark, d, "events"))


def ttl_expiry(spark, d):
    c = A.claims(spark, d)
    ttl = F.create_map(*(F.lit(x) for p in (("view", 20), ("click", 30), ("purchase", 45)) for x in p))
    until = F.col("seen_at") + F.make_dt_interval(mins=F.coalesce(ttl[F.col("attribute")], F.lit(60)))
    last = c.agg(F.max("seen_at").alias("now"))
    return c.crossJoin(F.broadcast(last)).where((F.col("class") == "observation") & (until > F.col("now") - F.expr("interval 1 day"))).select("claim_id", "attribute")


def html_visible_text(spark, d):
    t = text.visible_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("chars"), F.sha2(t, 256).alias("sha"))


def page_links(spark, d):
    links = text.links(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(links).alias("n"), F.size(F.array_distinct(links)).alias("different"), F.size(pages.event_feeds(F.col("html"))).alias("feeds"))


def jsonld_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(pages.structured_blocks(F.col("html"))).alias("n"))


def stated_price(spark, d):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Entry $12 or $ 7.50, group $12,345.50 or $12345").when(F.col("doc_id") % 3 == 1, " free with purchase").otherwise(" free entry"))
    p = text.stated_prices(t)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(p).alias("n"), F.coalesce(F.array_min(p), F.lit(-1.0)).alias("least"), text.listed_free(t).alias("free"))


def quote_on_page(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return quotes.on_page(docs, asked).select(F.col("page_id").alias("doc_id"), F.col("quote_id").alias("item_id"))


def clipped_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.clip(F.col("text"), 80).alias("t"))


def revenue_by_status(spark, d):
    """Pricing summary of shipped lines."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(net), 0).alias("net"), F.round(F.avg("l_discount"), 4).alias("discount"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (semi_join_events, anti_join_no_events, left_join_hours, lateral_latest, union_sources, set_operations, distinct_on_latest, having_stale, filtered_counts, cursor_pages, missing_essentials, gap_prefix, forecast_window, hour_windows, session_taste, taste_fold, ttl_expiry, html_visible_text, page_links, jsonld_blocks, stated_price, quote_on_page, clipped_text, revenue_by_status)}

_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)|<noscript\b[^<>]*>.*?(?:</noscript\s*>|\z)', ' ', 'g'), '(?s)<!--.*?(?:-->|\z)', ' ', 'g'), '<[^<>]*>', ' ', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_name}', '{_sign}')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '[ \t\r\n]+', ' ', 'g'))"

ORACLES = {
    "semi_join_events": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "anti_join_no_events": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "left_join_hours": "SELECT n_name, coalesce(max(s_acctbal), -1.0) AS best FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    "lateral_latest": "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)",
    "union_sources": "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer",
    "set_operations": "SELECT *, 'both' AS op FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT *, 'left' FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)",
    "distinct_on_latest": "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC",
    "having_stale": "SELECT user_id, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2 AND max(event_id) % 3 = 0",
    "filtered_counts": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(avg(o_totalprice), 2) AS mean, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "cursor_pages": "SELECT o_orderkey, ((n - 1) // 3)::INT AS page, ((n - 1) % 3)::INT AS slot FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 303",
    "missing_essentials": f"SELECT venue_id, concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN wheelchair IS NULL THEN 'wheelchair' END, CASE WHEN status IS NULL THEN 'status' END) AS missing FROM ({A.venues_sql()})",
    "gap_prefix": "WITH g AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(CASE WHEN floor(gap) > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS broken FROM g) SELECT user_id, count(*) AS n FROM b WHERE broken = 0 GROUP BY 1",
    "forecast_window": "WITH h AS (SELECT date_trunc('hour', ts) AS hour, min(value) AS low, max(value) AS high FROM events GROUP BY 1) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, round(min(low) OVER w, 4) AS low, round(max(high) OVER w, 4) AS high FROM h WINDOW w AS (PARTITION BY hour::DATE ORDER BY hour RANGE BETWEEN CURRENT ROW AND INTERVAL 2 HOUR FOLLOWING)",
    "hour_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_taste": "WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
    "taste_fold": """WITH RECURSIVE e AS (SELECT user_id, event_id % 4 AS interest, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) AS i, CASE event_type WHEN 'purchase' THEN 20 WHEN 'click' THEN 10 WHEN 'view' THEN -10 WHEN 'error' THEN -15 ELSE 0 END AS nudge FROM events),
      f AS (SELECT user_id, interest, i, greatest(-100, least(100, nudge)) AS w FROM e WHERE i = 1 UNION ALL SELECT f.user_id, f.interest, e.i, greatest(-100, least(100, f.w + e.nudge)) FROM f JOIN e ON e.user_id = f.user_id AND e.interest = f.interest AND e.i = f.i + 1)
      SELECT user_id, interest, arg_max(w, i) / 100 AS weight FROM f GROUP BY ALL""",
    "ttl_expiry": f"WITH c AS ({A.CLAIMS_SQL}) SELECT claim_id, attribute FROM c WHERE class = 'observation' AND seen_at + to_minutes(CASE attribute WHEN 'view' THEN 20 WHEN 'click' THEN 30 WHEN 'purchase' THEN 45 ELSE 60 END) > (SELECT max(seen_at) FROM c) - INTERVAL 1 DAY",
    "html_visible_text": f"SELECT page_id, length(t)::INT AS chars, sha256(t) AS sha FROM (SELECT page_id, {_TEXT} AS t FROM pages)",
    "page_links": r"""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\b[^<>]*?\bhref\s*=\s*("[^"<>]*"|''[^''<>]*''|[^\s"''<>]+)', 1), lambda x: trim(x, '"''')) AS ls FROM pages) SELECT page_id, len(ls)::INT AS n, len(list_distinct(ls))::INT AS different,
      len(list_distinct(list_filter(ls, lambda u: regexp_matches(lower(u), '\.ics(\?|$)|^webcal:|[?&](ical|outlook-ical)=|/calendar/'))))::INT AS feeds FROM l""",
    "jsonld_blocks": r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1))::INT AS n FROM pages""",
    "stated_price": r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Entry $12 or $ 7.50, group $12,345.50 or $12345' WHEN 1 THEN ' free with purchase' ELSE ' free entry' END AS t FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '\$ ?(\d{1,3}(?:,\d{3})+(?:\.\d\d)?|\d+(?:\.\d\d)?)', 1), lambda x: replace(x, ',', '')::DOUBLE) AS p FROM t)
      SELECT doc_id, len(p)::INT AS n, coalesce(list_min(p), -1.0) AS least, regexp_matches(lower(t), '\bfree\b') AND NOT regexp_matches(lower(t), '\bfree (with|for members|trial|parking)\b|\bsugar free\b') AS free FROM p""",
    "quote_on_page": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS q FROM benchmark)
      SELECT doc_id, item_id FROM f JOIN q ON q <> '' AND contains(' ' || t || ' ', ' ' || q || ' ')""",
    "clipped_text": r"SELECT item_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 79), '\s+\S*$', '') || '…' END AS t FROM benchmark",
    "revenue_by_status": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS net, round(avg(l_discount), 4) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
}
