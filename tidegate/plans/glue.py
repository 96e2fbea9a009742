"""Queries of names, dates, sinks and matches over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import clock, dates, geo, labels, text, titles
from tidegate.operators import matching, sinks
from tidegate.plans import adapters as A
from tidegate.plans.places import HAVERSINE
from tidegate.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


_LABEL = "(CASE WHEN ({m}) // 60 % 12 = 0 THEN 12 ELSE ({m}) // 60 % 12 END)::VARCHAR || CASE WHEN ({m}) % 60 > 0 THEN ':' || lpad((({m}) % 60)::VARCHAR, 2, '0') ELSE '' END || CASE WHEN ({m}) // 60 % 24 < 12 THEN 'am' ELSE 'pm' END"


@query(f"""SELECT o_orderkey, {_LABEL.format(m='o_orderkey % 1440')} AS at, CASE WHEN d < 60 THEN d || ' min' ELSE d // 60 || 'h' || CASE WHEN d % 60 > 0 THEN lpad((d % 60)::VARCHAR, 2, '0') ELSE '' END END AS lasts,
  CASE WHEN c // 1440 = a // 1440 OR (c - a < 1440 AND c % 1440 < 360) THEN {_LABEL.format(m='c % 1440')} WHEN c // 1440 = a // 1440 + 1 THEN {_LABEL.format(m='c % 1440')} || ' tomorrow'
  ELSE ['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][c // 1440 % 7 + 1] || ' ' || {_LABEL.format(m='c % 1440')} END AS until
  FROM (SELECT o_orderkey, o_orderkey % 300 AS d, o_orderkey * 7 % 8640 AS a, o_orderkey * 7 % 8640 + o_orderkey % 3000 AS c FROM orders)""")
def clock_labels(spark, d):
    k = F.col("o_orderkey")
    a = k * 7 % 8640
    return table(spark, d, "orders").select("o_orderkey", labels.time_label(k % 1440).alias("at"), labels.duration_label(k % 300).alias("lasts"), labels.until_label(a + k % 3000, a).alias("until"))


@query(r"""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '(' || 100 + c_custkey % 900 || ') ' || 100 + c_custkey % 800 || '-' || 1000 + c_custkey % 9000 WHEN 1 THEN '+1 ' || 200 + c_custkey % 700 || '.555.' || 1000 + c_custkey % 9000
      WHEN 2 THEN '+44 20 ' || 1000 + c_custkey % 9000 ELSE c_custkey::VARCHAR END AS raw FROM customer), g AS (SELECT *, regexp_replace(raw, '\D', '', 'g') AS n FROM r),
  t AS (SELECT *, CASE WHEN length(n) = 10 THEN n WHEN length(n) = 11 AND n LIKE '1%' THEN n[2:] END AS ten FROM g)
  SELECT c_custkey, coalesce(CASE WHEN regexp_full_match(ten, '[2-9]\d{2}[2-9]\d{6}') THEN '+1 ' || ten[1:3] || '-' || ten[4:6] || '-' || ten[7:] END, CASE WHEN raw LIKE '+%' AND length(n) BETWEEN 8 AND 15 THEN '+' || n END, '') AS phone FROM t""")
def phone_forms(spark, d):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("("), s(100 + k % 900), F.lit(") "), s(100 + k % 800), F.lit("-"), s(1000 + k % 9000))).when(k % 4 == 1, F.concat(F.lit("+1 "), s(200 + k % 700), F.lit(".555."), s(1000 + k % 9000))).when(k % 4 == 2, F.concat(F.lit("+44 20 "), s(1000 + k % 9000))).otherwise(s(k))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(labels.phone_form(raw), F.lit("")).alias("phone"))


SITES = ["example.org/a?utm_source=x&id=3", "http://www.cafe.example/menu#top", "ftp://files.example/x", "https://localhost/x", "https://10.0.0.1/", "HTTPS://Shop.example/?gclid=9", "mailto:me@x.example", "https://user@host.example/"]
SITE_FORMS = ["https://example.org/a?id=3", "http://www.cafe.example/menu", "", "", "", "HTTPS://Shop.example/", "", ""]


@query(f"SELECT c_custkey, {SITE_FORMS}[c_custkey % 8 + 1] AS site FROM customer")
def site_forms(spark, d):
    raw = F.get(F.array(*map(F.lit, SITES)), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(labels.site_form(raw), F.lit("")).alias("site"))


NAMES = ["hunan iii", "hunan 3", "hunan", "hunan three garden", "the hunan 3 annex", "blue", "blue door", "bluedoor"]
_NUM = "array_to_string(list_transform(string_split({k}, ' '), lambda w: coalesce(map(" + str(labels.ROMAN + labels.WORDS) + ", " + str([str(i) for i in range(1, 11)] * 2) + ")[w], w)), ' ')"


@query(f"""WITH n AS (SELECT c_custkey, {_NUM.format(k=f'{NAMES}[c_custkey % 8 + 1]')} AS x, {_NUM.format(k=f'{NAMES}[c_custkey // 8 % 8 + 1]')} AS y FROM customer),
  s AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS a, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS b FROM n)
  SELECT c_custkey, CASE WHEN x = y OR replace(x, ' ', '') = replace(y, ' ', '') THEN 'same' WHEN length(a) < 5 THEN '' WHEN starts_with(b, a || ' ') THEN 'prefix' WHEN contains(' ' || b || ' ', ' ' || a || ' ') THEN 'within' ELSE '' END AS how FROM s""")
def name_match_class(spark, d):
    names = F.array(*map(F.lit, NAMES))
    k = F.col("c_custkey")
    how = labels.names_match(F.get(names, (k % 8).cast("int")), F.get(names, (F.floor(k / 8) % 8).cast("int")))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(how, F.lit("")).alias("how"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN repeat('Привет мир ', 80) ELSE 'Ωmega' END, '[^\pL]+', '', 'g') AS l FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, coalesce(length(regexp_replace(l, '[^\p{Latin}]+', '', 'g')) / nullif(length(l), 0) >= 0.6, false) AS latin FROM t""")
def mostly_latin(spark, d):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "Привет мир " * 80).otherwise("Ωmega"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce(labels.latin_share(t) >= 0.6, F.lit(False)).alias("latin"))


GENERIC = ["supplier", "deli", "the", "shop"]


@query("""WITH s AS (SELECT s_suppkey, 'shop' || CASE WHEN s_suppkey % 3 = 0 THEN ' blue' ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN ' deli' ELSE '' END AS key, ['shopdeli.example', 'www.the-blue.example', 'x.example'][s_suppkey % 3 + 1] AS host, s_suppkey % 5 AS f FROM supplier)
  SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN contains(regexp_replace(regexp_replace(host, '^www\\.', ''), '[^a-z0-9]', '', 'g'), 'blue') ELSE contains(regexp_replace(host, '[^a-z0-9]', '', 'g'), replace(key, ' ', '')) END AS named FROM s""")
def domain_names_venue(spark, d):
    k = F.col("s_suppkey")
    key = F.concat(F.lit("shop"), F.when(k % 3 == 0, " blue").otherwise(""), F.when(k % 2 == 0, " deli").otherwise(""))
    host = F.get(F.array(F.lit("shopdeli.example"), F.lit("www.the-blue.example"), F.lit("x.example")), (k % 3).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", labels.domain_names(host, key, F.array(*map(F.lit, GENERIC))).alias("named"))


_FILMS = """f AS (SELECT p_partkey AS id, p_name, (p_partkey * 7919 % 100003) AS pop FROM part),
  top AS (SELECT *, row_number() OVER (ORDER BY pop DESC, id) AS place FROM f),
  k AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, arg_min(id, place) AS film_id, round(greatest(0.0::DOUBLE, 1 - (min(place) - 1) / 30.0::DOUBLE), 3) AS score FROM top GROUP BY 1)"""


def _films(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    lists = p.select(k.alias("film_id"), F.col("p_name").alias("title"), (k * 7919 % 100003).alias("popularity"))
    return matching.popular_films(lists.unionByName(lists.where("film_id % 2 = 0").withColumn("popularity", F.col("popularity") - 5)), most=None)


@query(f"WITH {_FILMS} SELECT key, film_id, score FROM k WHERE length(key) >= 3")
def popular_films(spark, d):
    return _films(spark, d)


@query(f"""WITH {_FILMS} SELECT p_partkey AS occ_id, film_id, score FROM part JOIN k ON key = trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))""")
def films_by_title(spark, d):
    around = [("Movie Night: ", " (35mm) - with the director"), ("Outdoor films | ", " [open caption] in 70mm"), ("Family Movie Night - ", " + Talkback"), ("Members' Screening: ", ": Live score"), ("", " sing-along | Director's cut"), ("Free movies on the pier – ", " - Q&A: a panel")]
    k = F.col("p_partkey") % len(around)
    put = lambda side: F.get(F.array(*(F.lit(x[side]) for x in around)), k.cast("int"))
    title = F.concat(put(0), F.when(k == 1, F.upper("p_name")).otherwise(F.col("p_name")), put(1))
    return matching.by_title(table(spark, d, "part").select(F.col("p_partkey").alias("occ_id"), title.alias("title")), _films(spark, d))


# Titles and, stated by hand, what they say: interest:percent, and whether drinks are the outing.
TITLES = {
    "Jazz on the Lawn": "live_music:100",
    "Open Mic Comedy": "comedy:100,live_music:50",
    "Cheese tasting and wine": "drinks:100,food:100",
    "Beer tastings": "drinks:100",
    "Fireworks parade": "festivals:100,outdoors:50",
    "STORYTIME": "books:100",
    "Tea tasting": "cafes:100",
    "Plain evening": "",
    "Improv & board games brunch": "comedy:100,food:100,games:100",
    "Ice cream tasting": "food:100",
    "Oil tasting, olive oil tasting": "drinks:100,food:100",
    "Food tastings": "food:100",
    "Craft fair: artist talk": "art:100,books:100,festivals:100,markets:100",
    "Stand-up vs. hip-hop (5K race)": "comedy:100,live_music:100,sports:100",
    "Bar crawling, brewers, pubs": "",
    "Pub crawl; happy hour/tour": "drinks:100,museums:100",
}


@query(f"""WITH t AS (SELECT o_orderkey, o_custkey AS u, {list(TITLES.values())}[o_orderkey % {len(TITLES)} + 1] AS interests FROM orders),
  f AS (SELECT o_orderkey, interests, list_transform(list_filter(string_split(interests, ','), lambda e: e <> ''), lambda e: split_part(e, ':', 2)::DOUBLE / 100 * CASE split_part(e, ':', 1) WHEN 'comedy' THEN u % 5 / 4.0::DOUBLE WHEN 'drinks' THEN -(u % 3) / 2.0::DOUBLE WHEN 'live_music' THEN 0.5::DOUBLE ELSE 0 END) AS felt FROM t)
  SELECT o_orderkey, interests, contains(interests, 'drinks:100') AS drinks, round(0.5::DOUBLE + 0.5::DOUBLE * (greatest(0, coalesce(list_max(felt), 0)) - greatest(0, -coalesce(list_min(felt), 0))), 3) AS match FROM f""")
def title_taste(spark, d):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    weights = F.create_map(F.lit("comedy"), u % 5 / F.lit(4.0), F.lit("drinks"), -(u % 3) / F.lit(2.0), F.lit("live_music"), F.lit(0.5))
    title = F.get(F.array(*map(F.lit, TITLES)), (k % len(TITLES)).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", titles.title_interests(title).alias("i"), titles.drink_title(title).alias("drinks"), weights.alias("w"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("i")), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 100).cast("int").cast("string"))), ",")
    return rows.select("o_orderkey", listed.alias("interests"), "drinks", titles.taste_match(F.col("i"), F.col("w")).alias("match"))


@query("SELECT s_suppkey, 'cafes:' || CASE WHEN s_suppkey % 2 = 0 THEN 100 ELSE 50 END || CASE WHEN s_suppkey % 3 = 0 THEN ',food:50' ELSE '' END AS merged FROM supplier")
def interest_merge(spark, d):
    k = F.col("s_suppkey")
    own = F.map_filter(F.create_map(F.lit("cafes"), F.when(k % 2 == 0, 1.0).otherwise(0.0)), lambda a, v: v > 0)
    place = F.map_filter(F.create_map(F.lit("cafes"), F.lit(1.0), F.lit("food"), F.when(k % 3 == 0, 1.0).otherwise(0.0)), lambda a, v: v > 0)
    m = titles.stronger(own, place, 0.5)
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), (e["value"] * 100).cast("int").cast("string"))), ",").alias("merged"))


# ---- dates


_PARTIAL = "CASE o_orderkey % 5 WHEN 0 THEN (1900 + o_orderkey % 200)::VARCHAR WHEN 1 THEN (1900 + o_orderkey % 200) || '-' || lpad((o_orderkey % 15)::VARCHAR, 2, '0') WHEN 2 THEN (1900 + o_orderkey % 200) || '-' || lpad((o_orderkey % 13)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 33)::VARCHAR, 2, '0') WHEN 3 THEN '9999-12-31' ELSE 'soon' END"


@query(f"""WITH v AS (SELECT o_orderkey, {_PARTIAL} AS v FROM orders),
  q AS (SELECT o_orderkey, v, CASE WHEN v < '9999' THEN try_cast(v || CASE length(v) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END AS DATE) END AS f FROM v)
  SELECT o_orderkey, coalesce(f::VARCHAR, '') AS first, coalesce((f + CASE length(v) WHEN 4 THEN INTERVAL 1 YEAR WHEN 7 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END)::DATE::VARCHAR, '') AS until FROM q""")
def partial_dates(spark, d):
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = (1900 + k % 200).cast("string")
    raw = F.when(k % 5 == 0, year).when(k % 5 == 1, F.concat(year, F.lit("-"), two(k % 15))).when(k % 5 == 2, F.concat(year, F.lit("-"), two(k % 13), F.lit("-"), two(k % 33))).when(k % 5 == 3, "9999-12-31").otherwise("soon")
    rows = table(spark, d, "orders").select("o_orderkey", dates.partial_date(raw).alias("p"))
    return rows.select("o_orderkey", F.coalesce(F.col("p.from").cast("string"), F.lit("")).alias("first"), F.coalesce(F.col("p.until").cast("string"), F.lit("")).alias("until"))


@query("""SELECT o_orderkey, dayofweek(l)::INT AS weekday, (hour(l) * 60 + minute(l))::INT AS minute, strftime(l, '%Y-%m-%d') AS day, floor((o_orderkey % 7200) / 60.0 + 0.5)::INT AS waited, true AS back
  FROM (SELECT o_orderkey, timezone('America/New_York', timezone('UTC', o_orderdate + to_minutes((o_orderkey % 1440)::INT))) AS l FROM orders)""")
def local_clock_round_trip(spark, d):
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", at.alias("at")).withColumn("c", clock.local_clock(F.col("at"), "America/New_York"))
    local = F.to_timestamp(F.col("c.day")) + F.make_dt_interval(mins=F.col("c.minute"))
    later = F.col("at") + F.make_dt_interval(secs=(k % 7200).cast("decimal(18,6)"))
    # a clock that is set back reads some times twice: then the first of them is meant
    back = F.abs(F.unix_seconds(dates.from_local(local, "America/New_York")) - F.unix_seconds("at")).isin(0, 3600)
    return rows.select("o_orderkey", F.col("c.weekday").cast("int").alias("weekday"), F.col("c.minute").cast("int").alias("minute"), F.date_format("c.day", "yyyy-MM-dd").alias("day"), clock.minutes_between(F.col("at"), later).alias("waited"), back.alias("back"))


@query("""WITH s AS (SELECT o_custkey AS job, max(o_orderdate) FILTER (o_orderstatus = 'F') AS ok, max(o_orderdate) FILTER (o_orderstatus <> 'F') AS bad FROM orders GROUP BY 1), e AS (SELECT *, (job % 4 + 1) * 20 AS every FROM s),
  b AS (SELECT *, coalesce(ok + to_minutes(every::INT), TIMESTAMP '1970-01-01') AS base FROM e)
  SELECT job, strftime(CASE WHEN bad IS NOT NULL AND (ok IS NULL OR bad > ok) THEN greatest(base, bad + to_minutes(least(every, 30)::INT)) ELSE base END, '%Y-%m-%d %H:%M') AS due FROM b""")
def job_due(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderstatus") == "F").alias("ok"), F.lit(1).alias("rows"))
    s = sinks.run_states(o)
    return s.select("job", F.date_format(dates.next_due(((F.col("job") % 4 + 1) * 20).cast("int"), F.col("last_success"), F.col("last_failure")), "yyyy-MM-dd HH:mm").alias("due"))


@query("SELECT o_custkey AS job, count(*) AS runs, coalesce(strftime(max(o_orderdate) FILTER (o_orderstatus = 'F'), '%Y-%m-%d'), '') AS success, coalesce(sum(o_shippriority + 1) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS rows FROM orders GROUP BY 1".replace("o_shippriority + 1", "1"))
def last_success(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderstatus") == "F").alias("ok"), F.lit(1).alias("rows"))
    return sinks.run_states(o).select("job", "runs", F.coalesce(F.date_format("last_success", "yyyy-MM-dd"), F.lit("")).alias("success"), F.col("rows").cast("long").alias("rows"))


@query("SELECT o_orderkey, o_orderkey % 7 <> 0 AND datediff('second', o_orderdate, TIMESTAMP '1997-01-01') BETWEEN -86400 AND 90 * 86400 AS fresh FROM orders")
def fresh_confirmation(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.confirmed(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 7 == 0, F.lit("1997-01-01").cast("timestamp")).alias("fresh"))


@query("SELECT event_id, CASE WHEN hour(ts) >= 18 OR hour(ts) < 6 THEN 2 WHEN hour(ts) BETWEEN 11 AND 13 THEN 12 ELSE 8 END AS minutes FROM events")
def parking_buffer(spark, d):
    return table(spark, d, "events").select("event_id", dates.buffer_at(F.hour("ts"), [(18, 6, 2), (11, 14, 12)], 8).alias("minutes"))


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS orders FROM orders GROUP BY 1), x AS (SELECT *, month(day) AS m, day(day) AS n, dayofweek(day) AS w, (day(day) + 6) // 7 AS k FROM d)
  SELECT strftime(day, '%Y-%m-%d') AS day, orders FROM x WHERE strftime(day, '%m-%d') IN ('01-01', '06-19', '07-04', '11-11', '12-25') OR (w = 1 AND ((m IN (1, 2) AND k = 3) OR (m = 5 AND n > 24) OR (m = 9 AND k = 1) OR (m = 10 AND k = 2))) OR (m = 11 AND w = 4 AND k = 4)""")
def public_holidays(spark, d):
    """The orders of each public holiday."""
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"))
    return days.where(dates.new_york_holiday(F.col("day"))).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "orders")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M') WHEN 1 THEN strftime(o_orderdate + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(timezone('UTC', timezone('America/New_York', o_orderdate + INTERVAL 12 HOUR)), '%Y-%m-%d %H:%M') ELSE '' END AS at FROM orders""")
def schema_dates(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 4 == 0, F.concat(day, F.lit("T12:00:00Z"))).when(k % 4 == 1, F.concat(day, F.lit("T12:00+05:00"))).when(k % 4 == 2, F.concat(day, F.lit("T12:00:00"))).otherwise("2021-02-30T12:00:00Z")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.date_format(dates.stated_instant(raw, "America/New_York"), "yyyy-MM-dd HH:mm"), F.lit("")).alias("at"))


@query(f"SELECT venue_id, category IN ('museum', 'library', 'bookshop') AND open_min > 0 AND close_min > 1380 AS doubtful FROM ({A.venues_sql()})")
def doubtful_closes(spark, d):
    v = A.venues(spark, d)
    return v.select("venue_id", dates.doubtful_close(F.col("category").isin("museum", "library", "bookshop"), F.col("open_min"), F.col("close_min")).alias("doubtful"))


# ---- relational


@query("SELECT doc_id FROM documents WHERE source IS NOT NULL AND (text LIKE '%100!%%' ESCAPE '!' OR text ILIKE '%the %' OR starts_with(coalesce(lang, ''), 'd'))")
def like_forms(spark, d):
    t = F.col("text")
    hit = F.expr("text LIKE '%100!%%' ESCAPE '!'") | t.ilike("%the %") | F.startswith(F.coalesce("lang", F.lit("")), F.lit("d"))
    return table(spark, d, "documents").where(F.col("source").isNotNull() & hit).select("doc_id")


@query("SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.zz') IS NOT NULL AS has_zz, event_type IN ('view', 'click') AS wanted FROM events")
def key_and_membership(spark, d):
    keys = F.json_object_keys("props")
    e = table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.array_contains(keys, "k"), F.lit(False)).alias("has_k"), F.coalesce(F.arrays_overlap(keys, F.array(F.lit("zz"), F.lit("yy"))), F.lit(False)).alias("has_zz"), F.col("event_type").isin("view", "click").alias("wanted"))


@query(f"SELECT occ_id FROM ({A.OCC_SQL}) WHERE coalesce(end_at, start_at + INTERVAL 2 HOUR) > TIMESTAMP '1996-03-01 18:00' AND start_at < TIMESTAMP '1996-04-01'")
def window_overlap(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return A.occurrences(spark, d).where((F.coalesce("end_at", F.col("start_at") + F.expr("interval 2 hours")) > at("1996-03-01 18:00:00")) & (F.col("start_at") < at("1996-04-01 00:00:00"))).select("occ_id")


@query(f"""WITH v AS (SELECT *, venue_id % 9 = 0 AS destination, 40.75::DOUBLE AS r_lat, -73.95::DOUBLE AS r_lon FROM ({A.venues_sql('customer')})), m AS (SELECT *, {HAVERSINE.format(a='r_', b='')} AS metres FROM v)
  SELECT w.window_min, venue_id, CASE WHEN destination THEN CASE WHEN w.window_min >= 210 THEN 60 WHEN w.window_min >= 150 THEN 45 ELSE 30 END ELSE 30 END AS limit_min FROM m CROSS JOIN (SELECT unnest([90, 150, 240]) AS window_min) w
  WHERE metres <= 1500 OR (destination AND metres <= 1500 * CASE WHEN w.window_min >= 210 THEN 2.0 WHEN w.window_min >= 150 THEN 1.5 ELSE 1.0 END)""")
def two_radii(spark, d):
    w = F.explode(F.array(F.lit(90), F.lit(150), F.lit(240)))
    v = A.venues(spark, d, "customer").withColumn("destination", F.col("venue_id") % 9 == 0).withColumn("window_min", w)
    metres = geo.distance_m(F.lit(40.75), F.lit(-73.95), F.col("lat"), F.col("lon"))
    far = geo.destination_multiplier(F.col("window_min"))
    limit = F.when(F.col("destination"), F.round(30 * far)).otherwise(30).cast("int")
    return v.where((metres <= 1500) | (F.col("destination") & (metres <= 1500 * far))).select("window_min", "venue_id", limit.alias("limit_min"))


@query("""SELECT s.s_suppkey, CASE WHEN n_nationkey % 5 = 0 THEN 'killed' WHEN n_nationkey % 7 = 0 THEN 'disabled' WHEN n_regionkey % 2 = 0 THEN 'operation not allowed' ELSE 'ok' END AS gate FROM supplier s JOIN nation ON s_nationkey = n_nationkey""")
def source_gate(spark, d):
    n = F.col("n_nationkey")
    policy = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (n % 5 == 0).alias("kill_switch"), (n % 7 != 0).alias("enabled"), F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("show"))).alias("allowed"))
    gate = F.when(F.col("kill_switch"), "killed").when(~F.col("enabled"), "disabled").when(~F.array_contains("allowed", "show"), "operation not allowed").otherwise("ok")
    return table(spark, d, "supplier").join(policy, "s_nationkey").select("s_suppkey", gate.alias("gate"))


_RAW_CLAIMS = f"""SELECT claim_id, CASE WHEN claim_id % 19 = 0 THEN 1.5 ELSE confidence END AS confidence, class, CASE WHEN claim_id % 13 <> 0 THEN 'x' END AS evidence, CASE WHEN claim_id % 11 <> 0 THEN seen_at END AS observed_at,
  CASE WHEN claim_id % 17 = 0 THEN 'queue' ELSE attribute END AS attribute, CASE WHEN claim_id % 23 <> 0 THEN value END AS value, source FROM ({A.CLAIMS_SQL})"""
_REFUSED = "CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' WHEN class = 'published' AND evidence IS NULL THEN 'published facts need evidence' WHEN class = 'observation' AND observed_at IS NULL THEN 'observations need observed_at' WHEN attribute = 'queue' AND class <> 'observation' THEN 'may only be an observation' WHEN value IS NULL THEN 'value is required' ELSE '' END"


def _raw_claims(spark, d):
    k = F.col("claim_id")
    return A.claims(spark, d).select(
        "claim_id", F.when(k % 19 == 0, F.lit(1.5)).otherwise(F.col("confidence").cast("double")).alias("confidence"), "class", F.when(k % 13 != 0, "x").alias("evidence"), F.when(k % 11 != 0, F.col("seen_at")).alias("observed_at"),
        F.when(k % 17 == 0, "queue").otherwise(F.col("attribute")).alias("attribute"), F.when(k % 23 != 0, F.col("value")).alias("value"), "source",
    )


@query(f"SELECT claim_id, {_REFUSED} AS reason FROM ({_RAW_CLAIMS})")
def row_validation(spark, d):
    rows = _raw_claims(spark, d)
    return rows.select("claim_id", F.coalesce(sinks.refused(rows, list(sinks.HOLDS_MIN)), F.lit("")).alias("reason"))


@query(f"SELECT source, {_REFUSED} AS reason, count(*) AS n FROM ({_RAW_CLAIMS}) GROUP BY ALL")
def reject_counts(spark, d):
    rows = _raw_claims(spark, d)
    return rows.groupBy("source", F.coalesce(sinks.refused(rows, list(sinks.HOLDS_MIN)), F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT 's' || s_suppkey % 40 || '.example' AS host, count(DISTINCT s_nationkey) AS venues FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1")
def shared_hosts(spark, d):
    url = F.concat(F.lit("https://www.S"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".example/p"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").groupBy(text.domain_key(url).alias("host")).agg(F.countDistinct("s_nationkey").alias("venues")).where("venues > 1")


@query(f"SELECT subject_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, strftime(max(seen_at) FILTER (class = 'observation'), '%Y-%m-%d %H:%M') AS verified, round(sum(CASE WHEN claim_id % 5 = 0 THEN 0.1::DECIMAL(4,2) ELSE 0 END), 2)::DOUBLE AS boost FROM ({A.CLAIMS_SQL}) GROUP BY 1 HAVING max(seen_at) FILTER (class = 'observation') IS NOT NULL")
def attribution(spark, d):
    g = A.claims(spark, d).groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.date_format(F.max(F.when(F.col("class") == "observation", F.col("seen_at"))), "yyyy-MM-dd HH:mm").alias("verified"), F.sum(F.when(F.col("claim_id") % 5 == 0, F.lit(0.1).cast("decimal(4,2)")).otherwise(0)).cast("double").alias("boost"))
    return g.where("verified is not null").select("subject_id", "sources", "verified", F.round("boost", 2).alias("boost"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3")
def priority_first(spark, d):
    o = table(spark, d, "orders")
    return matching.first_of_each(o, ["o_custkey"], [(F.col("o_orderstatus") == "O").desc(), F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("SELECT s_suppkey AS id, s_name AS name, 'venue' AS kind FROM supplier UNION ALL SELECT p_partkey, p_name, 'event' FROM part")
def venue_and_event_names(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("venue").alias("kind"))
    return a.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("event").alias("kind")))


@query(f"""WITH v AS (SELECT venue_id, category FROM ({A.venues_sql()})), o AS (SELECT occ_id, venue_id FROM ({A.OCC_SQL}) WHERE start_at >= TIMESTAMP '1996-01-01' AND start_at < TIMESTAMP '1996-02-01')
  SELECT 'occurrence' AS kind, occ_id AS id, venue_id, category FROM o JOIN v USING (venue_id) UNION ALL SELECT 'venue', venue_id, venue_id, category FROM v WHERE NOT (category IN ('cinema', 'museum') AND EXISTS (SELECT 1 FROM o WHERE o.venue_id = v.venue_id))""")
def candidate_union(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    v = A.venues(spark, d).select("venue_id", "category")
    o = A.occurrences(spark, d).where((F.col("start_at") >= at("1996-01-01")) & (F.col("start_at") < at("1996-02-01"))).select("occ_id", "venue_id")
    events = o.join(v, "venue_id").select(F.lit("occurrence").alias("kind"), F.col("occ_id").alias("id"), "venue_id", "category")
    shown = v.where(F.col("category").isin("cinema", "museum")).join(o, "venue_id", "left_semi").select("venue_id")  # their programme stands for them
    return events.unionByName(v.join(shown, "venue_id", "left_anti").select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"), "venue_id", "category"))


@query(f"""SELECT occ_id, array_to_string(list_sort(list_distinct(['age=' || CASE WHEN occ_id % 2 = 0 THEN 'own' ELSE CASE WHEN venue_id % 3 = 0 THEN 'venue' ELSE '' END END, 'price=' || CASE WHEN venue_id % 2 = 0 THEN 'venue' ELSE '' END])), ',') AS facts FROM ({A.OCC_SQL})""")
def fact_overlay(spark, d):
    fact = lambda name, cond, v: F.when(cond, F.array(F.struct(F.lit(name).alias("k"), F.lit(v).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    k, v = F.col("occ_id"), F.col("venue_id")
    occ = A.occurrences(spark, d).select("occ_id", "venue_id", F.map_from_entries(fact("age", k % 2 == 0, "own")).alias("facts"))
    venues = spark.range(100).select(F.col("id").alias("venue_id")).select("venue_id", F.map_from_entries(F.concat(fact("age", v % 3 == 0, "venue"), fact("price", v % 2 == 0, "venue"), fact("opening_hours", v >= 0, "daily"))).alias("facts"))
    got = matching.overlaid(occ, venues)
    show = lambda n: F.concat(F.lit(f"{n}="), F.coalesce(F.col("facts")[n], F.lit("")))
    return got.select("occ_id", F.array_join(F.array(show("age"), show("price")), ",").alias("facts"))


@query(f"""WITH a AS (SELECT c_custkey AS ask_id, {NAMES}[c_custkey % 8 + 1] AS ask_key FROM customer), v AS (SELECT s_suppkey AS venue_id, {NAMES}[s_suppkey % 5 + 1] || CASE WHEN s_suppkey > 6 THEN ' ' || s_suppkey ELSE '' END AS key FROM supplier),
  e AS (SELECT ask_id, count(*) AS n, min(venue_id) AS id FROM a JOIN v ON key = ask_key GROUP BY 1), b AS (SELECT ask_id, count(*) AS n, min(venue_id) AS id FROM a JOIN v ON key = ask_key OR starts_with(key, ask_key || ' ') GROUP BY 1),
  f AS (SELECT a.ask_id, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'unique' WHEN b.n > 1 THEN 'ambiguous' ELSE 'none' END AS found, e.id AS x, b.id AS y FROM a LEFT JOIN e USING (ask_id) LEFT JOIN b USING (ask_id))
  SELECT ask_id, found, coalesce(CASE found WHEN 'exact' THEN x WHEN 'unique' THEN y END, -1) AS venue_id FROM f""")
def venue_by_name(spark, d):
    names = F.array(*map(F.lit, NAMES))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("ask_id"), F.get(names, (F.col("c_custkey") % 8).cast("int")).alias("ask_key"))
    k = F.col("s_suppkey")
    venues = table(spark, d, "supplier").select(k.alias("venue_id"), F.concat(F.get(names, (k % 5).cast("int")), F.when(k > 6, F.concat(F.lit(" "), k.cast("string"))).otherwise("")).alias("key"))
    return matching.by_name(asked, venues).select("ask_id", "found", F.coalesce("venue_id", F.lit(-1)).alias("venue_id"))


@query(f"""WITH l AS (SELECT c_custkey AS loc_id, CASE c_custkey % 4 WHEN 0 THEN 'hall ' || c_custkey % 50 WHEN 1 THEN 'main stage at hall ' || c_custkey % 30 || ' tonight' WHEN 2 THEN 'somewhere' ELSE 'the hall' END AS key, CASE WHEN c_custkey % 4 = 2 THEN c_custkey % 25 || ' main street' END AS address FROM customer),
  v AS (SELECT s_suppkey AS venue_id, 'hall ' || s_suppkey AS key, s_suppkey % 20 || ' main street' AS address FROM supplier WHERE s_suppkey <= 60),
  n AS (SELECT loc_id, min(venue_id) AS id FROM l JOIN v USING (key) GROUP BY 1 HAVING count(DISTINCT venue_id) = 1),
  w AS (SELECT loc_id, min(venue_id) AS id FROM l JOIN v ON len(list_intersect(string_split(l.key, ' '), string_split(v.key, ' '))) = 2 GROUP BY 1 HAVING count(DISTINCT venue_id) = 1),
  a AS (SELECT loc_id, min(venue_id) AS id FROM l JOIN v USING (address) GROUP BY 1 HAVING count(DISTINCT venue_id) = 1)
  SELECT loc_id, CASE WHEN n.id IS NOT NULL THEN 'name' WHEN w.id IS NOT NULL THEN 'words' WHEN a.id IS NOT NULL THEN 'address' ELSE 'none' END AS how, coalesce(n.id, w.id, a.id, -1) AS venue_id FROM l LEFT JOIN n USING (loc_id) LEFT JOIN w USING (loc_id) LEFT JOIN a USING (loc_id)""")
def place_matcher(spark, d):
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    key = F.when(k % 4 == 0, F.concat(F.lit("hall "), s(k % 50))).when(k % 4 == 1, F.concat(F.lit("main stage at hall "), s(k % 30), F.lit(" tonight"))).when(k % 4 == 2, "somewhere").otherwise("the hall")
    locs = table(spark, d, "customer").select(k.alias("loc_id"), key.alias("key"), F.when(k % 4 == 2, F.concat(s(k % 25), F.lit(" main street"))).alias("address"))
    v = F.col("s_suppkey")
    venues = table(spark, d, "supplier").where("s_suppkey <= 60").select(v.alias("venue_id"), F.concat(F.lit("hall "), s(v)).alias("key"), F.concat(s(v % 20), F.lit(" main street")).alias("address"))
    return matching.placed(locs, venues, ["hall", "the", "at"]).select("loc_id", "how", F.coalesce("venue_id", F.lit(-1)).alias("venue_id"))


@query(f"""WITH e AS (SELECT n_nationkey AS entry_id, {NAMES}[n_nationkey % 8 + 1] AS key, {NAMES}[(n_nationkey + 3) % 8 + 1] AS other, {A.CATEGORIES}[n_nationkey % 3 + 1] AS filed, 40.72::DOUBLE + n_nationkey % 5 / 200.0::DOUBLE AS e_lat, -73.97::DOUBLE AS e_lon FROM nation),
  p AS (SELECT id AS place_id, {NAMES}[id % 8 + 1] AS key, category, id % 10 AS confidence, lat, lon FROM ({A.LISTINGS_SQL})), x AS (SELECT entry_id, place_id, (p.key <> e.key)::INT AS alias, (category <> filed)::INT AS unfiled, floor({HAVERSINE.format(a='e_', b='')} / 500) AS far, confidence, {HAVERSINE.format(a='e_', b='')} AS metres FROM e JOIN p ON p.key = e.key OR p.key = other)
  SELECT entry_id, arg_min(place_id, (alias, unfiled, far, -confidence, place_id)) AS place_id FROM x WHERE metres <= 3000 GROUP BY 1""")
def curated_match(spark, d):
    names = F.array(*map(F.lit, NAMES))
    n = F.col("n_nationkey")
    entries = table(spark, d, "nation").select(n.alias("entry_id"), F.get(names, (n % 8).cast("int")).alias("key"), F.array(F.get(names, ((n + 3) % 8).cast("int"))).alias("aliases"), F.get(F.array(*map(F.lit, A.CATEGORIES)), (n % 3).cast("int")).alias("filed"), (F.lit(40.72) + n % 5 / F.lit(200.0)).alias("e_lat"), F.lit(-73.97).alias("e_lon"))
    k = F.col("record_id")
    places = A.listings(spark, d).select(k.alias("place_id"), F.get(names, (k % 8).cast("int")).alias("key"), "category", (k % 10).alias("confidence"), "lat", "lon")
    return matching.curated(entries, places, 3000.0)


# ---- sinks


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS body FROM orders WHERE o_orderkey % 10 < 8), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderstatus END AS body FROM orders WHERE o_orderkey % 10 > 1),
  c AS (SELECT CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN n.body = o.body THEN 'unchanged' ELSE 'updated' END AS change, coalesce(n.body, o.body) AS body FROM o FULL JOIN n USING (id)) SELECT change, body, count(*) AS n FROM c GROUP BY ALL""")
def upsert_counts(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("body"))
    new = o.where("o_orderkey % 10 > 1").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderstatus")).alias("body"))
    return sinks.upserted(old, new, ["id"], ["body"]).groupBy("change", "body").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT venue_id AS id, lat, lon, 40.75::DOUBLE AS r_lat, -73.95::DOUBLE AS r_lon FROM ({A.venues_sql('customer')})), m AS (SELECT *, {HAVERSINE.format(a='r_', b='')} AS metres FROM p)
  SELECT id, CASE WHEN id % 3 = 0 AND metres <= 2000 THEN 'read' ELSE 'held' END AS came FROM m WHERE (metres > 2000) OR id % 3 = 0""")
def replace_in_extent(spark, d):
    v = A.venues(spark, d, "customer").select(F.col("venue_id").alias("id"), "lat", "lon")
    near = geo.distance_m(F.lit(40.75), F.lit(-73.95), F.col("lat"), F.col("lon")) <= 2000
    got = sinks.replaced_in_extent(v.withColumn("came", F.lit("held")), v.where(near & (F.col("id") % 3 == 0)).withColumn("came", F.lit("read")), 40.75, -73.95, 2000.0)
    return got.select("id", "came")


@query("SELECT o_orderkey AS run_id, round(40 + o_orderkey % 997 / 997.0::DOUBLE, 2) AS lat, round(-74 + o_orderkey % 991 / 991.0::DOUBLE, 2) AS lon, (o_orderkey % 4)::INT AS seen, 0 AS dismissed, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS taste FROM orders")
def coarse_runs(spark, d):
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(k.alias("run_id"), (40 + k % 997 / F.lit(997.0)).alias("lat"), (-74 + k % 991 / F.lit(991.0)).alias("lon"), F.when(k % 4 > 0, F.sequence(F.lit(1).cast("long"), k % 4)).alias("seen_ids"), F.lit(None).cast("array<long>").alias("dismissed_ids"), F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).alias("taste"))
    return sinks.coarse(runs)


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 500")
def retention_prune(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return sinks.prunable(runs, F.lit("1997-01-01").cast("timestamp"))


@query("""SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 1 OR o_orderkey % 10 = 2 OR (o_orderkey % 4 = 3 AND o_orderdate <= TIMESTAMP '1995-06-01')""")
def incremental_trigger(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    records = o.select(k.alias("record_id"), F.when(k % 10 == 1, "v1").when(k % 10 != 2, "v2").alias("normalized_with"), F.when(k % 4 == 3, F.col("o_orderdate").cast("timestamp")).alias("renormalize_at"))
    return sinks.due_again(records, o.where("o_orderkey % 6 = 0").select(k.alias("record_id")), "v2", F.lit("1995-06-01").cast("timestamp"))


def _batch(spark, d, odd):
    k = F.col("claim_id")
    c = A.claims(spark, d).where(k % 2 == odd)
    return c.select((F.col("subject_id") % 40).alias("subject_id"), "attribute", "source", F.when(k % 3 > 0, (k % 3).cast("string")).alias("record"), "value", F.when(F.col("class") == "observation", "observation").otherwise("published").alias("class"), F.lit("x").alias("evidence"), F.when(F.col("class") == "observation", F.date_trunc("month", "seen_at")).alias("observed_at"), F.col("seen_at").alias("fetched_at"), F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("timestamp").alias("valid_until"))


_W = f"""c AS (SELECT claim_id % 2 AS odd, subject_id % 40 AS subject_id, attribute, source, CASE WHEN claim_id % 3 > 0 THEN (claim_id % 3)::VARCHAR ELSE '' END AS record, value, CASE WHEN class = 'observation' THEN class ELSE 'published' END AS class,
  CASE WHEN class = 'observation' THEN date_trunc('month', seen_at) END AS observed_at, seen_at AS fetched_at, confidence::DOUBLE AS confidence FROM ({A.CLAIMS_SQL})),
b AS (SELECT DISTINCT ON (odd, subject_id, attribute, source, record, value, class, observed_at) * FROM c ORDER BY odd, subject_id, attribute, source, record, value, class, observed_at, fetched_at DESC, confidence DESC),
m AS (SELECT coalesce(n.subject_id, o.subject_id) AS subject_id, coalesce(n.attribute, o.attribute) AS attribute, coalesce(n.source, o.source) AS source, coalesce(n.record, o.record) AS record, coalesce(n.value, o.value) AS value, coalesce(n.class, o.class) AS class,
  coalesce(n.fetched_at, o.fetched_at) AS fetched_at, coalesce(n.confidence, o.confidence) AS confidence, CASE WHEN o.subject_id IS NULL THEN 'inserted' WHEN n.subject_id IS NULL THEN 'kept' ELSE 'refreshed' END AS change
  FROM (SELECT * FROM b WHERE odd = 0) o FULL JOIN (SELECT * FROM b WHERE odd = 1) n ON o.subject_id = n.subject_id AND o.attribute = n.attribute AND o.source = n.source AND o.record = n.record AND o.value = n.value AND o.class = n.class AND o.observed_at IS NOT DISTINCT FROM n.observed_at),
s AS (SELECT subject_id, attribute, source, record, arg_max(value, fetched_at) AS says FROM b WHERE odd = 1 AND class <> 'observation' GROUP BY ALL),
a AS (SELECT DISTINCT subject_id, attribute, source FROM s WHERE record <> ''),
w AS (SELECT m.*, m.class <> 'observation' AND (coalesce(says <> value, false) OR (m.record = '' AND a.subject_id IS NOT NULL)) AS gone FROM m LEFT JOIN s USING (subject_id, attribute, source, record) LEFT JOIN a USING (subject_id, attribute, source))"""


@query(f"WITH {_W} SELECT CASE WHEN gone THEN 'superseded' ELSE change END AS change, class, attribute, count(*) AS n, round(sum(confidence), 4) AS confidence FROM w GROUP BY ALL")
def ledger_write(spark, d):
    ledger = _batch(spark, d, 0)
    first = sinks.written_claims(ledger.limit(0), ledger).where("true").select(*ledger.columns)  # each claim once
    done = sinks.written_claims(first, _batch(spark, d, 1))
    return done.groupBy("change", "class", "attribute").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


# ---- places and events


@query("""WITH b AS (SELECT c_custkey AS i, 0.2::DOUBLE + c_custkey % 60 * 0.05::DOUBLE AS size, 1500 + 100 * (c_custkey % 60) AS catchment, c_custkey % 7 * 3000.0::DOUBLE AS reach FROM customer)
  SELECT i AS c_custkey, ceil(round(size / 0.49::DOUBLE, 9))::INT AS across, round(size / ceil(round(size / 0.49::DOUBLE, 9)), 6) AS step, (ceil((catchment + reach) / 100) * 100)::INT AS extent, greatest(1000, catchment / 4.0::DOUBLE) AS slack FROM b""")
def extents(spark, d):
    """The tiles and extents in which each customer's area would be read."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (F.lit(0.2) + k % 60 * 0.05).alias("size"), (1500 + 100 * (k % 60)).alias("catchment"), (k % 7 * 3000.0).alias("reach"))
    return rows.select("c_custkey", geo.tiles_across(F.col("size")).alias("across"), F.round(F.col("size") / geo.tiles_across(F.col("size")), 6).alias("step"), geo.extent_m(F.col("catchment"), F.col("reach")).alias("extent"), geo.slack_m(F.col("catchment")).alias("slack"))


@query(f"""WITH o AS (SELECT occ_id, venue_id % 10 AS venue_id, 'show ' || occ_id % 3 AS title_key, date_trunc('day', start_at) AS start_at, ['site', 'ticket', 'feed'][occ_id % 3 + 1] AS source FROM ({A.OCC_SQL}))
  SELECT DISTINCT ON (venue_id, title_key, start_at) occ_id, source FROM o ORDER BY venue_id, title_key, start_at, CASE source WHEN 'ticket' THEN 0 WHEN 'site' THEN 1 ELSE 99 END, occ_id""")
def event_dedupe(spark, d):
    k = F.col("occ_id")
    o = A.occurrences(spark, d).select("occ_id", (F.col("venue_id") % 10).alias("venue_id"), F.concat(F.lit("show "), (k % 3).cast("string")).alias("title_key"), F.date_trunc("day", "start_at").alias("start_at"), F.get(F.array(F.lit("site"), F.lit("ticket"), F.lit("feed")), (k % 3).cast("int")).alias("source"))
    return matching.once_across_sources(o, {"ticket": 0, "site": 1}).select("occ_id", "source")


@query(f"""WITH h AS (SELECT occ_id, venue_id % 6 AS feed_id, start_at FROM ({A.OCC_SQL})) SELECT occ_id FROM h WHERE feed_id % 2 = 0 AND start_at::DATE <= DATE '1995-01-01' + feed_id::INT * 100 AND occ_id % 3 = 0""")
def feed_withdrawal(spark, d):
    h = A.occurrences(spark, d).select("occ_id", (F.col("venue_id") % 6).alias("feed_id"), "start_at")
    feeds = spark.range(6).select(F.col("id").alias("feed_id"), (F.col("id") % 2 == 0).alias("complete"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") * 100).cast("int")).alias("last_day"))
    return matching.withdrawn_by_feed(h, h.where("occ_id % 3 <> 0").select("feed_id", "occ_id"), feeds)
