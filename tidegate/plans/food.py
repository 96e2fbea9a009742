"""Queries of cuisines and diets over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import cuisine
from tidegate.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


#: What places add to the names of parts, by the key: words that tell a cuisine or a diet, and words that must not.
SIGNS = [
    "Korean BBQ", "Coal Oven Pizza", "Italian Ices", "Trattoria Nonna", "Sushi & Ramen Bar", "Great Szechuan", "Taqueria Diana", "Banh Mi Corner", "Phở Hà Nội", "Hotpot House", "Hot Pot Dim Sum", "Steak House", "Steakhouse Diner",
    "Middle Eastern Grill", "Puerto Rican Café", "Ethiopian and Filipino Kitchen", "Nepali Momo", "Bagels", "Kosher-Style Deli", "Glatt Kosher Deli", "Vegan Burgers", "Jisu Vegetarian", "Madina Halal Gyro", "Gluten-Free Brunch", "Fish House", "Thairestaurant",
    "Hong Kong Dumplings", "Crêpes", "Tapas, Pasta, Pizza and Sushi", "Barbecue Korean Barbecue Italian Ice Pasta", "Öyster Łobster",
]
#: What mappers wrote of cuisines and diets; most wrote nothing.
TAGGED = ["Italian; pizza, Tex-Mex", "coffee_shop;cafe;bagel", " Thai ;thai;x;", "a1;a2;a3;a4;a5;a6;a7;a8;a9", "fish & chips,fish and chips"]
DIET_TAGGED = ["diet:vegan=only", "diet:halal=Yes;diet:kosher=no", "diet:vegan=unknown", "diet:vegetarian= limited ;diet:gluten_free=yes", "wheelchair=yes"]
ASKS = ["japanese", "italian", "middle_eastern", "breakfast", "nothing", "korean"]

_texts = lambda xs: F.array(*map(F.lit, xs))
_pick = lambda xs, i: F.get(_texts(xs), i.cast("int"))


def places(spark, d):
    """Food places: each part with a sign, tags of some, and a search that asks for a cuisine."""
    k = F.col("p_partkey")
    tags = F.str_to_map(_pick(DIET_TAGGED, k % 5), F.lit(";"), F.lit("="))
    return table(spark, d, "part").select(
        k.alias("place_id"), F.concat("p_name", F.lit(" "), _pick(SIGNS, k % len(SIGNS))).alias("name"), F.when(k % 4 == 3, _pick(TAGGED, F.floor(k / 4) % 5)).alias("tag"),
        F.when(k % 7 < 3, tags).alias("tags"), F.array(_pick(ASKS, F.floor(k / 3) % len(ASKS))).alias("asked"),
    )


_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_rows = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)

PLACES_SQL = f"""pl AS (SELECT p_partkey AS place_id, p_name || ' ' || {_list(SIGNS)}[p_partkey % {len(SIGNS)} + 1] AS name, CASE WHEN p_partkey % 4 = 3 THEN {_list(TAGGED)}[p_partkey // 4 % 5 + 1] END AS tag,
  CASE WHEN p_partkey % 7 < 3 THEN {_list(DIET_TAGGED)}[p_partkey % 5 + 1] END AS tags, {_list(ASKS)}[p_partkey // 3 % {len(ASKS)} + 1] AS asked FROM part),
plain AS (SELECT place_id, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')) AS p FROM pl)"""

CUISINES_SQL = f"""{PLACES_SQL}, told(phrase, rank, slug) AS (VALUES {_rows(cuisine.ranked_phrases())}),
w AS (SELECT place_id, unnest(string_split(p, ' ')) AS w, unnest(range(len(string_split(p, ' ')))) AS i FROM plain),
two AS (SELECT a.place_id, a.i, rank, slug FROM w a JOIN w b ON b.place_id = a.place_id AND b.i = a.i + 1 JOIN told ON phrase = a.w || ' ' || b.w),
used AS (SELECT place_id, i FROM two UNION SELECT place_id, i + 1 FROM two),
hit AS (SELECT * FROM two UNION ALL SELECT place_id, i, rank, slug FROM w JOIN told ON phrase = w ANTI JOIN used USING (place_id, i)),
named AS (SELECT place_id, (list(slug ORDER BY rank))[1:3] AS found FROM (SELECT place_id, rank, arg_min(slug, i) AS slug FROM hit GROUP BY ALL) GROUP BY ALL),
part_of AS (SELECT place_id, i, regexp_replace(trim(x, ' '), '[\\s-]+', '_', 'g') AS s FROM (SELECT place_id, unnest(string_split_regex(lower(tag), '[;,]')) AS x, unnest(range(len(string_split_regex(tag, '[;,]')))) AS i FROM pl)),
tagged AS (SELECT place_id, (list(s ORDER BY i))[1:8] AS found FROM (SELECT place_id, s, min(i) AS i FROM part_of WHERE regexp_full_match(s, '[a-z0-9_]{{2,40}}') GROUP BY ALL) GROUP BY ALL),
c AS (SELECT place_id, asked, coalesce(t.found, n.found, []) AS found, t.found IS NOT NULL AS from_tag FROM pl LEFT JOIN tagged t USING (place_id) LEFT JOIN named n USING (place_id)),
each AS (SELECT place_id, asked, unnest(found) AS slug, unnest(range(len(found))) AS i FROM c),
kind(slug, kind) AS (VALUES {_rows([(s, g) for g, ms in cuisine.GROUPS.items() for s in ms])}),
member(asked, slug) AS (VALUES {_rows([(a, s) for a, ms in cuisine.ASKED.items() for s in ms])}),
own(slug, label) AS (VALUES {_rows(list(cuisine.LABELS.items()))})"""


@query(f"""WITH {CUISINES_SQL}, k AS (SELECT place_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT place_id, coalesce(kind, slug) AS kind FROM each LEFT JOIN kind USING (slug)) GROUP BY ALL),
  m AS (SELECT e.place_id, e.slug, e.i, m.slug IS NOT NULL AS wanted, coalesce(label, upper(e.slug[1]) || replace(e.slug[2:], '_', ' ')) AS label FROM each e LEFT JOIN member m ON m.asked = e.asked AND m.slug = e.slug LEFT JOIN own o ON o.slug = e.slug),
  s AS (SELECT place_id, bool_or(wanted) AS wanted, string_agg(slug, ',' ORDER BY wanted DESC, i) AS shown, (list(label ORDER BY wanted DESC, i) FILTER (slug NOT IN ('coffee_shop', 'coffee', 'cafe')))[1] AS lead FROM m GROUP BY ALL)
  SELECT place_id, from_tag, coalesce(shown, '') AS shown, coalesce(kinds, '') AS kinds, coalesce(wanted, false) AS wanted, coalesce(lead, '') AS lead FROM c LEFT JOIN s USING (place_id) LEFT JOIN k USING (place_id)""")
def cuisines_of_places(spark, d):
    p = places(spark, d).select("place_id", "asked", (F.size(cuisine.slugs(F.col("tag"))) > 0).alias("from_tag"), cuisine.cuisines(F.col("tag"), F.col("name")).alias("found"))
    found, shown = F.col("found"), cuisine.asked_first(F.col("asked"), F.col("found"))
    return p.select("place_id", "from_tag", F.array_join(shown, ",").alias("shown"), F.array_join(F.array_sort(cuisine.groups(found)), ",").alias("kinds"), cuisine.matches(F.col("asked"), found).alias("wanted"), F.coalesce(cuisine.lead(shown), F.lit("")).alias("lead"))


@query(f"""WITH {CUISINES_SQL} SELECT m.asked, count(DISTINCT place_id) AS places FROM each e JOIN member m USING (slug) GROUP BY ALL""")
def cuisine_choices(spark, d):
    """How many places each cuisine that a search may ask for would find: the counts of a filter's list."""
    asked_by = F.create_map(*(x for s in sorted({s for ms in cuisine.ASKED.values() for s in ms}) for x in (F.lit(s), _texts([a for a, ms in cuisine.ASKED.items() if s in ms]))))
    found = places(spark, d).select(cuisine.cuisines(F.col("tag"), F.col("name")).alias("found"))
    finds = F.array_distinct(F.flatten(F.transform("found", lambda s: F.coalesce(asked_by[s], F.array().cast("array<string>")))))
    return found.select(F.explode(finds).alias("asked")).groupBy("asked").agg(F.count("*").alias("places"))


_DIETS = list(cuisine.DIETS)
_TAG = "nullif(trim(regexp_extract(lower(tags), 'diet:{d}=([^;]*)', 1)), '')"


def _diets_sql() -> str:
    said = {"vegetarian": "p LIKE '% vegetarian %'", "vegan": "p LIKE '% vegan %'", "gluten_free": "p LIKE '% gluten free %'", "halal": "p LIKE '% halal %'", "kosher": "replace(replace(p, ' kosher style ', '  style '), ' glatt style ', '  style ') SIMILAR TO '.* (kosher|glatt) .*'"}
    tag = {d: f"CASE WHEN {_TAG.format(d=d)} IN ('only', 'yes', 'limited', 'no') THEN {_TAG.format(d=d)} END" for d in _DIETS}
    level = ", ".join(f"CASE WHEN tags LIKE '%diet:%' THEN {tag[d]} WHEN {said[d]} THEN '{cuisine.DIET_NAMED[d]}' END AS {d}" for d in _DIETS)
    each = ", ".join(f"'{d}=' || {d}" for d in _DIETS)
    labels = ", ".join(f"CASE {d} WHEN 'only' THEN '{name}' WHEN 'yes' THEN '{name} options' END" for d, name in cuisine.DIETS.items())
    return f"""WITH {PLACES_SQL}, x AS (SELECT place_id, tags LIKE '%diet:%' AS stated, {level} FROM (SELECT place_id, tags, ' ' || p || ' ' AS p FROM pl JOIN plain USING (place_id)))
      SELECT place_id, coalesce(stated, false) AS stated, concat_ws(',', {each}) AS levels, concat_ws(', ', {labels}) AS labels, coalesce(vegetarian IN ('yes', 'only'), false) OR coalesce(vegan IN ('yes', 'only'), false) AS vegetarian FROM x"""


@query(_diets_sql())
def diets_of_places(spark, d):
    p = places(spark, d).select("place_id", cuisine.has_diet_tags(F.col("tags")).alias("stated"), "tags", "name")
    p = p.select("place_id", "stated", F.when(F.col("stated"), cuisine.diets_tagged(F.col("tags"))).otherwise(cuisine.diets_named(F.col("name"))).alias("levels"))
    v = F.col("levels")
    in_order = F.transform(F.filter(_texts(_DIETS), lambda x: v[x].isNotNull()), lambda x: F.concat(x, F.lit("="), v[x]))
    return p.select("place_id", "stated", F.array_join(in_order, ",").alias("levels"), F.array_join(cuisine.diet_labels(v), ", ").alias("labels"), cuisine.serves(v, "vegetarian").alias("vegetarian"))
