"""Cuisines and diets of names and tags, against plain Python that reads rule after rule."""

import itertools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from tidegate.functions import cuisine, text
from tidegate.plans import food


def plain(name):
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.category(c).startswith("M"))
    return re.sub(r"[^a-z0-9]+", " ", bare.lower()).strip()


def told_one_by_one(name):
    """Rules in order, each taking out the words it read; at most three cuisines."""
    left, out = f" {plain(name)} ", []
    for _, rules in itertools.groupby(cuisine.ranked_phrases(), key=lambda x: x[1]):
        slug_of = {p: s for p, _, s in rules}
        found = re.search(pattern := rf"\b({'|'.join(sorted(slug_of, key=len, reverse=True))})\b", left)
        if found and len(out) < 3:
            out.append(slug_of[found[1]])
            left = re.sub(pattern, " | ", left)
    return out


def test_names_tell_what_rules_read_in_order_tell(spark):
    pick = random.Random(5)
    words = [p for p, _, _ in cuisine.ranked_phrases()] + ["the", "house", "kitchen", "Café", "hot", "pot", "ice", "hong", "banh", "steak", "&", "-", "dim", "bar", "rican", "eastern"]
    names = [" ".join(pick.choices(words, k=pick.randint(1, 6))) for _ in range(1500)] + food.SIGNS + ["", "  ", "PIZZA", "pizza " * 5000, "Ğyro KÓREAN  B.B.Q.", "korean b bq", "phỏ"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(-1, None)], "id int, name string")
    got = {r.id: (list(r.found), r.plain) for r in rows.select("id", cuisine.from_name(F.col("name")).alias("found"), cuisine.plain(F.col("name")).alias("plain")).collect()}
    assert got[-1] == ([], "")
    for i, n in enumerate(names):
        assert got[i] == (told_one_by_one(n), plain(n)), n


def test_no_two_phrases_of_two_words_share_a_word_in_turn():
    """The walk over words needs that no phrase ends where another begins."""
    pairs = [p.split() for p, _, _ in cuisine.ranked_phrases() if " " in p]
    assert all(len(p) == 2 for p in pairs) and not {a for a, _ in pairs} & {b for _, b in pairs}


def test_tagged_cuisines_and_their_kinds(spark):
    rows = spark.createDataFrame([("Italian; pizza, Tex-Mex",), (" ;;x;Thai;thai ",), ("a1,a2,a3,a4,a5,a6,a7,a8,a9",), ("fish & chips",), ("",), (None,), ("\tsouth  indian\n",)], "tag string")
    got = rows.select(cuisine.slugs(F.col("tag")).alias("s"), cuisine.groups(cuisine.slugs(F.col("tag"))).alias("g")).collect()
    assert [r.s for r in got] == [["italian", "pizza", "tex_mex"], ["thai"], [f"a{i}" for i in range(1, 9)], [], [], [], ["south_indian"]]
    assert got[0].g == ["italian", "mexican"] and got[6].g == ["indian"]


def test_what_was_asked_leads(spark):
    found = F.array(*map(F.lit, ("coffee_shop", "italian", "tex_mex", "pizza")))
    asked = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    r = spark.range(1).select(cuisine.asked_first(asked("pizza"), found).alias("a"), cuisine.lead(found).alias("l"), cuisine.lead(cuisine.asked_first(asked("mexican"), found)).alias("m"), cuisine.matches(asked("nothing"), found).alias("n"), cuisine.matches(asked(), found).alias("e"), cuisine.lead(asked("cafe")).alias("none")).first()
    assert r.a == ["pizza", "coffee_shop", "italian", "tex_mex"] and r.l == "Italian" and r.m == "Tex-Mex" and not r.n and not r.e and r.none is None


def test_diets(spark):
    names = {"Jisu Vegetarian": {"vegetarian": "only"}, "Madina Halal & Gluten-Free": {"halal": "yes", "gluten_free": "yes"}, "Kosher-Style Deli": {}, "Kosher style kosher": {"kosher": "only"}, "Glatt kosher style": {"kosher": "only"}, "Veganish": {}, "kosher kosher": {"kosher": "only"}, "Kosher stylesheet": {"kosher": "only"}, "": {}}
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.name: r.d for r in rows.select("name", cuisine.diets_named(F.col("name")).alias("d")).collect()}
    assert got == {**names, None: {}}
    tags = spark.createDataFrame([({"diet:vegan": " Only ", "diet:kosher": "maybe"},), ({"diet:vegan": "unknown"},), ({"shop": "x"},), (None,)], "tags map<string,string>")
    out = tags.select(cuisine.diets_tagged(F.col("tags")).alias("d"), cuisine.has_diet_tags(F.col("tags")).alias("h"), cuisine.serves(cuisine.diets_tagged(F.col("tags")), "vegetarian").alias("v")).collect()
    assert [(r.d, r.h, r.v) for r in out] == [({"vegan": "only"}, True, True), ({}, True, False), ({}, False, False), ({}, False, False)]


def test_marks_of_all_latin_letters(spark):
    """Letters that are one of a-z under their marks, in either case, precomposed or not."""
    base = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if re.fullmatch("[a-z]", bare):
            base[c] = bare
            base[unicodedata.normalize("NFD", c)] = bare
    got = {r.c: r.x for r in spark.createDataFrame([(c,) for c in base], "c string").select("c", text.without_marks(F.col("c")).alias("x")).collect()}
    assert len(base) > 600 and got == base
