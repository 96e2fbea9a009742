"""What a place serves: cuisines and diets from tags or its name, as column expressions.

A name is read word by word against a list of phrases. The longest phrase at a
word wins and its words are used up, so "Korean BBQ" is neither Korean nor
barbecue. Null names and tags give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.functions.bind import let

# Categories whose cuisine says what they serve, and how many cuisines are kept.
FOOD = ["restaurant", "cafe", "dessert", "bar"]
MOST_TAGGED, MOST_NAMED = 8, 3

# Phrases of a name and the cuisine they tell, in order of precedence.
PHRASES = {
    "korean_bbq": ["korean bbq", "korean barbecue"],
    "pizza": ["pizza", "pizzas", "pizzeria"],
    "italian_ice": ["italian ice", "italian ices"],
    "italian": ["trattoria", "osteria", "ristorante", "italian", "italiano", "italiana", "enoteca"],
    "pasta": ["pasta"],
    "sushi": ["sushi", "omakase"],
    "ramen": ["ramen"],
    "japanese": ["izakaya", "japanese", "yakitori", "udon", "soba"],
    "mexican": ["taqueria", "taco", "tacos", "burrito", "burritos", "mexican", "mexicana", "mexicano"],
    "thai": ["thai"],
    "vietnamese": ["pho", "banh mi", "vietnamese"],
    "dim_sum": ["dim sum"],
    "dumpling": ["dumpling", "dumplings"],
    "hot_pot": ["hot pot", "hotpot"],
    "sichuan": ["szechuan", "sichuan"],
    "chinese": ["chinese", "hunan", "shanghai", "cantonese", "hong kong"],
    "taiwanese": ["taiwanese"],
    "indian": ["indian", "tandoor", "tandoori", "masala", "biryani", "dosa"],
    "korean": ["korean"],
    "barbecue": ["bbq", "barbecue", "barbeque", "smokehouse"],
    "burger": ["burger", "burgers"],
    "steak_house": ["steak house", "steakhouse"],
    "diner": ["diner"],
    "french": ["french", "brasserie", "bistrot"],
    "greek": ["greek", "gyro", "gyros", "souvlaki"],
    "mediterranean": ["mediterranean"],
    "middle_eastern": ["middle eastern"],
    "lebanese": ["lebanese"],
    "turkish": ["turkish"],
    "persian": ["persian"],
    "falafel": ["falafel"],
    "shawarma": ["shawarma"],
    "kebab": ["kebab", "kebabs", "kabob", "kabobs"],
    "seafood": ["seafood", "oyster", "oysters", "lobster"],
    "tapas": ["tapas"],
    "spanish": ["spanish"],
    "caribbean": ["caribbean"],
    "jamaican": ["jamaican"],
    "cuban": ["cuban", "cubana", "cubano"],
    "dominican": ["dominican"],
    "puerto_rican": ["puerto rican"],
    "haitian": ["haitian"],
    "peruvian": ["peruvian"],
    "colombian": ["colombian"],
    "venezuelan": ["venezuelan", "arepa", "arepas"],
    "argentinian": ["argentinian", "argentine"],
    "brazilian": ["brazilian"],
    "salvadoran": ["salvadoran"],
    "bagel": ["bagel", "bagels"],
    "deli": ["deli", "delicatessen"],
    "sandwich": ["sandwich", "sandwiches"],
    "breakfast": ["breakfast", "brunch"],
    "nepalese": ["nepalese", "nepali"],
}
# Words that are their own cuisine. They share one place, before nepalese, so the first of a name counts alone.
OWN_WORDS = ["ethiopian", "malaysian", "filipino", "indonesian", "georgian", "ukrainian", "afghan", "pakistani", "senegalese", "nigerian", "tibetan", "uzbek"]

# Cuisines that a diner calls one kind of food; any other is a kind of its own.
GROUPS = {
    "italian": ["pizza", "pasta", "italian_pizza", "neapolitan", "trattoria"],
    "japanese": ["sushi", "ramen", "udon", "soba", "izakaya", "yakitori", "tempura", "donburi"],
    "chinese": ["dim_sum", "dumpling", "dumplings", "szechuan", "sichuan", "cantonese", "hunan", "shanghai", "hot_pot"],
    "american": ["burger", "diner", "hot_dog", "wings", "chicken", "fried_chicken", "steak_house", "barbecue", "bbq"],
    "mexican": ["tacos", "taco", "tex_mex", "burrito"],
    "coffee_shop": ["coffee", "espresso", "cafe"],
    "dessert": ["ice_cream", "gelato", "frozen_yogurt", "cake", "cupcake", "donut", "doughnut", "waffle", "crepe", "chocolate"],
    "middle_eastern": ["lebanese", "israeli", "falafel", "kebab", "shawarma", "syrian"],
    "korean": ["korean_bbq"],
    "vietnamese": ["pho", "banh_mi"],
    "indian": ["south_indian", "north_indian"],
    "sandwich": ["deli", "sandwiches"],
    "breakfast": ["brunch"],
    "seafood": ["fish", "oyster", "oysters", "fish_and_chips"],
    "bagel": ["bagels"],
    "spanish": ["tapas"],
}

# What a search may ask for, and the cuisines each takes in.
ASKED = {
    "pizza": ["pizza", "italian_pizza", "neapolitan"],
    "italian": ["italian", "pizza", "italian_pizza", "neapolitan", "pasta", "trattoria"],
    "chinese": ["chinese", "dim_sum", "dumpling", "dumplings", "szechuan", "sichuan", "cantonese", "hunan", "shanghai", "hot_pot", "hotpot"],
    "japanese": ["japanese", "sushi", "ramen", "udon", "soba", "izakaya", "yakitori", "tempura", "donburi"],
    "sushi": ["sushi"],
    "ramen": ["ramen"],
    "mexican": ["mexican", "tacos", "taco", "tex_mex", "burrito"],
    "thai": ["thai"],
    "indian": ["indian", "south_indian", "north_indian"],
    "korean": ["korean", "korean_bbq"],
    "vietnamese": ["vietnamese", "pho", "banh_mi"],
    "american": ["american", "burger", "diner", "barbecue", "bbq", "steak_house", "wings", "hot_dog"],
    "burger": ["burger"],
    "french": ["french"],
    "greek": ["greek"],
    "mediterranean": ["mediterranean", "greek"],
    "middle_eastern": ["middle_eastern", "lebanese", "israeli", "falafel", "kebab", "shawarma", "syrian", "turkish", "persian"],
    "seafood": ["seafood", "fish", "oyster", "oysters", "fish_and_chips"],
    "spanish": ["spanish", "tapas"],
    "caribbean": ["caribbean", "jamaican", "cuban", "dominican", "puerto_rican", "trinidadian", "haitian"],
    "latin_american": ["latin_american", "peruvian", "colombian", "venezuelan", "argentinian", "brazilian", "salvadoran", "ecuadorian"],
    "breakfast": ["breakfast", "brunch"],
    "bagel": ["bagel", "bagels"],
    "sandwich": ["sandwich", "sandwiches", "deli"],
}

# Labels that are not the slug with spaces and one capital, and cuisines that only restate the kind of place.
LABELS = {
    "tex_mex": "Tex-Mex", "bbq": "BBQ", "korean_bbq": "Korean BBQ", "italian_pizza": "Pizza", "coffee_shop": "Coffee", "middle_eastern": "Middle Eastern", "latin_american": "Latin American",
    "south_indian": "South Indian", "north_indian": "North Indian", "puerto_rican": "Puerto Rican", "steak_house": "Steakhouse", "hotpot": "Hot pot", "eastern_european": "Eastern European",
    "south_american": "South American", "north_african": "North African", "west_african": "West African", "east_african": "East African",
}
RESTATES_KIND = ["coffee_shop", "coffee", "cafe"]

# Diets with their labels, the words that tell them, the level a word tells, and the levels there are.
DIETS = {"vegetarian": "Vegetarian", "vegan": "Vegan", "gluten_free": "Gluten-free", "halal": "Halal", "kosher": "Kosher"}
DIET_WORDS = {"vegetarian": ["vegetarian"], "vegan": ["vegan"], "gluten_free": ["gluten free"], "halal": ["halal"], "kosher": ["kosher", "glatt"]}
DIET_NAMED = {"vegetarian": "only", "vegan": "only", "gluten_free": "yes", "halal": "yes", "kosher": "only"}
LEVELS = ["only", "yes", "limited", "no"]


def ranked_phrases() -> list[tuple[str, int, str]]:
    """Every phrase with its place in the order of precedence and its cuisine."""
    out, rank = [], 0
    for slug, phrases in PHRASES.items():
        if slug == "nepalese":
            out += [(w, rank, w) for w in OWN_WORDS]
            rank += 1
        out += [(p, rank, slug) for p in phrases]
        rank += 1
    return out


def _table(pairs: list[tuple[Column, Column]]) -> Column:
    return F.create_map(*(x for pair in pairs for x in pair))


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def plain(name: Column) -> Column:
    """Lower-case words of a-z and 0-9 without marks, one space between; empty for null."""
    return F.trim(F.regexp_replace(text.without_marks(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def slugs(raw: Column) -> Column:
    """`Italian; pizza, Tex-Mex` as [italian, pizza, tex_mex]: at most eight, each once, in order."""
    parts = F.split(F.lower(F.coalesce(raw, F.lit(""))), "[;,]")
    forms = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"[\s-]+", "_"))
    return F.slice(F.array_distinct(F.filter(forms, lambda s: s.rlike("^[a-z0-9_]{2,40}$"))), 1, MOST_TAGGED)


def from_name(name: Column) -> Column:
    """At most three cuisines that the words of a name tell, in order of precedence."""
    told = _table([(F.lit(p), F.struct(F.lit(r).alias("rank"), F.lit(s).alias("slug"))) for p, r, s in ranked_phrases()])
    two = lambda ws: F.transform(ws, lambda w, i: told[F.concat(w, F.lit(" "), F.get(ws, i + 1))])

    def found(ws: Column, pairs: Column) -> Column:
        at = lambda w, i: F.coalesce(pairs[i], F.when(F.get(pairs, i - 1).isNull(), told[w]))
        hits = F.transform(ws, lambda w, i: let(at(w, i), lambda h: F.when(h.isNotNull(), F.struct(h["rank"].alias("rank"), i.alias("at"), h["slug"].alias("slug")))))
        return F.array_sort(F.filter(hits, lambda h: h.isNotNull()))

    firsts = lambda hs: F.filter(hs, lambda h, i: (i == 0) | (F.get(hs, i - 1)["rank"] != h["rank"]))
    hits = let(F.split(plain(name), " "), lambda ws: let(two(ws), lambda ps: found(ws, ps)))
    return F.slice(F.transform(let(hits, firsts), lambda h: h["slug"]), 1, MOST_NAMED)


def cuisines(tag: Column, name: Column) -> Column:
    """The tagged cuisines; where no tag tells any, those of the name."""
    return let(slugs(tag), lambda s: F.when(F.size(s) > 0, s).otherwise(from_name(name)))


def groups(found: Column) -> Column:
    """The kinds of food that cuisines fall in, each once."""
    kinds = _table([(F.lit(s), F.lit(g)) for g, ms in GROUPS.items() for s in ms])
    return F.array_distinct(F.transform(found, lambda s: F.coalesce(kinds[s], s)))


def matches(asked: Column, found: Column) -> Column:
    """Whether one of the cuisines is among those that a search asks for; false for an unknown search."""
    members = _table([(F.lit(a), _texts(ms)) for a, ms in ASKED.items()])
    return F.coalesce(F.exists(asked, lambda a: F.coalesce(F.arrays_overlap(members[a], found), F.lit(False))), F.lit(False))


def asked_first(asked: Column, found: Column) -> Column:
    """The cuisines with those a search asks for before the rest."""
    return F.concat(F.filter(found, lambda s: matches(asked, F.array(s))), F.filter(found, lambda s: ~matches(asked, F.array(s))))


def label(slug: Column) -> Column:
    own = _table([(F.lit(k), F.lit(v)) for k, v in LABELS.items()])
    spaced = F.replace(slug, F.lit("_"), F.lit(" "))
    return F.coalesce(own[slug], F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 64)))


def lead(ordered: Column) -> Column:
    """The label of the first cuisine that says more than the kind of place, null without one."""
    return label(F.get(F.filter(ordered, lambda s: ~s.isin(RESTATES_KIND)), F.lit(0)))


def _levels(of: Callable[[str], Column]) -> Column:
    return F.map_filter(_table([(F.lit(d), of(d)) for d in DIETS]), lambda _, level: level.isNotNull())


def diets_tagged(tags: Column) -> Column:
    """Diet and level from a map of tags, those of a known level alone."""
    value = lambda d: F.lower(F.trim(tags[f"diet:{d}"]))
    return _levels(lambda d: F.when(value(d).isin(LEVELS), value(d)))


def diets_named(name: Column) -> Column:
    """Diet and level that the words of a name tell; "kosher style" is a style and tells none."""
    padded = F.concat(F.lit(" "), plain(name), F.lit(" "))
    padded = F.regexp_replace(padded, rf" ({'|'.join(DIET_WORDS['kosher'])})(?= style )", "")

    def level(diet: str) -> Callable[[Column], Column]:
        return lambda p: F.when(F.exists(_texts(DIET_WORDS[diet]), lambda w: F.contains(p, F.concat(F.lit(" "), w, F.lit(" ")))), F.lit(DIET_NAMED[diet]))

    return let(padded, lambda p: _levels(lambda d: level(d)(p)))


def has_diet_tags(tags: Column) -> Column:
    """Whether a tag says anything of diets, known or not; then the name is not read."""
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: k.startswith("diet:")), F.lit(False))


def serves(levels: Column, diet: str) -> Column:
    """Whether a place serves a diet; a vegan kitchen serves vegetarians too."""
    yes = lambda d: F.coalesce(levels[d].isin("yes", "only"), F.lit(False))
    return yes(diet) | yes("vegan") if diet == "vegetarian" else yes(diet)


def diet_labels(levels: Column) -> Column:
    """Labels of the diets served: "Vegan" for a vegan place, "Vegan options" where there are some."""
    of = lambda d, name: F.when(levels[d] == "only", F.lit(name)).when(levels[d] == "yes", F.lit(f"{name} options"))
    return F.array_compact(F.array(*(of(d, name) for d, name in DIETS.items())))
