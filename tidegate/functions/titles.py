"""What the titles of events say: interests, drinks, and the film that a screening shows; all as column expressions.

A title is cut where words begin and end, and every run of up to three words
is looked up in one constant map. A word speaks through the longest listed
phrase that ends with it, so that "cheese tasting" is food and "tasting" alone
is a drink.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.functions.bind import let

# The words and phrases by which a title tells an interest in full.
TELLS = {
    "art": "art, artist talk, exhibit, exhibits, exhibition, exhibitions, opening reception",
    "books": "author, authors, book, books, lecture, lectures, panel, poetry, reading, readings, storytime, talk, talks",
    "cafes": "coffee tasting, coffee tastings, tea tasting, tea tastings",
    "comedy": "comedy, improv, stand-up, standup",
    "drinks": "bar crawl, beer, bourbon, brewery, breweries, brewfest, cocktail, cocktails, happy hour, pub crawl, tasting, tastings, whiskey, whisky, wine",
    "festivals": "block party, carnival, celebration, fair, fairs, festival, festivals, fireworks, parade, parades",
    "film": "cinema, film, films, movie, movies, screening, screenings",
    "food": "brunch, cheese tasting, cheese tastings, chocolate tasting, chocolate tastings, dessert tasting, dessert tastings, dinner, food, honey tasting, honey tastings, ice cream tasting, ice cream tastings, olive oil tasting, olive oil tastings, supper",
    "games": "bingo, board game, board games, game night, quiz, trivia",
    "live_music": "band, bands, blues, choir, concert, concerts, dj, folk, gig, hip-hop, hiphop, jazz, live music, orchestra, quartet, recital, rock, salsa, symphony",
    "markets": "bazaar, craft fair, flea, market, markets, pop-up shop, popup shop",
    "museums": "historic, history, tour, tours",
    "sports": "10k, 5k, baseball, basketball, football, hockey, marathon, race, soccer, tennis, yoga",
    "theatre": "ballet, burlesque, cabaret, dance, drag, musical, opera, theater, theatre",
}
# Phrases that tell half of an interest, and phrases that only keep their last word from speaking.
HALF = {"comedy": "open mic", "live_music": "open mic", "outdoors": "fireworks"}
SILENT = "food tasting, food tastings"
#: Characters of a title that are read.
LONGEST = 200

# What a screening puts before a film's title, and beside or after it.
SERIES_NOUNS = "movie, film, cinema, screening, movies, films, cinemas, screenings"
SERIES_PLACES = "night, nite, club, series, under the stars, on the lawn, on the green, on the pier, on the beach"
SERIES = "family movie night, summer movie, summer movies, sneak preview, special screening, opening night, member screening, members screening"
PRINTS = "35mm, 35 mm, 70mm, 70 mm, 16mm, 16 mm, imax, 3d, 4k, open caption, open captioned, sing-along, singalong, double feature"
ADDITIONS = "q and a, in person, intro, discussion, conversation, talkback, panel, live score, sneak preview, preview, premiere, anniversary, restoration, directors cut, director s cut, member screening, members screening, double feature, sing along, singalong"
GUESTS = "director, filmmaker, cast, writer, star, actor, special guest, guest"


def _listed(values: str) -> list[str]:
    return values.split(", ")


def meanings() -> dict[str, dict[str, float]]:
    """Every listed phrase with the interests that it tells and their strengths."""
    out: dict[str, dict[str, float]] = {p: {} for p in _listed(SILENT)}
    for told, strength in ((HALF, 0.5), (TELLS, 1.0)):
        for interest, phrases in told.items():
            for p in _listed(phrases):
                out.setdefault(p, {})[interest] = strength
    # a word within a longer phrase still speaks there, unless the phrase is a tasting of something
    for p, told in out.items():
        last = p.rsplit(" ", 1)[-1]
        if last not in ("tasting", "tastings") and last != p:
            told.update({k: v for k, v in out.get(last, {}).items() if k not in told})
    return out


def said(title: Column) -> Column:
    """Per word of a title what it tells: array<map<interest, strength>>, null where a word tells nothing."""
    listed = meanings()
    strengths = lambda told: F.create_map(*(x for k, v in told.items() for x in (F.lit(k), F.lit(v)))) if told else F.create_map().cast("map<string,double>")
    tells = F.create_map(*(x for p, told in listed.items() for x in (F.lit(p), strengths(told))))
    most = max(len(p.replace("-", " ").split(" ")) for p in listed)

    def at(parts: Column, last: Column) -> Column:
        # words and what stands between them take turns, so a run of n words is 2n - 1 parts
        runs = [(2 * n - 2) for n in range(most, 0, -1)]
        return F.coalesce(*(F.when(last >= back, tells[F.array_join(F.slice(parts, last - back + 1, back + 1), "")]) for back in runs))

    pieces = F.split(F.lower(F.substring(F.coalesce(title, F.lit("")), 1, LONGEST)), r"\b")
    return let(pieces, lambda ps: F.transform(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: at(ps, i)))


def title_interests(title: Column) -> Column:
    """map<interest, strength>: all that a title says, each at its strongest; empty for null."""
    told = F.flatten(F.transform(F.filter(said(title), lambda m: m.isNotNull()), F.map_entries))
    names = sorted({*TELLS, *HALF})
    strongest = lambda es: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.array_max(F.transform(F.filter(es, lambda e: e["key"] == k), lambda e: e["value"])) for k in names)))  # noqa: E731, B023
    return F.map_filter(let(told, strongest), lambda _, v: v.isNotNull())


def drink_title(title: Column) -> Column:
    """Whether drinks are the outing, by the title; such an event is probably for adults."""
    return F.exists(F.filter(said(title), lambda m: m.isNotNull()), lambda m: F.coalesce(m["drinks"], F.lit(0.0)) >= 1.0)


def _words(title: Column) -> Column:
    """Lower-case words without signs, one space between, `&` as a word."""
    return F.trim(F.regexp_replace(F.replace(title, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def _series() -> list[str]:
    """All that may stand before a film's title and a colon, as words."""
    made = product(("", "free "), ("", "outdoor "), _listed(SERIES_NOUNS), ("", *(f" {p}" for p in _listed(SERIES_PLACES))))
    return ["".join(parts) for parts in made] + _listed(SERIES)


def film_keys(title: Column) -> Column:
    """The keys a screening's title is matched by, the closest first; none for null.

    A title's parts stand between signs. The first part goes if it names a
    series, brackets and words of the print go anywhere, and for a second key
    all goes from the first part on that begins with an addition, such as a talk
    or a guest. A film's own second title is never an addition.
    """
    additions = _listed(ADDITIONS) + [f"with {of}{who}" for of, who in product(("", "the ", "its "), _listed(GUESTS))]
    low = text.without_marks(F.coalesce(title, F.lit("")))
    head, rest = F.regexp_extract(low, r"^([^:|–-]*)[:|–-]", 1), F.regexp_replace(low, r"^[^:|–-]*[:|–-]", "")
    film = F.when(_words(head).isin(_series()), rest).otherwise(low)
    shown = F.regexp_replace(F.regexp_replace(film, r"\([^)]*\)|\[[^\]]*\]", " "), rf"\b(in\s+)?({'|'.join(_listed(PRINTS))})\b", " ")
    # a part begins at a colon, or at a dash, bar or plus that stands alone
    parts = F.transform(F.split(shown, r":|\s[|+–-](?=\s)"), _words)
    added = lambda p: p.rlike(f"^({'|'.join(additions)})")
    kept = lambda ps: F.slice(ps, F.lit(1), F.coalesce(F.array_min(F.transform(ps, lambda p, i: F.when((i > 0) & added(p), i))), F.size(ps)))
    joined = lambda ps: F.array_join(F.filter(ps, lambda p: p != ""), " ")
    return let(parts, lambda ps: F.array_remove(F.array_distinct(F.array(joined(ps), joined(kept(ps)))), ""))


def stronger(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Two maps of strengths as one: of each key the greater, those of b scaled."""
    return F.map_zip_with(a, F.transform_values(b, lambda k, v: v * scale), lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def taste_match(interests: Column, weights: Column) -> Column:
    """0.5 for neutral, to 1 for a love and 0 for a skip: the best like less the worst skip."""
    felt = F.transform(F.map_entries(interests), lambda e: F.coalesce(weights[e["key"]], F.lit(0.0)) * e["value"])
    return let(felt, lambda f: F.round(0.5 + 0.5 * (F.greatest(F.lit(0.0), F.coalesce(F.array_max(f), F.lit(0.0))) - F.greatest(F.lit(0.0), -F.coalesce(F.array_min(f), F.lit(0.0)))), 3))
