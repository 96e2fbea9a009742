"""Names, keys and patterns of texts, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Small Latin letters that decompose into one of a-z and marks, and those letters; Spark has no Unicode normalisation."""
    letters = [chr(c) for low, high in ((0x00DF, 0x0250), (0x1E00, 0x1F00)) for c in range(low, high)]
    split = [(x, unicodedata.normalize("NFKD", x)) for x in letters if x.islower()]
    pairs = [(x, s[0]) for x, s in split if s != x and "a" <= s[0] <= "z" and all(map(unicodedata.combining, s[1:]))]
    return "".join(x for x, _ in pairs), "".join(s for _, s in pairs)


ACCENTS = _accents()
# Abbreviations written out in keys, and words that only join names in a title.
STREET_WORDS = {"st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "rd": "road", "pl": "place", "sq": "square", "ln": "lane", "dr": "drive", "pkwy": "parkway", "ct": "court", "mt": "mount", "ft": "fort"}
JOINING_WORDS = ["a", "an", "and", "at", "by", "for", "in", "of", "on", "vs", "with", "featuring", "feat", "presents", "live", "special", "guest", "guests"]


def without_marks(text: Column) -> Column:
    """Lower case, with the base letters of accented ones and without combining marks."""
    return F.regexp_replace(F.translate(F.lower(text), *ACCENTS), r"\p{M}", "")


def name_key(name: Column) -> Column:
    """Lower case without marks, punctuation, articles and company forms."""
    plain = F.regexp_replace(F.replace(without_marks(name), F.lit("&"), F.lit(" and ")), "['’`]", "")
    plain = F.regexp_replace(plain, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(the|inc|llc|ltd|co)\b", " "), " +", " "))


def match_key(name: Column) -> Column:
    """name_key with street words written out."""
    words = F.create_map(*(F.lit(x) for pair in STREET_WORDS.items() for x in pair))
    return F.array_join(F.transform(F.split(name_key(name), " "), lambda w: F.coalesce(words[w], w)), " ")


def tokens(key: Column) -> Column:
    """The distinct words of a key that have two letters or more."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def domain_key(url: Column) -> Column:
    """The host without www, null without one."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z]+://)?(?:www\.)?([a-z0-9.-]+)", 1)
    return F.nullif(host, F.lit(""))


def phone_key(phone: Column) -> Column:
    """The digits without a leading country code 1, null for fewer than seven."""
    digits = F.regexp_replace(phone, r"\D", "")
    local = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) >= 7, local)


def name_prefixes(key: Column) -> Column:
    """The first word of a key, the first two, and so on to the whole, to meet a list of chain names."""
    words = F.split(key, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def title_words(title: Column) -> Column:
    """The distinct words of a title's key that name the show."""
    joining = F.array(*map(F.lit, JOINING_WORDS))
    return F.array_except(F.array_remove(F.split(match_key(title), " "), ""), joining)


def same_show(x: Column, y: Column) -> Column:
    """Whether two sets of title words name one show.

    Every word of the smaller stands in the larger; a single word may meet one
    word more at most; and nothing that tells two apart, a number, is added.
    """
    small, big = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    added = F.array_except(big, small)
    tells = F.exists(added, lambda w: w.rlike("^([0-9]+|ii|iii|iv|vi{0,3}|ix|x|part)$"))
    return (F.size(small) > 0) & (F.size(F.array_except(small, big)) == 0) & ~((F.size(small) == 1) & (F.size(big) > 2)) & ~tells


def namesake(x: Column, y: Column, generic: Column, metres: Column) -> Column:
    """Whether two lists of name words this far apart could be one place.

    The same words count up to 500 m; up to 100 m, half of the distinctive words
    of the shorter name are enough.
    """
    dx, dy = F.array_except(x, generic), F.array_except(y, generic)
    least = F.least(F.size(dx), F.size(dy))
    shared = F.size(F.array_intersect(dx, dy)) / F.nullif(least, F.lit(0)) >= 0.5
    same = F.array_join(x, "") == F.array_join(y, "")
    return (F.size(x) > 0) & (F.size(y) > 0) & F.when(same, metres <= 500).otherwise((metres <= 100) & F.coalesce(shared, F.lit(False)))


def visible_text(html: Column) -> Column:
    """A page's words: scripts, styles, comments and tags go, common entities are read, spaces fold.

    A script or comment that never closes hides the rest of the page, and a tag
    ends at the next bracket of either kind, so each pattern passes over a page
    once, whatever stands in it.
    """
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^<>]*>.*?(?:</\1\s*>|\z)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?(?:-->|\z)", " "), r"<[^<>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def links(html: Column) -> Column:
    """Targets of the page's anchors, in order, however they are quoted."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^<>]*?\bhref\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def stated_prices(text: Column) -> Column:
    """Dollar amounts named in a text, with or without commas between thousands."""
    found = F.regexp_extract_all(text, F.lit(r"\$ ?(\d{1,3}(?:,\d{3})+(?:\.\d\d)?|\d+(?:\.\d\d)?)"), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def listed_free(text: Column) -> Column:
    """Whether a text says free without a condition beside it."""
    return F.lower(text).rlike(r"\bfree\b") & ~F.lower(text).rlike(r"\bfree (with|for members|trial|parking)\b|\bsugar free\b")


def clip(text: Column, most: int) -> Column:
    """The text cut at a word to at most `most` characters, with an ellipsis if cut."""
    cut = F.regexp_replace(F.substring(text, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))
