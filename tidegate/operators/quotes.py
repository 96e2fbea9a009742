"""Whole quotes found on pages, by an equi-join on their words and an exact check after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.feasibility import once

#: A quote meets a page through this many words of it.
WINDOW = 5
_SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def folded(text: Column) -> Column:
    """The text with every run of white space as one space, none at its ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def _windows(words: Column, size: int) -> Column:
    """The hashes of all runs of `size` words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def on_page(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(page_id, quote_id) of every quote that stands whole on a page, word for word.

    Pages have page_id and text, quotes quote_id and quote; white space is
    folded. A quote is looked for by the hash of its first WINDOW words, or of
    all of a shorter one; those that meet are checked on the whole text. An
    empty quote is on no page. Neither side is broadcast unless Spark finds it
    small.
    """
    q = quotes.select("quote_id", folded(F.col("quote")).alias("quote")).where("quote <> ''")
    own = F.split("quote", " ")
    size = F.least(F.size(own), F.lit(WINDOW))
    key = F.coalesce(*(F.when(size == n, F.xxhash64(*(F.get(own, F.lit(k)) for k in range(n)))) for n in range(1, WINDOW + 1)))
    q = q.select("quote_id", "quote", size.alias("size"), key.alias("key"))
    sizes = sorted(r["size"] for r in q.select("size").distinct().collect())  # at most WINDOW numbers
    p = pages.where("text is not null").select("page_id", folded(F.col("text")).alias("text"))
    words = once(p, "words", F.split("text", " "))
    none = F.array().cast("array<bigint>")
    of_size = lambda n: F.transform(F.array_distinct(F.when(F.size("words") >= n, _windows(F.col("words"), n)).otherwise(none)), lambda h: F.struct(F.lit(n).alias("size"), h.alias("key")))
    starts = [of_size(n) for n in sizes or [1]]
    keyed = words.select("page_id", F.explode(F.concat(*starts)).alias("k")).select("page_id", "k.size", "k.key")
    met = keyed.join(q, ["size", "key"]).select("page_id", "quote_id", "quote")
    space = F.lit(" ")
    whole = F.contains(F.concat(space, F.col("text"), space), F.concat(space, F.col("quote"), space))
    return p.join(met, "page_id").where(whole).select("page_id", "quote_id")
