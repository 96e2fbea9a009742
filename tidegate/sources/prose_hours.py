"""Opening hours that a page states in words, read line by line.

A page becomes lines with the heading each is under, found by windows over the
page's lines. Lines that may speak of days go through a small reader; lines that
do, next to each other, are a block, and a block counts unless it, the lines
around it or its heading say that it is about something else.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements that are not shown, that end a section, and that end a line.
HIDDEN = ["script", "style", "noscript", "svg", "template", "head"]
SECTIONS = ["section", "article", "aside", "header", "footer", "main", "nav", "table"]
BLOCKS = ["br", "p", "div", "li", "tr", "td", "th", "section", "article", "header", "footer", "dt", "dd", "table", "ul", "ol", "dl", "address", "main", "aside", "nav", "blockquote", "pre", "hr", "option"]
# What makes a block of hours one of something else, of a season, or a line an exception.
NOT_OPENING = r"(?i)happy\s*hour|deliver|take\s*-?\s*out|pick\s*-?\s*up|curbside|catering|office|phone|call\b|kitchen|ticket|reservation line|order online|online ordering|front desk|lessons?\b|classes\b|registration|mass\b|service times|worship|sermon|specials?\b|brunch menu|late night menu"
SEASONAL = r"(?i)\b(summer|winter|fall|autumn|spring|seasonal|school year|academic year|semester|intersession)\b"
EXCEPTION = r"(?i)\b(holiday|thanksgiving|christmas|easter|memorial day|labor day|new year|july 4|independence day|(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.? \d{1,2}\b|\d{1,2}/\d{1,2})"
# The spellings of days, from Sunday on.
SPELLINGS = ["sun suns sunday sundays", "mon mons monday mondays", "tue tues tuesday tuesdays", "wed weds wednesday wednesdays", "thu thus thur thurs thursday thursdays", "fri fris friday fridays", "sat sats saturday saturdays"]
DAY = {word: day for day, words in enumerate(SPELLINGS) for word in words.split()}
EVERY = list(range(7))

_MARKS = {"open": "\x01", "close": "\x02", "break": "\x03"}
_TOKEN = re.compile(r"[a-z']+|\d+(?::\d+)?|\S")
_SPEAKS = r"(?i)\b(" + "|".join([*DAY, "daily", "every ?day", "days", "weekdays", "weekends"]) + r")\b"


# Entities by name; the ampersand last, so that nothing is read twice.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "hellip": "…", "middot": "·", "bull": "•", "thinsp": " ", "ensp": " ", "emsp": " ", "amp": "&"}


def decoded(body: Column) -> Column:
    """The text with character references by number and by NAMED read; others stay."""
    hexes = lambda n, size: F.lpad(F.hex(n), size, "0")

    def sign(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "[&#;xX]", "")
        code = F.when(F.lower(ref).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        over = code - 0x10000
        pair = F.concat(hexes(F.lit(0xD800) + F.shiftright(over, 10), 4), hexes(F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF)), 4))
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(known, F.decode(F.unhex(F.when(code < 0x10000, hexes(code, 4)).otherwise(pair)), "UTF-16BE")).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(body, F.lit("(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
    out = F.aggregate(refs, body, lambda t, r: F.replace(t, r, sign(r)))
    for name, char in NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, line, heading, under): the visible lines of each page, from 1.

    heading says whether the line is in a heading; under is the last heading
    before it in its section ("" for none), the line itself if it is one. A tag
    that never closes takes the rest of the page, so each pattern passes over a
    page once, whatever stands in it.
    """
    tags = lambda names: "(?i)</?(" + "|".join(names) + r")(?![a-z0-9])[^>]*(?:>|\z)"
    t = F.regexp_replace(F.col(html), "[\x01-\x03]", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", "")
    t = F.regexp_replace(t, "(?is)<(" + "|".join(HIDDEN) + r")(?![a-z0-9])[^>]*(?:>.*?(?:</\1[^>]*(?:>|\z)|\z)|\z)", "\n")
    t = F.regexp_replace(t, r"(?i)<h[1-6](?![a-z0-9])[^>]*(?:>|\z)", "\n\x01")
    t = F.regexp_replace(t, r"(?i)</h[1-6](?![a-z0-9])[^>]*(?:>|\z)", "\x02\n")
    t = F.regexp_replace(t, tags(SECTIONS).replace("/?", "/"), "\n\x03\n")
    t = F.regexp_replace(F.regexp_replace(t, tags(BLOCKS), "\n"), r"<[^>]*(?:>|\z)", " ")
    rows = pages.select(F.col(key).alias("page_id"), F.posexplode(F.split(decoded(t), "\n", -1)).alias("at", "raw"))
    page = Window.partitionBy("page_id").orderBy("at")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    has = lambda mark: F.contains("raw", F.lit(_MARKS[mark]))
    rows = rows.withColumn("state", F.when(has("close"), False).when(has("open"), True))
    rows = rows.withColumn("heading", has("open") | F.coalesce(F.last("state", ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumn("section", F.count_if(has("break")).over(page))
    line = F.trim(F.regexp_replace(F.regexp_replace("raw", "[\x01\x02]", ""), r"[\s\x{a0}\x{200b}]+", " "))
    rows = rows.where(~has("break")).withColumn("line", line).where(F.col("line") != "")
    under = F.last(F.when(F.col("heading"), F.col("line")), ignorenulls=True).over(Window.partitionBy("page_id", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("page_id", F.row_number().over(page).alias("pos"), "line", "heading", F.coalesce(under, F.lit("")).alias("under"))


class _Line:
    """The days and times of a line, from its tokens."""

    def __init__(self, line: str):
        self.line = line
        low = re.sub("[–—]", "-", line).lower()
        self.found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]
        self.words = [x[0] for x in self.found]

    def word(self, at: int) -> str:
        return self.words[at] if at < len(self.words) else ""

    def day(self, at: int) -> tuple[int | None, int]:
        d = DAY.get(self.word(at))
        return (None, at) if d is None else (d, at + 1 + (self.word(at + 1) == "."))

    def days(self, at: int) -> tuple[list[int], int]:
        """The days named from a token on, and where they end."""
        w = self.words[at : at + 4]
        if w[:1] in (["daily"], ["everyday"]):
            return EVERY, at + 1
        if w[:2] == ["every", "day"]:
            return EVERY, at + 2
        if w[:2] in (["7", "days"], ["seven", "days"]):
            return EVERY, at + (4 if w[2:] == ["a", "week"] else 2)
        if w[:1] == ["weekdays"]:
            return [1, 2, 3, 4, 5], at + 1
        if w[:1] == ["weekends"]:
            return [0, 6], at + 1
        out: list[int] = []
        while True:
            first, end = self.day(at)
            if first is None:
                return out, start if out else at
            last = first
            if self.word(end) in ("-", "to", "thru", "through"):
                other, after = self.day(end + 1)
                if other is not None:
                    last, end = other, after
            out += [d for i in range((last - first) % 7 + 1) if (d := (first + i) % 7) not in out]
            start = end  # what follows a comma counts only if it is a day
            if self.word(end) not in (",", "&", "and", "/", "+"):
                return out, end
            at = end + 1

    def time(self, at: int) -> tuple[tuple[int, str, bool] | None, int]:
        """(minutes, "a", "p" or "" as the time says, whether minutes were written), and where it ends."""
        w = self.word(at)
        if w in ("noon", "midnight"):
            return ((720, "p", True) if w == "noon" else (0, "a", True)), at + 1
        if not re.fullmatch(r"\d{1,2}(:\d\d)?", w):
            return None, at
        hour, _, minute = w.partition(":")
        end, half = at + 1, ""
        if self.word(end) in ("am", "pm", "a", "p"):
            half, end = self.word(end)[0], end + 1
            if self.words[end : end + 2] == [".", "m"] and len(self.word(end - 1)) == 1:
                end += 2
            end += self.word(end) == "." and self.words[end - 1][-1] == "m"
        h, m = int(hour), int(minute or 0)
        if m > 59 or h > 24 or (half and not 1 <= h <= 12):
            return (-1, half, False), end
        return ((h % 12 + 12 * (half == "p")) * 60 + m if half else h * 60 + m, half, bool(minute)), end

    def times(self, at: int) -> tuple[list | None, int]:
        """The ranges from a token on (None among them: a guess), or [] for "closed"; None if there are none."""
        if self.word(at) == "closed":
            return [], at + 1
        out, end = [], at
        while True:
            a, i = self.time(at)
            if a is None or self.word(i) not in ("-", "to", "until", "till", "'til"):
                break
            b, i = self.time(i + 1)
            if b is None:
                break
            out.append(stretch(a, b))
            end = i
            if self.word(i) not in (",", "&", "and", "/"):
                break
            at = i + 1
        return (out, end) if out else (None, end)

    def statements(self) -> list[dict]:
        out, at = [], 0
        while at < len(self.words):
            days, i = self.days(at)
            if days:
                i += self.word(i) == ":"
                ranges, end = self.times(i)
                if ranges is None and self.word(i) == "-":
                    ranges, end = self.times(i + 1)
                if ranges is not None:
                    if None not in ranges:
                        out.append(said(days, ranges, self.line[self.found[at][1] : self.found[end - 1][2]]))
                    at = end
                    continue
            at += 1
        return out


def stretch(a: tuple[int, str, bool], b: tuple[int, str, bool]) -> tuple[int, int] | None:
    """The interval from one time to another, in minutes, or None where that would be a guess.

    Times without a half of the day are read by the clock of 24 hours only where
    both are written out and one is past 1 pm; an opening without one takes the
    half that puts it soonest before the close.
    """
    (start, half_a, full_a), (end, half_b, full_b) = a, b
    if start < 0 or end < 0 or (half_a and not half_b):
        return None
    if not half_a and not half_b:
        if not (full_a and full_b) or (start < 780 and end < 780):
            return None
    elif not half_a:
        like = start % 720 + 720 * (half_b == "p")
        start = like if like < end else start % 720
    end += 1440 * (end <= start)
    return (start, end) if 30 <= end - start < 1440 else None


def said(days: list[int], ranges: list, words: str) -> dict:
    return {"days": days, "closed": not ranges, "ranges": [{"start": s, "end": e} for s, e in ranges], "said": words}


def read_line(line: str, following: str | None) -> dict | None:
    """The statements of a line, and whether the following line holds the times of its days; None for none."""
    one = _Line(line)
    at = int(one.word(0) == "open")
    days, end = one.days(at)
    end += one.word(end) == ":"
    if days and end == len(one.words) and following:
        two = _Line(following)
        ranges, stop = two.times(0)
        if ranges is not None and stop == len(two.words):
            return None if None in ranges else {"statements": [said(days, ranges, f"{line} {following}")], "uses_next": True}
    found = one.statements()
    return {"statements": found, "uses_next": False} if found else None


READ = "struct<statements:array<struct<days:array<int>,closed:boolean,ranges:array<struct<start:int,end:int>>,said:string>>,uses_next:boolean>"


def _read(line: pd.Series, following: pd.Series) -> pd.DataFrame:
    none = {"statements": None, "uses_next": None}
    return pd.DataFrame([read_line(a, b if isinstance(b, str) else None) or none for a, b in zip(line, following, strict=True)], columns=["statements", "uses_next"])


def hours_of_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, reason, weekly, said): the week that each page states.

    weekly is array<struct<weekday, start, end>> in order, null unless reason is
    "". Reasons: none (no statement), closed_and_open, two_sets (ranges of one
    day overlap: several places), few_days (under three), no_weekend. A page that
    is null or empty states nothing; `key` is distinct.
    """
    lines = page_lines(pages, key, html)
    page = Window.partitionBy("page_id").orderBy("pos")
    lines = lines.withColumn("following", F.lead("line").over(page))
    spoken = lines.where(F.col("line").rlike(_SPEAKS)).select("page_id", "pos", F.pandas_udf(_read, READ)("line", "following").alias("read")).where("read.statements is not null")
    rows = lines.join(spoken, ["page_id", "pos"], "left")
    rows = rows.withColumn("inside", F.col("read").isNotNull() | F.coalesce(F.lag("read.uses_next").over(page), F.lit(False)))
    off = lambda c: F.col(c).rlike(NOT_OPENING) | F.col(c).rlike(SEASONAL)
    rows = rows.withColumn("off", off("line"))
    beside = lambda f: ~F.coalesce(f("inside").over(page), F.lit(False)) & F.coalesce(f("off").over(page), F.lit(False))
    first = ~F.coalesce(F.lag("inside").over(page), F.lit(False))
    rows = rows.withColumn("strange", F.col("off") | beside(F.lag) | beside(F.lead) | (first & off("under")))
    rows = rows.withColumn("block", F.count_if(~F.col("inside")).over(page)).where("inside")
    rows = rows.withColumn("strange", F.max("strange").over(Window.partitionBy("page_id", "block"))).where(~F.col("strange"))
    told = rows.where(F.col("read").isNotNull() & ~F.col("line").rlike(EXCEPTION)).select("page_id", "pos", F.posexplode("read.statements").alias("n", "s"))
    words = told.groupBy("page_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n", "s.said"))), lambda x: x["said"])), " | ").alias("said"))

    per_day = told.select("page_id", F.explode("s.days").alias("day"), "s.closed", "s.ranges").groupBy("page_id", "day").agg(F.max("closed").alias("closed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"))
    pairs = F.arrays_zip(F.slice("ranges", F.lit(1), F.greatest(F.size("ranges") - 1, F.lit(0))).alias("a"), F.slice("ranges", F.lit(2), F.size("ranges")).alias("b"))
    per_day = per_day.select("page_id", "day", (F.size("ranges") > 0).alias("open"), (F.col("closed") & (F.size("ranges") > 0)).alias("torn"), F.exists(pairs, lambda x: x["b"]["start"] < x["a"]["end"]).alias("laps"), F.transform("ranges", lambda r: F.struct(F.col("day").alias("weekday"), r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))
    week = per_day.groupBy("page_id").agg(
        F.max("open").alias("open"), F.max("torn").alias("torn"), F.max("laps").alias("laps"), F.count("*").alias("n"), F.max(F.col("day").isin(0, 6)).alias("weekend"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    reason = F.when(~F.coalesce("open", F.lit(False)), "none").when(F.col("torn"), "closed_and_open").when(F.col("laps"), "two_sets").when(F.col("n") < 3, "few_days").when(~F.col("weekend"), "no_weekend").otherwise("")
    out = pages.select(F.col(key).alias("page_id")).join(week, "page_id", "left").join(words, "page_id", "left").withColumn("reason", reason)
    fine: Column = F.col("reason") == ""
    return out.select("page_id", "reason", F.when(fine, F.col("spans")).alias("weekly"), F.when(fine, F.col("said")).alias("said"))
