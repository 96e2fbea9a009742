"""The order in which eligible options are shown, for variety, page by page.

Each choice depends on those already made, so it is no window function: one
request's rows are ordered together. Only those that can have a say are: rows
that nothing rules out and that rule nothing out stand by merit but for the few
that can come to the front, and of rows alike at one point the best is enough. A
pass goes once over the rows it may show; showing one clears the rows that it
rules out, which are looked up by place and name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.geo import EARTH_M
from tidegate.session import cut, spread

# Variety.
LAST_SHOWN = 3
SAME_CATEGORY, SAME_KIND = 0.03, 0.05
SAME_PLACE_M, SAME_GROUNDS_M = 150.0, 1000.0
GROUNDS = ["park", "garden", "waterfront", "attraction"]
LOVED_FROM = 0.85
PAGE = 3
MOST = 303

NEEDS = ["request_id", "option_id", "venue_id", "parent_id", "name_key", "category", "activity", "kind", "lat", "lon", "standing", "merit", "taste", "lead", "off", "age_doubt", "rank"]


def _codes(values: pd.Series) -> np.ndarray:
    """Equal values as equal numbers from 0, missing ones as -1."""
    return pd.factorize(values)[0]


class _Namesakes:
    """Looks up, for a row, the rows of its name so near that they would look like one place."""

    def __init__(self, rows: pd.DataFrame):
        self.lat, self.lon = np.radians(rows["lat"].to_numpy(float)), np.radians(rows["lon"].to_numpy(float))
        self.reach = np.where(rows["category"].isin(GROUNDS), SAME_GROUNDS_M, SAME_PLACE_M)
        self.code = _codes(rows["name_key"].replace("", None))
        self.named = _together(self.code, len(rows))

    def of(self, i: int) -> np.ndarray:
        at = self.named[self.code[i]] if self.code[i] >= 0 else np.zeros(0, dtype=int)
        if len(at) < 2:
            return at[:0]
        h = np.sin((self.lat[at] - self.lat[i]) / 2) ** 2 + np.cos(self.lat[at]) * np.cos(self.lat[i]) * np.sin((self.lon[at] - self.lon[i]) / 2) ** 2
        return at[2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))) <= np.maximum(self.reach[at], self.reach[i])]


def _together(codes: np.ndarray, n: int) -> dict[int, np.ndarray]:
    """The rows, of n, that have each code; codes may hold several columns one after the other."""
    order = np.argsort(codes, kind="stable")
    found, at = np.unique(codes[order], return_index=True)
    return {int(c): rows % n for c, rows in zip(found, np.split(order, at[1:]), strict=True)}


def arrange(rows: pd.DataFrame, narrowed: bool = False) -> np.ndarray:
    """The places, in display order, of rows that stand in merit order.

    For each standing, ready before check first: unlike activities that suit the
    taste, one each (not for a narrowed search); then the best merit less a cost
    for what the last shown repeat, and beyond MOST by merit alone. Rows of a
    doubtful age limit, and places inside a shown or eligible one, come last.
    """
    return _arranged(rows, narrowed, MOST)[0]


def _arranged(rows: pd.DataFrame, narrowed: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of `arrange`, and of each the step that showed it: 0 and 2 choose among ready and check first, 1 and 3 take the rest, 4 what comes last.

    Rows that are a part of a request's have `inside` and `suits` of the whole.
    """
    n = len(rows)
    venue, parent = np.split(_codes(pd.concat([rows["venue_id"], rows["parent_id"]], ignore_index=True)), 2)
    activity, category, kind = (_codes(rows[c]) for c in ("activity", "category", "kind"))
    doubt, taste, merit = rows["age_doubt"].to_numpy(bool), rows["taste"].to_numpy(float), rows["merit"].to_numpy(float)
    standing = rows["standing"].to_numpy()
    likes = taste > 0.5
    if "suits" in rows:
        suits, inside = rows["suits"].to_numpy(bool), rows["inside"].to_numpy(bool)
    else:
        suits = ~rows["off"].to_numpy(bool) & (taste >= 0.5)
        for s in set(standing[likes]):
            suits &= (standing != s) | likes
        inside = (parent >= 0) & np.isin(parent, venue)
    near = _Namesakes(rows)
    party = _together(np.concatenate([venue, parent]), n)
    free, order, steps = np.ones(n, dtype=bool), [], []
    done: set[int] = set()  # activities that are shown

    def show(i: int, step: int) -> None:
        order.append(i)
        steps.append(step)
        for whole in {venue[i], parent[i]} - {-1}:
            free[party[whole]] = False
        alike = near.of(i)
        free[alike if doubt[i] else alike[~doubt[alike]]] = False
        free[i] = False
        done.add(activity[i])

    def show_all(among: np.ndarray, step: int, diverse: bool = False) -> None:
        for i in np.flatnonzero(among):
            if free[i] and not (diverse and activity[i] in done):
                show(i, step)

    for step, s in ((0, "ready"), (2, "check_first")):
        among = (standing == s) & ~doubt & ~inside
        if not narrowed:
            show_all(among & suits, step, diverse=True)
        while len(order) < most and (among & free).any():
            cost = np.zeros(n)
            for last in order[-LAST_SHOWN:]:
                cost += SAME_CATEGORY * (category == category[last]) + SAME_KIND * ((kind >= 0) & (kind == kind[last]))
            show(int(np.where(among & free, merit - cost, -np.inf).argmax()), step)
        show_all(among, step + 1)
    show_all(np.ones(n, dtype=bool), 4)
    return np.array(order, dtype=int), np.array(steps, dtype=int)


def first_page_loves(shown: pd.DataFrame) -> pd.DataFrame:
    """The shown rows with one of each loved interest moved onto the first page, never to its first place.

    What they displace follows the page; all others keep their order.
    """
    place = np.arange(len(shown), dtype=float)
    loved = shown["taste"].to_numpy(float) >= LOVED_FROM
    page = place < PAGE
    have = shown["lead"][loved & page]
    wanted = shown.assign(_at=place)[loved & ~page & ~shown["off"].to_numpy(bool) & ~shown["age_doubt"].to_numpy(bool) & ~shown["lead"].isin(have).to_numpy()]
    slots = place[page & ~loved & (place > 0)]
    chosen = wanted.drop_duplicates("lead")["_at"].to_numpy(int)[: len(slots)]
    slots = slots[len(slots) - len(chosen) :].astype(int)
    place[chosen] = slots
    place[slots] += PAGE - slots - 1 + (np.arange(len(slots)) + 1) / (PAGE + 1)  # between the page and what follows it
    return shown.iloc[np.argsort(place, kind="stable")]


def _told(eligible: DataFrame) -> DataFrame:
    """The rows with what the whole request tells of each: suits, inside, last (comes last), tied (another row shares its place) and by_early (one that does not come last)."""
    c = F.col
    likes = F.coalesce(c("taste") > 0.5, F.lit(False))
    liked = eligible.groupBy("request_id", "standing").agg(F.max(likes).alias("_liked"))
    rows = eligible.join(liked, ["request_id", "standing"])
    rows = rows.withColumn("suits", ~c("off") & F.coalesce(c("taste") >= 0.5, F.lit(False)) & (likes | ~c("_liked"))).drop("_liked")
    # rows without a parent, most of all, are not moved to look for one
    venues = eligible.select("request_id", c("venue_id").alias("parent_id"), F.lit(True).alias("inside")).distinct()
    within = rows.where("parent_id is not null").join(venues, ["request_id", "parent_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    rows = rows.where("parent_id is null").withColumn("inside", F.lit(False)).unionByName(within).withColumn("last", c("age_doubt") | c("inside") | ~c("standing").isin("ready", "check_first"))
    # a place is shared by rows of which it is the venue or the parent
    places = rows.select("request_id", "last", F.explode(F.array_distinct(F.array_compact(F.array("venue_id", "parent_id")))).alias("_place"))
    shared = places.groupBy("request_id", "_place").agg(F.count("*").alias("_n"), F.count_if(~c("last")).alias("_early")).where("_n > 1")
    held = rows.join(shared.withColumnRenamed("_place", "venue_id"), ["request_id", "venue_id"], "left")
    tied = c("_n").isNotNull()
    # a row with a parent counts as tied whatever else there is
    return held.withColumn("tied", tied | c("parent_id").isNotNull()).withColumn("by_early", c("parent_id").isNotNull() | F.coalesce(c("_early") > F.when(c("last"), 0).otherwise(1), F.lit(False))).drop("_n", "_early")


def _deciding(told: DataFrame) -> DataFrame:
    """The rows that may be shown, with `apart`: nothing rules such a row out and it rules nothing out.

    Of rows that are alike in name, point and all that the order goes by but
    merit, those behind a row that only a namesake can rule out are never shown:
    either that row is, or what keeps it out keeps them out.
    """
    c = F.col
    unnamed = F.when(F.coalesce(c("name_key"), F.lit("")) == "", c("option_id"))
    by_name = ["request_id", "name_key", "_unnamed"]
    rows = spread(told.withColumn("_unnamed", unnamed), *by_name)
    alike = Window.partitionBy(*by_name, "lat", "lon", "standing", "category", "kind", "activity", "suits", "last", "age_doubt", "inside")
    sure = ~c("last") & ~c("by_early") & c("lat").isNotNull() & c("lon").isNotNull()
    left = rows.withColumn("_first", F.min(F.when(sure, c("rank"))).over(alike)).where("_first is null or rank <= _first")
    names = F.count("*").over(Window.partitionBy(*by_name))
    return left.withColumn("apart", ~c("tied") & (names == 1)).drop("_first", "_unnamed", "tied", "by_early")


def _at_front(rows: DataFrame, by: list[str | Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("request_id", *by).orderBy("rank"))).where(F.col("_n") <= n).drop("_n")


def display_order(eligible: DataFrame) -> DataFrame:
    """(request_id, option_id, shown): `eligible` has the columns NEEDS, rank being the merit order.

    Rows apart go to the task of their request only where they can be among the
    MOST that are chosen one by one or are the first loved ones of an interest.
    """
    most = MOST

    def of(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("rank", ignore_index=True)
        order, steps = _arranged(rows, False, most)
        at = rows.iloc[order].assign(_step=steps, _at=np.where(steps % 2 == 0, np.arange(len(order)), rows["rank"].to_numpy()[order]))
        at.loc[at["_step"] == 4, "_at"] = at["rank"]
        out = first_page_loves(at)
        front = (out["option_id"].to_numpy() != at["option_id"].to_numpy()).any() * 2 * PAGE
        first = np.arange(len(out)) < front
        return pd.DataFrame({"request_id": out["request_id"].to_numpy(), "option_id": out["option_id"].to_numpy(), "step": np.where(first, -1, out["_step"]), "at": np.where(first, np.arange(len(out)), out["_at"])})

    rows = cut(_deciding(_told(cut(eligible.select(*NEEDS), "eligible"))), "deciding")
    apart = rows.where("apart")
    loved = apart.where((F.col("taste") >= LOVED_FROM) & ~F.col("off") & ~F.col("age_doubt"))
    front = _at_front(apart, ["standing", "last", "suits", "activity", "category", "kind"], most).unionByName(_at_front(loved, ["standing", "last", "lead"], 1)).dropDuplicates(["request_id", "option_id"])
    front = cut(front, "front")
    chosen = rows.where("not apart").unionByName(front).groupBy("request_id").applyInPandas(of, "request_id long, option_id long, step int, at long")
    rest = apart.join(front.select("request_id", "option_id"), ["request_id", "option_id"], "left_anti")
    step = F.when(F.col("last"), 4).when(F.col("standing") == "ready", 1).otherwise(3)
    every = chosen.unionByName(rest.select("request_id", "option_id", step.alias("step"), F.col("rank").cast("long").alias("at")))
    return every.select("request_id", "option_id", F.row_number().over(Window.partitionBy("request_id").orderBy("step", "at")).alias("shown"))
