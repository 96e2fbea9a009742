"""Joins by distance: grid cells make them equi-joins; the exact distance decides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import geo
from tidegate.functions.bind import let
from tidegate.session import spread


class Grid:
    """Cells that any two points within `metres` share or have side by side, at every latitude.

    Rows are as high as the radius. A row is cut into equal cells around the
    whole circle of latitude, each at least as wide as the radius looks from the
    pole side of the rows beside it; near the poles one cell is the whole row.
    """

    def __init__(self, metres: float):
        self.angle = metres / geo.EARTH_M * (1 + 1e-9)
        self.height = math.degrees(self.angle)

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.height).cast("long")

    def cells(self, row: Column) -> Column:
        """How many cells a row has."""
        far = F.least(F.lit(90.0), F.greatest(F.abs(row - 1), F.abs(row + 2)) * self.height)
        half = math.sin(self.angle / 2) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12))
        return F.when(half < 0.4, F.floor(F.lit(2 * math.pi / 2.1) / half)).otherwise(F.lit(1)).cast("long")

    def column(self, lon: Column, row: Column) -> Column:
        n = self.cells(row)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)

    def cell(self, lat: Column, lon: Column) -> Column:
        row = self.row(lat)
        return F.struct(row.alias("y"), self.column(lon, row).alias("x"))

    def around(self, lat: Column, lon: Column) -> Column:
        """The cells in which points within the radius can lie, without repeats; how many cells a row has is worked out once a row."""
        steps = F.array(*map(F.lit, (-1, 0, 1)))
        rows = F.transform(steps, lambda s: let(self.row(lat) + s, lambda r: F.struct(r.alias("y"), self.column(lon, r).alias("x"), self.cells(r).alias("n"))))
        return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(steps, lambda s: F.struct(r["y"].alias("y"), F.pmod(r["x"] + s, r["n"]).alias("x"))))))


#: Rows of one point go together, in this many parts by their hash, so that no group grows with the table as a whole.
PARTS = 16


def _by_point(rows: DataFrame, side: str, also: str | None = None) -> DataFrame:
    """One row for a point and part, and a value of `also`, with the rows themselves as an array."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    part = F.pmod(F.xxhash64(f"{side}_id"), F.lit(PARTS)).alias("_part")
    return rows.groupBy(f"{side}_lat", f"{side}_lon", part, *([f"{side}_{also}"] if also else [])).agg(F.collect_list(F.struct(*cols)).alias(f"_{side}")).drop("_part")


def radius_join(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs within `metres`; left has a_id, a_lat, a_lon and right b_id, b_lat, b_lon.

    The right side is read once; the left is repeated for the cells around it.
    Distances are those of points: rows that share one are measured together and
    laid out as pairs in the same task.
    """
    return _within(left, right, metres, None)


def sharing_join(left: DataFrame, right: DataFrame, metres: float, also: str) -> DataFrame:
    """The pairs of `radius_join` that share the value of this column, a_ and b_, alone."""
    return _within(left, right, metres, also)


def _within(left: DataFrame, right: DataFrame, metres: float, also: str | None) -> DataFrame:
    grid = Grid(metres)
    near = spread(_by_point(left, "a", also).withColumn("_c", F.explode(grid.around(F.col("a_lat"), F.col("a_lon")))))
    placed = _by_point(right, "b", also).withColumn("_c", grid.cell(F.col("b_lat"), F.col("b_lon")))
    shared = (near["_c"]["y"] == placed["_c"]["y"]) & (near["_c"]["x"] == placed["_c"]["x"])
    pairs = near.join(placed, shared & (near[f"a_{also}"] == placed[f"b_{also}"]) if also else shared).drop("_c")
    points = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    # most pairs go by latitude or by the cheaper measure; the exact one is worked out for the rest
    likely = (F.abs(points[0] - points[2]) <= grid.height * (1 + 1e-6)) & (geo.haversine(*points) <= math.sin(min(grid.angle, math.pi) / 2) ** 2 * (1 + 1e-6))
    far = pairs.where(likely).withColumn("metres", geo.distance_m(*points)).where(F.col("metres") <= metres)
    laid = far.select("metres", "_b", F.explode("_a").alias("_a")).select("metres", "_a", F.explode("_b").alias("_b"))
    return laid.select(*(F.col(f"_a.`{c}`") for c in left.columns), *(F.col(f"_b.`{c}`") for c in right.columns), "metres")


#: How many points or rows a group of `near_groups` holds at most, and in how many tasks the pairs of a cell are made.
AT_ONCE = 64
DEALT = 8


def near_groups(rows: DataFrame, metres: float, by: tuple[str, ...]) -> DataFrame:
    """Groups that may hold pairs within `metres` of rows with id, lat, lon: a_ and b_ values of `by`, and points with their rows as arrays _a and _b.

    A group shares a cell and the values of `by`, so what these tell of a pair is
    worked out once for all pairs of two groups; `laid` makes the pairs. Groups
    are cut at AT_ONCE points of AT_ONCE rows.
    """
    grid, at = Grid(metres), ["lat", "lon"]
    cut_at = lambda group, order: F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / AT_ONCE).alias("_part")
    own = [F.col(f"`{c}`") for c in rows.columns if c not in (*by, *at)]
    points = rows.select("*", cut_at([*at, *by], ["id"])).groupBy(*at, *by, "_part").agg(F.collect_list(F.struct(*own)).alias("rows"), F.min("id").alias("low"))

    def grouped(p: str, cells: Column) -> DataFrame:
        said = [F.col(c).alias(f"{p}_{c}") for c in by]
        placed = points.select(*said, F.struct(*at, *geo.on_sphere(F.col("lat"), F.col("lon")), "low", "rows").alias("_p"), F.explode(cells).alias("_c"))
        group = ["_c", *(f"{p}_{c}" for c in by)]
        placed = placed.select("*", cut_at(group, ["_p.lat", "_p.lon"]))
        return placed.groupBy(*group, "_part").agg(F.collect_list("_p").alias(f"_{p}"), F.min("_p.lat").alias(f"_{p}_low"), F.max("_p.lat").alias(f"_{p}_high"))

    near = spread(grouped("a", grid.around(F.col("lat"), F.col("lon")))).withColumn("_deal", F.pmod(F.xxhash64("_part", *(f"a_{c}" for c in by)), F.lit(DEALT))).drop("_part")
    placed = grouped("b", F.array(grid.cell(F.col("lat"), F.col("lon")))).drop("_part").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    high = grid.height * (1 + 1e-6)
    return near.join(spread(placed), ["_c", "_deal"]).where((F.col("_a_low") - F.col("_b_high") <= high) & (F.col("_b_low") - F.col("_a_high") <= high))


def laid(groups: DataFrame, metres: float, kept: dict[str, Column]) -> DataFrame:
    """Each pair of rows within `metres` of near groups once, as structs _a and _b in no order, with these values of the groups and of `metres`.

    Two points of rows meet in both orders; the one with the smaller id first is
    kept, before their rows are laid out. The values are worked out once for all
    rows of two points.
    """
    p, q = (lambda n: F.col(f"_p.{n}")), (lambda n: F.col(f"_q.{n}"))
    # the straight line through the globe costs little and rules most pairs of points out; the exact measure is taken of the rest
    line = reduce(Column.__add__, ((p(n) - q(n)) * (p(n) - q(n)) for n in ("x", "y", "z")))
    likely = (p("low") <= q("low")) & (line <= (2 * math.sin(min(Grid(metres).angle, math.pi) / 2) + 1e-14) ** 2 * (1 + 1e-6))
    told = [c for c in groups.columns if c.startswith("_n")]
    met = groups.select(*told, "_b", F.explode("_a").alias("_p")).select(*told, "_p", F.explode("_b").alias("_q")).where(likely)
    far = met.select(*told, "_p", "_q", F.explode(F.array(geo.distance_m(p("lat"), p("lon"), q("lat"), q("lon")))).alias("metres")).where(F.col("metres") <= metres)
    same = (p("low") == q("low")).alias("_same")
    once = far.select(F.explode(F.array(F.struct(*(v.alias(c) for c, v in kept.items()), same))).alias("_k"), p("rows").alias("rows"), q("rows").alias("others"))
    rows = once.select("_k", "others", F.explode("rows").alias("_a")).select("_k", "_a", F.explode("others").alias("_b"))
    return rows.where((F.col("_a.id") < F.col("_b.id")) | (~F.col("_k._same") & (F.col("_a.id") > F.col("_b.id")))).select("_a", "_b", *(F.col(f"_k.{c}").alias(c) for c in kept))


def nearest(left: DataFrame, right: DataFrame, k: int, metres: float) -> DataFrame:
    """The k nearest of `right` within `metres` of each left point, ties by id.

    Of rows of `right` that share a point only the first k can be among them, and
    rows of `left` that share one have the same.
    """
    first = F.row_number().over(Window.partitionBy("b_lat", "b_lon").orderBy("b_id"))
    few = right.withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
    points = left.select("a_lat", "a_lon").distinct().withColumn("a_id", F.lit(0))
    place = F.row_number().over(Window.partitionBy("a_lat", "a_lon").orderBy("metres", "b_id"))
    best = radius_join(points, few, metres).withColumn("place", place).where(F.col("place") <= k).drop("a_id")
    return left.join(best, ["a_lat", "a_lon"]).select(*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{c}`") for c in right.columns), "metres", "place")


def without_neighbour(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Left points with nothing of `right` within `metres`."""
    return left.join(radius_join(left, right, metres).select("a_id").distinct(), "a_id", "left_anti")
