"""Trips around a water that a straight line would cross, as column expressions.

The middle of the water is a line from west to east with one latitude for each
longitude; its western end is the bridge. A trip whose straight line goes from
one side to the other is measured to the bridge and on from there, so a trip is
never shorter than the straight line and a radius of reach still holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import geo
from tidegate.functions.bind import let

# The middle of the sound from west to east (longitude, latitude), the bridge, and the southern and
# the least dividing latitude of what counts as the far shore.
MIDDLE = [
    (-73.775, 40.85), (-73.7, 40.9), (-73.6, 40.94), (-73.5, 40.97), (-73.4, 41.01), (-73.3, 41.03), (-73.1, 41.07), (-72.8, 41.1), (-72.3, 41.22), (-71.8, 41.3),
]
BRIDGE = (-73.7929, 40.8005)
FAR_FROM, FAR_LEAST = 40.5, 40.905

Line = list[tuple[float, float]]


def latitude(line: Line, lon: Column) -> Column:
    """The line's latitude at a longitude between its ends; null beyond them."""
    out = F.when(lon < line[0][0], F.lit(None).cast("double"))
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        out = out.when(lon <= x1, F.lit(y0) + (lon - x0) / F.lit(x1 - x0) * F.lit(y1 - y0))
    return out


def crosses(lat1: Column, lon1: Column, lat2: Column, lon2: Column, middle: Line = MIDDLE, bridge: tuple[float, float] = BRIDGE) -> Column:
    """Whether the straight line between two points has a part on either side of the water's middle.

    Over the longitudes that both share, the gap between them is straight from
    vertex to vertex, so its least and greatest stand at the ends of that stretch
    or at a vertex within it. To touch is not to cross; null where a point is.
    """
    line = [bridge, *middle]
    first, last = line[0][0], line[-1][0]
    point = lambda lat, lon: F.struct(lon.alias("lon"), lat.alias("lat"))
    ends = F.struct(F.when(lon1 > lon2, point(lat2, lon2)).otherwise(point(lat1, lon1)).alias("w"), F.when(lon1 > lon2, point(lat1, lon1)).otherwise(point(lat2, lon2)).alias("e"))

    def sides(t: Column) -> Column:
        west, east = t["w"], t["e"]
        slope = lambda x: west["lat"] + (x - west["lon"]) / F.nullif(east["lon"] - west["lon"], F.lit(0.0)) * (east["lat"] - west["lat"])
        at = lambda x, lat: let(x, lambda v: F.coalesce(slope(v), lat) - latitude(line, v))
        bends = F.filter(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in line)), lambda v: (v["lon"] > west["lon"]) & (v["lon"] < east["lon"]))
        return F.concat(F.array(at(F.greatest(west["lon"], F.lit(first)), west["lat"]), at(F.least(east["lon"], F.lit(last)), east["lat"])), F.transform(bends, lambda v: slope(v["lon"]) - v["lat"]))

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    low, high = min(y for _, y in line), max(y for _, y in line)
    shared = (F.greatest(lon1, lon2) >= first) & (F.least(lon1, lon2) <= last) & (F.greatest(lat1, lat2) >= low) & (F.least(lat1, lat2) <= high)  # settles most trips
    gaps = let(let(ends, sides), lambda g: F.exists(g, lambda x: x < 0) & F.exists(g, lambda x: x > 0))
    return F.when(known, F.when(shared, gaps).otherwise(F.lit(False)))


def middle_at(lon: Column, middle: Line = MIDDLE, bridge: tuple[float, float] = BRIDGE) -> Column:
    """The latitude of the water's middle at a longitude, or at the end of it that is nearer."""
    line = [bridge, *middle]
    return latitude(line, F.least(F.greatest(lon, F.lit(line[0][0])), F.lit(line[-1][0])))


def crossed(pairs: DataFrame, name: str, a: tuple[str, str, str], b: tuple[str, str, str], middle: Line = MIDDLE, bridge: tuple[float, float] = BRIDGE) -> DataFrame:
    """The pairs with what `crosses` says of two known points, each the names of its latitude, longitude and `middle_at`.

    For very many pairs: plain columns alone, in steps short enough to be
    compiled, and what one end tells is worked out before the ends meet.
    """
    line = [bridge, *middle]
    (lat1, lon1, mid1), (lat2, lon2, mid2) = ([F.col(c) for c in end] for end in (a, b))
    c = lambda n: F.col(f"_{n}")
    back = lon1 > lon2
    ends = {"wx": F.least(lon1, lon2), "wy": F.when(back, lat2).otherwise(lat1), "ex": F.greatest(lon1, lon2), "ey": F.when(back, lat1).otherwise(lat2), "wm": F.when(back, mid2).otherwise(mid1), "em": F.when(back, mid1).otherwise(mid2)}
    rows = pairs.select("*", *(e.alias(f"_{n}") for n, e in ends.items()))
    shared = {"f": F.greatest(c("wx"), F.lit(line[0][0])), "t": F.least(c("ex"), F.lit(line[-1][0])), "dx": F.nullif(c("ex") - c("wx"), F.lit(0.0)), "dy": c("ey") - c("wy")}
    rows = rows.select("*", *(e.alias(f"_{n}") for n, e in shared.items()))
    slope = lambda x: c("wy") + (x - c("wx")) / c("dx") * c("dy")
    meet = c("f") <= c("t")
    gaps = [F.when(meet, F.coalesce(slope(c("f")), c("wy")) - c("wm")), F.when(meet, F.coalesce(slope(c("t")), c("ey")) - c("em"))]
    gaps += [F.when((c("f") < x) & (c("t") > x), slope(F.lit(x)) - y) for x, y in line]
    rows = rows.select(*pairs.columns, F.least(*gaps).alias("_low"), F.greatest(*gaps).alias("_high"))
    return rows.select(*pairs.columns, F.explode(F.array(F.coalesce((c("low") < 0) & (c("high") > 0), F.lit(False)))).alias(name))


def trip_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, middle: Line = MIDDLE, bridge: tuple[float, float] = BRIDGE) -> Column:
    """Straight metres of a trip, by the bridge where the straight line crosses the water."""
    by = F.lit(bridge[1]), F.lit(bridge[0])
    round_trip = geo.distance_m(lat1, lon1, *by) + geo.distance_m(*by, lat2, lon2)
    return F.when(crosses(lat1, lon1, lat2, lon2, middle, bridge), round_trip).otherwise(geo.distance_m(lat1, lon1, lat2, lon2))


def far_shore(lat: Column, lon: Column, middle: Line = MIDDLE) -> Column:
    """Whether a place counts as across the water: south of its middle or of the least dividing latitude.

    That takes in some of the near shore as well, so it decides what is added as
    a destination, not how far a trip is.
    """
    return F.coalesce(lon.between(middle[0][0], middle[-1][0]) & (lat >= FAR_FROM) & (lat <= F.greatest(F.lit(FAR_LEAST), latitude(middle, lon))), F.lit(False))
